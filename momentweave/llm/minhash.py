"""Operator 11: near-duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, cut, mix, pieces, prefix_hash, span_hash, table
from .simhash import components

SHINGLE, PERCENT = 2, 80
BANDS, BAND_ROWS = 38, 5  # texts of similarity 0.8 share no band once in 3.6 million pairs
COORDINATES, LONGS = 192, 3  # one bit of each coordinate goes into the sketch; the first BANDS * BAND_ROWS make the bands
BITS = 40  # similarity 0.8 differs in 19.2 of 192 bits on average, with a deviation of 4.2: 5 deviations of room
SHARD, SHARD_BYTES = 1_024, 8 << 20  # rows, and bytes of text, of one side of a comparison
_SEED, _FOLD = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)
_PI = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BLOCK, _SLICE = 1 << 20, 1 << 15
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_GAP = re.compile(rb"[ \t-\r]")


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and its document's place in docs; texts are read in blocks cut at white space."""
    blob = b"\n".join(docs).lower() + b"\n"
    first = np.cumsum([0] + [len(d) + 1 for d in docs[:-1]])
    hashes, owners, at = [], [], 0
    while at < len(blob):
        gap = _GAP.search(blob, at + _BLOCK)
        to = gap.end() if gap else len(blob)
        data = np.frombuffer(blob, np.uint8, to - at, at)
        edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes.append(span_hash(prefix_hash(data), start, end))
        owners.append(np.searchsorted(first, start + at, "right") - 1)
        at = to
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(docs: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners): the distinct `size`-word shingles of each text, ordered by text and hash. A text of fewer words
    has its whole sequence as one, a text without words has none."""
    word, doc = word_hashes(docs)
    n = np.bincount(doc, minlength=len(docs))
    begin = np.cumsum(n) - n
    width = np.minimum(n, size)[doc]
    at = np.flatnonzero(np.arange(len(word)) + width <= (begin + n)[doc])
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        more = k < width[at]
        h = np.where(more, h * _FOLD + word[np.minimum(at + k, len(word) - 1)] + np.uint64(1), h)
    h, doc = mix(h), doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], doc[new]


def signatures(h: np.ndarray, first: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """coordinates x sets: minima of each set of hashes under pi(sigma(x) - k mod 2^64).

    Two permutations of the 64-bit numbers do for all coordinates: sigma scatters the elements once, and pi is shifted
    circularly by k. first: where each set, none of them empty, begins in h.
    """
    sigma = mix(h ^ _SEED)
    least = np.full((coordinates, len(first)), 2**64 - 1, np.uint64)
    for a in range(0, len(h), _SLICE):
        part = sigma[a : a + _SLICE]
        x, y = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, a + len(part))
        cuts = np.maximum(first[x:y] - a, 0)
        v, t = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.subtract(part, np.uint64(k + 1), out=v)
            v ^= np.right_shift(v, np.uint64(33), out=t)
            v *= _PI[0]
            v ^= np.right_shift(v, np.uint64(29), out=t)
            v *= _PI[1]
            np.minimum(least[k, x:y], np.minimum.reduceat(v, cuts), out=least[k, x:y])
    return least


def sketch(docs: list[bytes], size: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One row a text: a hash of its set, the set's size, LONGS words of bits, a key of each band. Zeros without words."""
    out = np.zeros((len(docs), 2 + LONGS + bands), np.uint64)
    h, doc = shingle_sets(docs, size)
    if not len(h):
        return out
    some, first, n = np.unique(doc, return_index=True, return_counts=True)
    least = mix(signatures(h, first))
    out[some, 0] = np.add.reduceat(mix(h), first)
    out[some, 1] = n
    out[some, 2 : 2 + LONGS] = np.ascontiguousarray(np.packbits((least & np.uint64(1)).astype(np.uint8).T, axis=1)).view(np.uint64)
    places = np.arange(1, bands * rows + 1, dtype=np.uint64)
    keys = mix(least[: bands * rows] + mix(places)[:, None]).reshape(bands, rows, -1).sum(1, dtype=np.uint64)
    out[some, 2 + LONGS :] = mix(keys).T
    return out


def sketches(size: int, bands: int, rows: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            found = np.concatenate([sketch(some, size, bands, rows) for some in pieces(texts)] or [np.zeros((0, 2 + LONGS + bands), np.uint64)])
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            yield pa.ListArray.from_arrays(offsets, pa.array(found.ravel().view(np.int64)))

    return of


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with one value of `group`; a run may span batches."""
    held = []
    for batch in batches:
        group = batch.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else []
        for a, b in zip(edges, edges[1:]):
            if held and group[a] != held[-1].column("group")[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _near(group: pa.Table, limit: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's rows that sketches and sizes don't rule out, of different components, whose first common band
    is the group's: so a pair is looked at in one bucket alone. Rows of side 1 meet those of side 0; if there is no side
    1, all meet."""
    side, n, component, band = (group[c].to_numpy() for c in ("side", "n", "component", "band"))
    bits, bands = (group[c].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(side), -1) for c in ("bits", "bands"))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in range(0, len(right), 128):  # memory by blocks, not by pairs
        some = right[r : r + 128]
        far = sum(np.bitwise_count(bits[some, k][:, None] ^ bits[left, k]).astype(np.int16) for k in range(bits.shape[1]))
        few, many = np.minimum(n[some][:, None], n[left]), np.maximum(n[some][:, None], n[left])
        near = (far <= limit) & (100 * few >= percent * many) & (component[some][:, None] != component[left])
        if not side.any():
            near &= some[:, None] > left
        x, y = np.nonzero(near)
        x, y = some[x], left[y]
        for k in range(int(band[0])):
            other = bands[x, k] != bands[y, k]
            x, y = x[other], y[other]
        xs.append(x)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _asking(limit: int, percent: int):
    """Rows of groups, to (group, side, node) of those that have a partner in _near."""
    schema = pa.schema([("group", pa.int64()), ("side", pa.int64()), ("node", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rows = np.unique(np.concatenate(_near(group, limit, percent)))
            if len(rows):
                yield from group.select(["group", "side", "node"]).take(pa.array(rows)).cast(schema).combine_chunks().to_batches()

    return of


def _compared(size: int, limit: int, percent: int):
    """Rows of groups with text, to links (a, b) whose full sets are similar: enough to connect all that are."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            pairs = list(zip(*(x.tolist() for x in _near(group, limit, percent)), strict=True))
            if not pairs:
                continue
            node, component = group["node"].to_pylist(), group["component"].to_pylist()
            sets: list[np.ndarray] = []
            for some in pieces(group["text"].combine_chunks()):
                h, doc = shingle_sets(some, size)
                sets += np.split(h, np.searchsorted(doc, np.arange(1, len(some))))
            root = {c: c for c in component}

            def top(c: int) -> int:
                while root[c] != c:  # noqa: B023
                    root[c] = root[root[c]]  # noqa: B023
                    c = root[c]  # noqa: B023
                return c

            links = []
            for x, y in pairs:
                p, q = top(component[x]), top(component[y])
                if p == q:
                    continue
                few, many = sorted((sets[x], sets[y]), key=len)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                shared = int((many[at] == few).sum())
                if 100 * shared >= percent * (len(few) + len(many) - shared):
                    root[max(p, q)] = min(p, q)
                    links.append((max(node[x], node[y]), min(node[x], node[y])))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema)

    return of


def near_duplicates(
    docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS, bits: int = BITS, shard: int = SHARD
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text): sets of distinct shingles of which
    the common part is at least `percent` of the union are linked, and component_id is the smallest doc_id reachable.

    Rows with equal sets are one node, so copies cost nothing. Nodes meet in buckets, one for each band of signature
    coordinates. First each node is held against the smallest of the heads (least nodes) of its buckets; then, in
    buckets that this leaves in several components, the nodes of different ones are held against one another, in shards
    bounded in rows and bytes: a first look at sketches and sizes finds the rows that need their text, a second compares
    full sets and gives the links that connect. Nothing in a task grows with the size of a bucket. bands, rows and bits
    are for a percent of 80: lower ones need more bands and bits.

    Null texts and texts without words have no shingles, link with nothing and are kept. Rows that share a doc_id are
    one document, which links what each of them links. Rows without a doc_id link nothing: their component_id is null
    and they are kept. Other columns are ignored. No rows give no rows. A task holds a text, its words' hashes and 1 MB
    blocks of work on it, so its memory grows with the longest text by about four times its bytes.
    """
    if bands * rows > COORDINATES:
        raise ValueError(f"bands * rows must be at most {COORDINATES}")
    bounded_batches(docs.sparkSession)
    s, after = F.col("sketch"), 2 + LONGS
    told = docs.select("doc_id", F.xxhash64("text").alias("told"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), sketches(size, bands, rows)("text").alias("sketch"))
    prints = cut(
        told.select("doc_id", "told", "bytes", s[0].alias("same"), s[1].alias("n"), F.slice(s, 3, LONGS).alias("bits"), F.slice(s, after + 1, bands).alias("bands")), "sketches"
    )
    least = F.min(F.struct(F.col("doc_id").alias("node"), "n", "told", "bytes", "bits", "bands"))
    nodes = cut(prints.where("doc_id IS NOT NULL AND n > 0").groupBy("same").agg(least.alias("least")).select("same", "least.*"), "nodes")
    keyed = nodes.select("node", "n", "bytes", "bits", F.posexplode("bands").alias("band", "bucket"))
    heads = keyed.groupBy("bucket").agg(F.count("*").alias("k"), F.min(F.struct("node", "n", "bits")).alias("head")).where("k > 1").select("bucket", "head")
    met = cut(keyed.join(heads, "bucket"), "met")

    far = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("head.bits")[k])) for k in range(LONGS)), F.lit(0))
    even = 100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n")
    stars = cut(met.where((F.col("node") > F.col("head.node")) & (far <= bits) & even).groupBy("node").agg(F.min("head.node").alias("head"), F.min("bytes").alias("bytes")), "stars")
    sizes = stars.groupBy("head").agg(F.ceil(F.greatest(F.count("*") / shard, F.sum("bytes") / SHARD_BYTES)).cast("int").alias("shards"))
    spread = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    of_head = sizes.select("head", F.col("head").alias("node"), spread.alias("shard"), F.lit(0).cast("long").alias("side"))
    of_node = stars.join(sizes, "head").select("head", "node", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), F.lit(1).cast("long").alias("side"))
    star = of_head.union(of_node).select(F.xxhash64("head", "shard").alias("group"), "side", "node", F.col("node").alias("component"), F.lit(0).cast("long").alias("band"))
    texts = _texts(docs, nodes, stars.select(F.explode(F.array("node", "head")).alias("node")).distinct())
    links = cut(_sorted(star.join(texts, "node")).mapInArrow(_compared(size, bits, percent), "a long, b long"), "star_links")

    rest = met.drop("head", "bits").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = rest.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("bytes").alias("b"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    rest = rest.join(open_.select("bucket", F.ceil(F.greatest(F.col("k") / shard, F.col("b") / SHARD_BYTES)).cast("int").alias("shards")), "bucket")
    dealt = rest.withColumn("own", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).withColumn("other", spread)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == low, 0).otherwise(1).cast("long").alias("side")
    groups = cut(dealt.select(F.xxhash64("bucket", low, high).alias("group"), side, "node", "component", F.col("band").cast("long")), "groups")
    looks = _sorted(groups.join(nodes.select("node", "n", "bits", "bands"), "node"))
    asking = cut(looks.mapInArrow(_asking(bits, percent), "group long, side long, node long"), "asking")
    texts = _texts(docs, nodes, asking.select("node").distinct())
    found = _sorted(groups.join(asking, ["group", "side", "node"]).join(texts, "node")).mapInArrow(_compared(size, bits, percent), "a long, b long")
    links = cut(links.union(found), "all_links")

    several = prints.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 AND doc_id IS NOT NULL").select("doc_id")
    of_row = prints.select("doc_id", "same", "n").join(nodes.select("same", "node"), "same", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    own = of_row.join(several, "doc_id", "left_semi").where("doc_id != node")
    links = links.union(own.select(F.greatest("doc_id", "node").alias("a"), F.least("doc_id", "node").alias("b")))
    found = components(links).withColumnRenamed("node", "doc_id")
    # A document's links are those of its node, but a doc_id with several texts is a node of the graph itself.
    of_doc = of_row.withColumn("at", F.coalesce("node", "doc_id")).join(found.toDF("at", "component"), "at", "left")
    component = F.coalesce("component", "at")
    return of_doc.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sorted(groups: DataFrame) -> DataFrame:
    return groups.repartition("group").sortWithinPartitions("group", "side", "node")


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """What a comparison needs of each asked node: its size, bits, bands and the text that it stands for, once."""
    wanted = nodes.join(asked, "node", "left_semi").select("node", "told", "n", "bits", "bands")
    rows = docs.select(F.col("doc_id").alias("node"), "text", F.xxhash64("text").alias("told")).join(wanted, ["node", "told"])
    return cut(rows.dropDuplicates(["node"]).drop("told"), "texts")


def op11_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM ws),
nodes AS MATERIALIZED (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
terms AS MATERIALIZED (SELECT node, n, unnest(s) AS t FROM nodes),
ranked AS (SELECT node, n, t, row_number() OVER (PARTITION BY node ORDER BY f, t) AS r FROM terms JOIN (SELECT t, count(*) AS f FROM terms GROUP BY 1) USING (t)),
rare AS MATERIALIZED (SELECT node, n, t FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
met AS (SELECT DISTINCT a.node AS x, b.node AS y FROM rare a JOIN rare b ON a.t = b.t AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (SELECT x, y, a.n AS p, b.n AS q, len(list_intersect(a.s, b.s)) AS k FROM met JOIN nodes a ON a.node = x JOIN nodes b ON b.node = y),
links AS MATERIALIZED (SELECT x, y FROM shared WHERE 100 * k >= 80 * (p + q - k)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
top AS (SELECT x AS node, min(y) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN nodes USING (s) LEFT JOIN top USING (node)
"""
