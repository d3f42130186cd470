"""Operator 8: near-duplicates by SimHash fingerprints, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, cut, mix, prefix_hash, span_hash, table

SHINGLE, RADIUS, SEED = 3, 3, 42
STAGE_SHINGLE, SIMILARITY, STAGE_RADIUS = 5, 0.8, 36  # of the pipeline's stage; radius of its first 128 bits
WORDS, COMPARED = 8, 2  # 64-bit words of the stage's fingerprints, and those of them that its trees compare
WHOLE_RADIUS = 144  # of all 512 bits: the same share as STAGE_RADIUS, but eight deviations from texts of that similarity
MISSED = 1 / 2_800  # pairs of that similarity that agree in no table's bits
BUCKET = 128  # rows of a table's bucket, about, if fingerprints are evenly spread
FINE, FINER = 12, 12  # tables of so many more bits, in which rows meet the least of their bucket alone
STAGE_SHARD = 1_024  # rows of a shard of the stage; larger buckets are compared shard by shard
FOREST = 4_096  # rows whose trees are built and searched together, about
SHARD = 512  # fingerprints of one shard tree; larger buckets are compared shard by shard
SPLITS = 3  # times that a large bucket is split again by further bits: with four blocks to 16, then 28, 37 and 43 agreeing bits of 64
SHARD_BYTES = 8 << 20  # of the texts that a shard of the stage holds, and of the rows of a forest, about


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the three-word shingles of a text (repeats counted): a bit is 1 if set in over half of them."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[k : k + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(h)).tolist())


@F.arrow_udf(T.LongType())
def simhash(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fingerprint's 64 bits as a signed long; null as the empty text."""
    for texts in arrays:
        yield pa.array(np.array([fingerprint(b) for b in as_bytes(texts)], np.uint64).view(np.int64))


class BKTree:
    """Fingerprints in flat lists; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, fp: int) -> None:
        node, new = 0, len(self.prints)
        self.prints.append(fp)
        self.children.append({})
        while node != new:
            d = (fp ^ self.prints[node]).bit_count()
            node = self.children[node].setdefault(d, new)

    def near(self, fp: int, radius: int) -> list[int]:
        """Nodes within radius: only edges whose distance differs by at most radius can lead to one."""
        found, todo = [], [0] if self.prints else []
        while todo:
            node = todo.pop()
            d = (fp ^ self.prints[node]).bit_count()
            if d <= radius:
                found.append(node)
            todo += [child for key, child in self.children[node].items() if d - radius <= key <= d + radius]
        return found


def link_group(rows: Iterable[tuple[int, int, int]], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of one group as (node, root) pairs, one for each node that has a partner.

    rows: (side, fingerprint, node). Rows of side 0 make the shard's tree; rows of side 1 query it. If there is no
    side 1, the tree's rows are also linked among themselves as they enter.
    """
    tree, nodes, root = BKTree(), [], {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = list(rows)
    alone = all(side == 0 for side, _, _ in rows)
    for side, fp, node in sorted(rows, key=lambda r: r[0]):
        if alone or side:
            for other in tree.near(fp, radius):
                a, b = top(node), top(nodes[other])
                root[max(a, b)] = min(a, b)
        if side == 0:
            tree.add(fp)
            nodes.append(node)
    return [(x, top(x)) for x in list(root) if top(x) != x]


def _link_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by group; a group may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key, rows = None, []
    for batch in batches:
        out = []
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for group, side, fp, node in zip(*columns, strict=True):
            if group != key:
                out += link_group(rows) if len(rows) > 1 else []
                key, rows = group, []
            rows.append((side, fp & 0xFFFFFFFFFFFFFFFF, node))
        yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema)
    out = link_group(rows) if len(rows) > 1 else []
    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema)


def _blocks(n: int) -> int:
    """Blocks to cut fingerprints into: more of them (longer keys) as there are more fingerprints."""
    return 4 if n < 1 << 22 else 5 if n < 1 << 30 else 6


def _split(mask: int, radius: int) -> list[int]:
    """mask with each one of radius + 1 blocks of the bits that it lacks: fingerprints within radius that agree on
    mask agree on one of these too."""
    free = [k for k in range(64) if not mask >> k & 1]
    edges = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(edges, edges[1:]) if a < b]


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63)


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    """rows (fingerprint, node) under each of masks, with the hash of the bits that the mask shows, and its bucket's size."""
    each = rows.select("fingerprint", "node", F.explode(masks).alias("mask"))
    each = each.withColumn("bucket", F.xxhash64("mask", F.col("fingerprint").bitwiseAND(F.col("mask"))))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return each.join(sizes, "bucket")


def meetings(nodes: DataFrame, *, radius: int = RADIUS, shard: int = SHARD, splits: int = SPLITS) -> DataFrame:
    """(group, side, fingerprint, node): groups in which all nodes meet whose fingerprints differ in at most radius bits.

    Fingerprints within radius agree in all but radius of their blocks, so rows meet under every choice of the
    remaining blocks. A bucket of more than (radius + 1) * shard rows is split again by radius + 1 blocks of its other
    bits, one of which two rows within radius share, `splits` times at most: its rows grow by radius + 1 each time, not
    with its size. What is still larger than a shard is dealt into shards; each pair of shards is one group, so no group
    holds more than about two shards whatever the bucket's size.
    """
    blocks = max(_blocks(nodes.count()), radius + 1)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    keyed = cut(_keyed(nodes, F.array(*[F.lit(_signed(m)) for m in masks])), "buckets")
    hot = F.col("n") > (radius + 1) * shard
    settled = keyed.where(~hot)
    for _ in range(splits):
        rest = keyed.where(hot)
        if rest.isEmpty():
            break
        finer = {m: _split(m, radius) for m in masks}
        of = F.create_map(*[c for m, more in finer.items() for c in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in more]))])
        keyed = cut(_keyed(rest, of[F.col("mask")]), "buckets")
        masks = sorted({x for more in finer.values() for x in more})
        settled = settled.union(keyed.where(~hot))
    keyed = settled.union(keyed.where(hot))
    shards = F.ceil(F.col("n") / shard).cast("int")
    own = F.pmod(F.xxhash64("fingerprint", F.lit(1)), shards).cast("int")
    pairs = keyed.withColumn("shards", shards).withColumn("own", own)
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return pairs.select(
        F.xxhash64("bucket", low, high).alias("group"), F.when(F.col("own") == low, 0).otherwise(1).alias("side"), "fingerprint", "node"
    )


def link(nodes: DataFrame, *, radius: int = RADIUS, shard: int = SHARD, splits: int = SPLITS) -> DataFrame:
    """Links (a, b), b < a, between nodes (fingerprint, node) whose distinct fingerprints differ in at most radius bits:
    spanning links of each group of meetings, not all pairs."""
    groups = meetings(nodes, radius=radius, shard=shard, splits=splits)
    dealt = groups.repartition("group").sortWithinPartitions("group", "side", "node")
    return dealt.mapInArrow(_link_partitions, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node: component is the smallest node it is connected to.

    Alternates large-star and small-star steps until no link changes; each step is two keyed aggregations with a
    join back, and ends in a table in the shared folder.
    """
    links = cut(links, "links")
    before = None
    while True:
        # Large star: hand a node's larger neighbours to the smallest node it knows.
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        links = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b").distinct()
        # Small star: hand a node and its smaller neighbours to the smallest of them.
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        small = links.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = cut(small.union(least.select("a", F.col("least").alias("b"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links of at most three differing bits, the row's own included.
    Null and word-free texts have fingerprint zero. Rows that share a doc_id count as one document, so each links
    what the others link. Rows without a doc_id have the component of their fingerprint (null if nobody else has
    it). No rows give no rows. Distinct fingerprints alone are compared, so copies cost nothing and lose no link.
    """
    bounded_batches(docs.sparkSession)
    prints = cut(docs.select("doc_id", simhash("text").alias("fingerprint")), "fingerprints")
    nodes = prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    shared = prints.where("doc_id IS NOT NULL").join(nodes, "fingerprint").where("doc_id != node")
    repeated = shared.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).join(
        nodes.select(F.col("node").alias("a")), "a", "left_semi"
    )  # a doc_id with several texts may stand for one fingerprint and belong to another
    found = components(link(nodes).union(repeated))
    of_print = cut(nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id")), "components")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return prints.join(of_print, "fingerprint", "left").select("doc_id", hexed, "component_id")


def shingles(text: bytes, size: int) -> np.ndarray:
    """Distinct hashes, in order, of the `size`-word shingles of a text; a shorter text is one shingle, none has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    return np.unique(span_hash(prefix_hash(np.frombuffer(b" ".join(words), np.uint8)), starts[: len(words) - size + 1], ends[size - 1 :]))


def wide_print(h: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes in WORDS * 64 bits: each is 1 if set in over half of the hashes, mixed anew for each word."""
    ones = np.zeros(64 * WORDS, np.int64)
    seeds = mix(np.arange(1, WORDS + 1, dtype=np.uint64))
    for k in range(0, len(h), 16 * 255):
        part = mix(h[k : k + 16 * 255, None] ^ seeds)
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # as many as a byte can count
            ones += bits[i : i + 255].sum(0, dtype=np.uint8)
    return 2 * ones > len(h)


def tables_of(n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Bits that rows must agree in to meet: of the FINE tables, and of as many others as leave MISSED of n rows' pairs.

    Of texts of similarity 0.8 a share of 0.151 of the bits differ: the angle between equally large sets, by pi.
    A table of n rows takes as many bits as make buckets of BUCKET rows; fewer rows than that are one bucket. Tables
    take their bits from shuffled decks of all bits, so they share few.
    """
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BUCKET))))
    agree = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** bits
    rng = np.random.default_rng(SEED)

    def dealt(tables: int, k: int) -> np.ndarray:
        decks = -(-tables * k // (64 * WORDS))
        return np.concatenate([np.empty(0, np.int64), *(rng.permutation(64 * WORDS) for _ in range(decks))])[: tables * k].astype(np.int64).reshape(tables, k)

    return dealt(FINE, bits + FINER), dealt(1 if not bits else int(np.ceil(np.log(MISSED) / np.log(1 - agree))), bits)


def sketch(text: bytes, size: int, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """Hash of a text's set of shingles, the set's size, its wide SimHash and its key in each of tables."""
    h = shingles(text, size)
    same = mix(h).sum(dtype=np.uint64)
    if not tables:
        return np.array([same], np.uint64)
    bits = wide_print(h)
    told = np.packbits(bits, bitorder="little").view(np.uint64)
    keys = [bits[chosen] @ (1 << np.arange(chosen.shape[1])) for chosen in tables]
    return np.concatenate([np.array([same, len(h)], np.uint64), told, *(k.astype(np.uint64) for k in keys)])


def sketches(size: int, tables: tuple[np.ndarray, ...] = ()):
    width = 1 + (1 + WORDS + sum(map(len, tables)) if tables else 0)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            found = [sketch(b, size, tables).view(np.int64) for b in as_bytes(texts)]
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * width)
            yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))

    return of


def verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets of shingles have a Jaccard similarity of at least `similarity`."""

    @F.arrow_udf(T.BooleanType())
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(as_bytes(left), as_bytes(right), strict=True):
                x, y = shingles(x, size), shingles(y, size)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                out.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.array(out, pa.bool_())

    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = cut(docs.select("doc_id", "text").join(asked, "doc_id", "left_semi"), "compared")
    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
    return cut(both.where(similar("left", "right")).select("a", "b").distinct(), "similar")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of rows with one value in the first column, together FOREST rows or SHARD_BYTES at least; a run may span batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(group)) + 1
        edge = int(edges[-1]) if len(edges) else 0  # where the last run of the batch begins
        ended = edge > 0 or (held and last != group[0])
        if ended and (sum(b.num_rows for b in held) + edge >= FOREST or sum(b.nbytes for b in held) >= SHARD_BYTES):
            yield pa.Table.from_batches([*held, batch.slice(0, edge)])
            held, batch = [], batch.slice(edge)
        held.append(batch)
        last = group[-1]
    if held:
        yield pa.Table.from_batches(held)


class BKForest:
    """A BK-tree of each group of fingerprints (rows of 64-bit words; starts: the groups' first rows) in flat arrays.

    They are the trees that adding rows in order gives: all rows of a level go down one edge at a time, and the first row
    on a new edge becomes its node. So a node's descendants all come after it.
    """

    def __init__(self, prints: np.ndarray, starts: np.ndarray) -> None:
        n = len(prints)
        self.prints = prints
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        self.edge = np.zeros(n, np.int16)  # a node's distance to its parent
        parent, at = np.full(n, -1), self.root.copy()
        rows = np.delete(np.arange(n), starts)
        while len(rows):
            d = self.apart(rows, at[rows])
            _, first, of = np.unique(at[rows] * (64 * prints.shape[1] + 1) + d, return_index=True, return_inverse=True)
            nodes = rows[first]
            parent[nodes], self.edge[nodes] = at[nodes], d[first]
            at[rows] = nodes[of]
            rows = np.delete(rows, first)
        self.children = np.argsort(parent, kind="stable")[len(starts) :]
        self.first = np.searchsorted(parent[self.children], np.arange(n))
        self.count = np.bincount(parent[self.children], minlength=n)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = np.zeros(len(x), np.int16)
        for word in self.prints.T:
            d += np.bitwise_count(word[x] ^ word[y])
        return d

    def near(self, radius: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, earlier row) of each group within radius, the earlier one less than before[row]. Only edges whose distance
        differs by at most radius can lead to one, and none past a node that is not before."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        row = np.flatnonzero(before > self.root)
        node = self.root[row]
        while len(row):
            d = self.apart(row, node)
            near = d <= radius
            found.append((row[near], node[near]))
            m = self.count[node]
            ends = np.cumsum(m)
            child = self.children[np.arange(ends[-1]) + np.repeat(self.first[node] - ends + m, m)]
            row, d = np.repeat(row, m), np.repeat(d, m)
            leads = (child < before[row]) & (np.abs(self.edge[child] - d) <= radius)
            row, node = row[leads], child[leads]
        x, y = zip(*found, strict=True)
        return np.concatenate(x), np.concatenate(y)


def _near(rows: pa.Table, radius: int, similarity: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of one group's rows within radius, of different components; if sizes of sets are told, only
    those that can be so similar; if fingerprints are told whole, only those within WHOLE_RADIUS; if all bands are told,
    only those whose first common band is the group's, so each pair is looked at in one bucket alone. rows are sorted by
    group and component; where a group has rows of side 1, these are held against those of side 0.

    A row asks its group's tree for rows before its own component's first, so rows of one component never meet.
    """
    told = {c: rows[c].to_numpy() for c in rows.column_names if c in ("group", "side", "component", "band", "fingerprint", "further")}
    n = rows.num_rows
    group = told.get("group", np.zeros(n, np.int64))
    prints = np.stack([told[c] for c in ("fingerprint", "further") if c in told], axis=1).view(np.uint64)  # bits, not numbers
    parts = np.append(True, np.diff(group) != 0)
    starts = np.flatnonzero(parts)
    runs = parts | np.append(True, np.diff(told["component"]) != 0)
    x, y = BKForest(prints, starts).near(radius, np.flatnonzero(runs)[np.cumsum(runs) - 1])
    two = np.add.reduceat(told["side"], starts)[np.cumsum(parts) - 1] > 0
    pairs = ~two[x] | (told["side"][x] != told["side"][y])
    x, y = x[pairs], y[pairs]
    if "size" in rows.column_names:
        sizes = rows["size"].to_numpy()
        alike = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y]) - 1e-9
        x, y = x[alike], y[alike]
    if "others" in rows.column_names:
        others = rows["others"].combine_chunks().flatten().to_numpy().reshape(n, -1).view(np.uint64)
        d = np.zeros(len(x), np.int64)
        for word in np.concatenate([prints, others], axis=1).T:
            d += np.bitwise_count(word[x] ^ word[y])
        x, y = x[d <= WHOLE_RADIUS], y[d <= WHOLE_RADIUS]
    if "bands" in rows.column_names:
        bands, band = rows["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1), told["band"]
        for k in range(bands.shape[1]):
            new = (k >= band[x]) | (bands[x, k] != bands[y, k])
            x, y = x[new], y[new]
    return x, y


def _candidates(radius: int, similarity: float):
    """Rows (group, ..., and maybe others and bands), sorted by group and component, that have a partner in _near."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            found = np.unique(np.concatenate(_near(rows, radius, similarity)))
            if len(found):
                yield from rows.take(pa.array(found)).combine_chunks().to_batches()

    return of


LOOKED_AT = ["group", "side", "node", "fingerprint", "further", "component", "band", "size"]


def _compared(radius: int, size: int, similarity: float):
    """The same rows with text, to links (a, b) between similar ones: enough to connect all that are, not all pairs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            node, component = rows["node"].to_numpy(), rows["component"].to_numpy().tolist()
            root = {c: c for c in component}

            def top(c: int) -> int:
                while root[c] != c:  # noqa: B023
                    root[c] = root[root[c]]  # noqa: B023
                    c = root[c]  # noqa: B023
                return c

            pairs = list(zip(*(x.tolist() for x in _near(rows, radius, similarity)), strict=True))
            told = {i: shingles(b, size) for i, b in enumerate(as_bytes(rows["text"].combine_chunks()))} if pairs else {}
            links = []
            for x, y in pairs:
                p, q = top(component[x]), top(component[y])
                if p == q:
                    continue
                shared = len(np.intersect1d(told[x], told[y], assume_unique=True))
                if shared >= similarity * (len(told[x]) + len(told[y]) - shared) - 1e-9:
                    root[max(p, q)] = min(p, q)
                    links.append((max(node[x], node[y]), min(node[x], node[y])))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema)

    return of


def dealt(keyed: DataFrame, shard: int) -> DataFrame:
    """keyed (band, key, node, component, bytes, ...) with group and side: buckets as groups; larger ones than a shard, in
    rows or bytes, are dealt into shards, and each pair of shards is one group.

    Rows of one component need not meet. Where one has over half of a large bucket's rows, its shards meet only those
    of the other rows, so the rows made grow with a group of linked copies, not with its square; buckets of one component go.
    """
    parts = lambda n, b: F.ceil(F.greatest(n / shard, b / SHARD_BYTES)).cast("int")
    large = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).where(parts(F.col("n"), F.col("b")) > 1)
    large = cut(large, "large")
    each = keyed.join(F.broadcast(large.select("band", "key")), ["band", "key"]).groupBy("band", "key", "component").agg(F.count("*").alias("of"), F.sum("bytes").alias("held"))
    most = each.groupBy("band", "key").agg(F.max(F.struct("of", "held", "component")).alias("most"))
    over = 2 * F.col("most.of") > F.col("n")
    split = large.join(most, ["band", "key"]).select(
        "band", "key", F.when(over, F.col("most.component")).alias("main"), F.when(over, parts(F.col("most.of"), F.col("most.held"))).otherwise(0).alias("first"),
        F.when(over, parts(F.col("n") - F.col("most.of"), F.col("b") - F.col("most.held"))).otherwise(parts(F.col("n"), F.col("b"))).alias("more"), (F.col("n") == F.col("most.of")).alias("one"),
    )
    rows = keyed.join(F.broadcast(cut(split, "split")), ["band", "key"], "left").where(~F.coalesce("one", F.lit(False)))
    rows = rows.withColumn("first", F.coalesce("first", F.lit(0))).withColumn("more", F.greatest("more", F.lit(1))).withColumn("is_main", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    h = F.xxhash64("node")
    rows = rows.withColumn("own", F.when(F.col("is_main"), F.pmod(h, F.col("first"))).otherwise(F.col("first") + F.pmod(h, F.col("more"))).cast("int"))
    least = F.when(F.col("is_main"), F.col("first")).otherwise(0)
    rows = rows.withColumn("other", F.explode(F.sequence(least, F.col("first") + F.col("more") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == low, 0).otherwise(1).cast("long").alias("side")
    return rows.select(F.xxhash64("band", "key", low, high).alias("group"), side, *keyed.columns)


def similar_documents(
    docs: DataFrame, *, size: int = STAGE_SHINGLE, similarity: float = SIMILARITY, radius: int = STAGE_RADIUS, shard: int = STAGE_SHARD
) -> DataFrame:
    """doc_id and component_id of every row of docs (doc_id, text) with a doc_id; links are pairs of similar sets of shingles.

    Fingerprints of texts of similarity 0.8 differ in about 0.15 of their bits, too many for blocks of 64, so they have
    512: rows that agree in the bits of a table (tables_of) meet in a bucket, whose BK-tree finds those within radius in
    the first 128 bits, and these are compared exactly. First each row with the least of its bucket in tables of many
    bits, which joins large groups of near copies; then rows of different components, in shards bounded in rows and
    bytes (dealt): a first look at 128 bits and sizes finds the rows that have a partner, a second, at all bits, those
    that have one whose first common bucket it is, a third compares their texts and gives the links that connect. So no
    pairs are made into rows; those of unlinked rows of a bucket take time, and a row in one goes once to each of its shards.
    Rows that share a doc_id count as one document, equal sets as one row.
    """
    bounded_batches(docs.sparkSession)
    fine, coarse = tables_of(docs.count(), similarity)
    s = F.col("sketch")
    told = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.octet_length("text").alias("bytes")).withColumn("sketch", sketches(size, (fine, coarse))("text"))
    words = [s[2].alias("fingerprint"), s[3].alias("further"), F.slice(s, 3 + COMPARED, WORDS - COMPARED).alias("others")]
    keys = [F.slice(s, 3 + WORDS, FINE).alias("heads"), F.slice(s, 3 + WORDS + FINE, len(coarse)).cast("array<int>").alias("bands")]
    told = told.select("doc_id", s[0].alias("same"), s[1].alias("size"), *words, *keys, F.coalesce("bytes", F.lit(0)).alias("bytes"))
    prints = cut(told, "sketches")
    least = F.min(F.struct(F.col("doc_id").alias("node"), "fingerprint", "further", "size", "others", "heads", "bands", "bytes"))
    nodes = cut(prints.groupBy("same").agg(least.alias("least")).select("same", "least.*"), "nodes")
    keyed = nodes.select("node", "fingerprint", "further", F.posexplode("heads").alias("band", "key"))
    heads = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(F.struct("node", "fingerprint", "further")).alias("head")).where("n > 1")
    met = keyed.join(heads.drop("n"), ["band", "key"]).where("node != head.node")
    apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"head.{c}"))) for c in ("fingerprint", "further"))
    star = met.where(apart <= radius).select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct()
    links = verified(cut(star, "star"), docs, size, similarity)

    of_node = nodes.select("node", "fingerprint", "further", "size", "bytes", "bands").join(components(links), "node", "left")
    of_node = cut(of_node.withColumn("component", F.coalesce("component", "node")).withColumn("bytes", F.col("bytes").cast("long")), "components")
    keyed = of_node.select("node", "fingerprint", "further", "component", "size", "bytes", F.posexplode("bands").alias("band", "key"))
    groups = dealt(keyed, shard).withColumn("band", F.col("band").cast("long")).select(*LOOKED_AT)
    look = f"{', '.join(f'{c} long' for c in LOOKED_AT)}"
    sorted_ = lambda df: df.repartition("group").sortWithinPartitions("group", "component", "node")
    asking = cut(sorted_(groups).mapInArrow(_candidates(radius, similarity), look), "asking")
    asking = asking.join(nodes.select("node", "others", "bands"), "node").select(*LOOKED_AT, "others", "bands")  # only rows with a partner carry all their bits
    asking = cut(sorted_(asking).mapInArrow(_candidates(radius, similarity), f"{look}, others array<long>, bands array<int>"), "asking")
    asked = nodes.select("node", "same").join(asking.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(asked, "node")
    # Rows that share a doc_id may have other texts than the one the node stands for.
    texts = cut(texts.where(sketches(size)("text")[0] == F.col("same")).groupBy("node").agg(F.min("text").alias("text")), "texts")
    full = asking.join(texts, "node").select(*LOOKED_AT, "others", "bands", "text")
    links = links.union(sorted_(full).mapInArrow(_compared(radius, size, similarity), "a long, b long"))

    several = prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    of_row = prints.select("doc_id", "same").join(nodes.select("same", "node"), "same").select("doc_id", "node")
    repeated = of_row.join(several, "doc_id", "left_semi").where("doc_id != node").select(F.greatest("doc_id", "node").alias("a"), F.least("doc_id", "node").alias("b"))
    found = components(links.union(repeated))
    return of_row.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of similar_documents, that of its smallest doc_id, and each row without a doc_id.

    If several rows share that doc_id, the first by text and then by the row's hash stays.
    """
    judged = cut(similar_documents(docs.select("doc_id", "text")), "judged")
    later = judged.where("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(later, "doc_id", "left_anti").select(docs.columns)
    repeated = judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    several = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(*docs.columns))).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(several.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
