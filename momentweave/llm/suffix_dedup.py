"""Operator 7: exact substring dedup: anchors find repeats, suffix arrays by induced sorting decide them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, cut, mix, powers, prefix_hash, span_hash, spare, table

LENGTH = 100  # bytes of a string that may stay once
GRAM = 32  # bytes of an anchor
SHARD_SEGMENTS = 4_096  # segments of one anchor in one shard
SHARD_BYTES = 1 << 20  # bytes of a suffix array, about
PART_ROWS = 1_024  # rows of one anchor that are compared in one place, about
CELLS, HOT_SHARE = 1 << 18, 32  # of anchors, by hash: a frequent anchor's cell is split; one document in so many is looked at to find them
_PACK = 16  # bits of a start count beside a start


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    return h


def anchors(docs: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, document, first start, number of starts and segment hash of each anchor of the documents.

    The anchor of a string of `length` bytes is its gram of the least hash (the leftmost of equal ones), so equal
    strings have equal anchors at equal places, wherever they lie. Strings that share one anchor start at adjacent
    bytes; their union is the anchor's segment. Every string of `length` bytes lies in exactly one segment.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    if not len(docs) or size.max() < length:
        return none
    data = np.frombuffer(b"".join(docs), np.uint8)
    if len(data) < length:
        return none
    first = np.cumsum(size) - size
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    full = span_hash(prefix, at, at + gram)
    half = np.uint64(32)  # of the hash, whatever the batch, beside the position
    key = ((full >> half) << half) | at.astype(np.uint64)
    owner = (_window_min(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(owner) + 1, np.int32)
    fits = size >= length
    np.add.at(inside, first[fits], 1)
    np.add.at(inside, first[fits] + size[fits] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    own, doc = owner[start], np.searchsorted(first + size, start, "right")
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))))
    begin, last = start[new], start[np.concatenate((new[1:], [len(start)])) - 1]
    segment = mix(span_hash(prefix, begin, last + length) ^ mix((own[new] - begin).astype(np.uint64)))
    return full[own[new]].view(np.int64), doc[new], begin - first[doc[new]], last - begin + 1, segment.view(np.int64)


# Suffix arrays of one shard.


def _ranks_by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string over a wide alphabet; only suffixes that still tie are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    new = np.concatenate(([True], names[order[1:]] != names[order[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while not new.all():
        single = new & np.concatenate((new[1:], [True]))
        at = np.flatnonzero(~single)
        tied = order[at]
        ahead = tied + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[tied]
        by = np.lexsort((second, first))
        tied, first, second = tied[by], first[by], second[by]
        order[at] = tied
        new[at] = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        step *= 2
    return order


class _Buckets:
    """Induces a suffix array from sorted leftmost-smaller suffixes, a whole frontier of a bucket at a time."""

    def __init__(self, s: np.ndarray, smaller: np.ndarray):
        self.s, self.smaller, self.n = s, smaller, len(s)
        self.counts = np.bincount(s)
        self.end = np.cumsum(self.counts)
        self.start = self.end - self.counts
        self.larger = np.bincount(s[~smaller], minlength=len(self.counts))
        self.chars = np.flatnonzero(self.counts)

    def _push(self, block: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The predecessors of a class among block, by character in stable order, with their ranks and the counts."""
        before = block[block > 0] - 1
        before = before[self.smaller[before] == want]
        chars = self.s[before]
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        first = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(chars) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((first, [len(chars)])))
        return before[order], chars, np.arange(len(chars)) - np.repeat(first, size), np.stack((chars[first], size))

    def induce(self, least: np.ndarray) -> np.ndarray:
        """least: the leftmost-smaller positions, in order within each first character."""
        sa = np.full(self.n, -1, np.int64)
        chars = self.s[least]
        size = np.bincount(chars, minlength=len(self.counts))
        place = np.cumsum(size) - size
        sa[self.end[chars] - size[chars] + np.arange(len(least)) - place[chars]] = least
        head = self.start.copy()
        last = self.s[self.n - 1]
        if not self.smaller[self.n - 1]:
            sa[head[last]] = self.n - 1
            head[last] += 1
        for c in self.chars:
            at = self.start[c]
            while at < head[c]:
                block, at = sa[at : head[c]], head[c]
                before, chars, rank, new = self._push(block, False)
                sa[head[chars] + rank] = before
                head[new[0]] += new[1]
            if size[c]:
                before, chars, rank, new = self._push(sa[self.end[c] - size[c] : self.end[c]], False)
                sa[head[chars] + rank] = before
                head[new[0]] += new[1]
        tail = self.end.copy()
        for c in self.chars[::-1]:
            at = self.end[c]
            while tail[c] < at:
                block, at = sa[tail[c] : at][::-1], tail[c]
                before, chars, rank, new = self._push(block, True)
                sa[tail[chars] - 1 - rank] = before
                tail[new[0]] -= new[1]
            if self.larger[c]:
                before, chars, rank, new = self._push(sa[self.start[c] : self.start[c] + self.larger[c]][::-1], True)
                sa[tail[chars] - 1 - rank] = before
                tail[new[0]] -= new[1]
        return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small non-negative integers, by induced sorting.

    Suffixes are classified as smaller or larger than the next; leftmost-smaller substrings are sorted by inducing
    and named; their order as suffixes comes from the string of names (by this function while its alphabet is
    narrow, by doubling where buckets would be many and tiny), and induces the rest.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    step = np.append(step, -1)  # the end is smaller than all
    following = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    smaller = step[following] > 0
    least = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    buckets = _Buckets(s, smaller)
    if len(least) < 2:
        return buckets.induce(least)
    sa = buckets.induce(least[np.argsort(s[least], kind="stable")])
    mark = np.full(n, -1, np.int64)
    mark[least] = np.arange(len(least))
    order = mark[sa]
    order = order[order >= 0]
    until = np.append(least[1:] + 1, n + 1)  # substrings take in the next one's first character; the last, the end
    h = np.zeros(n + 2, np.uint64)
    np.cumsum(mix(np.append(s, -1).astype(np.uint64) + np.uint64(2)) * powers(n + 1)[0], out=h[1:])
    name = span_hash(h, least, until)
    names = np.empty(len(least), np.int64)
    names[order] = np.cumsum(np.concatenate(([0], name[order[1:]] != name[order[:-1]])))
    if names.max() == len(least) - 1:
        ranked = order
    else:
        ranked = suffix_array(names) if names.max() < 256 else _ranks_by_doubling(names)
    return buckets.induce(least[ranked])


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in text order with its predecessor in the suffix array (0 for the first).

    Zeros in s match nothing, not even each other. Only irreducible values (where the characters before differ, or
    are zero) are compared; every other one is one less than its left neighbour's.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    left = np.where((at > 0) & (before > 0), s[at - 1], 0)
    reducible = (before > 0) & (at > 0) & (left == s[np.maximum(before - 1, 0)]) & (left != 0)
    reducible[1:] &= before[1:] - 1 == before[:-1]
    compare = np.flatnonzero(~reducible & (before >= 0))
    plcp = np.zeros(n, np.int64)
    padded = np.append(s, 0)
    size, live = np.zeros(len(compare), np.int64), np.arange(len(compare))
    while len(live):
        a = padded[np.minimum(compare[live] + size[live], n)]
        b = padded[np.minimum(before[compare[live]] + size[live], n)]
        live = live[(a == b) & (a != 0)]
        size[live] += 1
    plcp[compare] = size
    last = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.maximum(plcp[last] - (at - last), 0) * (before >= 0)


def repeats(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, segments: list[bytes], length: int = LENGTH):
    """Which strings of a shard repeat one that starts earlier.

    Segment i holds counts[i] strings; the k-th starts at byte k of it, which is byte starts[i] + k of document
    docs[i]. Returns for every string (segments in order) its segment, its k, whether an equal one starts earlier in
    the shard (smaller document, or the same and an earlier byte), and its hash.
    """
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    first = np.cumsum(size + 1) - size - 1
    text[first + size] = 0
    sa = suffix_array(text)
    same = common_prefixes(text, sa)[sa] >= length
    segment = np.repeat(np.arange(len(segments)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[segment] + k
    group = np.empty(len(text), np.int64)
    group[sa] = np.cumsum(~same)
    group = group[at]
    doc, start = docs[segment], starts[segment] + k
    order = np.lexsort((start, doc, group))
    g, d, b = group[order], doc[order], start[order]
    head = np.concatenate(([True], g[1:] != g[:-1]))
    lead = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
    later = np.empty(len(g), bool)
    later[order] = (d != d[lead]) | (b != b[lead])
    prefix = prefix_hash((text - 1).astype(np.uint8))
    return segment, k, later, span_hash(prefix, at, at + length).view(np.int64)


_FOUND = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("split", pa.bool_()), ("key", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])


def _decide(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Spans of repeats of one shard's segments (anchor, shards, key, start, count, bytes); of anchors in several
    shards also each string that is this shard's first, for the other shards' to be held against."""
    anchor, shards, key, start, count = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
    segment, k, later, h = repeats(key, start, count, [r[5] for r in rows], length)
    starts_new = np.concatenate(([True], segment[1:] != segment[:-1]))
    begin = np.flatnonzero(later & (~np.concatenate(([False], later[:-1])) | starts_new))
    end = np.flatnonzero(later & (~np.concatenate((later[1:], [False])) | np.concatenate((starts_new[1:], [True]))))
    own = np.flatnonzero(~later & (shards[segment] > 1))
    at = np.concatenate((begin, own))
    until = np.concatenate((end, own))
    of = segment[at]
    split = np.arange(len(at)) >= len(begin)
    one = np.where(split, anchor[of], key[of])
    two = np.where(split, h[at], start[of] + k[at])
    return pa.RecordBatch.from_arrays(
        [pa.array(one), pa.array(two), pa.array(split), pa.array(key[of]), pa.array(start[of] + k[at]), pa.array(start[of] + k[until] + length)], schema=_FOUND
    )


def _shards(length: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and shard; whole groups are gathered into shards of about SHARD_BYTES."""
        rows: list[tuple] = []
        size, group = 0, None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                anchor, shard, shards, key, packed, segment = row
                if (anchor, shard) != group and size > SHARD_BYTES:
                    yield _decide(rows, length)
                    rows, size = [], 0
                group = (anchor, shard)
                if segment is not None and len(segment) == (packed & ((1 << _PACK) - 1)) + length - 1:
                    rows.append((anchor, shards, key, packed >> _PACK, packed & ((1 << _PACK) - 1), segment))
                    size += len(segment)
        if rows:
            yield _decide(rows, length)

    return decide


def own_repeats(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, segment: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Which rows of anchors() repeat a segment that their document has before, and the maximal runs (document, from,
    to) of bytes in those: a long periodic text has a row for every byte, but few different ones."""
    order = np.lexsort((start, segment, anchor, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (anchor[order][1:] == anchor[order][:-1]) & (segment[order][1:] == segment[order][:-1])
    again = np.zeros(len(doc), bool)
    again[order[1:]] = same
    at = np.flatnonzero(again)
    at = at[np.lexsort((start[at], doc[at]))]
    d, begin, end = doc[at], start[at], start[at] + count[at] + length - 1
    if not len(at):
        return again, d, begin, end
    far = np.int64(max(end.max(), 1) + 1)
    reach = np.maximum.accumulate(end + d * far)  # of all rows so far, documents laid apart
    new = np.concatenate(([True], begin[1:] + d[1:] * far > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:], [len(at)])) - 1
    return again, d[new], begin[new], reach[last] - d[new] * far


def _find_anchors(length: int, gram: int):
    """Rows (key, text) to rows (anchor, segment, key, packed: start and count); for bytes that repeat a segment of
    their own document, to rows with packed below 0: a run from -1 - packed to `segment`."""
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("key", pa.int64()), ("packed", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            held, size = [], 0
            for i, b in enumerate(batch.column(1)):
                text = b.as_buffer().to_pybytes() if b.is_valid else b""
                for first in range(0, max(len(text) - length + 1, 1), SHARD_BYTES):  # a long text comes in chunks: each string starts in one
                    part = text[first : first + SHARD_BYTES + length - 1]
                    if held and size + len(part) > SHARD_BYTES:
                        yield rows(keys, held)
                        held, size = [], 0
                    held.append((i, first, part))
                    size += len(part)
            if held:
                yield rows(keys, held)

    def rows(keys: np.ndarray, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        of, offset = np.array([i for i, _, _ in held]), np.array([first for _, first, _ in held])
        anchor, doc, start, count, segment = anchors([part for *_, part in held], length, gram)
        again, d, begin, end = own_repeats(anchor, doc, start, count, segment, length)
        anchor, doc, start, count, segment = (x[~again] for x in (anchor, doc, start, count, segment))
        run = keys[of[d]]
        columns = (
            np.concatenate((anchor, mix(mix(run.astype(np.uint64)) + (begin + offset[d]).astype(np.uint64)).view(np.int64))), np.concatenate((segment, end + offset[d])),
            np.concatenate((keys[of[doc]], run)), np.concatenate(((start + offset[doc]) << _PACK | count, -1 - (begin + offset[d]))),
        )
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return find


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key that orders documents: doc_id, or (where ids repeat or are null) a number by doc_id, nulls
    last, then text hash."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return cut(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


def repeated_spans(keyed: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key and spans (array of from, to; bytes, unsorted, they may overlap) of documents with bytes to remove.

    keyed: key, text. Every string of `length` bytes has one anchor, at the same place in each copy, so anchors that
    occur once rule their strings out. Copies of a whole segment are settled by its hash (64 bits beside the anchor's
    64); where segments of one anchor differ, suffix arrays over the different ones find their equal strings. Anchors
    that are very frequent are found in a sample of documents first: their rows (and those of the anchors of their
    cells, so any number of frequent anchors is told by CELLS numbers) are dealt into parts, and their different
    segments into several shards. One document gives an anchor no segment twice (own_repeats), so a frequent
    anchor lies in many documents, and the sample misses one that is in a thousand of them once in 10^13 times.
    """
    bounded_batches(keyed.sparkSession)
    texts = keyed.select("key", "text").where(F.octet_length("text") >= length)
    found_type = "anchor long, segment long, key long, packed long"
    rows = texts.mapInArrow(_find_anchors(length, gram), found_type)
    sampled = texts.where(F.pmod(F.xxhash64("key"), F.lit(HOT_SHARE)) == 0).mapInArrow(_find_anchors(length, gram), found_type)
    # A row a cell: at most CELLS rows whatever the input, so it may be broadcast. It only says into how many parts the
    # rows of a cell's anchors go; one that is rare itself is split with its neighbours, and put together again below.
    cell = F.pmod(F.xxhash64("anchor", F.lit(7)), F.lit(CELLS)).cast("int").alias("cell")
    parts = F.ceil(F.count("*") * HOT_SHARE / PART_ROWS).cast("int")
    frequent = sampled.groupBy("anchor").agg(parts.alias("parts")).where("parts > 1")
    hot = cut(frequent.groupBy(cell).agg(F.max("parts").alias("parts")), "hot")

    # A part settles its copies alone; a segment's first row in each part is then held against the other parts'.
    dealt = rows.withColumn("cell", cell).join(F.broadcast(hot), "cell", "left").drop("cell").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key", "packed"), F.col("parts")).cast("int"))
    place = F.rank().over(Window.partitionBy("anchor", "part", "segment").orderBy("key", "packed"))
    whole = Window.partitionBy("anchor", "part")
    judged = dealt.withColumn("place", place)
    judged = judged.withColumn("several", F.min("segment").over(whole) != F.max("segment").over(whole))
    judged = judged.where("place > 1 OR several OR parts > 1 OR packed < 0")
    # Copies need no anchor any more, and only an anchor in several parts needs its segments told apart again.
    kept = judged.select(
        F.when(F.col("place") == 1, F.col("anchor")).alias("anchor"), F.when((F.col("place") == 1) & (F.col("parts") > 1) | (F.col("packed") < 0), F.col("segment")).alias("segment"),
        "key", "packed", (F.col("place") > 1).alias("copy"), "part", "parts",
    )
    kept = cut(kept, "segments")
    own = kept.where("packed < 0").select("key", (-1 - F.col("packed")).alias("from"), F.col("segment").alias("to"))
    kept = kept.where("packed >= 0")

    again = kept.where("segment IS NOT NULL").withColumn("place", F.rank().over(Window.partitionBy("anchor", "segment").orderBy("key", "packed")))
    told = (F.approx_count_distinct("segment").alias("kinds"), (F.min("segment") != F.max("segment")).alias("several"), F.max("parts").alias("parts"))
    kinds = again.where("place = 1").groupBy("anchor").agg(*told)
    shards = F.ceil(F.col("kinds") / SHARD_SEGMENTS).cast("int")
    mine = F.pmod(F.xxhash64("segment"), shards).cast("int")
    # Every part of an anchor is joined with a row of its own, so no task holds a whole anchor.
    kinds = kinds.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    again = again.join(kinds, ["anchor", "part"]).where("place > 1 OR several")
    again = cut(again.select("anchor", "key", "packed", (F.col("place") > 1).alias("copy"), mine.alias("shard"), shards.alias("shards")), "parted")
    judged = kept.where("segment IS NULL").select("anchor", "key", "packed", "copy", F.lit(0).alias("shard"), F.lit(1).alias("shards")).union(again)

    begin, count = F.shiftright("packed", _PACK), F.col("packed").bitwiseAND(F.lit((1 << _PACK) - 1))
    sliced = F.expr(f"substring(cast(text AS binary), cast(shiftright(packed, {_PACK}) AS int) + 1, cast(packed & {(1 << _PACK) - 1} AS int) + {length - 1})")
    # Joined with the documents here and again by the caller: on one key, so Spark shuffles the texts once.
    segments = keyed.join(judged.where("NOT copy"), "key").select("anchor", "shard", "shards", "key", "packed", sliced.alias("bytes"))
    dealt = segments.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "key", "packed")
    found = dealt.mapInArrow(_shards(length), "one long, two long, split boolean, key long, from long, to long")
    # A split anchor's strings meet here, at most one from each of its shards; all but the earliest repeat it.
    met = found.groupBy("one", "two", "split").agg(F.sort_array(F.collect_list(F.struct("key", "from", "to"))).alias("rows"))
    later = F.filter("rows", lambda r: ~F.col("split") | (F.struct(r["key"], r["from"]) > F.struct(F.col("rows")[0]["key"], F.col("rows")[0]["from"])))
    partial = met.select(F.inline(later))
    full = judged.where("copy").select("key", begin.alias("from"), (begin + count + (length - 1)).alias("to"))
    return partial.union(full).union(own).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@F.arrow_udf(T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string"))
def _digest(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for array, spans in texts:
        rows = []
        for b, found in zip(as_bytes(array), spans.to_pylist(), strict=True):
            runs, at, h = merged(found), 0, hashlib.sha256()
            for first, last in runs:
                h.update(b[at:first])
                at = last
            h.update(b[at:])
            rows.append((len(b), sum(y - x for x, y in runs), len(runs), h.hexdigest()))
        n, removed, runs, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@F.arrow_udf(T.StringType())
def _remaining(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for array, spans in texts:
        out = []
        for b, found in zip(as_bytes(array), spans.to_pylist(), strict=True):
            parts, at = [], 0
            for first, last in merged(found):
                while first < last and b[first] & 0xC0 == 0x80:  # no character is cut in two: what is left of it stays
                    first += 1
                while last < len(b) and last > first and b[last] & 0xC0 == 0x80:
                    last -= 1
                parts.append(b[at:first])
                at = last
            parts.append(b[at:])
            out.append(b"".join(parts).decode("utf-8", "ignore"))
        yield pa.array(out, pa.string())


def _with_spans(docs: DataFrame, column: str, length: int) -> DataFrame:
    """docs with the spans to remove (null: none) in a new column."""
    key = spare(docs, "__key")
    keyed = _keyed(docs, key)
    spans = repeated_spans(keyed.select(F.col(key).alias("key"), "text"), length=length)
    return keyed.join(spans.select(F.col("key").alias(key), F.col("spans").alias(column)), key, "left").drop(key)


def removed_digest(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of what remains) of each row.

    Removed is each byte covered by a string of `length` bytes that also starts earlier: in a document of smaller
    doc_id, or at an earlier byte of the same; judged on the input, within documents. Null texts are empty. Rows that
    share a doc_id, and rows without one (after all others), are documents of their own, in order of their texts'
    hashes. Extra columns are ignored. No rows give no rows.
    """
    found = _with_spans(docs.select("doc_id", "text"), "spans", length)
    return found.select("doc_id", _digest("text", "spans").alias("d")).select("doc_id", "d.*")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """docs with those bytes taken out of text, whole characters only, and n_chars (if there) counted anew. Other
    columns are untouched; a null text stays null."""
    column = spare(docs, "__spans")
    found = _with_spans(docs, column, length)
    text = F.when(F.col(column).isNull(), F.col("text")).otherwise(_remaining("text", column))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
