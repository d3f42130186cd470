"""Operator 6: roles of raw transcripts by a hidden Markov model, and canonical rendering of their turns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fold, table

ROLES = ("system", "user", "assistant")
BLOCK = 12  # bits of a line's number below its block's: 4,096 lines are decoded together
#: Speaker markers, lower case, that may open a line before a colon. Fixed values.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model"),
}
MARKER_ODDS = 50.0  # how much likelier a role is on a line with its marker
FEATURES = {"place": 3, "ending": 3, "length": 4, "shape": 3}  # feature -> number of values
NAMES = "|".join(name for names in MARKERS.values() for name in names)
MARKER = rf"[\[<*#]*\s*(?i:({NAMES}))\s*[\]>*]*\s*:"
#: White space with a line break in it, before a marker; each run of white space is looked at once.
EDGE = rf"(?<=\S)(?=[^\S\n]*+\n)\s++(?={MARKER})"
#: White space that is taken off lines.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"


@dataclass(frozen=True)
class RoleModel:
    """Log probabilities: of the first role, of role after role, and of each feature value in a role."""

    first: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, ...]

    def observe(self, features: np.ndarray, marker: np.ndarray) -> np.ndarray:
        """Log likelihood of each line in each role; marker: index of the role that a marker names, or -1."""
        out = np.zeros((len(features), len(ROLES)))
        for j, table_ in enumerate(self.emit):
            out += table_[:, features[:, j]].T
        named = marker >= 0
        out[named, marker[named]] += _exact(np.log(MARKER_ODDS))
        return out

    @property
    def into(self) -> np.ndarray:
        """Log probability of each role after each role, and (last row) of each at the start."""
        return np.vstack((self.step, self.first))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lines_of(turns: DataFrame, *keep: str) -> DataFrame:
    """keep, part, marker, said and FEATURES of the lines in turns (turn, text): a text is cut where a line of it opens
    with a speaker marker. marker: index of the role that the line's marker names, or -1; said: the rest of the line
    without outer white space. Whole texts are looked at; a null text is one empty line."""
    text = F.coalesce("text", F.lit(""))
    split = turns.select(*keep, "turn", F.posexplode(F.split(text, EDGE)).alias("part", "raw"))
    name = F.lower(F.regexp_extract("raw", rf"^\s*{MARKER}", 1))
    marker = F.lit(-1)
    for k, role in enumerate(ROLES):
        marker = F.when(name.isin(*MARKERS[role]), k).otherwise(marker)
    out = split.withColumns({"marker": marker, "said": stripped(F.regexp_replace("raw", rf"^\s*{MARKER}", ""))})
    place = F.when(F.col("part") > 0, 2).when(F.col("turn") <= 0, 0).when(F.col("turn") == 1, 1).otherwise(2)
    size = F.length("said")
    return out.select(
        *keep, "turn", "part", "marker", "said", F.coalesce(place, F.lit(2)).alias("place"),
        F.when(F.endswith("said", F.lit("?")), 0).when(F.endswith("said", F.lit(".")), 1).otherwise(2).alias("ending"),
        F.when(size < 80, 0).when(size < 200, 1).when(size < 500, 2).otherwise(3).alias("length"),
        F.when(F.rlike("said", F.lit(r"^(?i:you are|you're|act as|as an?|please)\b")), 0).when(F.contains("said", F.lit("\n")), 1).otherwise(2).alias("shape"),
    )


def fit(turns: DataFrame) -> RoleModel:
    """Count transitions and features over all turns (conv_id, turn, role, text) whose role is known.

    A text's first line has the row's role. A transition joins a turn with the next number of its conversation; roles
    of one number are counted before the join, so many rows of one number make no pairs. The counts, not the turns,
    come to the driver: a few dozen rows at any size. Add-one smoothing; roles that never occur get it alone.
    """
    known = lines_of(turns.where(F.col("role").isin(*ROLES)), "conv_id", "role").where("part = 0")
    emit = []
    for name, values in FEATURES.items():
        counts = np.ones((len(ROLES), values))
        for r in known.groupBy("role", name).count().collect():
            counts[ROLES.index(r["role"]), r[name]] += r["count"]
        emit.append(np.log(counts / counts.sum(1, keepdims=True)))
    first, step = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
    for r in known.where("turn = 0").groupBy("role").count().collect():
        first[ROLES.index(r["role"])] += r["count"]
    at = known.groupBy("conv_id", "turn", "role").count()
    after = at.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"), F.col("count").alias("times"))
    pairs = at.join(after, ["conv_id", "turn"]).groupBy("role", "next").agg(F.sum(F.col("count").cast("double") * F.col("times")).alias("n"))
    for r in pairs.collect():
        step[ROLES.index(r["role"]), ROLES.index(r["next"])] += r["n"]
    return RoleModel(_exact(np.log(first / first.sum())), _exact(np.log(step / step.sum(1, keepdims=True))), tuple(map(_exact, emit)))


def _exact(x: np.ndarray) -> np.ndarray:
    """Multiples of 2^-24: their sums are exact, so the order of additions can't change a path's score."""
    return np.round(x * (1 << 24)) / (1 << 24)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal neighbours."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def products(model: RoleModel, scores: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run of lines, best scores from each role before it (or the start, the last row) to each at its end. All
    runs advance together."""
    order = np.argsort(-size, kind="stable")
    whole = model.into[None] + scores[first[order]][:, None]
    for k in range(1, int(size.max(initial=1))):
        live = int(np.searchsorted(-size[order], -k))
        whole[:live] = (whole[:live, :, :, None] + model.step).max(2) + scores[first[order[:live]] + k][:, None]
    out = np.empty_like(whole)
    out[order] = whole
    return out


def viterbi(model: RoleModel, scores: np.ndarray, first: np.ndarray, size: np.ndarray, before: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best role of each line, by runs of lines; before: the role before a run (or len(ROLES): none); end: its last
    role, or -1. All runs advance together."""
    order = np.argsort(-size, kind="stable")
    best = model.into[before[order]] + scores[first[order]]
    back = np.zeros((len(scores), len(ROLES)), np.int64)
    live = len(order)
    for k in range(1, int(size.max(initial=1))):
        live = int(np.searchsorted(-size[order], -k))
        at = first[order[:live]] + k
        options = best[:live, :, None] + model.step
        back[at] = options.argmax(1)
        best[:live] = options.max(1) + scores[at]
    role = np.empty(len(order), np.int64)
    role[order] = np.where(end[order] >= 0, end[order], best.argmax(1))
    out = np.empty(len(scores), np.int64)
    for k in range(int(size.max(initial=0))):  # from the ends back
        mine = np.flatnonzero(size > k)
        at = first[mine] + size[mine] - 1 - k
        out[at] = role[mine]
        role[mine] = back[at, role[mine]]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one value in column `key`; a run may span batches."""
    held, now = [], None
    for batch in batches:
        value = batch.column(key).to_numpy(zero_copy_only=False)
        for a, n in zip(*_runs(value), strict=True):
            if held and value[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = value[a]
            held.append(batch.slice(a, n))
    if held:
        yield pa.Table.from_batches(held)


def parse_transcripts(turns: DataFrame, model: RoleModel) -> DataFrame:
    """conv_id, turn, part, seq, role, opens and rendered of each line of the transcripts in turns (conv_id, turn, text).

    A text is cut into lines where one opens with a speaker marker. The roles are the Viterbi path over all lines of a
    conversation; a column `role` is not looked at. opens: whether the line's role differs from the one before.
    rendered is the line's share of the canonical transcript, `<|role|>`, what is said, and `<|end|>`, without markers
    and outer white space: a conversation's shares, joined in the order of seq (transcripts()), are its whole text,
    with neighbouring lines of one role as one turn. So no row, group or task grows with a conversation.

    Lines come in ranges of (conv_id, turn, text hash, part), cut into blocks. A block of a conversation that goes over
    several is summed up as a matrix of best scores; the matrices give the roles at the blocks' edges, and every block
    is then decoded between them. Null turns come first; rows of one number go by text hash, equal rows in any order.
    A null text is an empty line. Rows of a null conv_id are one conversation. Extra columns are ignored. No rows give
    no rows.
    """
    bounded_batches(turns.sparkSession)
    shared = turns.sparkSession.sparkContext.broadcast(model)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text", F.xxhash64("text").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "h", "tie", "part")]
    ranged = lines_of(rows, "conv_id", "h", "tie").repartitionByRange(*order).sortWithinPartitions(*order).drop("h", "tie")
    lines = cut(ranged.withColumn("seq", F.monotonically_increasing_id()), "lines").withColumn("block", F.shiftright("seq", BLOCK))
    # Null is a conversation too: keys are compared by (conv, none).
    lines = lines.withColumns({"conv": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull().cast("long")})
    names = [*FEATURES, "marker"]
    long = lines.groupBy("conv", "none").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    matrix = pa.schema([("conv", pa.int64()), ("none", pa.int64()), ("block", pa.int64()), ("m", pa.list_(pa.float64()))])

    def observed(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features = np.column_stack([block[c].to_numpy() for c in FEATURES])
        first, size = _runs(np.stack([block[c].to_numpy() for c in ("conv", "none")], 1).view([("c", "i8"), ("n", "i8")]).ravel())
        return shared.value.observe(features, block["marker"].to_numpy()), first, size

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "block"):
            scores, first, size = observed(block)
            found = products(shared.value, scores, first, size).reshape(len(first), -1)
            keys = [pa.array(block[c].to_numpy()[first]) for c in ("conv", "none", "block")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found.tolist(), pa.list_(pa.float64()))], schema=matrix)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.int64()), ("none", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("end", pa.int64()), ("last", pa.bool_())])
        for part in _blocks(batches, "key"):
            m = np.array(part["m"].to_pylist()).reshape(len(part), len(ROLES) + 1, len(ROLES))
            best, back = m[0][-1], []
            for edge in m[1:]:
                options = best[:, None] + edge[: len(ROLES)]
                back.append(options.argmax(0))
                best = options.max(0)
            path = [int(best.argmax())]
            for pointers in reversed(back):
                path.append(int(pointers[path[-1]]))
            path = path[::-1]
            last = [False] * (len(path) - 1) + [True]
            columns = [part[c].combine_chunks() for c in ("conv", "none", "block")] + [pa.array([len(ROLES), *path[:-1]]), pa.array(path), pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    in_blocks = lambda df: df.repartition("block").sortWithinPartitions("block", "seq")
    crossing = lines.select("conv", "none", "block", "seq", *names).join(long.select("conv", "none"), ["conv", "none"])
    sums = in_blocks(crossing).mapInArrow(summed, "conv long, none long, block long, m array<double>").withColumn("key", F.xxhash64("conv", "none"))
    # A conversation's blocks, one row for 4,096 lines, are chained in one place.
    chained = sums.repartition("key").sortWithinPartitions("key", "block")
    ends = cut(chained.mapInArrow(bounded, "conv long, none long, block long, before long, end long, last boolean"), "ends")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "block"):
            scores, first, size = observed(block)
            start, end, last = (block[c].to_numpy()[first] for c in ("before", "end", "last"))
            path = viterbi(shared.value, scores, first, size, start, end)
            before = np.concatenate(([0], path[:-1]))
            before[first] = start
            closes = np.zeros(len(path), bool)
            closes[(first + size - 1)[last]] = True
            columns = [block[c].combine_chunks() for c in ("conv_id", "turn", "part", "seq", "said")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(path), pa.array(before), pa.array(closes)], ["conv_id", "turn", "part", "seq", "said", "role", "before", "closes"])

    known = lines.join(ends, ["conv", "none", "block"], "left")
    known = known.withColumns({"before": F.coalesce("before", F.lit(len(ROLES)).cast("long")), "end": F.coalesce("end", F.lit(-1).cast("long")), "last": F.coalesce("last", F.lit(True))})
    sent = known.select("conv", "none", "block", "seq", *names, "before", "end", "last", "conv_id", "turn", F.col("part").cast("long"), "said")
    found = in_blocks(sent).mapInArrow(decoded, "conv_id long, turn long, part long, seq long, said string, role long, before long, closes boolean")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("role") + 1).cast("int"))
    opens = F.col("role") != F.col("before")
    ended = F.when(F.col("before") < len(ROLES), "\n<|end|>\n").otherwise("")
    rendered = F.concat(F.when(opens, F.concat(ended, F.lit("<|"), role, F.lit("|>\n"))).otherwise("\n"), "said", F.when(F.col("closes"), "\n<|end|>\n").otherwise(""))
    return found.select("conv_id", "turn", "part", "seq", role.alias("role"), opens.alias("opens"), rendered.alias("rendered"))


def transcripts(lines: DataFrame) -> DataFrame:
    """conv_id and text: the whole canonical transcript of each conversation in parse_transcripts' lines, as one row;
    for conversations that fit one."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "rendered")))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["rendered"]), "").alias("text"))


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """The model learns from conversations whose crc32(conv_id as text) mod 5 is not 0; held_out marks the others."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    held = fold("conv_id", 5) == 0
    found = parse_transcripts(turns.select("conv_id", "turn", "text"), fit(turns.where(~held)))
    return found.select("conv_id", "turn", "part", held.alias("held_out"), "role", "opens", "rendered")
