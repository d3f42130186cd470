"""Operator 13: fill-in-middle transformation over run-length encoded character classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, table

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
RATE, SUFFIX_FIRST, SEED = 90, 20, 1  # percent of texts to cut, percent of those with the suffix first
CUT = ("n", "a", "b", "a_byte", "b_byte")
BLOCK = 1 << 20
_WIDTH = np.ones(256, np.int8)  # bytes of a character by its first byte; continuation bytes have none
_WIDTH[0x80:0xC0], _WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 0, 2, 3, 4


class Runs:
    """A text as maximal runs of characters of one class, a class being the characters of one width in UTF-8.

    width, units and place hold a run's class, and how many units (code points) and bytes lie before it; the last
    entries of units and place are the text's totals. Built block by block: beside the runs, memory is one block's.
    """

    def __init__(self, text: bytes, block: int = BLOCK):
        if text.isascii():
            self.width = np.array([1] if text else [], np.int8)
            self.units = self.place = np.array([0, len(text)] if text else [0], np.int64)
            return
        widths, counts = [], []
        for a in range(0, len(text), block):
            w = _WIDTH[np.frombuffer(text, np.uint8, min(block, len(text) - a), a)]
            w = w[w > 0]
            at = np.concatenate(([0], np.flatnonzero(w[1:] != w[:-1]) + 1, [len(w)]))
            if len(w):
                widths.append(w[at[:-1]])
                counts.append(np.diff(at))
        width, count = np.concatenate(widths), np.concatenate(counts)
        new = np.flatnonzero(np.concatenate(([True], width[1:] != width[:-1])))  # a run may cross blocks
        self.width, count = width[new], np.add.reduceat(count, new)
        self.units = np.concatenate(([0], np.cumsum(count)))
        self.place = np.concatenate(([0], np.cumsum(count * self.width)))

    def __len__(self) -> int:
        return int(self.units[-1])

    def byte(self, unit: int) -> int:
        """The byte at which a unit starts: binary search of its run, the rest by the run's width."""
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        return int(self.place[k]) + ((unit - int(self.units[k])) * int(self.width[k]) if k < len(self.width) else 0)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in CUT]))
def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """n units of a text, the two cuts that h1 and h2 draw from its n + 1 places, and their bytes."""
    for texts, h1, h2 in batches:
        out = []
        for text, x, y in zip(as_bytes(texts), h1.to_pylist(), h2.to_pylist(), strict=True):
            runs = Runs(text)
            n = len(runs)
            a, b = sorted((x % (n + 1), y % (n + 1)))
            out.append((n, a, b, runs.byte(a), runs.byte(b)))
        columns = np.array(out, np.int64).reshape(-1, 5)
        yield pa.StructArray.from_arrays([pa.array(c) for c in columns.T], list(CUT))


def fill_in_middle(docs: DataFrame, *, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output of every row of docs (doc_id, text).

    n counts code points; the first four 8-digit groups of sha256("seed:doc_id") draw the cuts and the form. psm puts
    prefix, suffix and middle after their sentinels, spm suffix, prefix and middle; the other texts stay as they are
    (plain, lengths null): those that draw it, empty ones, and those that hold a sentinel. A null text is the empty
    text, a null doc_id the empty string; repeated rows give repeated rows, since a form follows from doc_id and text
    alone. No rows give no rows, and other columns are ignored. doc_id may be of any type that casts to a string. The
    runs take at most 17 bytes a character (if each differs in class from the next) beside the text and a block of it.
    """
    starts = [s[:1] for s in sentinels]
    if len(set(sentinels)) < 3 or not all(starts) or any(c in s[1:] for s in sentinels for c in starts):
        raise ValueError("sentinels must differ, and the character that starts one must not occur later in any")
    bounded_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *draws).withColumn("at", cuts("text", "h1", "h2"))
    held = F.lit(False)
    for s in sentinels:
        held = held | F.contains("text", F.lit(s))
    plain = (F.col("at.n") == 0) | held | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    raw, a, b = F.col("text").cast("binary"), F.col("at.a_byte").cast("int"), F.col("at.b_byte").cast("int")
    part = lambda low, high: F.substring(raw, low + 1, high - low).cast("string")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, F.octet_length("text"))
    p, s, m = map(F.lit, sentinels)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
    shown = lambda c: F.when(F.col("form") != "plain", c)
    return drawn.withColumn("form", form).select(
        "doc_id", "text", F.col("at.n").alias("n"), "form", shown(F.col("at.a")).alias("prefix_chars"), shown(F.col("at.b") - F.col("at.a")).alias("middle_chars"),
        F.coalesce(output, F.col("text")).alias("output"),
    )


def restored(output: str | Column = "output", form: str | Column = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of. No sentinel can arise where two parts meet, so each occurs once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = sentinels
    middle = F.substring_index(output, m, -1)
    ahead = F.substring_index(output, m, 1)

    def between(first: str, second: str) -> tuple[Column, Column]:
        return F.substring_index(F.substring_index(ahead, second, 1), first, -1), F.substring_index(ahead, second, -1)

    (psm_prefix, psm_suffix), (spm_suffix, spm_prefix) = between(p, s), between(s, p)
    return F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents),
h AS (
  SELECT doc_id, t, n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
         ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM drawn),
cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
