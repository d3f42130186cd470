"""Operator 4: mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2
BINS = 4096  # of the sampling order; only the bin where a source's target falls is ranked row by row
SEED = "mix-2"


def text_size(text: str | Column = "text") -> Column:
    """Words of a text (runs without ASCII white space); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with the sums, over all rows before each one in `order`, of the given columns.

    Rows are dealt by ranges of the order, so no task gets more than its share, whatever the keys; each adds the
    totals of the ranges before its own. Rows that are equal in the order stand in any order.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    parts = dealt.groupBy("part").agg(*[F.sum(c).alias(f"base_{name}") for name, c in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    parts = parts.select("part", *[F.coalesce(F.sum(f"base_{name}").over(before), F.lit(0)).alias(f"base_{name}") for name in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(parts), "part")  # as many rows as ranges: bounded
    return out.select(*df.columns, *[(F.col(f"base_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in sums.items()])


def _by_source() -> Column:
    return F.col("source").asc_nulls_last()


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """source, source_size, target of each source of sizes (source, size).

    Sources by code point, null last, weigh `weights`, repeating. They share `share` of all sizes by weight; a target
    stops at `copies` times its source's size, and the excess is shared again until none is above. That fixed point
    is found at once: by rising limit per weight, a source stops at its limit exactly if the level that the rest
    would have at it (what is left to share / weight left) is not below its limit per weight.
    """
    totals = running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [_by_source()], place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = totals.select("source", "source_size", weight.alias("weight")).withColumn("limit", F.col("source_size") / F.col("weight"))
    stood = running(weighed, [F.col("limit").asc(), _by_source()], taken=F.col("source_size"), weight_before=F.col("weight"))
    whole = stood.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (share * F.lit(whole["size"]) - copies * F.col("taken")) / (F.lit(whole["weight"]) - F.col("weight_before"))
    judged = stood.withColumn("level", level).withColumn("full", copies * F.col("source_size") <= F.col("level") * F.col("weight"))
    # Full sources come first in that order, so the common level is that of the first which is not full.
    common = judged.where("NOT full").agg(F.min_by("level", F.struct("limit", F.col("source").isNull(), "source")).alias("level")).first()["level"]
    target = F.when(F.col("full"), (copies * F.col("source_size")).cast("double")).otherwise(F.lit(common).cast("double") * F.col("weight"))
    return judged.select("source", "source_size", target.alias("target"))


def _unit(seed: str) -> Column:
    """A number in (0, 1) from md5(seed, doc_id, text)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with plan's columns. plan is one row a source: Spark broadcasts it if its file is small, and splits the hot
    source's rows otherwise."""
    return rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])


def inclusions(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, rest: words still to take) with `scale`: a document of the source is included with probability
    min(1, scale * size), and the words expected are `rest`.

    Documents that would exceed probability one are certain; the scale is that of the words that they leave over the
    sum of squares of the other sizes. Going down from the largest size, the first at which no more have to be
    certain is the right one. Different sizes are counted first, so the table is far smaller than that of documents.
    """
    kinds = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    square = (F.col("n").cast("decimal(38,0)") * F.col("size") * F.col("size")).cast("decimal(38,0)")
    down = running(kinds.withColumn("square", square), [_by_source(), F.col("size").desc()], words_above=F.col("n") * F.col("size"), square_above=F.col("square"))
    of = down.groupBy("source").agg(F.min("words_above").alias("w0"), F.min("square_above").alias("s0"), F.sum("square").alias("s"))
    at = _joined(_joined(down, of), wanted.select("source", "rest"))
    left = (F.col("s") - (F.col("square_above") - F.col("s0"))).cast("double")  # of this size and all smaller ones
    scale = (F.col("rest") - (F.col("words_above") - F.col("w0"))) / left
    fits = at.withColumn("scale", scale).where(F.col("scale") * F.col("size") <= 1)
    return _with(wanted, fits.groupBy("source").agg(F.max_by("scale", "size").alias("scale")))


def _with(wanted: DataFrame, found: DataFrame) -> DataFrame:
    return wanted.join(found, wanted["source"].eqNullSafe(found["source"]), "left").drop(found["source"])


def _ranked(rows: DataFrame, plan: DataFrame, bins: int) -> DataFrame:
    """rows with plan's columns, their inclusion probability p, Pareto's ratio and its bin."""
    out = _joined(rows, plan)
    some = (F.col("rest") > 0) & (F.col("size") > 0)
    out = out.withColumn("p", F.when(some, F.least(F.lit(1.0), F.coalesce("scale", F.lit(1.0)) * F.col("size"))).otherwise(0.0))
    ratio = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))  # random odds over inclusion odds
    out = out.withColumn("ratio", F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, ratio).otherwise(F.lit(float("inf"))))
    place = F.least(F.floor(F.col("ratio") / (1 + F.col("ratio")) * bins), F.lit(bins - 1))
    return out.withColumn("bin", F.when(F.col("p") > 0, place).otherwise(F.lit(bins)).cast("long"))


def mixing_plan(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, bins: int = BINS) -> DataFrame:
    """One row a source of sizes (doc_id, source, size, u): source_size, target, whole (copies for certain), rest (the
    words still wanted), scale (of inclusion), edge (the bin in which the rest is reached) and before (words below it)."""
    targets = source_targets(sizes, weights=weights, share=share, copies=copies)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = targets.withColumn("whole", F.least(F.floor(expected), F.lit(copies)).cast("long"))
    wanted = cut(wanted.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    plan = cut(inclusions(sizes, wanted), "inclusions")
    # A bin's words, summed before the shuffle: at most `bins` rows a source, whatever its share of the rows.
    filled = _ranked(sizes, plan, bins).where("p > 0").groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    filled = running(filled, [_by_source(), F.col("bin").asc()], before=F.col("words"))
    base = filled.groupBy("source").agg(F.min("before").alias("base"))
    filled = _joined(filled, base).withColumn("before", F.col("before") - F.col("base"))
    edge = filled.where("before < rest AND rest <= before + words").groupBy("source").agg(F.min("bin").alias("edge"), F.min("before").alias("before"))
    return cut(_with(plan, edge), "plan")


def apply_plan(rows: DataFrame, plan: DataFrame, *, bins: int = BINS) -> DataFrame:
    """rows (doc_id, source, size, u and others) with source_size, target and copies."""
    ranked = _ranked(rows, plan, bins).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    inside = running(ranked.where("bin = edge"), [_by_source(), *map(F.col, ("ratio", "doc_id", "size", "tie"))], upto=F.col("size"))
    base = inside.groupBy("source").agg(F.min("upto").alias("base"))
    upto = F.col("before") + F.col("upto") - F.col("base") + F.col("size") / 2
    inside = _joined(inside, base).withColumn("more", upto <= F.col("rest"))
    outside = ranked.where("edge IS NULL OR bin != edge").withColumn("more", F.coalesce(F.col("bin") < F.col("edge"), F.lit(False)))
    copies = (F.col("whole") + F.col("more").cast("long")).alias("copies")
    kept = [*rows.columns, "source_size", "target", copies]
    return inside.select(kept).unionByName(outside.select(kept))


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of each row of docs (doc_id, source, text).

    The whole part of target / source_size is allocated for certain, as copies of every document. The words left are
    drawn with probability proportional to size, at most one (so that long documents, whose words make up a target,
    are not left to chance): documents are ranked by Pareto's ratio of random odds u / (1 - u) to their inclusion
    odds p / (1 - p), and those whose words, in that order, fill the rest of the target are taken once more: the one
    that the target falls into only if at least half of it fits. So a source's taken words miss its target by at most
    half a document. Numbers u come from md5(seed, doc_id, text), so reruns agree; ties go by doc_id, then size.

    A null text has size 0; a source of size 0 has target 0 and no copies; null is a source like any other and comes
    last. Repeated rows are documents of their own: which of equal ones is taken is left open. Extra columns are
    ignored. No rows give no rows.
    """
    sizes = cut(docs.select("doc_id", "source", text_size().alias("size"), _unit(seed).alias("u")), "sizes")
    plan = mixing_plan(sizes, weights=weights, share=share, copies=copies, bins=bins)
    mixed = apply_plan(sizes, plan, bins=bins).drop("u")
    return mixed.withColumn("taken", F.col("copies") * F.col("size"))


def take_mix(docs: DataFrame, *, seed: str = SEED, bins: int = BINS, **settings) -> DataFrame:
    """The mix itself: docs' rows with all their columns, each as often as mix_sources takes it."""
    columns = ("doc_id", "source", text_size().alias("size"), _unit(seed).alias("u"))
    plan = mixing_plan(cut(docs.select(*columns), "sizes"), bins=bins, **settings)
    rows = docs.select(*columns, F.struct(*docs.columns).alias("row"))
    taken = apply_plan(rows, plan, bins=bins).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (('0x' || substr(md5('mix-2:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5)
           / 281474976710656.0::DOUBLE AS u
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM sizes GROUP BY source),
stood AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS taken_before,
         sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weight_left
  FROM totals),
levels AS (SELECT *, (1.5::DOUBLE * total - 2 * taken_before) / weight_left AS level FROM stood),
judged AS (SELECT *, 2 * source_size <= level * weight AS is_full FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN 2.0::DOUBLE * source_size
              ELSE weight * (SELECT arg_min(level, source_size::DOUBLE / weight) FROM judged WHERE NOT is_full) END AS target
  FROM judged),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM targets),
parts AS (SELECT *, target - whole * source_size AS rest FROM wanted),
-- A size is left to chance if, with all larger ones certain, its own probability is at most one.
chances AS (
  SELECT w.source, a.size,
         (w.rest - coalesce(sum(CASE WHEN b.size > a.size THEN b.n * b.size END), 0)) / sum(CASE WHEN b.size <= a.size THEN b.n * b.size * b.size END)::DOUBLE AS scale
  FROM parts w JOIN (SELECT DISTINCT source, size FROM sizes WHERE size > 0) a ON a.source IS NOT DISTINCT FROM w.source
  JOIN (SELECT source, size::HUGEINT AS size, count(*) AS n FROM sizes WHERE size > 0 GROUP BY ALL) b ON b.source IS NOT DISTINCT FROM w.source
  GROUP BY w.source, w.rest, a.size),
scales AS (SELECT source, arg_max(scale, size) AS scale FROM chances WHERE scale * size <= 1 GROUP BY source),
odds AS (
  SELECT s.*, w.source_size, w.target, w.whole, w.rest, CASE WHEN w.rest > 0 AND s.size > 0 THEN least(1, coalesce(c.scale, 1) * s.size) ELSE 0 END::DOUBLE AS p
  FROM sizes s JOIN parts w ON s.source IS NOT DISTINCT FROM w.source LEFT JOIN scales c ON c.source IS NOT DISTINCT FROM s.source),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) ELSE 'inf'::DOUBLE END, doc_id, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM odds)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN p > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""
