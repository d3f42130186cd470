"""Operator 12: how far the sources of a language diverge in their terms, by wide vectors of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, TOP = 10, 10
SMOOTH = 2  # added to each count


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows of docs that hold the term).

    A text's terms and its distinct terms go through one explosion, told apart by kind, so the counts of both are
    aggregated before the shuffle and no row of a document crosses it.
    """
    text = F.coalesce("text", F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    terms = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.split(lowered, NOT_TERM).alias("terms"))
    both = terms.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("kind", "terms"))
    one = both.select("lang", "source", "kind", F.explode("terms").alias("term")).where("term != ''")
    return one.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("kind")).cast("long").alias("n"), F.sum("kind").cast("long").alias("docs"))


def _share(n: Column, mass: Column) -> Column:
    """1 + floor(10^9 (n + SMOOTH) / mass), by three digits at a time: exact for masses up to 9 * 10^15."""
    left, whole = n + SMOOTH, F.lit(0).cast("long")
    steps = []
    for scale in (1_000_000_000, 1_000_000, 1_000, 1):
        steps.append(_div(left, mass) * scale)
        left = left % mass * 1000
    for s in steps:
        whole = whole + s
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, b)


def _distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank, for docs (text, lang, source).

    Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII; a language keeps those in at least
    least_docs of its rows. A share is 1 + floor(10^9 (count + 2) / (N + 2 V)), N a group's occurrences of the V kept
    terms. Part `pair` ranks the other sources of the language by the distance of their shares, summed over all kept
    terms; part `term` ranks the top kept terms that a source has oftener than its language.

    Each kept term is one row: its counts pivoted into an array indexed by the language's sources, from which
    higher-order functions give the shares, the distances of pairs, and the terms. Sums of pairs start in the task.

    Nulls are empty strings, and languages and sources are compared as they stand. Each row counts as a document, so
    repeated rows count again. Equal values rank by item in order of bytes. A language without kept terms has pairs of
    value 0 and no terms; a language of one source has no pairs. No rows give no rows; other columns are ignored.
    Counts may reach 9 * 10^15 a language. A document's terms are one array: memory follows the longest text, by about
    ten times its bytes.
    """
    counts = cut(term_counts(docs), "term_counts")
    found = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = cut(found.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "sources")

    # One row a kept term, with the counts of the sources that have it, in order.
    of_term = counts.join(groups, ["lang", "source"]).groupBy("lang", "term")
    some = F.sort_array(F.collect_list(F.struct("at", "n"))).alias("some")
    kept = cut(of_term.agg(F.sum("docs").alias("docs"), some).where(F.col("docs") >= least_docs).select("lang", "term", "some"), "kept_terms")
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = kept.select("lang", F.inline("some")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    massed = groups.join(n_terms, "lang").join(totals, ["lang", "at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    masses = F.transform(F.sort_array(F.collect_list(F.struct("at", (F.col("n") + SMOOTH * F.col("v")).alias("mass")))), lambda r: r["mass"])
    langs = cut(massed.groupBy("lang").agg((F.sum("n") + SMOOTH * F.first("v")).alias("lang_mass"), masses.alias("masses")), "masses")

    # The wide vector: zeros between the sources that have the term.
    gaps = F.zip_with("some", F.concat(F.array(F.lit(None)), "some"), lambda e, b: F.when(
        e.isNotNull(), F.concat(F.array_repeat(F.lit(0).cast("long"), e["at"] - F.coalesce(b["at"], F.lit(-1)) - 1), F.array(e["n"]))
    ).otherwise(F.array_repeat(F.lit(0).cast("long"), F.size("masses") - 1 - b["at"])))
    wide = kept.join(langs, "lang").select("lang", "term", "lang_mass", "masses", F.flatten(gaps).alias("counts"))
    shares = F.zip_with("counts", "masses", lambda n, m: F.struct(n.alias("n"), _share(n, m).alias("p")))
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    wide = wide.select("lang", "term", shares.alias("wide"), _share(whole, F.col("lang_mass")).alias("q"))

    each = wide.select("lang", "wide", F.posexplode("wide").alias("i", "own"))
    after = F.slice("wide", F.col("i") + 2, F.size("wide"))
    apart = each.select("lang", "i", F.posexplode(F.transform(after, lambda o: _distance(F.col("own.p"), o["p"]))).alias("k", "f"))
    sums = cut(apart.groupBy("lang", "i", "k").agg(F.sum("f").alias("value")), "pair_sums")
    sums = sums.select("lang", "i", (F.col("i") + F.col("k") + 1).alias("j"), "value")
    sums = sums.union(sums.select("lang", F.col("j"), F.col("i"), "value"))
    others = groups.toDF("lang", "item", "j").join(groups.withColumnRenamed("at", "i"), "lang").where("i != j")
    pairs = others.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    best = F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.desc("value"), "term"))
    ahead = wide.select("lang", "term", "q", F.posexplode("wide").alias("at", "own")).where("own.n > 0 AND own.p > q")
    terms = ahead.select("lang", "at", "term", _distance(F.col("own.p"), F.col("q")).alias("value")).withColumn("rank", best).where(F.col("rank") <= top)
    terms = terms.join(groups, ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(terms)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
terms AS MATERIALIZED (SELECT lang, source, d, unnest(ts) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM terms GROUP BY 1, 2 HAVING count(DISTINCT d) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
mass AS (SELECT lang, source, sum(coalesce(n, 0))::HUGEINT + 2 * any_value(v) AS mass FROM groups JOIN v USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY 1, 2),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)::HUGEINT) // mass AS p
  FROM groups JOIN kept USING (lang) JOIN mass USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
lang_mass AS (SELECT lang, sum(n)::HUGEINT + 2 * any_value(v) AS mass FROM counts JOIN v USING (lang) GROUP BY 1),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)::HUGEINT) // any_value(mass) AS q FROM counts JOIN lang_mass USING (lang) GROUP BY 1, 2),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
