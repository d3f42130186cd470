"""Operator 2: license scans. MinHash bands over text windows find templates, exact containment verifies them.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHINGLE, CONTAINED = 5, 0.8
#: Scales: from so many shingles of a template on, shingles of a window, and one-row bands of a window. A window is at
#: most a third of its template; windows of a text lie half a window apart, those of a template start everywhere.
SCALES = ((48, 16, 8), (12, 4, 4), (1, 1, 1))
MOST_KEYS = 20_000  # that are looked for inside a row of shingles; more are joined
WORDS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"  # what lies between words

#: Public license notices to look for. Fixed values.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
}


def _shingled(df: DataFrame, *keep: str) -> DataFrame:
    """keep, and h: hashes of the five-word shingles of text in order. Words are runs of letters and digits, in lower
    case; a null text, or one of fewer words, has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), WORDS), "")
    split = df.select(*keep, words.alias("words"))
    each = F.transform(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice("words", i, SHINGLE)))
    return split.select(*keep, F.when(F.size("words") >= SHINGLE, each).otherwise(F.array().cast("array<bigint>")).alias("h"))


def _permuted(df: DataFrame, bands: int) -> DataFrame:
    """df with p0, p1, ...: h under bands / 2 permutations, each computed once a row."""
    shuffled = lambda k: lambda x: F.xxhash64(x, F.lit(k))
    return df.withColumns({f"p{k}": F.transform("h", shuffled(k)) for k in range(bands // 2)})


def _windows(width: int, bands: int, stride: int) -> Column:
    """Keys of the windows of h, whose permutations are p0, p1, ...: a band is the least or the greatest hash of a
    window under one of bands / 2 permutations, so two windows of similarity j share one with probability
    1 - (1 - j)^bands. A window of one shingle is its own."""
    if width == 1:
        return F.transform("h", lambda x: F.xxhash64(F.lit(-1), x))
    starts = F.sequence(F.lit(1), F.size("h") - (width - 1), F.lit(stride))
    band = lambda k: lambda i: F.array(
        F.xxhash64(F.lit(width), F.lit(2 * k), F.array_min(F.slice(f"p{k}", i, width))),
        F.xxhash64(F.lit(width), F.lit(2 * k + 1), F.array_max(F.slice(f"p{k}", i, width))),
    )
    keys = [F.flatten(F.transform(starts, band(k))) for k in range(bands // 2)]
    return F.when(F.size("h") >= width, F.concat(*keys)).otherwise(F.array().cast("array<bigint>"))


def template_keys(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, shingles (different ones), keys by which windows of texts find each template, and their scale.

    A text that contains 0.8 of a template has, even if changes are spread evenly, windows of similarity 2/3 with it.
    A template is at least three windows long and those of a text lie half a window apart, so it has four of them at
    least, which miss all bands with probability (1/3)^(4 * bands): 6e-16 at 16 shingles, 3e-8 at 4. Templates under
    12 shingles are found by windows of one, of which equal ones collide for certain.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates.items()]))
    known = _shingled(spark.range(1).select(rows.alias("t")).select("t.*"), "license").where(F.size("h") > 0)
    keys, scale = F.array().cast("array<bigint>"), F.lit(-1)
    for k, (least, width, bands) in reversed(list(enumerate(SCALES))):
        keys = F.when(F.size("h") >= least, _windows(width, bands, 1)).otherwise(keys)
        scale = F.when(F.size("h") >= least, k).otherwise(scale)
    known = _permuted(known, max(bands for *_, bands in SCALES))
    return known.select("license", F.array_distinct("h").alias("shingles"), F.array_distinct(keys).alias("keys"), scale.alias("scale"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment: for each row of docs (doc_id, text) every template of which the whole text
    contains at least 0.8 of the different five-word shingles.

    Null texts and templates under five words find nothing. Rows that share a doc_id give each license once, with the
    greatest containment; so do rows without one. Extra columns are ignored. No rows, or no templates, give no rows.
    Whatever the number of templates, texts meet them by the same keys; up to MOST_KEYS are sought inside the row.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    found = template_keys(spark, templates).select("keys", "scale").collect() if templates else []  # an argument's keys
    if not found:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment")).where("false")
    known = template_keys(spark, templates)
    keys = sorted({k for r in found for k in r["keys"]})
    scales = [SCALES[k] for k in sorted({r["scale"] for r in found})]  # those that some template needs
    own = F.concat(*[_windows(width, bands, max(1, width // 2)) for _, width, bands in scales])
    texts = _permuted(_shingled(docs.select("doc_id", "text"), "doc_id"), max(bands for *_, bands in scales))
    places = known.select("license", F.explode("keys").alias("key"))
    if len(keys) <= MOST_KEYS:  # most texts share none: only the others' shingles are carried on
        wanted = F.array(*[F.lit(k).cast("bigint") for k in keys])
        # The row's number keeps the filter from being pushed into the windows, where each would permute the row anew.
        hits = texts.select("doc_id", "h", F.array_intersect(wanted, own).alias("keys"), F.monotonically_increasing_id().alias("row")).where(F.size("keys") > 0)
        licenses = hits.select("row", "doc_id", "h", F.explode("keys").alias("key")).join(F.broadcast(places), "key").drop("key").dropDuplicates(["row", "license"])
    else:
        texts = cut(texts.select("doc_id", "h", F.array_distinct(own).alias("keys"), F.monotonically_increasing_id().alias("row")), "shingles")
        met = texts.select("row", F.explode("keys").alias("key")).join(places, "key").select("row", "license").distinct()
        licenses = met.join(texts.select("row", "doc_id", "h"), "row")
    share = F.size(F.array_intersect("shingles", "h")) / F.size("shingles")
    checked = licenses.join(known.select("license", "shingles"), "license").select("doc_id", "license", share.alias("containment")).where(F.col("containment") >= CONTAINED)
    return checked.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


_VALUES = ", ".join("('" + name.replace("'", "''") + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES.items())
_SHINGLES = r"""SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i
        FROM (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x != '') AS w FROM TABLE))"""
OP2_SQL = f"""
WITH templates(id, text) AS (VALUES {_VALUES}),
t AS ({_SHINGLES.replace("TABLE", "templates")}),
d AS ({_SHINGLES.replace("TABLE", "(SELECT doc_id AS id, text FROM documents)")}),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id)
SELECT d.id AS doc_id, t.id AS license, count(*)::DOUBLE / n.n AS containment
FROM d JOIN t ON d.shingle = t.shingle JOIN n ON n.id = t.id
GROUP BY d.id, t.id, n.n HAVING count(*)::DOUBLE / n.n >= 0.8
"""
