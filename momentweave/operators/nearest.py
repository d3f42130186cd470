"""Exact nearest neighbours by angular distance: cells of vectors with centre and radius, skipped by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import kept

SAMPLE, MOST_CELLS = 16_384, 1_024  # vectors that centres are fitted on, and centres: what the driver and each task hold
ROWS = 8_192  # vectors of a cell, as far as MOST_CELLS allows, and of one shard of it in any case
DIGITS, SLACK = 6, 1e-6


def _units(vectors: pa.Array, zero: int) -> np.ndarray:
    """Unit vectors with two more components: a zero vector is the unit of component `zero`, so a zero row (0) and a zero
    query (1) are at a right angle to everything, one another included."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.zeros((len(vectors), len(flat) // max(len(vectors), 1) + 2))
    m[:, :-2] = flat.reshape(len(vectors), -1)
    largest = np.abs(m).max(1, keepdims=True, initial=0)
    m /= np.where(largest > 0, largest, 1)  # so that squares neither overflow nor vanish
    size = np.linalg.norm(m, axis=1, keepdims=True)
    m /= np.where(size > 0, size, 1)
    m[size[:, 0] == 0, m.shape[1] - 2 + zero] = 1
    return m


def _angular(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 * (1 - a @ b.T), 0))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; equal to the angular ones between unit vectors, but centres are not units."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))


def _centres(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Means of n groups of the sample, each vector in the group of its nearest mean."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        own = _apart(sample, centres).argmin(1)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=n)
        np.add.at(sums, own, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _usable(df: DataFrame, name: str) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(name, F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def _in_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with cell, the nearest centre, and far, the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _apart(_units(batch.column("embedding"), 0), centres)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "far"])

    return vectors.mapInArrow(assign, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))


def _visits(queries: DataFrame, cells: list[int], centres: np.ndarray, radius: np.ndarray, rows: np.ndarray, k: int) -> DataFrame:
    """queries with each cell to visit. With a column `reached` (the k-th distance so far), all cells that could hold
    something as near, but those of the first visit; without it the nearest cells that hold k rows between them."""
    again = "reached" in queries.columns
    fields = [f for f in queries.schema.fields if f.name != "reached"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _apart(_units(batch.column("embedding"), 1), centres)
            order = np.argsort(far, axis=1, kind="stable")
            held = np.cumsum(rows[order], axis=1)
            first = np.zeros(far.shape, bool)
            np.put_along_axis(first, order, held - rows[order] < k, 1)
            if again:
                near = ~first & (far - radius <= batch.column("reached").to_numpy(zero_copy_only=False)[:, None] + SLACK)
            q, c = np.nonzero(near if again else first)
            kept_ = batch.select([f.name for f in fields]).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*kept_.columns, pa.array(np.asarray(cells, np.int32)[c])], [*kept_.schema.names, "cell"])

    return queries.mapInArrow(choose, T.StructType([*fields, T.StructField("cell", T.IntegerType())]))


def _best(far: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k least values; of equal ones the first."""
    if far.shape[1] <= k:
        return np.ones(far.shape, bool)
    kth = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
    less, equal = far < kth, far == kth
    return less | (equal & (np.cumsum(equal, axis=1) <= k - less.sum(1, keepdims=True)))


def _searched(visits: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance: the k nearest rows of each visited cell's shards.

    A shard's vectors come first in its partition and are held; its queries stream past them, a batch at a time, so a
    task holds one shard whatever the number of queries.
    """
    shards = placed.select("cell", "shard").distinct()
    asked = visits.join(shards, "cell").select("cell", "shard", F.lit(1).alias("side"), F.col("query_id"), F.lit(None).cast(placed.schema["vec_id"].dataType).alias("vec_id"), "embedding")
    there = placed.join(visits.select("cell").distinct(), "cell", "left_semi")
    rows = there.select("cell", "shard", F.lit(0).alias("side"), F.lit(None).cast(visits.schema["query_id"].dataType).alias("query_id"), "vec_id", "embedding").unionByName(asked)
    out = T.StructType([visits.schema["query_id"], placed.schema["vec_id"], T.StructField("distance", T.DoubleType())])
    schema = to_arrow_schema(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, ready = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("cell", "shard", "side")]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows]):
                cell, shard, side = (int(x[a]) for x in keys)
                if (cell, shard) != now:
                    now, ids, held, ready = (cell, shard), [], [], None
                part = batch.slice(a, b - a)
                if not side:
                    ids.append(part.column("vec_id"))
                    held.append(_units(part.column("embedding"), 0))
                    continue
                if ready is None:
                    ready = pa.concat_arrays(ids), np.concatenate(held)
                for r in range(0, b - a, 256):
                    some = part.slice(r, 256)
                    far = np.round(_angular(_units(some.column("embedding"), 1), ready[1]), DIGITS)
                    q, v = np.nonzero(_best(far, k))
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(q)), ready[0].take(pa.array(v)), pa.array(far[q, v])], schema=schema)

    return rows.repartition("cell", "shard").sortWithinPartitions("cell", "shard", "side", "vec_id").mapInArrow(search, out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, *, rows_per_cell: int = ROWS, sample: int = SAMPLE) -> DataFrame:
    """T4. query_id, rank, vec_id, distance: the k nearest of vectors (vec_id, embedding) to each of queries (query_id,
    embedding) by angular distance sqrt(2 (1 - cosine)), exactly; distances have six digits, ties go to the smaller vec_id.

    Each vector lies in the cell of its nearest centre. A query first visits the nearest cells that hold k rows. The k-th
    distance found there is a bound: of the other cells only those are visited whose centre lies no farther than that and
    the cell's radius. So vectors are shuffled twice, whatever the number of queries, and a query goes to the cells
    that it needs. Centres are fitted on a sample of at most `sample` rows, which bears on cost alone; there are at most
    MOST_CELLS, so what is sent to tasks is bounded, and larger cells have several shards.

    Zero vectors are sqrt(2) away from everything. Vectors and queries that are null, empty, or hold a null or non-finite
    component take no part. All must have one length.
    """
    vectors, queries = _usable(vectors, "vec_id"), _usable(queries, "query_id")
    size = F.size("embedding")
    told = vectors.agg(F.count("*").alias("n"), F.min(size).alias("a"), F.max(size).alias("b")).first()
    asked = queries.agg(F.count("*").alias("n"), F.min(size).alias("a"), F.max(size).alias("b")).first()
    answers = f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, distance double"
    if not told.n or not asked.n:
        return vectors.sparkSession.createDataFrame([], answers)
    if len({told.a, told.b, asked.a, asked.b}) > 1:
        raise ValueError("vectors and queries must have one length")
    few = vectors.select(F.xxhash64("vec_id").alias("h"), "embedding").orderBy("h").limit(sample).select("embedding").toArrow()
    units = _units(few.column("embedding").combine_chunks(), 0)
    centres = _centres(units, max(1, min(MOST_CELLS, told.n // rows_per_cell, len(units))))

    placed = kept(_in_cells(vectors, centres), "cells")
    cells = sorted(placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect())  # MOST_CELLS at most
    names = [c.cell for c in cells]
    about = (names, centres[names], np.array([c.radius for c in cells]), np.array([c.n for c in cells]), k)
    shards = F.element_at(F.create_map(*[F.lit(x) for c in cells for x in (c.cell, -(-c.n // rows_per_cell))]), F.col("cell"))
    placed = placed.select("cell", F.pmod(F.xxhash64("vec_id"), shards).cast("int").alias("shard"), "vec_id", "embedding")

    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    first = kept(ranked(_searched(_visits(queries, *about), placed, k)), "first_visits")
    reached = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("reached"))
    rest = _searched(_visits(queries.join(reached, "query_id"), *about), placed, k)
    return ranked(first.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "distance")
