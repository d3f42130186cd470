"""Operator 9: approximate nearest neighbours by hierarchical navigable small-world graphs, one a shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, mix, table

SHARD_ROWS = 8_192  # different vectors of one graph, about
QUERY_ROWS = 2_048  # queries that search a graph together
LINKS, BUILD = 12, 48  # neighbours of a node (twice that on the ground layer), and breadth of the search for them
BREADTHS = (64, 128, 256, 512, 1024)  # of a query's search: the first that finds RECALL of the trials' neighbours
RECALL = 0.95
BAND = 1.15  # ratio of the longest to the shortest vector of a band
CELLS, SAMPLE = 512, 16_384  # cells of a band, and rows that their centres are fitted on, at most
TRIALS, SHARE = 128, 0.98  # queries that are answered exactly, and how many of their neighbours must lie in the cells visited
_BATCH = 512  # points that enter a graph together
_STEP = 4  # nodes that a search expands together


@dataclass(frozen=True)
class Graph:
    """A graph over the rows of `points`. links[k] is layer k's flat neighbour matrix, a row a point (unused above a
    point's own level), padded with -1."""

    points: np.ndarray
    level: np.ndarray
    links: tuple[np.ndarray, ...]
    entry: int


def _levels(n: int, links: int) -> np.ndarray:
    """Geometric levels from hashes of row numbers, so a rebuilt graph is the same."""
    u = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(links)).astype(np.int64)


def _diverse(points: np.ndarray, near: np.ndarray, gap: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 where none) those that lie nearer to the row than to a kept one;
    then the nearest of the rest, `width` in all, padded with -1. All rows are pruned together, a column at a time."""
    n, k = near.shape
    there = near >= 0
    if k <= width:
        return np.concatenate((near, np.full((n, width - k), -1)), 1)
    kept = np.zeros((n, k), bool)
    x = points[near]
    square = (x**2).sum(2)
    apart = square[:, :, None] + square[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
    for j in range(k):
        crowded = ((apart[:, j, :j] < gap[:, j][:, None] - 1e-6) & kept[:, :j]).any(1)
        kept[:, j] = ~crowded & there[:, j] & (kept.sum(1) < width)
    rank = np.where(kept, np.arange(k), np.where(there, k, 2 * k) + np.arange(k))
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    return np.where(np.take_along_axis(there, order, 1), np.take_along_axis(near, order, 1), -1)


def _distances(points: np.ndarray, square: np.ndarray, queries: np.ndarray, own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its nodes; inf where a node is -1."""
    d = square[nodes] + own[:, None] - 2 * np.matmul(points[nodes], queries[:, :, None])[:, :, 0]
    return np.where(nodes >= 0, d, np.inf)


def _walk(points, square, links: np.ndarray, queries: np.ndarray, own: np.ndarray, start: np.ndarray, breadth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer from start (a column of nodes a query, -1 where none), all queries together: the
    nearest `breadth` nodes found and their distances. A step expands each unfinished query's nearest open nodes."""
    n = len(queries)
    seen = np.zeros((n, size + 1), bool)  # the last column takes the padding
    every = np.arange(n)
    seen[every[:, None], start] = True
    pool, far = np.full((n, breadth), -1), np.full((n, breadth), np.inf, np.float32)
    pool[:, : start.shape[1]], far[:, : start.shape[1]] = start, _distances(points, square, queries, own, start)
    done, live = pool < 0, every
    while len(live):
        waiting = np.where(done[live], np.inf, far[live])
        pick = np.argpartition(waiting, min(_STEP, breadth) - 1, axis=1)[:, :_STEP]
        open_ = np.take_along_axis(waiting, pick, 1) < np.inf
        more = open_.any(1)  # all in the pool are expanded: it can't improve
        live, pick, open_ = live[more], pick[more], open_[more]
        if not len(live):
            break
        done[live[:, None], pick] = True
        nodes = np.where(open_, np.take_along_axis(pool[live], pick, 1), size)
        options = np.sort(links[nodes].reshape(len(live), -1), axis=1)
        new = ~seen[live[:, None], options] & (options >= 0)
        new[:, 1:] &= options[:, 1:] != options[:, :-1]
        seen[live[:, None], options] = True
        row, column = np.nonzero(new)
        node = options[row, column]
        d = np.full(options.shape, np.inf, np.float32)
        d[row, column] = square[node] + own[live[row]] - 2 * np.einsum("nd,nd->n", points[node], queries[live[row]])
        both = np.concatenate((far[live], d), 1)
        order = np.argpartition(both, breadth - 1, axis=1)[:, :breadth]
        far[live] = np.take_along_axis(both, order, 1)
        pool[live] = np.take_along_axis(np.concatenate((pool[live], np.where(new, options, -1)), 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate((done[live], ~new), 1), order, 1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(pool, order, 1), np.take_along_axis(far, order, 1)


def build_graph(points: np.ndarray, *, links: int = LINKS, breadth: int = BUILD) -> Graph:
    """Insert points in batches. Each point searches the graph as it stands, layer by layer, for its candidates, to
    which those of its own batch are added; they are thinned to diverse ones, linked both ways, and a node with too
    many links is thinned again."""
    n = len(points)
    level, points = _levels(n, links), np.ascontiguousarray(points, np.float32)  # to find the way; scores are taken from the original vectors
    square = (points**2).sum(1)
    layers = int(level.max(initial=0)) + 1
    width = [links * 2 if k == 0 else links for k in range(layers)]
    table_ = [np.full((n + 1, w), -1) for w in width]  # the last row belongs to the padding
    entry, top = 0, int(level[0]) if n else 0
    first = 0
    while first < n:
        last = min(n, first + min(_BATCH, max(32, first)))
        batch = np.arange(first, last)
        q, own = points[batch], square[batch]
        mates = own[:, None] + own - 2 * q @ q.T
        np.fill_diagonal(mates, np.inf)
        start = np.full((len(batch), 1), entry)
        for k in range(layers - 1, -1, -1):
            found = gap = None
            if first and k <= top:
                found, gap = _walk(points, square, table_[k], q, own, start, breadth if (level[batch] >= k).any() else 1, n)
                start = found[:, :1]
            mine = np.flatnonzero(level[batch] >= k)
            if not len(mine):
                continue
            d = np.where((level[batch] >= k)[None, :], mates[mine], np.inf)
            few = np.argpartition(d, min(width[k], len(batch) - 1), axis=1)[:, : width[k]]
            d = np.take_along_axis(d, few, 1)
            near = np.where(d < np.inf, batch[few], -1)
            if found is not None:
                near, d = np.concatenate((found[mine], near), 1), np.concatenate((gap[mine], d), 1)
            order = np.argsort(d, axis=1, kind="stable")
            near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
            chosen = _diverse(points, near, d, width[k] // 2)
            table_[k][batch[mine], : width[k] // 2] = chosen
            _link_back(points, square, table_[k], batch[mine], chosen)
        if level[batch].max() > top or not first:
            entry, top = int(batch[level[batch].argmax()]), int(level[batch].max())
        first = last
    return Graph(points, level, tuple(table_), entry)


def _link_back(points, square, links: np.ndarray, sources: np.ndarray, chosen: np.ndarray) -> None:
    """Give the chosen nodes their links to sources, in place; those that get too many keep diverse ones."""
    width = links.shape[1]
    a, b = np.repeat(sources, chosen.shape[1]), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    if not len(b):
        return
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    nodes, start, count = np.unique(b, return_index=True, return_counts=True)
    extra = np.full((len(nodes), count.max()), -1)
    row = np.repeat(np.arange(len(nodes)), count)
    extra[row, np.arange(len(b)) - start[row]] = a
    extra[(extra[:, :, None] == links[nodes][:, None, :]).any(2)] = -1  # linked already
    for part in np.array_split(np.arange(len(nodes)), -(-len(nodes) * (width + extra.shape[1]) // (1 << 14))):
        both = np.concatenate((links[nodes[part]], extra[part]), 1)
        gap = _distances(points, square, points[nodes[part]], square[nodes[part]], both)
        order = np.argsort(gap, axis=1, kind="stable")[:, : 3 * width]
        both, gap = np.take_along_axis(both, order, 1), np.take_along_axis(gap, order, 1)
        full = (both >= 0).sum(1) > width
        links[nodes[part][~full]] = both[~full][:, :width] if both.shape[1] >= width else np.pad(both[~full], ((0, 0), (0, width - both.shape[1])), constant_values=-1)
        if full.any():
            links[nodes[part][full]] = _diverse(points, both[full], gap[full], width)


def search_graph(graph: Graph, queries: np.ndarray, k: int, *, breadth: int = BREADTHS[0]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of about the k nearest points of each query (k columns, padded with -1 and inf):
    greedily down the upper layers, then a best-first search of the given breadth on the ground layer."""
    n, size = len(queries), len(graph.points)
    if not n or not size:
        return np.full((n, k), -1), np.full((n, k), np.inf)
    q = np.ascontiguousarray(queries, np.float32)
    square, own = (graph.points**2).sum(1), (q**2).sum(1)
    start = np.full((n, 1), graph.entry)
    for links in graph.links[:0:-1]:
        start = _walk(graph.points, square, links, q, own, start, 1, size)[0]
    pool, far = _walk(graph.points, square, graph.links[0], q, own, start, max(breadth, k), size)
    return pool[:, :k], far[:, :k]


def usable(vector: str = "embedding") -> Column:
    """True for a vector that is not null, empty or zero and holds no null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(array.flatten(), float).reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def _points(rows: DataFrame, k: int) -> DataFrame:
    """The different vectors of rows (vec_id, v, row, h): point, h, v, d (length), band (of its norm) and members, those
    of its rows that can be among anybody's k nearest: the k + 1 of smallest vec_id, since equal scores go by it."""
    by = Window.partitionBy("h", "v").orderBy("vec_id", "row")
    first = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    members = F.array_sort(F.collect_list(F.struct("vec_id", "row")))
    largest = F.array_max(F.transform("v", F.abs))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("largest")) * (x / F.col("largest")))
    out = first.groupBy("h", "v").agg(members.alias("members")).withColumn("largest", largest)
    norm = F.log("largest") + F.log(square) / 2
    return out.select(F.monotonically_increasing_id().alias("point"), "h", "v", F.size("v").alias("d"), F.floor(norm / float(np.log(BAND))).cast("int").alias("band"), "members")


def _centres(points: DataFrame, shard_rows: int) -> dict[tuple[int, int], np.ndarray]:
    """Centres of the cells of each (d, band) of points: one cell for shard_rows points, CELLS at most, fitted by
    k-means on a sample of SAMPLE rows at most."""
    found = {}
    for r in points.groupBy("d", "band").agg(F.count("*").alias("n")).collect():
        cells = min(CELLS, -(-r["n"] // shard_rows))
        found[r["d"], r["band"]] = cells, min(1.0, min(SAMPLE, max(256, 32 * cells)) / r["n"])
    share = F.create_map(*[x for (d, b), (_, s) in found.items() for x in (F.lit(f"{d} {b}"), F.lit(s))])
    unit = F.xxhash64("h").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    sample = points.where(unit < share[F.concat_ws(" ", "d", "band")]).select("d", "band", "h", "v").toPandas().sort_values("h")
    out = {}
    for (d, band), (cells, _) in found.items():
        x = sample.loc[(sample["d"] == d) & (sample["band"] == band), "v"]
        x = np.stack(x.to_list()) if len(x) else np.zeros((1, d))
        centres = x[:cells]
        for _ in range(8):
            near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            n = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        out[d, band] = centres
    return out


@dataclass(frozen=True)
class _Cells:
    """The cells of one vector length: ids, centres, how far above its centre a cell's best product may lie, and points."""

    ids: np.ndarray
    centres: np.ndarray
    above: np.ndarray
    n: np.ndarray

    def order(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cells by expected product with each query (of unit length), best first, and these products."""
        score = _unit(queries) @ self.centres.T + self.above
        at = np.argsort(-score, axis=1, kind="stable")
        return at, np.take_along_axis(score, at, 1)

    def visits(self, queries: np.ndarray, first: int, least: int, reached: np.ndarray) -> list[np.ndarray]:
        """Ids of the cells that each query visits. reached is nan at first: then the first cells in order, and more until
        they hold `least` points. Later it is the score of the last of `least` rows found: then every other cell whose
        expected product is as great."""
        at, score = self.order(queries)
        held = np.cumsum(self.n[at], axis=1) - self.n[at]
        begin = (np.arange(at.shape[1]) < first) | (held < least)
        longest = np.abs(queries).max(1)
        size = longest * np.sqrt(((queries / longest[:, None]) ** 2).sum(1))
        further = ~begin & (score >= (reached / size)[:, None])
        return [self.ids[a[m]] for a, m in zip(at, np.where(np.isnan(reached)[:, None], begin, further), strict=True)]


def _built(group: pa.Table) -> pa.Table:
    """A shard's points (shard, point, v, members) as one row: its graph in flat arrays, and its members."""
    group = group.take(np.lexsort((group["point"].to_numpy(),)))
    v = _matrix(group["v"])
    longest = np.abs(v).max() * np.sqrt(((v / np.abs(v).max()) ** 2).sum(1).max())
    inner = v / longest
    # Inner products become distances: each vector gets a coordinate that makes it as long as the longest, queries get 0.
    graph = build_graph(np.column_stack((inner, np.sqrt(np.maximum(1 - (inner**2).sum(1), 0)))))
    members = group["members"].combine_chunks()
    flat = members.flatten()
    row = {
        "shard": group["shard"][0].as_py(), "d": v.shape[1], "v": v.ravel(), "level": graph.level, "links": np.concatenate([x.ravel() for x in graph.links]), "entry": graph.entry,
        "layers": len(graph.links), "vec_id": flat.field("vec_id").to_numpy(), "row": flat.field("row").to_numpy(), "size": np.diff(members.offsets.to_numpy()),
    }
    return pa.table({c: pa.array([x], _GRAPH.field(c).type) for c, x in row.items()}, schema=_GRAPH)


_LONGS = pa.list_(pa.int64())
_GRAPH = pa.schema([
    ("shard", pa.int64()), ("d", pa.int64()), ("v", pa.list_(pa.float64())), ("level", _LONGS), ("links", _LONGS), ("entry", pa.int64()), ("layers", pa.int64()), ("vec_id", _LONGS), ("row", _LONGS), ("size", _LONGS),
])
_GRAPH_TYPE = "shard long, d long, v array<double>, level array<long>, links array<long>, entry long, layers long, vec_id array<long>, row array<long>, size array<long>"
_FOUND = pa.schema([("breadth", pa.int64()), ("point", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])


def _answers(graphs: pa.Table, asked: pa.Table, k: int, breadths: tuple[int, ...]) -> pa.Table:
    """breadth, point, vec_id, row, score: each asked point's k + 1 best rows in one shard."""
    if not len(graphs) or not len(asked):
        return _FOUND.empty_table()
    g = {c: graphs[c][0] for c in graphs.column_names}
    array = lambda c: g[c].values.to_numpy()
    v = array("v").reshape(-1, g["d"].as_py())
    longest = np.abs(v).max() * np.sqrt(((v / np.abs(v).max()) ** 2).sum(1).max())
    inner = v / longest
    width, links, at = [2 * LINKS] + [LINKS] * (g["layers"].as_py() - 1), [], 0
    for w in width:
        links.append(array("links")[at : at + (len(v) + 1) * w].reshape(-1, w))
        at += (len(v) + 1) * w
    graph = Graph(np.column_stack((inner, np.sqrt(np.maximum(1 - (inner**2).sum(1), 0)))).astype(np.float32), array("level"), tuple(links), g["entry"].as_py())
    size, ids, rows = array("size"), array("vec_id"), array("row")
    first = np.cumsum(size) - size
    points, q = asked["point"].to_numpy(), _matrix(asked["v"])
    out = []
    for breadth in breadths:
        for a in range(0, len(q), QUERY_ROWS // 4):
            part, mine = q[a : a + QUERY_ROWS // 4], points[a : a + QUERY_ROWS // 4]
            near, _ = search_graph(graph, np.column_stack((_unit(part), np.zeros(len(part)))), k + 9, breadth=breadth)
            query, column = np.nonzero(near >= 0)
            node = near[query, column]
            score = np.einsum("nd,nd->n", part[query], v[node])
            source = np.repeat(np.arange(len(node)), size[node])
            member = np.arange(len(source)) - np.repeat(np.cumsum(size[node]) - size[node], size[node]) + first[node][source]
            query, score = query[source], score[source]
            order = np.lexsort((rows[member], ids[member], -score, query))
            query = query[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            order = order[place <= k]
            out.append(pd.DataFrame({"breadth": breadth, "point": mine[query[place <= k]], "vec_id": ids[member[order]], "row": rows[member[order]], "score": score[order]}))
    return pa.Table.from_pandas(pd.concat(out), _FOUND, preserve_index=False)


def nearest(vectors: DataFrame, queries: Column, *, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each row of vectors that `queries` selects.

    vectors: vec_id, embedding. Nearness is the inner product in double precision, taken from the original vectors;
    the candidates are all rows of the same length but the query's own, ties go to the smaller vec_id. Rows whose
    vec_id is null or whose vector isn't usable() take no part. Rows that share a vec_id are rows of their own, each
    with its own answers. Extra columns are ignored. No rows give no rows.

    Different vectors are dealt by length, band of norms and nearest centre into cells, and these into shards of
    about shard_rows; each shard's graph is built once and kept as a row. TRIALS queries are also answered exactly,
    by a scan: a query visits as many cells, in order of their expected products, as hold SHARE of the trials'
    neighbours, and more until they hold k + 1 points; it searches with the first breadth that finds RECALL of the
    trials' (or the largest). Then it goes on to every cell whose expected product is as great as the score of its own
    last row, so a query unlike the trials gets its rows too. Recall is held on any data, and it is the cost that follows
    from how well the vectors cluster.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    known = vectors.where(F.col("vec_id").isNotNull() & usable())
    rows = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = cut(rows.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("v")}), "vectors")
    points = cut(_points(rows, k), "points")
    if points.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    centres = _centres(points, shard_rows)
    base = {key: i * CELLS for i, key in enumerate(sorted(centres))}  # cells are numbered through all bands
    shared = spark.sparkContext.broadcast(centres)  # at most CELLS vectors a band

    @F.arrow_udf("struct<cell: bigint, square: double>")
    def placed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for d, band, v in batches:
            cell, square = np.zeros(len(d), np.int64), np.zeros(len(d))
            keys = np.column_stack((d.to_numpy(), band.to_numpy()))
            for key in np.unique(keys, axis=0):
                at = np.flatnonzero((keys == key).all(1))
                c, x = shared.value[tuple(key.tolist())], _matrix(v.take(pa.array(at)))
                far = (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T
                cell[at], square[at] = base[tuple(key.tolist())] + far.argmin(1), np.maximum(far.min(1), 0)
            yield pa.StructArray.from_arrays([pa.array(cell), pa.array(square)], ["cell", "square"])

    points = cut(points.withColumn("p", placed("d", "band", "v")).select("point", "h", "v", "d", "band", "members", "p.*"), "placed")
    sizes = cut(points.groupBy("d", "band", "cell").agg(F.count("*").alias("n"), F.sqrt(F.avg("square")).alias("radius")).withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("long")), "cells")
    cells: dict[int, _Cells] = {}
    found = sizes.toPandas()  # at most CELLS rows a band
    for d, g in found.groupby("d"):
        above = g["radius"].to_numpy() * np.sqrt(2 * np.log(g["n"].to_numpy() + 1) / d)
        cells[int(d)] = _Cells(g["cell"].to_numpy(), np.stack([centres[d, r.band][r.cell - base[d, r.band]] for r in g.itertuples()]), above, g["n"].to_numpy())

    # A shard is a cell and a part of it, as one number.
    shard = lambda part: F.col("cell") * F.lit(1 << 32) + part
    dealt = points.join(F.broadcast(sizes.select("cell", "shards")), "cell").select(shard(F.pmod(F.xxhash64("h"), "shards")).alias("shard"), "point", "v", "members")
    graphs = cut(dealt.groupBy("shard").applyInArrow(_built, _GRAPH_TYPE), "graphs")

    asked_rows = cut(rows.where("is_query").select("vec_id", "row", "h", "v").join(points.select("point", "h", "v", "d"), ["h", "v"]).select("vec_id", "row", "point", "d"), "asked")
    asked = points.select("point", "v", "d").join(asked_rows.select("point").distinct(), "point", "left_semi")

    def answered(asked: DataFrame, first: dict[int, int], breadths: tuple[int, ...]) -> DataFrame:
        visits = spark.sparkContext.broadcast((cells, first))

        @F.arrow_udf("array<bigint>")
        def visited(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for d, v, reached in batches:
                out: list = [None] * len(d)
                held, d, reached = visits.value, d.to_numpy(), reached.to_numpy(zero_copy_only=False).astype(np.float64)
                for size in np.unique(d).tolist():
                    at = np.flatnonzero(d == size)
                    for i, c in zip(at.tolist(), held[0][size].visits(_matrix(v.take(pa.array(at))), held[1][size], k + 1, reached[at]), strict=True):
                        out[i] = c
                yield pa.array(out, pa.list_(pa.int64()))

        sent = asked.select("point", "v", F.explode(visited("d", "v", "reached")).alias("cell")).join(F.broadcast(sizes.select("cell", "shards")), "cell")
        sent = sent.select("point", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), shard)).alias("shard"))
        sent = cut(sent, "sent")
        blocks = sent.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
        copies = graphs.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        sent = sent.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("point"), "blocks").cast("int")).drop("blocks")
        # One group is a shard's graph with one block of queries: both bounded.
        pairs = copies.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
        found = pairs.applyInArrow(lambda g, q: _answers(g, q, k, breadths), "breadth long, point long, vec_id long, row long, score double")
        return ranked(found)

    by = Window.partitionBy("breadth", "point").orderBy(F.desc("score"), "vec_id", "row")
    ranked = lambda found: found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1)
    asked = asked.withColumn("reached", F.lit(None).cast("double"))
    trials = asked.orderBy(F.xxhash64("point"), "point").limit(TRIALS)
    first, breadth = _settings(points, trials, cells, answered, k)
    begun = cut(answered(asked, first, (breadth,)), "answers")
    last = begun.groupBy("point").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("reached"))
    further = answered(asked.drop("reached").join(last, "point"), first, (breadth,))
    best = ranked(begun.drop("place").union(further.drop("place"))).groupBy("point").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "row", "score"))).alias("best"))
    others = F.slice(F.filter("best", lambda r: r["row"] != F.col("row")), 1, k)
    answers = asked_rows.join(best, "point").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "r"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")


def _settings(points: DataFrame, trials: DataFrame, cells: dict[int, _Cells], answered, k: int) -> tuple[dict[int, int], int]:
    """How many cells a query of each length visits, and the breadth of its searches, from trials (point, v, d)."""
    held = trials.toPandas()
    of = {int(d): (g["point"].to_numpy(), np.stack(g["v"].to_list())) for d, g in held.groupby("d")}
    schema = pa.schema([("trial", pa.int64()), ("point", pa.int64()), ("cell", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pd.DataFrame] = {}
        for batch in batches:
            lengths = batch["d"].to_numpy()
            for d in np.unique(lengths).tolist():
                if d not in of:
                    continue
                at = np.flatnonzero(lengths == d)
                score = of[d][1] @ _matrix(batch["v"].take(pa.array(at))).T
                top = np.argpartition(-score, min(k, len(at) - 1), axis=1)[:, : k + 1]
                new = pd.DataFrame({
                    "trial": np.repeat(of[d][0], top.shape[1]), "point": batch["point"].to_numpy()[at][top].ravel(), "cell": batch["cell"].to_numpy()[at][top].ravel(),
                    "score": np.take_along_axis(score, top, 1).ravel(),
                })
                both = pd.concat([kept[d], new]) if d in kept else new
                both = both.sort_values(["trial", "score", "point"], ascending=[True, False, True])
                kept[d] = both[both.groupby("trial").cumcount() <= k]
        for frame in kept.values():
            yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)

    best = Window.partitionBy("trial").orderBy(F.desc("score"), "point")
    exact = points.select("point", "d", "cell", "v").mapInArrow(scan, "trial long, point long, cell long, score double")
    exact = exact.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place").toPandas()  # TRIALS times k rows
    first = {d: len(c.ids) for d, c in cells.items()}
    for d, (ids, v) in of.items():
        order = cells[d].ids[cells[d].order(v)[0]]
        place = {(p, c): i for p, row in zip(ids.tolist(), order.tolist(), strict=True) for i, c in enumerate(row)}
        mine = exact[exact["trial"].isin(ids)]
        needed = np.sort([place[t, c] for t, c in zip(mine["trial"], mine["cell"], strict=True)])
        first[d] = int(needed[min(len(needed) - 1, int(np.ceil(SHARE * len(needed))))]) + 1
    floor = exact.groupby("trial")["score"].min()  # a row found counts if it is as near as the last exact one
    got = answered(trials, first, BREADTHS).toPandas()
    share = got[got["score"] >= got["point"].map(floor) - 1e-12 * got["point"].map(floor).abs()].groupby("breadth").size() / len(exact)
    return first, next((b for b in BREADTHS if share.get(b, 0) >= RECALL), BREADTHS[-1])


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
