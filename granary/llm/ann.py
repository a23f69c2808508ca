"""Approximate nearest neighbours by cosine: stable projections in a kd-tree.

Vectors are scaled to length one, where the nearest by angle is the nearest by distance, and projected onto a few
Gaussian directions. The Gaussian law is 2-stable: a projected squared distance divided by the true one is chi-square
with as many degrees of freedom as there are directions.

The projections are indexed by a kd-tree in two parts. Its upper levels, split at the medians of a bounded sample, deal
all vectors into cells; a cell's segments of bounded size keep the lower levels. A query first goes to its own cell, then
to the cells that are not too far off, where leaves are taken in the order of their distance from the projected query.
Their points are verified on the original vectors, until the chi-square test says that a point so far away is nearer
than the k-th found with a probability of at most 1 - `sure`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

DIRECTIONS = 16
LEAF = 64
#: Vectors in a segment, and queries that it answers at once, about.
SEGMENT = 8192
QUERY_BLOCK = 4096
#: Cells of the vectors of a length at most, and vectors that their splits are fitted to, about.
CELLS = 4096
SAMPLE = 32_768


def chi_square(x: float, freedom: int) -> float:
    """Distribution function of the chi-square law for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 20.0 * freedom + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return high


def directed(length: int, directions: int, seed: int) -> np.ndarray:
    """The directions that vectors of a length are projected on."""
    return np.random.default_rng(seed).standard_normal((length, directions))


def projected(vectors: np.ndarray, directions: int, seed: int) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ directed(vectors.shape[1], directions, seed)


def splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper levels of a kd-tree: side and value at which each node is halved, level by level."""
    side, value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    held = [np.arange(len(points))]
    for node in range(2**depth - 1):
        at = held[node]
        if len(at):
            side[node] = int((points[at].max(0) - points[at].min(0)).argmax())
            value[node] = np.median(points[at, side[node]])
        right = points[at, side[node]] > value[node]
        held += [at[~right], at[right]]
    return side, value


def cell_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if tree is None:
        return node
    side, value = tree
    for _ in range(int(math.log2(len(side) + 1))):
        node = 2 * node + 1 + (points[np.arange(len(points)), side[node]] > value[node])
    return node - len(side)


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """The leaves of a kd-tree: halves along the widest side until at most `size` points are left."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        at = open_.pop()
        if len(at) <= size:
            out.append(at)
            continue
        held = points[at]
        side = int((held.max(0) - held.min(0)).argmax())
        half = np.argpartition(held[:, side], len(at) // 2)
        open_ += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return out


def reach_of(cosine: float, limit: float) -> float:
    """Squared projected distance from which the test holds for a k-th nearest of this cosine."""
    return limit * max(0.0, 2 - 2 * cosine) + 1e-12


class Segment:
    """Vectors with the kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        held = leaves(points, LEAF)
        order = np.concatenate(held)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.ends = np.cumsum([0, *(len(x) for x in held)])
        self.low = np.array([points[x].min(0) for x in held])
        self.high = np.array([points[x].max(0) for x in held])

    def search(self, query: np.ndarray, point: np.ndarray, k: int, limit: float, least: float = -math.inf) -> list[tuple[float, int, bool]]:
        """The k nearest found of a cosine of `least` or more, nearest first: cosine, id, and whether the vector is the query's."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        far = (gap * gap).sum(1)
        norm = math.sqrt((query * query).sum())
        found: list[tuple[float, int, bool]] = []
        reach = reach_of(least, limit) if least > -math.inf else math.inf
        order = np.argsort(far, kind="stable")
        at, step = 0, 1
        while at < len(order) and far[order[at]] < reach:
            some = order[at : at + step]
            some = some[far[some] < reach]
            at, step = at + step, min(2 * step, 32)
            start, count = self.ends[some], self.ends[some + 1] - self.ends[some]
            near = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
            away = self.points[near] - point
            near = near[(away * away).sum(1) < reach]
            cosine = (self.vectors[near] * query).sum(1) / (self.norms[near] * norm)
            better = cosine >= max(least, found[-1][0] if len(found) == k else -math.inf)
            if not better.any():
                continue
            cosine, near = cosine[better], near[better]
            if len(cosine) > k:
                best = np.lexsort((self.ids[near], -cosine))[:k]
                cosine, near = cosine[best], near[best]
            same = (self.vectors[near] == query).all(1)
            found = sorted([*found, *zip(cosine.tolist(), self.ids[near].tolist(), same.tolist())], key=lambda x: (-x[0], x[1]))[:k]
            if len(found) == k:
                reach = min(reach, reach_of(found[-1][0], limit))
        return found


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (of doubles) and its length of the rows that take part: those with an id and a vector without null or
    non-finite components that is not zero. Rows that are equal in both are one."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    held = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    held = held.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return held.distinct().withColumn("length", F.size("v"))


def placed(held: DataFrame, trees, directions: int, seed: int) -> DataFrame:
    """`held` (id, v, length) with the projection `p` and the cell of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length in sorted(set(batch.column("length").to_pylist())):
                part = batch.filter(pa.compute.equal(batch.column("length"), length))
                points = projected(matrix(part.column("v"), length), directions, seed)
                cells = pa.array(cell_of(points, trees.value.get(length)))
                p = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, directions), pa.int32()), pa.array(points.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("length"), p, cells], ["id", "v", "length", "p", "cell"])

    return held.select("id", "v", "length").mapInArrow(run, "id long, v array<double>, length int, p array<double>, cell long")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def answer(k: int, limit: float):
    """Searches a segment for a block of queries that visit it."""

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(asked):
            stacked = lambda x: np.stack(x.to_numpy())
            tree = Segment(points["id"].to_numpy(np.int64), stacked(points["v"]), stacked(points["p"]))
            for number, v, p, least in zip(asked["number"].tolist(), stacked(asked["v"]), stacked(asked["p"]), asked["least"].tolist()):
                out += [(number, i, s, same) for s, i, same in tree.search(v, p, k, limit, least)]
        return pd.DataFrame(out, columns=["number", "vec_id", "score", "same"])

    return run


def visited(points: DataFrame, visits: DataFrame, cells: DataFrame, k: int, limit: float) -> DataFrame:
    """number, vec_id, score, same: what each query finds in the cells that it visits.

    `visits`: length, cell, number, v, p, least. A cell's segments and blocks of queries are bounded; each block of
    queries meets each segment of the cell in one group.
    """
    blocks = visits.groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    split = cells.join(F.broadcast(blocks), ["length", "cell"]).select("length", "cell", "segments", "blocks")  # a row per cell
    group = ["length", "cell", "segment", "block"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = points.join(F.broadcast(split), ["length", "cell"]).withColumn("segment", F.pmod(F.xxhash64("id", "v"), F.col("segments")).cast("int")).withColumn("block", each("blocks"))
    there = visits.join(F.broadcast(split), ["length", "cell"]).withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")).withColumn("segment", each("segments"))
    here, there = here.select(*group, "id", "v", "p"), there.select(*group, "number", "v", "p", "least")
    return here.groupBy(*group).cogroup(there.groupBy(*group)).applyInPandas(answer(k, limit), "number long, vec_id long, score double, same boolean")


def search(rows: DataFrame, every: int, k: int = 5, sure: float = 0.95, key: str = "vec_id", vector: str = "embedding", seed: int = 29, directions: int = DIRECTIONS) -> DataFrame:
    """The `k` nearest found to each row whose id `every` divides: query_id, rank, vec_id, score, query_row.

    Every row is a candidate, also those that repeat an id with another vector, and each vector is compared with all
    others of its length. A row with a null id or vector, with null or non-finite components, or a zero vector takes no
    part, and rows equal in id and vector count once. Candidates are all rows but the query's own; ties go to the
    smaller id, so of rows with equal vectors the index needs the k + 1 of the smallest ids only, and a vector that
    very many rows share has no more places than that. Each row of a repeated query id is a query: query_row numbers
    them from 1 in the order of their vectors. With fewer candidates than `k` there are fewer ranks; no rows give no
    rows; other columns are ignored.

    `SAMPLE` vectors, drawn by hash, place the splits between cells; all are indexed.
    """
    spark = rows.sparkSession
    limit = quantile(sure, directions)
    whole = staged(usable(rows, key, vector), "vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    held = staged(whole.withColumn("place", first).filter(F.col("place") <= k + 1).drop("place"), "distinct")
    sizes = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    depth = {n: max(0, math.ceil(math.log2(min(CELLS, size / SEGMENT)))) for n, size in sizes.items()}
    share = min(1.0, SAMPLE / max(sum(sizes.values()), 1))
    drawn = held.filter(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).filter(F.col("length").isin([n for n, d in depth.items() if d]))
    trees, sample = {}, drawn.select("length", "v").toPandas() if any(depth.values()) else pd.DataFrame({"length": [], "v": []})
    for n, part in sample.groupby("length"):
        trees[n] = splits(projected(np.stack(part["v"].to_numpy()), directions, seed), depth[n])
    shared = spark.sparkContext.broadcast(trees)  # CELLS splits for each length
    points = staged(placed(held, shared, directions, seed), "points")
    box = [f(F.col("p")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(directions)]
    cells = staged(points.groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / SEGMENT).cast("int").alias("segments"), *box), "cells", small=True)
    own = F.row_number().over(Window.partitionBy("id").orderBy("length", "v"))
    queries = whole.filter(F.col("id") % every == 0).withColumn("query_row", own).withColumnRenamed("id", "query_id")
    # equal vectors ask once, for one more, as each has itself among the nearest
    asked = placed(queries.select(F.lit(0).cast("long").alias("id"), "v", "length").distinct(), shared, directions, seed)
    asked = staged(asked.withColumn("number", F.monotonically_increasing_id()).drop("id"), "queries", small=True)
    queries = staged(queries.join(asked.select("v", "number"), "v").select("query_id", "query_row", "number"), "asked", small=True)
    nowhere = F.lit(-math.inf).alias("least")
    near = staged(visited(points, asked.select("length", "cell", "number", "v", "p", nowhere), cells, k + 1, limit), "near", small=True)
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    so_far = top(near).groupBy("number").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least"))
    waiting = asked.join(so_far, "number", "left").withColumn("least", F.coalesce("least", nowhere))
    boxes: dict[int, list] = {}
    for r in cells.collect():  # CELLS rows at most for each length
        boxes.setdefault(r["length"], []).append(r)
    boxes = {n: (np.array([r["cell"] for r in x]), *(np.array([[r[f"{s}{i}"] for i in range(directions)] for r in x]) for s in ("low", "high"))) for n, x in boxes.items()}
    other = waiting.mapInArrow(further(spark.sparkContext.broadcast(boxes), limit), waiting.schema)
    other = staged(other, "visits")
    far = staged(visited(points, other, cells, k + 1, limit), "far", small=True)
    nearest = top(near.unionAll(far)).select("number", "vec_id", "score", "same")
    theirs = queries.join(nearest, "number").filter(~(F.col("same") & (F.col("vec_id") == F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    discard(whole, held, points, cells, asked, other)
    return theirs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


def further(boxes, limit: float):
    """Each query with every cell but its own that may hold a nearer vector than its k-th so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, home, least = (batch.column(c).to_pylist() for c in ("length", "cell", "least"))
            owner, there, held = [], [], 0
            for at in range(batch.num_rows):
                cell, low, high = boxes.value[lengths[at]]
                point = np.array(batch.column("p")[at].as_py())
                gap = np.maximum(0, np.maximum(low - point, point - high))
                reach = reach_of(least[at], limit) if least[at] > -math.inf else math.inf
                go = cell[((gap * gap).sum(1) < reach) & (cell != home[at])]
                owner.append(np.full(len(go), at))
                there.append(go)
                held += len(go)
                if held and (held >= CELLS or at == batch.num_rows - 1):
                    out = batch.take(pa.array(np.concatenate(owner).astype(np.int64)))
                    yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(np.concatenate(there), pa.int64()))
                    owner, there, held = [], [], 0

    return run
