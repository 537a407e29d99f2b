"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors get one coordinate more, so that the largest inner product is the
shortest distance, and are projected on a few Gaussian (2-stable) directions.
A squared projected distance over the squared true distance is then chi-square
distributed.  A kd-tree over a bounded sample of projections cuts the space
into cells; inside a task each cell has a kd-tree of its own.

A query takes the points of its own cell in the order of projected distance and
verifies them on the original vectors, until the chi-square test says that a
point further out is closer than the k-th found with a chance of at most
``1 - CONFIDENCE``.  It then visits the cells of others that its stopping
radius reaches, with what it has found so far as a start.

Equal vectors are one point with its smallest ids, so a vector that a third of
all rows share is one point.  Cells with too many points or queries are split
by hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.sources.storage import write_shared

DIRECTIONS = 8  # even, for the closed form below
CONFIDENCE = 0.97
# The bound of the sample that the cells are fitted on, and of the cells.
SAMPLE, MOST_CELLS = 8192, 256
CELL_POINTS, CHUNK_QUERIES, LEAF = 8192, 1024, 48
STEP_LEAVES = 8


def chi_square_quantile(share: float, freedom: int) -> float:
    """By bisection on the closed form for an even number of degrees of freedom."""
    low, high = 0.0, 400.0
    for _ in range(80):
        middle = (low + high) / 2
        tail = math.exp(-middle / 2) * sum((middle / 2) ** i / math.factorial(i) for i in range(freedom // 2))
        low, high = (middle, high) if 1 - tail < share else (low, middle)
    return high


def directions(size: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size + 1, DIRECTIONS))


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that halves the widest side."""
    leaves, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        part = points[rows]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(rows) else 0
        if len(rows) <= leaf or part[:, side].max() == part[:, side].min():
            leaves.append(rows)
            continue
        order = np.argsort(part[:, side], kind="stable")
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


class Cells:
    """The cells of the whole space: a kd-tree of split planes, and what each cell's box is."""

    def __init__(self, sample: np.ndarray, count: int) -> None:
        self.planes: list[tuple[int, float] | None] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.children: list[tuple[int, int]] = []
        self._grow(sample, count, np.full(DIRECTIONS, -np.inf), np.full(DIRECTIONS, np.inf))

    def _grow(self, sample, count, low, high) -> int:
        node = len(self.planes)
        self.planes.append(None)
        self.children.append((-1, -1))
        spread = sample.max(axis=0) - sample.min(axis=0) if len(sample) else np.zeros(DIRECTIONS)
        side = int(np.argmax(spread))
        if count < 2 or len(sample) < 4 or spread[side] == 0:
            self.children[node] = (len(self.boxes), -1)
            self.boxes.append((low, high))
            return node
        value = float(np.quantile(sample[:, side], (count // 2) / count))
        left_high, right_low = high.copy(), low.copy()
        left_high[side] = right_low[side] = value
        below = sample[:, side] <= value
        left = self._grow(sample[below], count // 2, low, left_high)
        right = self._grow(sample[~below], count - count // 2, right_low, high)
        self.planes[node], self.children[node] = (side, value), (left, right)
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(points), np.int64)
        open_ = [(0, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            if self.planes[node] is None:
                cell[rows] = self.children[node][0]
                continue
            side, value = self.planes[node]
            below = points[rows, side] <= value
            open_ += [(self.children[node][0], rows[below]), (self.children[node][1], rows[~below])]
        return cell

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from each cell's box."""
        low, high = np.array([b[0] for b in self.boxes]), np.array([b[1] for b in self.boxes])
        gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
        return (gap * gap).sum(axis=2)


class Space:
    """Lifting and projecting; ``largest`` is the greatest squared norm."""

    def __init__(self, size: int, largest: float) -> None:
        self.largest, self.matrix = largest, directions(size)

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - (vectors * vectors).sum(axis=1), 0))
        return vectors @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def scale(self, queries: np.ndarray) -> np.ndarray:
        return np.sqrt(self.largest) / np.sqrt((queries * queries).sum(axis=1))

    def query_points(self, queries: np.ndarray) -> np.ndarray:
        return (queries * self.scale(queries)[:, None]) @ self.matrix[:-1]

    def distance(self, scores: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Squared lifted distance for an inner product with the unscaled query."""
        return np.maximum(2 * self.largest - 2 * scores * scale, 0)


def search_block(data: pd.DataFrame, queries: pd.DataFrame, space: Space, k: int, quantile: float) -> pd.DataFrame:
    """The k best (query_id, vec_id, score) of one block, by incremental search with the stopping test."""
    columns = ["query_id", "vec_id", "score"]
    if not len(data) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    vectors = np.stack(data["vector"].to_numpy()).astype(np.float64)
    ids = data["ids"].to_numpy()
    points = space.points(vectors)
    leaves = kd_leaves(points, LEAF)
    low, high = np.array([points[rows].min(axis=0) for rows in leaves]), np.array([points[rows].max(axis=0) for rows in leaves])
    wanted = np.stack(queries["vector"].to_numpy()).astype(np.float64)
    at, scale = space.query_points(wanted), space.scale(wanted)
    out = []
    for row, (query_id, bound) in enumerate(zip(queries["query_id"].to_numpy(), queries["bound"].to_numpy(), strict=True)):
        gap = np.maximum(np.maximum(low - at[row], at[row] - high), 0)
        gap = (gap * gap).sum(axis=1)
        order = np.argsort(gap, kind="stable")
        scores, found = np.zeros(0), np.zeros(0, np.int64)
        least = bound  # the k-th best score so far, here or elsewhere
        for start in range(0, len(order), STEP_LEAVES):
            if np.isfinite(least) and gap[order[start]] > quantile * space.distance(np.array(least), scale[row]):
                break  # the stopping test
            rows = np.concatenate([leaves[i] for i in order[start : start + STEP_LEAVES]])
            new = vectors[rows] @ wanted[row]
            near = new >= least if np.isfinite(least) else np.ones(len(new), bool)
            scores, found = np.concatenate([scores, new[near]]), np.concatenate([found, rows[near]])
            if len(scores) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= cut
                scores, found, least = scores[keep], found[keep], max(least, cut)
        rows = sorted((-score, int(i)) for score, place in zip(scores.tolist(), found.tolist(), strict=True) for i in ids[place])[:k]
        out += [(query_id, i, -score) for score, i in rows]
    return pd.DataFrame(out, columns=columns)


def distinct_vectors(embeddings: DataFrame, vec_id: str, vector: str, most_ids: int) -> DataFrame:
    """(vector, ids): each usable vector once, with its ``most_ids`` smallest ids; more can never be among the nearest."""
    value = F.col(vector).cast("array<double>")
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), value.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & usable)

    def gather(batches):
        held: dict[bytes, list[int]] = {}

        def flush():
            keys = list(held)
            vectors = [np.frombuffer(key, np.float64) for key in keys]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(vectors, pa.list_(pa.float64())), pa.array([sorted(held[key])[:most_ids] for key in keys], pa.list_(pa.int64()))], names=["vector", "ids"]
            )
            held.clear()
            return batch

        for batch in batches:
            for key, one in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                some = held.setdefault((np.array(one) + 0.0).tobytes(), [])
                some.append(key)
                if len(some) > 8 * most_ids:
                    some[:] = sorted(some)[:most_ids]
            if len(held) > 20_000:
                yield flush()
        if held:
            yield flush()

    parts = rows.mapInArrow(gather, "vector array<double>, ids array<long>")
    return parts.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most_ids).alias("ids"))


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, vec_id="vec_id", vector="embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row whose id ``every`` divides.

    Vectors that are missing, zero or hold missing or non-finite components take
    no part; neither do rows without an id or of another length than most.
    Repeated ids are separate candidates; a query's own id is none.
    """
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = write_shared(distinct_vectors(embeddings, vec_id, vector, k + 1), "vectors")
    sizes = points.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return empty
    points = points.where(F.size("vector") == sizes["size"])
    norm = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    space = Space(sizes["size"], points.agg(F.max(norm)).first()[0])
    count = sizes["count"]
    sampled = points.where(F.pmod(F.xxhash64(F.lit("cells"), "vector"), F.lit(1 << 20)) / F.lit(1 << 20) < min(1.0, SAMPLE / count)).select("vector").collect()
    sample = space.points(np.array([row["vector"] for row in sampled])) if sampled else np.zeros((0, DIRECTIONS))
    sample = sample[np.lexsort(sample.T)]
    cells = Cells(sample, min(MOST_CELLS, max(1, math.ceil(count / CELL_POINTS))))
    quantile = chi_square_quantile(confidence, DIRECTIONS)

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(cells.of(space.points(np.stack(vectors.to_numpy()).astype(np.float64)))).astype("int32")

    @F.pandas_udf("int")
    def cell_of_query(vectors: pd.Series) -> pd.Series:
        return pd.Series(cells.of(space.query_points(np.stack(vectors.to_numpy()).astype(np.float64)))).astype("int32")

    data = write_shared(points.select("vector", "ids", cell_of("vector").alias("cell")), "cells")
    held = {row["cell"]: row["count"] for row in data.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
    splits = F.create_map(*[F.lit(x) for cell, n in held.items() for x in (cell, math.ceil(n / CELL_POINTS))])
    data = data.withColumn("split", F.pmod(F.xxhash64("vector"), splits[F.col("cell")]).cast("int"))
    # The ids of a query may have been cut from its point, so queries come from the rows.
    queries = embeddings.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    queries = queries.where((F.pmod("query_id", F.lit(every)) == 0) & F.col("vector").isNotNull() & (F.size("vector") == sizes["size"]) & usable)
    queries = write_shared(queries.dropDuplicates(["query_id"]).withColumn("home", cell_of_query("vector")), "queries")

    def search(asked: DataFrame) -> DataFrame:
        """``asked`` has (query_id, vector, bound, cell)."""
        asked = asked.where(F.col("cell").isin(list(held)))
        asking = {row["cell"]: row["count"] for row in asked.groupBy("cell").count().collect()}
        if not asking:
            return spark.createDataFrame([], "query_id long, vec_id long, score double")
        chunks = F.create_map(*[F.lit(x) for cell, n in asking.items() for x in (cell, math.ceil(n / CHUNK_QUERIES))])
        left = data.where(F.col("cell").isin(list(asking))).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks[F.col("cell")] - 1)))
        right = asked.withColumn("split", F.explode(F.sequence(F.lit(0), splits[F.col("cell")] - 1)))
        right = right.withColumn("chunk", F.pmod(F.xxhash64("query_id"), chunks[F.col("cell")]).cast("int"))

        def block(data_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
            return search_block(data_rows, query_rows, space, k + 1, quantile)

        keys = ["cell", "split", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")

    @F.pandas_udf("array<int>")
    def others(vectors: pd.Series, bounds: pd.Series, homes: pd.Series) -> pd.Series:
        wanted = np.stack(vectors.to_numpy()).astype(np.float64)
        radius = quantile * space.distance(bounds.to_numpy(), space.scale(wanted))
        near = cells.distances(space.query_points(wanted)) <= np.where(np.isfinite(radius), radius, np.inf)[:, None]
        near[np.arange(len(near)), homes.to_numpy()] = False
        return pd.Series([np.flatnonzero(row).astype("int32") for row in near])

    first = write_shared(search(queries.withColumns({"bound": F.lit(float("-inf")), "cell": F.col("home")})), "first")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k + 1).select(F.col("query_id").alias("_id"), F.col("score").alias("bound"))
    asked = queries.join(kth, F.col("query_id") == F.col("_id"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    asked = write_shared(asked.select("query_id", "vector", "bound", F.explode(others("vector", "bound", "home")).alias("cell")), "asked")
    found = first.union(search(asked)).where("query_id <> vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
