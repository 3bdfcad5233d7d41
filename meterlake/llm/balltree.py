"""Exact top-k by inner product, with a ball tree per shard and branch and bound.

Vectors become whole numbers, floor(scale * x), within the range of a 64-bit number. Each goes to the
nearest of some pivots, vectors that a hash of their ids picks: about the square root of their number,
1,024 at least and 16,384 at most, but one for each shard_rows rows at most. The vectors of a pivot are dealt
into shards of about `shard_rows` rows, so a hot pivot is many shards. A query is first searched in one
shard of its own pivot, which gives a k-th score that all other shards share; it then goes to those
pivots only whose ball, by the upper bound q.c + |q| r, may hold a score as high. Queries are dealt into
blocks of about `query_rows`; each (shard, block) cell is one group of a cogrouped pandas job, so memory
is bounded by a cell whatever the input; vectors go only to the blocks that ask for their shard. In a cell, a ball tree over the shard is searched once per
query: nodes go by descending bound, and the search ends at the first node whose bound lies below the
current k-th score. The best k of each shard are then ranked per query.

Scores are exact. Where products of two vectors' components may pass 2**53, floating-point products
only bound the search, and candidates are scored in whole numbers of any size; a score beyond the range
of a 64-bit number counts as the end of that range.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
as query or candidate; rows with a null id neither. Vectors of other lengths than the query's are no
candidates. Rows with the query's id are not its candidates. Ties go to the smaller id. Repeated
rows are candidates each; a query id that stands on several rows is one query, by the smallest vector.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterlake.llm.tasks import cut, in_small_batches, parts, small_side

FOUND = "query_id long, vec_id long, score long"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Over the rows of a float matrix that holds whole numbers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(rows))
        self.rows, self.nodes = rows, []
        self._build(0, len(rows), leaf)
        self.rows, self.ids = rows[self.order], ids[self.order]
        self.most = float(np.abs(rows).max(initial=0))

    def _build(self, lo: int, hi: int, leaf: int) -> int:
        own = self.rows[self.order[lo:hi]]
        center = own.mean(0)
        radius = float(np.sqrt(((own - center) ** 2).sum(1).max()))
        me = len(self.nodes)
        self.nodes.append([center, radius, lo, hi, -1, -1])
        if hi - lo > leaf and radius > 0:
            axis = int(own.var(0).argmax())
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
            self.nodes[me][4] = self._build(lo, lo + mid, leaf)
            self.nodes[me][5] = self._build(lo + mid, hi, leaf)
        return me

    def finish(self) -> BallTree:
        self.centers = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])
        return self

    def search(self, query: np.ndarray, own_id: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Best k (score, id) of this tree with a score of at least floor."""
        norm = float(np.linalg.norm(query))
        slack = 1e-6 * (1 + norm)
        exact = self.most * float(np.abs(query).max(initial=0)) * len(query) < 2**53
        if not exact:
            # how far a floating-point score or bound may be from the true one
            slack = max(slack, 1e-9 * norm * float(np.sqrt(len(query))) * self.most)
            floor = -np.inf if floor <= LOW else floor - slack - 1e-9 * abs(floor)
            whole = [int(x) for x in query.tolist()]
        bounds = self.centers @ query + (norm + slack) * (self.radii + 1e-6) + slack
        heap, best, kth = [(-bounds[0], 0)], [], floor
        while heap and -heap[0][0] >= kth:
            _, at = heapq.heappop(heap)
            _, _, lo, hi, left, right = self.nodes[at]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            scores, ids = self.rows[lo:hi] @ query, self.ids[lo:hi]
            good = (scores >= kth - (0 if exact else slack)) & (ids != own_id)
            if exact:
                best += zip((-scores[good]).tolist(), ids[good].tolist(), strict=True)
            else:
                best += ((-min(max(sum(int(a) * b for a, b in zip(row, whole, strict=True)), LOW), HIGH), i) for row, i in zip(self.rows[lo:hi][good].tolist(), ids[good].tolist(), strict=True))
            best.sort()
            del best[k:]
            if len(best) == k and (exact or -best[-1][0] > LOW):
                kth = max(kth, -float(best[-1][0]) - (0 if exact else slack))
        return [(int(-s), i) for s, i in best]


def _search_cell(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(vectors) and len(queries):
        sizes = vectors["v"].map(len)
        for size, own in vectors.groupby(sizes):
            asked = queries[queries["qv"].map(len) == size]
            if len(asked):
                tree = BallTree(np.array(own["v"].tolist(), float), own["vec_id"].to_numpy(np.int64)).finish()
                for q, v, floor in zip(asked["query_id"].tolist(), asked["qv"].tolist(), asked["floor"].tolist(), strict=True):
                    out += ((q, i, s) for s, i in tree.search(np.asarray(v, float), q, k, -np.inf if floor != floor or floor is None else floor))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: the vectors that take part, as floor(scale * x)."""
    good = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = good.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    return good.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


class Pivots:
    """A few vectors, those of the most frequent length; vectors of other lengths belong to pivot -1."""

    def __init__(self, rows: list[list[float]]):
        lengths = [len(r) for r in rows]
        self.size = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
        rows = [r for r in rows if len(r) == self.size]
        self.centers = np.array(rows, float).reshape(len(rows), self.size)
        self.norms = (self.centers**2).sum(1)

    def nearest(self, vectors: list) -> tuple[np.ndarray, np.ndarray]:
        """Per vector its pivot and its distance to it."""
        own, far = np.full(len(vectors), -1), np.zeros(len(vectors))
        at = np.array([i for i, v in enumerate(vectors) if self.size and len(v) == self.size], int)
        if len(at):
            rows = np.array([vectors[i] for i in at], float)
            own[at] = (self.norms - 2 * rows @ self.centers.T).argmin(1)
            far[at] = np.sqrt(((rows - self.centers[own[at]]) ** 2).sum(1))
        return own, far

    def reached(self, vector: np.ndarray, radii: np.ndarray, floor: float) -> np.ndarray:
        """The pivots whose ball may hold a score of at least floor."""
        norm = np.linalg.norm(vector)
        bound = self.centers @ vector + norm * radii
        slack = 1e-6 + 1e-9 * (np.abs(bound) + norm * np.sqrt(self.norms) + abs(floor))
        return np.flatnonzero((radii >= 0) & (bound + slack >= floor))


def assigned(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """vec_id, v, pivot, far (distance to it)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def made(batches):
        for batch in parts(batches, 4096):
            own, far = shared.value.nearest(batch["v"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(own, pa.int32()), pa.array(far)], names=["vec_id", "v", "pivot", "far"])

    return in_small_batches(vectors).select("vec_id", "v").mapInArrow(made, "vec_id long, v array<double>, pivot int, far double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, query_rows: int = 4096, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. vectors, queries: vec_id, v as from whole_vectors."""
    context = vectors.sparkSession.sparkContext
    n = vectors.count()
    n_pivots = max(1, min(pivots or max(1024, min(16_384, math.isqrt(n))), n // shard_rows))
    n_blocks = max(1, -(-queries.count() // query_rows))
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).toArrow()
    chosen = Pivots(picked["v"].to_pylist())
    every = cut(assigned(vectors, chosen))
    # one row per pivot
    sizes = {r["pivot"]: r for r in every.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    shards, first = {}, 0
    for pivot in sorted(sizes):
        shards[pivot] = (first, -(-sizes[pivot]["n"] // shard_rows))
        first += shards[pivot][1]
    radii = context.broadcast(np.array([sizes[i]["far"] if i in sizes else -1.0 for i in range(len(chosen.centers))]))
    shared = context.broadcast(chosen)
    places = vectors.sparkSession.createDataFrame([(p, *s) for p, s in shards.items()], "pivot int, first int, shards int")
    spread = lambda col, n: F.pmod(F.xxhash64(col), n).cast("int")
    sharded = every.join(F.broadcast(places), "pivot").select("vec_id", "v", (F.col("first") + spread("vec_id", F.col("shards"))).alias("shard"), F.col("first"))
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut(assigned(queries, chosen).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), "pivot", spread("vec_id", F.lit(n_blocks)).alias("block")))
    search = lambda left, right: _search_cell(left, right, k)

    def cells(rows: DataFrame, ask: DataFrame) -> DataFrame:
        # a vector goes to the blocks that ask for its shard, and to no other
        dealt = rows.select("vec_id", "v", "shard").join(small_side(ask.select("shard", "block").distinct()), "shard")
        return dealt.groupBy("shard", "block").cogroup(ask.groupBy("shard", "block")).applyInPandas(search, FOUND)

    nearest = asked.join(F.broadcast(places), "pivot").select("query_id", "qv", "block", F.lit(None).cast("double").alias("floor"), F.col("first").alias("shard"))
    near = cells(sharded.where("shard = first"), nearest)
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))

    def reached(batches):
        for batch in parts(batches, 4096):
            at, to = [], []
            for i, (v, floor) in enumerate(zip(batch["qv"].to_pylist(), batch["floor"].to_pylist(), strict=True)):
                some = shared.value.reached(np.array(v, float), radii.value, -np.inf if floor is None else floor) if len(v) == shared.value.size else [-1]
                for p in some:
                    start, n = shards.get(int(p), (0, 0))
                    to += range(start, start + n)
                    at += [i] * n
            yield batch.select(["query_id", "qv", "block", "floor"]).take(pa.array(at, pa.int64())).append_column("shard", pa.array(to, pa.int32()))

    asked = cut(asked.join(floors, "query_id", "left").select("query_id", "qv", "block", "floor").mapInArrow(reached, "query_id long, qv array<double>, block int, floor double, shard int"))
    found = cells(sharded, asked)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
