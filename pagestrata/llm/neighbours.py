"""Exact top-k inner products through a pivot-distance index.

Components become whole numbers; a vector x gets one more component, sqrt(M - |x|^2) with M the largest squared length, so
that the highest inner products are the nearest points. Vectors are keyed by their nearest pivot and their distance to
it, cut into rings (annuli) of even counts. A query visits rings in the order of their lower bounds
``max(0, d - high, low - d)`` (d: its distance to the ring's pivot) in rounds of growing width, and stops when the next
bound lies beyond its k-th nearest so far. Scores are whole numbers and exact; bounds have slack for rounding, so a tie is
never cut off.

Rings are a bounded number; a ring's rows are dealt to blocks of bounded size by a hash, so a ring that holds very many
equal vectors is not one task. Queries are sent to the blocks of the rings they visit, scored there by matrix products,
and only scores that can still reach the top k leave a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm import base

SCALE, PIVOTS, RINGS = 64, 16, 8
#: Vectors the pivots are chosen from, rows of a block, rings of the first round and growth from round to round.
PIVOT_ROWS, BLOCK_ROWS, FIRST, GROWTH = 4096, 4096, 4, 8
QUERY_ROWS = 2048
SLACK = 1e-6


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row_id, vec_id, x): floor(scale * component) as longs, at most 2^62 either way; vectors that are null or not finite throughout are left out."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = base.with_row(vectors, "vec_id", "embedding").filter(F.col("embedding").isNotNull() & finite & F.col("vec_id").isNotNull())
    return rows.select("row_id", "vec_id", F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long")).alias("x"))


class Index:
    """Pivots, the largest squared length and the rings' bounds; at most ``PIVOTS`` * ``RINGS`` rings."""

    def __init__(self, points: np.ndarray, largest: int):
        self.largest = float(largest)
        self.rounding = float(np.sqrt(1e-14 * self.largest))  # of a distance whose square is a difference of squared lengths
        spots = self.lift(points)
        # farthest-first: every pivot is the point farthest from those before
        chosen, far = [0], np.full(len(spots), np.inf)
        while len(chosen) < min(PIVOTS, len(spots)):
            far = np.minimum(far, ((spots - spots[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(far.argmax()))
        self.pivots = spots[chosen]
        pivot, distance = self.nearest(points)
        self.cuts = [np.quantile(distance[pivot == p], np.arange(1, RINGS) / RINGS) if (pivot == p).any() else np.zeros(RINGS - 1) for p in range(len(self.pivots))]
        self.low = self.high = self.blocks = np.zeros(0)
        self.rings = np.zeros((0, 2), np.int64)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0))])

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """To every pivot; a query has 0 as its last component."""
        spots = np.column_stack([x.astype(float), np.zeros(len(x))]) if query else self.lift(x)
        square = (spots**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * spots @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def nearest(self, x):
        d = self.distances(x)
        pivot = d.argmin(axis=1)
        return pivot, d[np.arange(len(x)), pivot]

    def keys(self, x):
        pivot, distance = self.nearest(x)
        ring = np.array([np.searchsorted(self.cuts[p], d) for p, d in zip(pivot, distance)], np.int64)
        return pivot * RINGS + ring, distance

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bound of the distance from each query to each ring."""
        d = self.distances(x, query=True)[:, self.rings // RINGS]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0) - SLACK * (1 + d) - self.rounding

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a query's inner product is ``score``."""
        length = (x.astype(float) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(length + self.largest - 2.0 * score, 0)) + self.rounding


def products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond the range of a long they stay at its ends."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * queries.shape[1]
    if most < 2.0**53:
        return (queries.astype(float) @ x.T.astype(float)).astype(np.int64)
    whole = queries.astype(object) @ x.T.astype(object)
    return np.clip(whole, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def _matrix(column) -> np.ndarray:
    return np.array(column, np.int64).reshape(len(column), -1)


def top_k(vectors: DataFrame, queries_by: int = 20, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of every query with all other rows.

    Queries are the rows whose vec_id is divisible by ``queries_by``. Ties go to the smaller vec_id, then the earlier row;
    a query never meets its own row, but does meet a repeated one. Vectors that are null or hold null or non-finite
    components, and rows without id, take no part. A shorter vector has zeros in the places it lacks. Scores are exact, whatever the size of
    the components; one beyond the range of a long is given as its end. With fewer rows than k, all are
    returned. An empty table gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    base.small_batches(spark, BLOCK_ROWS)
    rows = base.stage(whole_numbers(vectors, scale), "vectors")
    length = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    total, largest, least, most = rows.agg(F.count("*"), F.max(length), F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))))
    out = "query_row long, query_id long, row_id long, vec_id long, score long"
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = rows.orderBy(F.xxhash64("row_id")).limit(PIVOT_ROWS).select("x").toPandas()["x"]
    index = Index(_matrix(points.tolist()), largest)

    sent = spark.sparkContext.broadcast(index)

    def keyed(batch, index):
        key, distance = index.keys(_matrix(batch["x"]))
        return batch | {"ring": key, "distance": distance}

    rows = base.stage(base.map_batches(rows, keyed, "row_id long, vec_id long, x array<long>, ring long, distance double", start=lambda: sent.value), "rings")
    rings = rows.groupBy("ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).orderBy("ring").toPandas()
    index.rings, index.low, index.high = rings["ring"].to_numpy(), rings["low"].to_numpy(), rings["high"].to_numpy()
    index.blocks = np.maximum(1, -(-rings["n"].to_numpy() // BLOCK_ROWS))
    sent = spark.sparkContext.broadcast(index)
    blocks = F.create_map(*(F.lit(int(v)) for pair in zip(index.rings, index.blocks) for v in pair))[F.col("ring")]
    stored = rows.withColumn("block", F.pmod(F.xxhash64("row_id"), blocks))

    state = rows.filter(F.col("vec_id") % queries_by == 0).select(F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.lit(None).cast("long").alias("floor"))
    best, seen, width = None, 0, FIRST
    while True:
        def visits(batch, index, seen=seen, width=width):
            """The next ``width`` rings of each query in the order of their bounds, as far as they can matter."""
            q = _matrix(batch["q"])
            bound = index.bounds(q)
            order = np.argsort(bound, axis=1, kind="stable")[:, seen : seen + width]
            floor = np.array([0 if f is None else f for f in batch["floor"]], np.int64)
            none = np.array([f is None for f in batch["floor"]], bool)
            near = np.take_along_axis(bound, order, axis=1) <= np.where(none, np.inf, index.reach(q, np.where(none, 0, floor).astype(float)))[:, None] * (1 + SLACK) + SLACK
            i, j = np.nonzero(near)
            ring = order[i, j]
            n = index.blocks[ring]
            i, ring, block = np.repeat(i, n), np.repeat(ring, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i = i.tolist()
            return {"query_row": [batch["query_row"][a] for a in i], "query_id": [batch["query_id"][a] for a in i], "q": [batch["q"][a] for a in i],
                    "floor": [batch["floor"][a] for a in i], "ring": index.rings[ring], "block": block}

        asked = base.map_batches(state, visits, "query_row long, query_id long, q array<long>, floor long, ring long, block long", start=lambda: sent.value)

        def scored(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(vectors) and len(queries):
                vectors = vectors.sort_values(["vec_id", "row_id"])
                x, ids, at = np.vstack(vectors["x"].to_numpy()), vectors["vec_id"].to_numpy(), vectors["row_id"].to_numpy()
                for a in range(0, len(queries), QUERY_ROWS):
                    part = queries.iloc[a : a + QUERY_ROWS]
                    scores = products(np.vstack(part["q"].to_numpy()), x)
                    floors = part["floor"].astype(float).fillna(-np.inf).to_numpy()
                    floors = floors - 1 - np.abs(np.where(np.isinf(floors), 0, floors)) * 1e-15  # below the whole number it stands for
                    for i, (own, query) in enumerate(zip(part["query_row"], part["query_id"])):
                        s = scores[i]
                        hit = np.flatnonzero((s >= floors[i]) & (at != own))
                        hit = hit[np.argsort(-s[hit], kind="stable")[:k]]  # rows are in the order of ties
                        found.append(pd.DataFrame({"query_row": own, "query_id": query, "row_id": at[hit], "vec_id": ids[hit], "score": s[hit]}))
            return pd.concat(found) if found else pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in out.split(", ")})

        new = stored.select("ring", "block", "row_id", "vec_id", "x").groupBy("ring", "block").cogroup(asked.groupBy("ring", "block")).applyInPandas(scored, out)
        order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id")
        best = base.stage((new if best is None else best.unionByName(new)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "best")
        seen += width
        if seen >= len(index.rings):
            break
        width *= GROWTH
        floors = best.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query_row", F.col("least").alias("floor"))
        state = state.drop("floor").join(floors, "query_row", "left")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
