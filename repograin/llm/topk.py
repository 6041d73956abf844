"""Exact top-k search by inner product, by distributed histogram selection.

Queries and candidates are dealt to blocks of fixed size; each pair of blocks is one group that scores all its pairs
with a matrix product. No scores are kept. Every round counts scores per query in equal bins of the range in which the
k-th best score must lie and narrows that range to one bin; when the range is a single value, a last pass returns the
scores above it and, of those equal to it, the smallest ids.

A block reports only the bins from its own k-th best score upwards: the k-th best of all cannot lie below the k-th
best of a part. So at most k bins per query leave a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograin.llm.scratch import written
from repograin.llm.ship import ship

QUERY_BLOCK = 1 << 16
CANDIDATE_BLOCK = 8192
BINS = 1 << 12
EXACT = float(1 << 53)
LONG = 1 << 63


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0, **more: Column) -> DataFrame:
    """``vec_id, v array<double>``: floor(scale * x) of each component x as double; ``more`` names further columns.

    Vectors that are null, or hold null or non-finite components, are left out; so are null ids.
    """
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(wide, lambda x: F.floor(x * F.lit(scale)).cast("double"))
    # floor() of a double is a long in Spark and saturates at the ends of its range.
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("v"), *[c.alias(name) for name, c in more.items()]
    )


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products. Doubles while every partial sum is a whole number they hold, else long integers
    of any length, cut at the ends of the 64-bit range."""
    bound = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
    return np.clip(exact, -LONG, LONG - 1).astype(np.int64)


def _scores(q: pd.DataFrame, c: pd.DataFrame):
    """For a few queries at a time: their rows, the scores, and which pairs are a query with itself (to be left out)."""
    width = max(map(len, (*q["v"], *c["v"])), default=0)
    candidates, ids = _matrix(c["v"], width), c["vec_id"].to_numpy()
    for at in range(0, len(q), 128):
        part = q.iloc[at : at + 128]
        yield part, inner_products(_matrix(part["v"], width), candidates), ids[None, :] == part["vec_id"].to_numpy()[:, None]


def _frame(names: str, columns: list[list[np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate(c) if c else np.empty(0, np.int64) for n, c in zip(names.split(), columns)})


def _histograms(k: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[], [], []]
        for part, scores, own in _scores(q, c) if len(q) and len(c) else ():
            for row, (query, low, width) in enumerate(zip(part["vec_id"], part["low"], part["width"])):
                mine = scores[row][~own[row]]
                if not len(mine):
                    continue
                floor = np.partition(mine, len(mine) - k)[len(mine) - k] if len(mine) > k else mine.min()
                mine = mine[mine >= max(int(floor), low)]
                # Distances from ``low`` are unsigned, so they hold for any two longs; scores above the range count in
                # the bin past the last. The lowest bin may be cut by ``floor`` and still holds the block's k best.
                steps = (mine.astype(np.uint64) - np.uint64(low % (1 << 64))) // np.uint64(width)
                bins, counts = np.unique(np.minimum(steps, np.uint64(BINS)).astype(np.int64), return_counts=True)
                for column, values in zip(out, (np.full(len(bins), query), bins, counts)):
                    column.append(values)
        return _frame("query_id bin n", out)

    return run


def _survivors(k: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[], [], []]
        ids = c["vec_id"].to_numpy()
        for part, scores, own in _scores(q, c) if len(q) and len(c) else ():
            for row, (query, low) in enumerate(zip(part["vec_id"], part["low"])):
                near = np.flatnonzero((scores[row] >= low) & ~own[row])
                # All of them lie at or above the k-th best score, so only ties can be more than k.
                best = near[np.lexsort((ids[near], ~scores[row][near]))[:k]]
                for column, values in zip(out, (np.full(len(best), query), ids[best], scores[row][best])):
                    column.append(values)
        return _frame("query_id vec_id score", out)

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best partners, ties to the smaller id.

    ``vectors`` has ``vec_id`` and ``v`` (whole numbers as doubles; shorter vectors count as padded with zeros). A
    query is never its own partner, nor is a repeated row of the same id; other repeated rows count once each. With
    fewer than ``k`` candidates all are returned; no queries give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    size = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    candidate_blocks, query_blocks = max(1, -(-size[0] // CANDIDATE_BLOCK)), max(1, -(-size[1] // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    # Written once; each round deals them to the blocks of queries as it reads them. Row numbers keep repeated ids apart.
    stored = written(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("_row")), "topk-candidates")
    own_block = F.pmod(F.xxhash64("_row"), F.lit(candidate_blocks)).cast("int").alias("cb")
    candidates = stored.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), own_block, "vec_id", "v")
    queries = vectors.where(is_query).dropDuplicates(["vec_id"]).withColumn("qb", block(query_blocks))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # By Cauchy-Schwarz no score is farther from zero than the product of the largest norms.
    reach = vectors.agg(F.max(norm)).first()[0] or 0.0
    reach = min(int(reach * reach * (1 + 1e-9)) + 1, LONG - 1)
    state = queries.select("vec_id", F.lit(-reach).cast("bigint").alias("low"))
    span, bounded = 2 * reach + 1, queries
    dealt = F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))).alias("cb")
    groups = candidates.groupBy("qb", "cb")
    while span > 1:
        width = -(-span // BINS)
        bounded = queries.join(state, "vec_id").withColumn("width", F.lit(width).cast("bigint"))
        asked = bounded.select("qb", dealt, "vec_id", "v", "low", "width")
        counts = asked.groupBy("qb", "cb").cogroup(groups).applyInPandas(_histograms(k), "query_id bigint, bin bigint, n bigint")
        summed = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        # The first bin, from above, with which k scores are reached; the lowest bin where there are fewer.
        reached = summed.withColumn("_above", F.sum("n").over(down) - F.col("n")).where(F.col("_above") < k)
        kth = reached.groupBy("query_id").agg(F.min("bin").alias("bin"))
        # The range may be as wide as all longs, so the step is taken in decimals.
        whole = lambda c: c.cast("decimal(20,0)")
        step = whole(F.coalesce(F.least("bin", F.lit(BINS - 1)), F.lit(0))) * F.lit(width).cast("decimal(18,0)")
        low = (whole(F.col("low")) + step).cast("bigint")
        state = written(
            state.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", low.alias("low")),
            "topk-state",
        )
        span = width
    asked = queries.join(state, "vec_id").select("qb", dealt, "vec_id", "v", "low")
    found = asked.groupBy("qb", "cb").cogroup(groups).applyInPandas(_survivors(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
