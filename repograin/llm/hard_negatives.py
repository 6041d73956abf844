"""Hard negatives of anchors by exact integer scores, computed in a residue number system.

Scores are inner products of whole-number vectors. Component matrices are taken modulo several small primes, multiplied in
float32 (every partial sum stays below 2**24, so nothing is rounded), and the signed score is rebuilt from its residues
by Chinese remaindering. As many primes are used as the largest possible score of the two blocks asks for.

1. Anchors meet all rows in blocks: each pair of blocks gives the best same-label rows of every anchor, at most
   ``positives`` each; the best of all are its positives.
2. Each positive's score opens a window. Anchors meet all rows again, with their windows: each pair of blocks gives the
   best rows of another label in every window, at most ``negatives`` each; the best of all are returned.

Rows are written once and dealt to blocks by row number, so equal ids and equal vectors do not gather in one block. Blocks
have a fixed size in bytes. What leaves a pair of blocks is bounded by its anchors, never by its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograin.llm.scratch import written
from repograin.llm.ship import ship

ANCHOR_BYTES = 1 << 25  # of the vectors in a block of anchors, as doubles
ROW_BYTES = 1 << 22  # of the vectors in a block of rows, as doubles
SLICE = 128  # anchors whose scores are held at a time
LARGEST_PRIME = 256
EXACT = 1 << 24  # whole numbers that float32 holds
LONG = 1 << 63


def _primes(below: int) -> list[int]:
    """All primes below, the largest first."""
    return [n for n in range(below - 1, 1, -1) if all(n % d for d in range(2, int(n**0.5) + 1))]


PRIMES = _primes(LARGEST_PRIME)


def primes_for(bound: int) -> list[int]:
    """Primes whose product tells all whole numbers from -bound to bound apart."""
    chosen, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    else:
        raise ValueError("components too large for the primes")
    return chosen or PRIMES[:1]


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers held by doubles, modulo ``p``, as float32 from -p/2 to p/2."""
    rest = np.fmod(values, p)  # exact for doubles of any size
    rest[rest > p // 2] -= p
    rest[rest < -(p // 2)] += p
    return rest.astype(np.float32)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p``, from 0 to p - 1, of residues; columns are taken in parts that float32 sums exactly."""
    part = max(1, EXACT // (p // 2 or 1) ** 2)
    out = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], part):
        out += (a[:, at : at + part] @ b[:, at : at + part].T).astype(np.int32) % p
    return out % p


def rebuilt(rests: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers nearest to zero with these residues, cut at the ends of the 64-bit range.

    Mixed-radix digits: each prime adds one digit, the number so far taken out of its residue.
    """
    digits: list[np.ndarray] = []
    weights = [1]
    for p in primes:
        weights.append(weights[-1] * p)
    for i, (rest, p) in enumerate(zip(rests, primes)):
        so_far = sum((d * (w % p) for d, w in zip(digits, weights)), np.zeros_like(rest))
        digits.append((rest - so_far) * pow(weights[i], -1, p) % p)
    product = weights.pop()
    if product < LONG // 2:
        number = sum(d.astype(np.int64) * w for d, w in zip(digits, weights))
        return number - product * (number > product // 2)
    number = sum(d.astype(object) * w for d, w in zip(digits, weights))
    return np.clip(np.where(number > product // 2, number - product, number), -LONG, LONG - 1).astype(np.int64)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _scores(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """A few anchors at a time, and their scores with all rows."""
    width = max(map(len, (*anchors["v"], *rows["v"])), default=0)
    b = _matrix(rows["v"], width)
    high = int(np.abs(b).max(initial=0.0))
    residue_rows: dict[int, np.ndarray] = {}
    for at in range(0, len(anchors), SLICE):
        part = anchors.iloc[at : at + SLICE]
        a = _matrix(part["v"], width)
        primes = primes_for(int(np.abs(a).max(initial=0.0)) * high * width)
        for p in primes:
            if p not in residue_rows:
                residue_rows[p] = residues(b, p)
        yield part, rebuilt([product_modulo(residues(a, p), residue_rows[p], p) for p in primes], primes)


def _best(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties to the smaller id."""
    if len(among) > k:
        least = np.partition(scores[among], len(among) - k)[len(among) - k]
        among = among[scores[among] >= least]
    return among[np.lexsort((ids[among], ~scores[among]))[:k]]


def _frame(names: str, columns: list[list]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate(c) if c else np.empty(0, np.int64) for n, c in zip(names.split(), columns)})


def _positives(k: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], []]
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        for part, scores in _scores(anchors, rows) if len(anchors) and len(rows) else ():
            for anchor, label, own in zip(part["vec_id"], part["label"], scores):
                best = _best(own, ids, np.flatnonzero((labels == label) & (ids != anchor)), k)
                for column, values in zip(out, (np.full(len(best), anchor), ids[best], own[best])):
                    column.append(values)
        return _frame("anchor_id positive_id positive_score", out)

    return run


def share(score: int, percent: int) -> tuple[int, int]:
    """``score * percent / 100``, rounded down and up."""
    return score * percent // 100, -(-score * percent // 100)


def _negatives(k: int, low: int, high: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], [], [], []]
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        for part, scores in _scores(anchors, rows) if len(anchors) and len(rows) else ():
            columns = (part[c] for c in ("vec_id", "label", "positive_ids", "positive_scores"))
            for anchor, label, positives, reached, own in zip(*columns, scores):
                others = np.flatnonzero((labels != label) & (ids != anchor))
                for positive, score in zip(positives, map(int, reached)):
                    least, most = max(share(score, low)[1], -LONG), min(share(score, high)[0], LONG - 1)
                    inside = others[(own[others] >= least) & (own[others] <= most)]
                    best = _best(own, ids, inside, k)
                    same = [np.full(len(best), x) for x in (anchor, positive, score)]
                    for column, values in zip(out, (*same, ids[best], own[best])):
                        column.append(values)
        return _frame("anchor_id positive_id positive_score negative_id negative_score", out)

    return run


def _ranked(rows: DataFrame, of: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, label, v`` (whole numbers as doubles; shorter vectors count as padded with zeros); see
    ``topk.quantised``. An anchor's positives are its ``positives`` best rows of the same label; for each of them the
    ``negatives`` best rows of another label are returned whose score is from ``low`` to ``high`` per cent of the
    positive's. Higher scores come first, ties by smaller id.

    * Rows with a null id, label or vector take no part. Scores beyond 64 bits are cut at the ends of that range.
    * No row with the anchor's own id is its positive or negative; other repeated rows count once each, and a positive
      that repeats with the same score has its negatives once. An anchor that repeats stands for its smallest label and vector.
    * Anchors without positives, and positives without a row in their window, have no rows; so have empty tables.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    chosen = vectors.where(whole).select("vec_id", "label", "v", F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    rows = written(chosen.withColumn("_row", F.monotonically_increasing_id()), "negatives-rows")
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("_anchor"), F.max(F.size("v"))).first()
    per = 8 * max(width or 0, 1)
    row_blocks, anchor_blocks = (max(1, -(-x * per // size)) for x, size in ((n, ROW_BYTES), (asked, ANCHOR_BYTES)))
    block = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    first = rows.where("_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_first"))
    anchors = written(
        first.select(block("vec_id", anchor_blocks).alias("ab"), "vec_id", "_first.label", "_first.v"), "negatives-anchors"
    )
    groups = rows.select(
        every(anchor_blocks).alias("ab"), block("_row", row_blocks).alias("rb"), "vec_id", "label", "v"
    ).groupBy("ab", "rb")

    dealt = anchors.withColumn("rb", every(row_blocks)).groupBy("ab", "rb")
    found = dealt.cogroup(groups).applyInPandas(
        _positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint"
    )
    best = written(_ranked(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "negatives-positives")
    windows = best.distinct().groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("_p"))
    opened = anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]).select(
        "ab", "vec_id", "label", "v", F.col("_p.positive_id").alias("positive_ids"), F.col("_p.positive_score").alias("positive_scores")
    )
    dealt = opened.withColumn("rb", every(row_blocks)).groupBy("ab", "rb")
    mined = dealt.cogroup(groups).applyInPandas(
        _negatives(negatives, low, high),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    of = ["anchor_id", "positive_id", "positive_score"]
    return _ranked(mined, of, "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
