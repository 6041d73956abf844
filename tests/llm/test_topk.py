"""Exact top-k against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from repograin.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, v int"


def brute(rows, k):
    ok = {i: [math.floor(256 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in ok:
        if q % 5 == 0:
            scored = sorted((-max(min(sum(a * b for a, b in zip(ok[q], ok[i])), 2**63 - 1), -(2**63)), i) for i in ok if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5):
    vectors = topk.quantised(spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA), "vec_id", "embedding")
    got = topk.exact_top_k(vectors, F.col("vec_id") % 5 == 0, k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


@pytest.mark.parametrize(("blocks", "bins"), [((1024, 8192), 1 << 12), ((7, 16), 8)])
def test_against_brute_force(spark, monkeypatch, blocks, bins):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    monkeypatch.setattr(topk, "BINS", bins)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [0.5, 0.25, -1.0, 0.0, 0.0, 2.0]) for i in range(40)]  # many ties
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] * 6), (203, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    assert run(spark, rows) == brute(rows, 5)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [(-1.0) ** i * 1e12 * (i + 1), 3.0, float(i)]) for i in range(12)] + [(50, [1e300, 1.0, 1.0])]
    rows = [(i, [min(x, 2.0**54) for x in e]) for i, e in rows]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_few_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert run(spark, rows) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(1, [2.0])]) == [] and run(spark, []) == []
