"""Hard negatives against brute force with Python's whole numbers, and the residue arithmetic by itself."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repograin.llm import hard_negatives as hn
from repograin.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, rank int, _row int"
CUT = lambda x: max(min(x, 2**63 - 1), -(2**63))


def brute(rows, step=10, positives=5, negatives=10, low=30, high=90):
    ok = [
        (i, [math.floor(256 * x) for x in e], lab)
        for i, e, lab in rows
        if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    anchors = {}
    for i, e, lab in sorted(ok, key=lambda r: (r[0], r[2], r[1])):
        if i % step == 0:
            anchors.setdefault(i, (e, lab))
    out = []
    for a, (e, lab) in anchors.items():
        scored = [(-CUT(sum(x * y for x, y in zip(e, f))), i, other) for i, f, other in ok if i != a]
        same = sorted((s, i) for s, i, other in scored if other == lab)[:positives]
        for s, p in dict.fromkeys(same):
            inside = sorted((t, i) for t, i, other in scored if other != lab and low * -s <= 100 * -t <= high * -s)
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    vectors = topk.quantised(table, "vec_id", "embedding", label=F.col("label"))
    got = hn.hard_negatives(vectors, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(hn, "ROW_BYTES", 8 * 6 * 40)
        monkeypatch.setattr(hn, "ANCHOR_BYTES", 8 * 6 * 9)
        monkeypatch.setattr(hn, "SLICE", 3)
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)], i % 3) for i in range(150)]
    rows += [(300 + i, [0.5, 0.25, -1.0, 0.0, 0.0, 2.0], i % 2) for i in range(60)]  # ties
    rows += [(7, rows[7][1], 1), (20, [0.5] * 6, 0), (20, [0.25] * 6, 2), (41, [0.5] * 6, 1), (41, [0.5] * 6, 1)]  # repeated ids
    rows += [(500, None, 1), (501, [1.0, None] + [0.0] * 4, 1), (502, [math.nan] * 6, 1), (503, [-math.inf] + [0.0] * 5, 1)]
    rows += [(None, [1.0] * 6, 1), (510, [1.0] * 6, None), (520, [], 1), (530, [1.0], 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, positives=2, negatives=3, low=-20, high=60) == brute(rows, 10, 2, 3, -20, 60)


def test_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 32768)]


def test_scores_beyond_64_bits_are_cut(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i)], i % 2) for i in range(25)] + [(40, [3e7, 2.0**40], 0), (41, [2.0**39, 2.0], 1)]
    rows = [(i, [max(min(x, 2.0**54), -(2.0**54)) for x in e], lab) for i, e, lab in rows]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("top", [1, 200, 1 << 20, 1 << 40, (1 << 53) - 1])
def test_residues_give_exact_products(top):
    rnd = random.Random(top)
    for width in (1, 70, 2500):  # wider than one exact float32 sum
        a, b = ([[rnd.randint(-top, top) for _ in range(width)] for _ in range(4)] for _ in range(2))
        b[0] = [top] * width
        a[0] = [-top] * width
        primes = hn.primes_for(top * top * width)
        x, y = np.array(a, float), np.array(b, float)
        got = hn.rebuilt([hn.product_modulo(hn.residues(x, p), hn.residues(y, p), p) for p in primes], primes)
        assert got.tolist() == [[CUT(sum(p * q for p, q in zip(r, s))) for s in b] for r in a]
