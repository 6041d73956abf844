"""Ordered operators against a plain loop, with a key that holds most rows and tiny blocks."""

import random

import pytest
from pyspark.sql import functions as F

from repograin.operators import ordered as O

ROWS = []
_rng = random.Random(5)
for _key, _size in [("hot", 700), ("a", 40), ("b", 1), ("c", 90)]:
    for _pos in range(_size):
        ROWS.append((_key, _pos * (1 + _size % 2), _rng.randint(0, 9), _rng.choice([None, None, None, "h1", "h2", "h3"])))


@pytest.fixture(scope="module")
def frame(spark):
    shuffled = ROWS[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "k string, pos bigint, v bigint, tag string").repartition(6)


def by_key():
    groups = {}
    for row in sorted(ROWS):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_block_running_sum(frame, block):
    got = {(r.k, r.pos): r.out for r in O.block_running_sum(frame, ["k"], "pos", F.col("v"), "out", block).collect()}
    want = {}
    for key, rows in by_key().items():
        total = 0
        for _, pos, v, _tag in sorted(rows, key=lambda r: r[1]):
            want[key, pos] = total
            total += v
    assert got == want


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_block_carry_last(frame, block):
    got = {(r.k, r.pos): r.out for r in O.block_carry_last(frame, ["k"], "pos", F.col("tag"), "out", block).collect()}
    want = {}
    for key, rows in by_key().items():
        last = None
        for _, pos, _v, tag in sorted(rows, key=lambda r: r[1]):
            last = tag or last
            want[key, pos] = last
    assert got == want


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_block_row_number(frame, block):
    got = {(r.k, r.pos): r.out for r in O.block_row_number(frame, ["k"], "pos", ["pos"], "out", block).collect()}
    want = {(k, row[1]): n for k, rows in by_key().items() for n, row in enumerate(sorted(rows, key=lambda r: r[1]), 1)}
    assert got == want


def test_tasks_of_block_row_number_stay_small(spark, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", 200, raising=False)
    rows = spark.range(20_000).select((F.col("id") % 500).alias("k"), F.floor(F.col("id") / 500).alias("pos"))
    ranked = O.block_row_number(rows, ["k"], "pos", ["pos"], "out").withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in ranked.groupBy("task").count().collect()]
    assert sum(tasks) == 20_000 and max(tasks) <= 1_000
    assert ranked.filter(F.col("out") != F.col("pos") + 1).isEmpty()


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_block_lists(frame, block):
    lists = O.block_lists(frame, ["k"], "pos", ["pos"], F.col("v"), 30, block)
    got = {(r.k, r.part): r["values"] for r in lists.collect()}
    want = {}
    for key, rows in by_key().items():
        for n, (_, _pos, v, _tag) in enumerate(sorted(rows, key=lambda r: r[1])):
            want.setdefault((key, n // 30), []).append(v)
    assert got == want


@pytest.mark.parametrize("slices", [1, 5])
def test_sorted_row_number_with_sums(frame, slices):
    rows = O.sorted_row_number(frame, ["k", "pos"], "rn", {"before": "v"}, slices).collect()
    total = 0
    ordered = sorted(rows, key=lambda r: (r.k, r.pos))
    for number, r in enumerate(ordered, 1):
        assert (r.rn, r.before) == (number, total)
        total += r.v
    assert len(rows) == len(ROWS)


def test_slices_follow_the_number_of_rows(frame, monkeypatch):
    setting = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = O.sorted_slices(frame, ["k", "pos"])
    assert few.select("_slice").distinct().count() <= setting
    monkeypatch.setattr(O, "SLICE_ROWS", max(1, len(ROWS) // (4 * setting)))
    sizes = [r["count"] for r in O.sorted_slices(frame, ["k", "pos"]).groupBy("_slice").count().collect()]
    assert sum(sizes) == len(ROWS)
    assert len(sizes) > 2 * setting
    rows = O.sorted_row_number(frame, ["k", "pos"], "rn").collect()
    assert [r.rn for r in sorted(rows, key=lambda r: (r.k, r.pos))] == list(range(1, len(ROWS) + 1))


def test_slices_of_an_empty_table(frame):
    assert O.sorted_row_number(frame.where("false"), ["k", "pos"], "rn", {"before": "v"}).collect() == []


@pytest.mark.parametrize("slices", [1, 5, 40])
def test_sorted_previous(frame, slices):
    rows = sorted(O.sorted_previous(frame, ["k"], ["pos"], "v", "prev", slices).collect(), key=lambda r: (r.k, r.pos))
    before = {}
    for r in rows:
        assert r.prev == before.get(r.k)
        before[r.k] = r.v


def test_salted_join_keeps_every_row_once(frame, spark):
    small = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, w int")
    got = O.salted_join(frame, small, ["k"], F.col("pos"), "left", salts=5)
    assert got.count() == len(ROWS)
    assert {(r.k, r.w) for r in got.collect()} == {("hot", 1), ("a", 2), ("b", None), ("c", None)}
