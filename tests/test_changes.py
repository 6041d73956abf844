import random

import pytest
from pyspark.sql import functions as F

from repograin.operators import catalog as K
from repograin.operators import changes as C

META = "repo_id string, rel_path string, hash string, last_updated timestamp, summary string"


def meta(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, rel_path string, hash string, summary string").withColumn(
        "last_updated", F.lit("2024-01-01").cast("timestamp")
    )


@pytest.fixture(scope="module")
def states(spark):
    old = meta(spark, [("r", "same", "h", "s1"), ("r", "mod", "h", "s2"), ("r", "gone", "h", "s3"), ("r", "null", None, "s4"), ("r", "lost", "h", "s5"), ("q", "mod", "h", "s6")])
    new = spark.createDataFrame(
        [("r", "same", "h"), ("r", "mod", "h2"), ("r", "new", "h"), ("r", "null", None), ("r", "lost", None), ("q", "mod", "h")],
        "repo_id string, rel_path string, hash string",
    )
    return old, new


def test_feed_is_null_safe_and_keyed_by_repo(states):
    got = {(r.repo_id, r.rel_path): r.change for r in C.change_feed(*states).collect()}
    assert got == {
        ("r", "same"): "unchanged", ("r", "mod"): "modified", ("r", "gone"): "deleted", ("r", "new"): "new",
        ("r", "null"): "unchanged", ("r", "lost"): "modified", ("q", "mod"): "unchanged",
    }


def test_first_run_is_all_new(spark, states):
    empty = spark.createDataFrame([], META)
    assert {r.change for r in C.change_feed(empty, states[1]).collect()} == {"new"}


def test_classes_partition_the_key_union(spark):
    rng = random.Random(2)
    keys = [f"f{i}" for i in range(300)]
    old = {k: rng.choice("ab") for k in rng.sample(keys, 200)}
    new = {k: rng.choice("ab") for k in rng.sample(keys, 200)}
    frames = [spark.createDataFrame([("r", k, h) for k, h in d.items()], "repo_id string, rel_path string, hash string") for d in (old, new)]
    rows = C.change_feed(*frames).collect()
    assert sorted(r.rel_path for r in rows) == sorted(old.keys() | new.keys())
    for r in rows:
        want = "new" if r.rel_path not in old else "deleted" if r.rel_path not in new else "unchanged" if old[r.rel_path] == new[r.rel_path] else "modified"
        assert r.change == want


def test_files_to_update_force_and_retry(states, spark):
    old, new = states
    names = lambda df: sorted((r.repo_id, r.rel_path) for r in df.collect())
    assert names(C.files_to_update(new, old)) == [("r", "lost"), ("r", "mod"), ("r", "new")]
    assert len(names(C.files_to_update(new, old, force=True))) == 6
    blank = old.withColumn("summary", F.when(F.col("rel_path") == "same", "").otherwise(F.col("summary")))
    assert ("r", "same") in names(C.files_to_update(new, blank, retry_empty=True))


def test_live_and_removed_split_the_state(states):
    old, new = states
    live, removed = C.live_metadata(old, new), C.removed_metadata(old, new)
    assert live.count() + removed.count() == old.count()
    assert [r.rel_path for r in removed.collect()] == ["gone"]


def test_merge_state(states, spark):
    old, new = states
    answers = spark.createDataFrame([("r", "mod", "m!"), ("r", "new", ""), ("r", "same", "ignored")], "repo_id string, rel_path string, summary string")
    rows = {(r.repo_id, r.rel_path): r for r in C.merge_state(new, old, answers, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert set(rows) == {("r", "same"), ("r", "mod"), ("r", "new"), ("r", "null"), ("r", "lost"), ("q", "mod")}
    assert rows["r", "mod"].summary == "m!" and rows["r", "mod"].hash == "h2" and rows["r", "mod"].last_updated.year == 2025
    assert rows["r", "same"].summary == "s1" and rows["r", "same"].last_updated.year == 2024
    assert rows["r", "new"].summary == "" and rows["r", "lost"].summary == "s5" and rows["r", "lost"].hash is None
    stats = {r.repo_id: r for r in C.run_stats(C.change_feed(old, new), answers).collect()}
    assert (stats["r"].processed, stats["r"].errors, stats["r"].deleted, stats["r"].total_files, stats["r"].unchanged) == (1, 2, 1, 5, 2)


def test_upsert_replaces_whole_entries(states, spark):
    old, _ = states
    new = meta(spark, [("r", "mod", None, None), ("r", "fresh", "x", "y")])
    rows = {r.rel_path: r for r in C.upsert(old.filter("repo_id = 'r'"), new).collect()}
    assert rows["mod"].hash is None and rows["mod"].summary is None and rows["fresh"].summary == "y" and len(rows) == 6


def test_queries_on_stored_tables(states, spark):
    rows = [("r", p) for p in ["src/A.PY", "src/b.py", "src2/c.py", "d.js", "x.py.txt"]]
    df = spark.createDataFrame(rows, "repo_id string, rel_path string")
    names = lambda d: sorted(r.rel_path for r in d.collect())
    assert names(K.filter_query(df, "rel_path", "PY", "src/")) == ["src/A.PY", "src/b.py"]
    assert names(K.filter_by_extensions(df, [".py"])) == ["src/b.py", "src2/c.py"]
    assert names(K.filter_by_extensions(df, [])) == sorted(p for _, p in rows)
    assert K.get_file_info(states[0], "r", "nope").count() == 0
    known = {r.rel_path: (r.known, r.summary) for r in K.lookup(spark.createDataFrame([("r", "mod"), ("r", "zz")], "repo_id string, rel_path string"), states[0]).collect()}
    assert known == {"mod": (True, "s2"), "zz": (False, None)}
