"""Sources, stores, update jobs and the streaming form on small trees."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from repograin.operators import requests as R
from repograin.operators.catalog import build_catalog
from repograin.plans import updates as U
from repograin.sources import buckets, commits, stores, tree
from repograin.streaming import incremental


def write_tree(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())


FILES = {
    "__init__.py": "x = 1\n", ".github/ci.yml": "on: push\n", "src/_private/m.py": "def f():\n    pass\n", "src/a.log": "log",
    "build/out.py": "y = 2\n", "docs/é.md": "# Title\n", "src/bad.txt": b"\xff\xfeok", "empty.py": "", ".repograin/v1/x": "no",
}


def test_tree_source_sees_hidden_names_and_prunes(spark, tmp_path):
    write_tree(tmp_path / "repo", FILES)
    rows = build_catalog(tree.read_files(spark, str(tmp_path / "repo"), ["build/", "*.log"])).collect()
    assert {r.rel_path for r in rows} == {"__init__.py", ".github/ci.yml", "src/_private/m.py", "docs/é.md", "src/bad.txt", "empty.py"}
    one = next(r for r in rows if r.rel_path == "__init__.py")
    assert (one.repo_id, one.length, one.hash) == ("repo", 6, hashlib.md5(b"x = 1\n").hexdigest())
    listed = tree.list_files(spark, str(tmp_path / "repo"), ["build/"], "named")
    assert {r.repo_id for r in listed.collect()} == {"named"} and listed.columns == ["repo_id", "rel_path", "abs_path", "length", "mtime"]


@pytest.mark.skipif(os.geteuid() == 0, reason="root reads everything")
def test_unreadable_file_keeps_a_null_hash(spark, tmp_path):
    write_tree(tmp_path / "r", {"a.py": "x"})
    os.chmod(tmp_path / "r" / "a.py", 0)
    assert build_catalog(tree.read_files(spark, str(tmp_path / "r"))).first().hash is None


def test_file_that_vanishes_keeps_a_null_hash(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame([("r", "gone.py", str(tmp_path / "gone.py"), 1, None)], columns=["repo_id", "rel_path", "abs_path", "length", "mtime"])
    out = list(tree._read_contents(iter([frame])))
    assert out[0]["content"].iloc[0] is None


def test_flat_folder_is_listed_by_several_tasks(spark, tmp_path):
    folder = tmp_path / "flat repo"
    folder.mkdir()
    for i in range(50_000):
        (folder / f"f{i}.{'py' if i % 1000 == 0 else 'log'}").touch()
    (folder / "f7.log").write_bytes(b"seven")
    listed = tree.list_files(spark, folder.as_uri())
    by_task = listed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by_task) == 7 and sum(r["count"] for r in by_task) == 50_000 and max(r["count"] for r in by_task) < 8_000
    one = tree.with_contents(listed.filter("rel_path = 'f7.log'"), tasks=1).first()
    assert (one.repo_id, one.length, bytes(one.content)) == ("flat repo", 5, b"seven")
    reader = tree.TreeReader({"path": str(folder)})
    kept = list(reader.pushFilters([tree.StringEndsWith(("rel_path",), ".py")]))
    assert len(kept) == 1 and sum(1 for u in reader.partitions() for _ in reader.read(u)) == 50  # pruned in the walk
    assert listed.filter(F.col("rel_path").endswith(".py")).count() == 50


def test_filters_prune_the_walk(spark, tmp_path, monkeypatch):
    write_tree(tmp_path / "repo", {f"d{i}/e{j}/f.py": "x" for i in range(5) for j in range(5)} | {"top.py": "y"})
    listed = tree.list_files(spark, str(tmp_path / "repo"))
    count = lambda cond: listed.filter(cond).count()
    assert count("rel_path LIKE 'd3/%'") == 5 and count("rel_path LIKE 'd3/e1%'") == 1 and count("rel_path = 'top.py'") == 1
    assert count("rel_path IN ('d1/e1/f.py', 'd2/e2/f.py', 'nothing')") == 2 and count("repo_id = 'other'") == 0
    assert count("repo_id = 'repo'") == 26 and count("rel_path LIKE '%/f.py' AND length = 1") == 25
    opened = []
    real = tree.entries
    monkeypatch.setattr(tree, "entries", lambda folder: opened.append(folder) or real(folder))
    reader = tree.TreeReader({"path": str(tmp_path / "repo")})
    list(reader.pushFilters([tree.StringStartsWith(("rel_path",), "d3/e1"), tree.EqualTo(("length",), 1)]))
    assert [r[1] for u in reader.partitions() for r in reader.read(u)] == ["d3/e1/f.py"]
    assert {f.removeprefix(str(tmp_path / "repo")) for f in opened} == {"", "/d3", "/d3/e1"}


def test_component_mode_equals_the_rule_on_paths(spark, tmp_path):
    from repograin.operators.ignore import is_ignored_by_component

    names = ["src", ".git", "node_modules", ".20", ".MVHJS", ".abcd", "m.pyc", "a.py", "x.so", "__pycache__"]
    files = {f"{a}/{b}/{c}" for a in names for b in names for c in names if c not in (".git", "node_modules", "src")}
    write_tree(tmp_path / "repo", dict.fromkeys(files, "x"))
    got = {r.rel_path for r in tree.list_files(spark, str(tmp_path / "repo"), mode="component").collect()}
    df = spark.createDataFrame([(f,) for f in files], "rel_path string")
    assert got == {r.rel_path for r in df.filter(~is_ignored_by_component()).collect()} and 0 < len(got) < len(files)
    assert tree.list_files(spark, str(tmp_path / "repo"), [], mode="component").count() > len(got)
    with pytest.raises(ValueError):
        tree.list_files(spark, str(tmp_path / "repo"), mode="other")


def test_stored_catalog_answers_size_questions_without_contents(spark, tmp_path):
    from repograin.operators import hierarchy

    rows = landed(spark, [("r", "a/b.py", "one"), ("r", "c.py", "three"), ("q", "a.py", "")])
    source = str(tmp_path / "landed")
    rows.write.parquet(source)
    stores.save_catalog(spark.read.parquet(source), str(tmp_path / "catalog"))
    stored = stores.load_catalog(spark, str(tmp_path / "catalog"))
    whole = build_catalog(rows)
    for job in (hierarchy.dir_rollup, hierarchy.large_repos, hierarchy.tree_lines):
        plan = job(stored)._jdf.queryExecution().toString()
        assert "content" not in plan.split("== Physical Plan ==")[1]
        assert sorted(map(tuple, job(stored).collect()), key=str) == sorted(map(tuple, job(whole).collect()), key=str)
    assert {(r.rel_path, r.hash) for r in stored.collect()} == {(r.rel_path, r.hash) for r in whole.collect()}
    listed = build_catalog(rows.drop("content").withColumn("length", F.lit(7)))
    assert "content" not in listed.columns and {(r.length, r.hash) for r in listed.collect()} == {(7, None)}


def landed(spark, rows):
    return spark.createDataFrame([(r, p, c.encode()) for r, p, c in rows], "repo_id string, rel_path string, content binary")


def make_talk():
    def talk(path, content, language):  # a local function travels to the workers by value
        if "boom" in content:
            raise RuntimeError("no answer")
        return {"summary": f"{path} [{language}] {len(content)}"}

    return talk


talk = make_talk()


def state_of(spark, store):
    return {(r.repo_id, r.rel_path): (r.summary, r.last_updated.year) for r in stores.load_metadata(spark, f"{store}/content").collect()}


def test_incremental_content_run(spark, tmp_path):
    store = str(tmp_path / "store")
    first = landed(spark, [("r", "a.py", "one"), ("r", "b.md", "two"), ("r", "c.py", "boom"), ("r", "e.py", ""), ("q", "a.py", "one")])
    stats = {r.repo_id: r for r in U.update_content(spark, first, store, talk, "2024-01-01").collect()}
    assert (stats["r"].processed, stats["r"].errors, stats["r"].total_files) == (2, 2, 4)
    second = landed(spark, [("r", "a.py", "one"), ("r", "b.md", "three"), ("r", "n.c", "new"), ("q", "a.py", "one")])
    stats = {r.repo_id: r for r in U.update_content(spark, second, store, talk, "2025-01-01").collect()}
    # Statistics are lazy: they compare with the state the run started from.
    assert state_of(spark, store) == {
        ("r", "a.py"): ("a.py [Python] 3", 2024), ("r", "b.md"): ("b.md [Markdown] 5", 2025),
        ("r", "n.c"): ("n.c [C] 3", 2025), ("q", "a.py"): ("a.py [Python] 3", 2024),
    }
    assert (stats["r"].processed, stats["r"].deleted, stats["r"].unchanged) == (2, 2, 1)
    snaps = stores.load_content_history(spark, f"{store}/content_history")
    assert {(r.kind, r.snapshot_ts.year) for r in snaps.select("kind", "snapshot_ts").distinct().collect()} == {("snapshot", 2024), ("snapshot", 2025), ("backup", 2025)}
    assert stores.load_content_history(spark, f"{store}/content_history", "2024-01-01").count() == 5
    with pytest.raises(FileNotFoundError):
        stores.load_content_history(spark, f"{store}/content_history", "1999-01-01")
    purged = {r.repo_id: (r.n_kept, r.n_deleted) for r in stores.delete_old_history(spark, f"{store}/content_history", 1).collect()}
    assert purged == {"r": (1, 1), "q": (1, 1)}
    assert stores.load_content_history(spark, f"{store}/content_history", "2025-01-01").count() == 4


def test_batch_run(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "requests")
    rows = [("r", f"f{i}.py", f"text {i}") for i in range(25)] + [("q", "f1.py", "other"), ("q", "x.txt", "skip me")]
    cost = {r.repo_id: r.n_requests for r in U.prepare_batch(spark, landed(spark, rows), store, out, [".txt"], max_requests=10).collect()}
    assert cost == {"r": 25, "q": 1}
    chunks = sorted(p for p in (tmp_path / "requests").rglob("*.txt"))
    sizes = [len(p.read_text().splitlines()) for p in chunks]
    assert sorted(sizes) == [6, 10, 10]
    ids = [json.loads(line)["custom_id"] for p in chunks for line in p.read_text().splitlines()]
    assert sorted(ids) == sorted(f"{r}::{p}" for r, p, _ in rows if not p.endswith(".txt"))
    answers = [json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": json.dumps({"summary": s + i})}}]}}}) for s in ("old ", "new ") for i in ids]
    (tmp_path / "results.jsonl").write_text("\n".join([*answers, "", "{bad"]) + "\n")
    stats = {r.repo_id: r for r in U.finish_batch(spark, landed(spark, rows), store, str(tmp_path / "results.jsonl"), "2024-05-05").collect()}
    assert stats["r"].processed == 25 and stats["q"].processed == 1
    state = state_of(spark, store)
    assert state["q", "f1.py"] == ("new q::f1.py", 2024) and len(state) == 26


def test_batch_answer_keeps_the_hash_it_was_asked_for(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "requests")
    before = landed(spark, [("r", "a.py", "old"), ("r", "b.py", "same"), ("r", "gone.py", "x"), ("q", "README.md", "one"), ("r", "Makefile", "all:")])
    U.prepare_batch(spark, before, store, out, ["Makefile"]).collect()
    ids = ["r::a.py", "r::b.py", "r::gone.py", "q::README.md"]
    answers = [json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": json.dumps({"summary": "of " + i})}}]}}}) for i in ids]
    (tmp_path / "results.jsonl").write_text("\n".join(answers) + "\n")
    after = landed(spark, [("r", "a.py", "new"), ("r", "b.py", "same"), ("q", "README.md", "one"), ("r", "README.md", "two")])
    U.finish_batch(spark, after, store, str(tmp_path / "results.jsonl"), "2024-05-05").collect()
    state = {(r.repo_id, r.rel_path): (r.hash, r.summary) for r in stores.load_metadata(spark, f"{store}/content").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert state == {("r", "a.py"): (md5("old"), "of r::a.py"), ("r", "b.py"): (md5("same"), "of r::b.py"), ("q", "README.md"): (md5("one"), "of q::README.md")}
    from repograin.operators import changes

    due = changes.files_to_update(build_catalog(after).select("repo_id", "rel_path", "hash"), stores.load_metadata(spark, f"{store}/content"))
    assert {(r.repo_id, r.rel_path) for r in due.collect()} == {("r", "a.py"), ("r", "README.md")}


def test_history_is_kept_per_repository_and_empty_snapshots_count(spark, tmp_path):
    path = str(tmp_path / "h")
    meta = lambda rows: spark.createDataFrame([(r, p, "h", None, "s") for r, p in rows], "repo_id string, rel_path string, hash string, last_updated timestamp, summary string")
    stores.save_content_history(meta([("old", "a"), ("busy", "a")]), path, "2020-01-01")
    for year in (2021, 2022, 2023):
        stores.save_content_history(meta([("busy", "a"), ("busy", "b")]), path, f"{year}-01-01")
    stores.save_content_history(meta([]), path, "2024-01-01")
    assert stores.load_content_history(spark, path, "2024-01-01").count() == 0
    counts = {r.repo_id: (r.n_kept, r.n_deleted) for r in stores.delete_old_history(spark, path, 2).collect()}
    assert counts == {"old": (1, 0), "busy": (2, 2)}
    left = {(r.repo_id, r.snapshot_ts.year) for r in stores.load_content_history(spark, path).collect()}
    assert left == {("old", 2020), ("busy", 2022), ("busy", 2023)}
    stores.save_content_history(meta([]), path, "2020-01-01")
    assert stores.load_content_history(spark, path, "2020-01-01").count() == 0


def test_old_versions_go_on_request(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.range(3)
    assert [stores.save_table(rows, table) for _ in range(4)] == [1, 2, 3, 4]
    assert stores.drop_old_versions(spark, table, keep=2) == 2
    assert stores.load_table(spark, table, "id bigint").count() == 3 and stores.save_table(rows, table) == 5


def test_symbol_update_and_text_store(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("r", "a.py", "def f():\n    x = 1\n"), ("r", "d/b.sql", "create table t (id int)"), ("q", "c.ipynb", "{bad")]
    U.update_symbols(spark, landed(spark, rows), store, "2024-01-01 10:00:00")
    stored = U.update_symbols(spark, landed(spark, rows[:1]), store, "2024-01-02 10:00:00")
    assert sorted((r.file, r.line, r.name) for r in stored.collect()) == [("a.py", 1, "f"), ("a.py", 2, "x")]
    back = stores.read_compact(spark, f"{store}/symbols_text").collect()
    assert sorted((r.repo_id, r.file, r.line, r.type, r.name) for r in back) == [("r", "a.py", 1, "fun", "f"), ("r", "a.py", 2, "var", "x")]
    history = stores.load_symbol_history(spark, f"{store}/symbol_history")
    assert history.filter("kind = 'backup'").count() == 3
    assert stores.load_symbol_history(spark, f"{store}/symbol_history", "2024-01-01 10:00:00").count() == 3


def test_patterns_and_trees_on_disk(spark, tmp_path):
    pats = spark.createDataFrame([("b.log", False), ("z/", True), ("a/", True), ("*.o", False)], "pattern string, is_dir boolean")
    stores.write_patterns(pats, str(tmp_path / "ignore"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "ignore").glob("part-*"))).splitlines()
    assert [t for t in text if t and not t.startswith("#")] == ["a/", "z/", "*.o", "b.log"] and "# Folders" in text
    assert {r.pattern for r in stores.read_patterns(spark, str(tmp_path / "ignore"), "r").collect()} == {"a/", "z/", "*.o", "b.log"}
    assert stores.read_patterns(spark, str(tmp_path / "nothing"), "r").count() == 0
    files = build_catalog(landed(spark, [("r", "a/b.py", "x"), ("r", "c.py", "xy")]))
    out = stores.write_trees(files, str(tmp_path / "trees"), [])
    tree_text = "".join(p.read_text() for p in sorted((tmp_path / "trees" / "files" / "repo_id=r").glob("part-*")))
    assert tree_text.endswith("r/\n├── a/\n│   └── b.py (1.0B)\n└── c.py (2.0B)\n") and set(out) == {"folder_tree", "file_tree"}


def test_jobs_table_and_versions(spark, tmp_path):
    path = str(tmp_path / "jobs")
    assert stores.load_jobs(spark, path).count() == 0
    sizes = spark.createDataFrame([("r", f"f{i}", 5) for i in range(30)], "repo_id string, custom_id string, bytes bigint")
    stores.append_jobs(R.job_rows(R.chunk_requests(sizes, max_requests=10), 1.0), path)
    assert sorted(r.chunk_index for r in stores.load_jobs(spark, path).collect()) == [1, 2, 3]
    table = str(tmp_path / "t")
    assert stores.load_metadata(spark, table).count() == 0
    meta = spark.createDataFrame([("r", "a", "h", None, "s")], "repo_id string, rel_path string, hash string, last_updated timestamp, summary string")
    assert stores.save_metadata(meta, table) == 1
    # The next version may read the one before it.
    assert stores.save_metadata(stores.load_metadata(spark, table).withColumn("summary", F.lit("t")), table) == 2
    assert stores.load_metadata(spark, table).first().summary == "t"


def test_stream_keeps_unreadable_files_and_never_goes_back(spark, tmp_path):
    store = str(tmp_path / "store")
    batch = lambda rows: spark.createDataFrame(rows, "repo_id string, rel_path string, t string, content binary").withColumn("mtime", F.col("t").cast("timestamp")).drop("t")
    incremental.apply_batch(batch([("r", "a.py", "2024-01-01", b"new"), ("r", "no.py", "2024-01-01", None), ("r", "un.py", None, b"x")]), store, talk)
    got = {r.rel_path: r.hash for r in stores.load_metadata(spark, f"{store}/content").collect()}
    assert got.keys() == {"a.py", "no.py", "un.py"} and got["no.py"] is None
    incremental.apply_batch(batch([("r", "a.py", "2023-01-01", b"older")]), store, talk)
    kept = {r.rel_path: r.hash for r in stores.load_metadata(spark, f"{store}/content").collect()}
    assert kept == got


def test_streaming_form_matches_and_is_idempotent(spark, tmp_path):
    landing, store, state = (str(tmp_path / d) for d in ("landing", "store", "state"))
    schema_rows = lambda rows: spark.createDataFrame(
        [(r, p, c.encode(), t) for r, p, c, t in rows], "repo_id string, rel_path string, content binary, t string"
    ).select("repo_id", "rel_path", F.col("t").cast("timestamp").alias("mtime"), "content")
    schema_rows([("r", "a.py", "one", "2024-01-01"), ("r", "a.py", "two!", "2024-01-02"), ("r", "b.py", "b", "2024-01-01")]).write.parquet(landing)
    incremental.start(spark, landing, store, state, talk).awaitTermination()
    assert state_of(spark, store) == {("r", "a.py"): ("a.py [Python] 4", 2024), ("r", "b.py"): ("b.py [Python] 1", 2024)}
    schema_rows([("r", "b.py", "bbb", "2025-01-01")]).write.mode("append").parquet(landing)
    incremental.start(spark, landing, store, state, talk).awaitTermination()
    want = {("r", "a.py"): ("a.py [Python] 4", 2024), ("r", "b.py"): ("b.py [Python] 3", 2025)}
    assert state_of(spark, store) == want
    incremental.apply_batch(schema_rows([("r", "b.py", "bbb", "2026-01-01")]), store, talk)
    assert state_of(spark, store) == want


BATCH = "repo_id string, rel_path string, t string, content binary"


def batch_of(spark, rows):
    return spark.createDataFrame(rows, BATCH).withColumn("mtime", F.col("t").cast("timestamp")).drop("t")


def data_folders(spark, path):
    return commits.read(spark, path).content["folders"]


def test_stream_rewrites_touched_buckets_only(spark, tmp_path):
    store = str(tmp_path / "store")
    path = f"{store}/content"
    rows = [(f"r{i}", f"f{j}.py", "2024-01-01", f"{i} {j}".encode()) for i in range(12) for j in range(12)]
    first = incremental.apply_batch(batch_of(spark, rows), store, None)
    before = data_folders(spark, path)
    assert len(before) == len(first) > 20
    changed = [("r3", "f1.py", "2024-02-01", b"new"), ("r3", "f2.py", "2024-02-01", b"3 2")]  # the second one is as it was
    assert len(incremental.apply_batch(batch_of(spark, changed), store, None)) == 1
    after = data_folders(spark, path)
    assert sum(after[b] != before[b] for b in before) == 1 and after.keys() == before.keys()
    assert incremental.apply_batch(batch_of(spark, changed), store, None) == []  # nothing is written twice
    assert commits.read(spark, path).number == 2
    state = {(r.repo_id, r.rel_path): r for r in stores.load_metadata(spark, path).collect()}
    assert len(state) == 144 and state["r3", "f1.py"].hash == hashlib.md5(b"new").hexdigest()
    assert (state["r3", "f1.py"].last_updated.month, state["r3", "f2.py"].last_updated.month) == (2, 1)
    assert len(list((tmp_path / "store" / "content" / "data").iterdir())) == 2
    assert stores.vacuum_metadata(spark, path, keep=1, older_than_s=0) == 0  # all but one bucket still live in the first data
    stores.save_metadata(stores.load_metadata(spark, path), path, 4)
    assert stores.vacuum_metadata(spark, path, keep=1, older_than_s=0) == 2 and len(data_folders(spark, path)) == 4
    assert stores.load_metadata(spark, path).count() == 144


def test_stream_replays_a_batch_that_was_lost_before_its_commit(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    incremental.apply_batch(batch_of(spark, [("r", "a.py", "2024-01-01", b"one")]), store, talk, "s", 0)
    before = state_of(spark, store)
    rows = [("r", "a.py", "2024-02-01", b"three"), ("r", "b.py", "2024-02-01", b"x"), ("r", "b.py", "2024-02-01", b"x")]
    with monkeypatch.context() as m:

        def lost(*_):
            raise OSError("the driver is gone")

        m.setattr(commits, "claim", lost)
        with pytest.raises(OSError):
            incremental.apply_batch(batch_of(spark, rows), store, talk, "s", 1)
    assert state_of(spark, store) == before and commits.read(spark, f"{store}/content").number == 1
    assert incremental.apply_batch(batch_of(spark, rows), store, talk, "s", 1)
    want = {("r", "a.py"): ("a.py [Python] 5", 2024), ("r", "b.py"): ("b.py [Python] 1", 2024)}
    assert state_of(spark, store) == want
    # A replay after the commit is left out, whatever it holds; another stream is not.
    late = batch_of(spark, [("r", "a.py", "2025-01-01", b"late")])
    assert incremental.apply_batch(late, store, talk, "s", 1) == [] and state_of(spark, store) == want
    assert len(incremental.apply_batch(late, store, talk, "other", 1)) == 1


def test_stream_meets_another_writer(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    path = f"{store}/content"
    incremental.apply_batch(batch_of(spark, [("r", "a.py", "2024-01-01", b"one")]), store, None)
    real, once = buckets.rewrite, []

    def rewrite(*args, **marks):
        if not once:
            once.append(1)
            incremental.apply_batch(batch_of(spark, [("r", "a.py", "2024-03-01", b"newest"), ("q", "z", None, None)]), store, None)
        return real(*args, **marks)

    monkeypatch.setattr(buckets, "rewrite", rewrite)
    incremental.apply_batch(batch_of(spark, [("r", "a.py", "2024-02-01", b"older"), ("r", "b.py", "2024-02-01", b"b")]), store, None)
    got = {(r.repo_id, r.rel_path): r.hash for r in stores.load_metadata(spark, path).collect()}
    md5 = lambda t: hashlib.md5(t).hexdigest()
    assert got == {("r", "a.py"): md5(b"newest"), ("r", "b.py"): md5(b"b"), ("q", "z"): None}
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {}, 1)


def test_history_survives_a_driver_that_is_lost_between_write_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    meta = lambda rows: spark.createDataFrame([(r, p, "h", None, "s") for r, p in rows], "repo_id string, rel_path string, hash string, last_updated timestamp, summary string")
    for year in (2021, 2022, 2023):
        stores.save_content_history(meta([("busy", "a"), ("busy", "b")] + [("old", "a")] * (year == 2021)), path, f"{year}-01-01")
    read = lambda: sorted((r.repo_id, r.rel_path, r.snapshot_ts.year) for r in stores.load_content_history(spark, path).collect())
    before = read()
    with monkeypatch.context() as m:

        def lost(*_):
            raise OSError("the driver is gone")

        m.setattr(commits, "claim", lost)
        with pytest.raises(OSError):
            stores.delete_old_history(spark, path, 1)
        with pytest.raises(OSError):
            stores.save_content_history(meta([]), path, "2021-01-01")
    assert read() == before
    # A snapshot that is saved again while the purge runs stays as it was saved.
    real = commits.update

    def meanwhile(spark, path, change):
        monkeypatch.setattr(commits, "update", real)
        stores.save_content_history(meta([("busy", "again")]), path, "2022-01-01")
        return real(spark, path, change)

    monkeypatch.setattr(commits, "update", meanwhile)
    counts = {r.repo_id: (r.n_kept, r.n_deleted) for r in stores.delete_old_history(spark, path, 1).collect()}
    assert counts == {"busy": (1, 2), "old": (1, 0)}
    want = [("busy", "a", 2023), ("busy", "again", 2022), ("busy", "b", 2023), ("old", "a", 2021)]
    assert read() == want
    # Data without a state goes on request, and nothing else.
    assert stores.vacuum_history(spark, path, keep=1) == 0
    assert stores.vacuum_history(spark, path, keep=1, older_than_s=0) > 0 and read() == want


def test_history_import_is_one_commit(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = spark.createDataFrame([("r", "2024-01-01", "snapshot"), ("q", "2024-01-02", "snapshot"), ("r", "2024-01-02", "backup")], "repo_id string, t string, kind string")
    stores.import_history(rows.withColumn("snapshot_ts", F.col("t").cast("timestamp")).drop("t"), path)
    assert commits.read(spark, path).number == 1
    assert stores.load_content_history(spark, path, "2024-01-02").first().repo_id == "q"
    assert stores.load_content_history(spark, path).count() == 3
