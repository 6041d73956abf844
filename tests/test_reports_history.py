import random

from pyspark.sql import functions as F

from repograin.operators import history as H
from repograin.operators import reports as P
from repograin.operators import symbols as S

SYM = "repo_id string, file string, line int, type string, name string, type_ord int, pos bigint, cell int, block string"


def sample(spark, n=450):
    rng = random.Random(3)
    rows = [("r", f"src/f{rng.choice('abb')}.py", rng.randint(1, 40), t, f"n{i}:x", o, i, None, None) for i in range(n) for t, o in [rng.choice([("function", 0), ("class", 1)])]]
    return spark.createDataFrame(rows, SYM), rows


def test_compact_drops_nothing_and_reads_back(spark):
    df, rows = sample(spark)
    parts = P.symbols_compact(df, 100).collect()
    assert sum(r.n_symbols for r in parts) == len(rows) and max(r.n_symbols for r in parts) == 100
    text = [r.value for r in P.compact_text(df).collect()]
    assert text[0] == P.COMPACT_TITLE + ":" and text[2] == f"Total symbols: {len(rows)}"
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(text)], "repo_id string, line_no bigint, value string")
    back = sorted((r.file, r.line, r.type, r.name) for r in P.parse_compact(lines).collect())
    assert back == sorted((f, ln, t[:3], n) for _, f, ln, t, n, *_ in rows)


def test_compact_reader_skips_noise(spark):
    text = ["1:fun:lost", "# c", "a/b.rs", "5:fun:x bad 7:var x:y:z 8:cla:n:m", "", "root.sql", "1:tbl:t", "note.txt", "2:tbl:u"]
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(text)], "repo_id string, line_no bigint, value string")
    got = sorted((r.file, r.line, r.type, r.name) for r in P.parse_compact(lines).collect())
    assert got == [("a/b.rs", 5, "fun", "x"), ("a/b.rs", 8, "cla", "n:m"), ("root.sql", 1, "tbl", "t"), ("root.sql", 2, "tbl", "u")]


def test_formats(spark):
    df = spark.createDataFrame([("r", "d/a.py", 7, "function", "go", 0, 0, None, None)], SYM)
    assert P.symbols_markdown(df).first().value == "| d/a.py | 7 | function | go |"
    assert P.symbols_markdown(df, short_names=True).first().value == "| a.py | 7 | function | go |"
    assert P.symbols_text(df).first().value == "     7 fun go"
    assert P.symbols_listing(df).first().value == f"{'d/a.py':<60} {7:<6} {'function':<10} go"
    assert P.symbols_summary(df).first().value == "  7:fun:go"
    assert P.symbols_json(df).first().value == '{"file":"d/a.py","line":7,"type":"function","name":"go"}'
    report = [r.value for r in P.list_report(P.symbols_markdown(df), P.SYMBOL_TABLE_HEAD, ["file", "line"]).collect()]
    assert report == [*P.SYMBOL_TABLE_HEAD, "| d/a.py | 7 | function | go |"]


def test_profiles_and_sample(spark):
    df, rows = sample(spark)
    names = S.profile_names(df, per_row=50).collect()
    assert sum(len(r.names) for r in names) == len(rows) and max(len(r.names) for r in names) <= 50
    assert len(S.symbol_sample(df).collect()) == 5
    tags = {r.type: (r.stored_tag, r.table_tag) for r in S.type_tags(df.unionByName(df.limit(1).withColumn("type", F.lit("heading")))).collect()}
    assert tags["heading"] == ("hea", "hdr") and tags["function"] == ("fun", "fun")


def test_summary_reports(spark):
    rows = [("r", "a.py", "é" * 81), ("r", "b.py", ""), ("r", "c.py", "x" * 80)]
    meta = spark.createDataFrame(rows, "repo_id string, rel_path string, summary string").withColumn("last_updated", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = sorted(r.value for r in P.summary_report(meta).collect())
    assert got == [f"| a.py | {'é' * 80}... | 2024-01-02 03:04:05 |", f"| c.py | {'x' * 80} | 2024-01-02 03:04:05 |"]
    assert P.summary_text(meta).count() == 2 and P.summary_json(meta).count() == 2


def test_retention_with_a_hot_repo(spark):
    rows = [("hot", f"2024-01-{d:02d} 00:00:00", "snapshot") for d in range(1, 29) for _ in range(9)]
    rows += [("hot", "2025-01-01 00:00:00", "backup"), ("small", "2024-02-01 00:00:00", "snapshot")]
    hist = spark.createDataFrame(rows, "repo_id string, ts string, kind string").select("repo_id", F.col("ts").cast("timestamp").alias("snapshot_ts"), "kind")
    marked = H.retention(hist, 10).collect()
    kept = sorted(r.snapshot_ts.day for r in marked if r.keep and r.repo_id == "hot")
    assert kept == list(range(19, 29)) and sum(not r.keep for r in marked) == 18
    assert {r.repo_id: str(r.snapshot_ts.date()) for r in H.latest(hist).collect()} == {"hot": "2024-01-28", "small": "2024-02-01"}
    counts = {r.repo_id: (r.n_kept, r.n_deleted) for r in H.retention_counts(H.retention(hist, 10)).collect()}
    assert counts == {"hot": (10, 18), "small": (1, 0)}
    first = H.newest_first(H.snapshots(hist)).first()
    assert (first.label, first.n_rows) == ("2024-01-28_00-00-00", 9)
