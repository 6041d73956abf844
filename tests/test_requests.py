import json
from collections import Counter

import duckdb
import pytest

from pyspark.sql import functions as F

from repograin.functions.paths import split_ext, suffix
from repograin.functions.text import summary_from_answer, time_label
from repograin.operators import requests as R
from repograin.plans.queries import ORACLES, QUERIES
from repograin.sources import stores


def test_requests_truncate_and_skip_empty(spark):
    files = spark.createDataFrame([("r", "a.py", "é" * 60), ("r", "b", ""), ("r", "c.zz", "z")], "repo_id string, rel_path string, text string")
    rows = {r.custom_id: r for r in R.batch_requests(files, max_chars=50).collect()}
    assert set(rows) == {"a.py", "c.zz"}
    prompt = rows["a.py"].body.messages[1].content
    assert "é" * 50 in prompt and "é" * 51 not in prompt and "Language: Python" in prompt and R.TRUNCATION_NOTE not in prompt
    assert "Language: Unknown" in rows["c.zz"].body.messages[1].content
    single = files.select(R.single_prompt(F.col("rel_path"), F.lit(None).cast("string"), F.col("text"), 50).alias("p")).collect()
    assert R.TRUNCATION_NOTE in single[0].p and "Language" not in single[0].p and R.TRUNCATION_NOTE not in single[2].p
    line = R.request_lines(R.batch_requests(files)).filter("custom_id = 'a.py'").first()
    parsed = json.loads(line.value)
    assert "é" in line.value and line.bytes == len(line.value.encode()) + 1
    assert parsed["method"] == "POST" and parsed["body"]["temperature"] == 0.3 and parsed["body"]["max_tokens"] == 4000


def test_types_histogram_and_exclusion(spark):
    ids = ["a.py", "d/b.py", "Makefile", ".env", "x.", "t.tar.gz", None, ""]
    df = spark.createDataFrame([(i,) for i in ids], "custom_id string")
    hist = {r.file_type: r.n_requests for r in R.type_histogram(df).collect()}
    assert hist == {".py": 2, "Makefile": 1, ".env": 1, ".": 1, ".gz": 1}
    left = [r.custom_id for r in R.exclude_types(df, [".py", "Makefile"]).collect()]
    assert sorted(left) == [".env", "t.tar.gz", "x."]
    assert R.exclude_types(df, []).count() == len(ids)


def test_suffix_and_split_ext(spark):
    names = ["a.b.c", ".env", "a.", "..a", "noext", "d.x/f", ".a.b"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", suffix("p").alias("s"), split_ext("p").alias("e")).collect()
    assert {r.p: (r.s, r.e) for r in rows} == {
        "a.b.c": (".c", ".c"), ".env": ("", ""), "a.": ("", "."), "..a": (".a", ""), "noext": ("", ""), "d.x/f": ("", ""), ".a.b": (".b", ".b"),
    }


def test_chunks_respect_both_limits(spark):
    rows = [("hot" if i % 3 else f"r{i}", f"f{i:05d}", 10 + (i * 7) % 90) for i in range(1000)]
    sizes = spark.createDataFrame(rows, "repo_id string, custom_id string, bytes bigint").repartition(5)
    chunked = R.chunk_requests(sizes, max_requests=64, max_bytes=2000)
    got = chunked.collect()
    assert sorted(r.seq for r in got) == list(range(1, 1001))
    order = sorted(got, key=lambda r: (r.repo_id, r.custom_id))
    assert [r.seq for r in order] == list(range(1, 1001))
    for r in R.chunk_sizes(chunked).collect():
        assert r.n_requests <= 64 and r.bytes <= 2000
    jobs = R.job_rows(chunked, 0.0).collect()
    assert sorted(j.chunk_index for j in jobs) == list(range(1, jobs[0].total_chunks + 1)) and len(jobs) == jobs[0].total_chunks


def test_lines_near_or_above_the_limit_stay_alone(spark, tmp_path):
    rows = [("r", f"f{i:03d}", b) for i, b in enumerate([50, 61, 5, 5, 700, 30, 31, 60] * 5)]
    sizes = spark.createDataFrame(rows, "repo_id string, custom_id string, bytes bigint")
    got = {r.custom_id: r for r in R.chunk_requests(sizes, max_bytes=60).collect()}
    assert len(got) == len(rows) and sorted(r.seq for r in got.values()) == list(range(1, 41))
    parts = {}
    for r in got.values():
        parts.setdefault((r.chunk, r.part), []).append(r.bytes)
    assert all(len(p) == 1 or sum(p) <= 60 for p in parts.values())
    assert all((got[c].part < 0) == (b > 30) for _, c, b in rows)
    wide = spark.createDataFrame([("r", "a", "POST", "u", "x" * 100)], "repo_id string, custom_id string, method string, url string, body string")
    with pytest.raises(ValueError):
        stores.write_requests(wide, str(tmp_path / "out"), max_bytes=60)


def test_request_chunk_sizes_splits_by_bytes(spark, tmp_path):
    sizes = [(i * 7919) % 9000 for i in range(250)] + [30_000, 30_001, 60_000, 60_001, 90_000, 0]
    rows = [(i, "é" * (n // 2) + "x" * (n % 2), "en", f"s{i % 3}") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame([*rows, (len(rows), None, "en", "s0")], "doc_id bigint, text string, lang string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    columns = ["chunk", "part", "n_requests", "bytes"]
    got = [tuple(r) for r in QUERIES["request_chunk_sizes"](spark, str(tmp_path)).select(columns).collect()]
    assert all(n == 1 or b <= 60_000 for _, _, n, b in got)
    assert all(n <= 100 for _, _, n, _ in got) and any(n > 1 and part > 0 for _, part, n, _ in got)
    assert sum(r[2] for r in got) == len(rows) + 1 and sum(r[3] or 0 for r in got) == sum(sizes)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['request_chunk_sizes']})").fetchall()) == Counter(got)


def test_results_of_several_folders_keep_their_order(spark, tmp_path):
    line = lambda i, text: json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": json.dumps({"summary": text})}}]}}})
    files = {"b/part-1": [("x", "early"), ("y", "b1")], "b/part-2": [("x", "late"), ("z", "z1"), ("z", "z2")], "a/part-0": [("y", "a0")], "a/part-1": [("y", "a1")]}
    for name, rows in files.items():
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_text("\n".join([*(line(*r) for r in rows), "{broken", ""]))
    read = lambda *folders: {r.custom_id: r.summary for r in R.last_summaries(stores.read_results(spark, *[str(tmp_path / f) for f in folders])).collect()}
    assert read("b") == {"x": "late", "y": "b1", "z": "z2"}
    assert read("b", "a") == {"x": "late", "y": "a1", "z": "z2"} and read("a", "b")["y"] == "b1"


def test_types_come_from_the_path(spark):
    rows = [("my.repo", "Makefile", "my.repo::Makefile"), ("my.repo", "a.py", "my.repo::a.py")]
    df = spark.createDataFrame(rows, "repo_id string, rel_path string, custom_id string")
    assert {r.file_type for r in R.type_histogram(df).collect()} == {"Makefile", ".py"}
    assert [r.rel_path for r in R.exclude_types(df, ["Makefile"]).collect()] == ["a.py"]


def test_answers(spark):
    cases = {
        '{"summary": "a"}': ("a", "a", "a"),
        '{"other": 1}': ('{"other": 1}', '{"other": 1}', ""),
        'text {"summary": "b\\n"} more': ("b\n", 'text {"summary": "b\\n"} more', "b\n"),
        "plain": ("plain", "plain", "Error parsing API response: plain"),
        "{bad} {": ("{bad} {", "{bad} {", "Error parsing API response: {bad} {"),
        "[1, 2]": ("[1, 2]", "[1, 2]", ""),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    rows = df.select("c", *[summary_from_answer("c", m).alias(m) for m in ("single", "batch", "legacy")]).collect()
    assert {r.c: (r.single, r.batch, r.legacy) for r in rows} == cases


def result(i, content):
    return json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_result_lines(spark):
    lines = [
        result("a", '{"summary": "first"}'), "", "  ", "{broken", '{"custom_id": "x"}', result("a", "last"), result("b", ""),
        '{"custom_id": "c", "response": {"body": {"choices": []}}}', result("d", '["list"]'), result(None, "z"),
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string")
    parsed = R.parse_results(df)
    assert {(r.custom_id, r.summary) for r in parsed.collect()} == {("a", "first"), ("a", "last"), ("d", '["list"]')}
    assert {(r.custom_id, r.summary) for r in R.last_summaries(parsed).collect()} == {("a", "last"), ("d", '["list"]')}


def test_error_lines(spark):
    lines = ['{"custom_id": "a", "error": {"code": "429", "message": "slow"}}', '{"custom_id": "b"}', "", "nope{"]
    rows = R.parse_errors(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert {(r.custom_id, r.code, r.message) for r in rows} == {("a", "429", "slow"), ("b", "Unknown", "Unknown error")}


def test_totals_cost_states(spark):
    files = spark.createDataFrame([("r", "abc"), ("r", "éé"), ("r", None)], "repo_id string, text string")
    row = R.char_totals(files).first()
    assert (row.total_chars, row.est_tokens) == (5, 1)
    assert R.batch_cost(files).first().est_cost == 0.0015
    jobs = spark.createDataFrame([("j", "completed"), ("j", "failed"), ("j", "validating"), ("k", "completed")], "g string, status string")
    got = {r.g: (r.completed, r.failed, r.pending, r.all_done, r.any_failed) for r in R.state_counts(jobs, ["g"]).collect()}
    assert got == {"j": (1, 1, 1, False, True), "k": (1, 0, 0, True, False)}


def test_transitions_keep_first_and_changes(spark):
    polls = [("j", t, s) for t, s in enumerate(["new", "new", "run", "run", "new", "done"])] + [("k", 0, "new")]
    df = spark.createDataFrame(polls, "job string, t int, status string")
    got = sorted((r.job, r.t) for r in R.status_transitions(df, "job", ["t"]).collect())
    assert got == [("j", 0), ("j", 2), ("j", 4), ("j", 5), ("k", 0)]


def test_time_label(spark):
    df = spark.sql("select timestamp_seconds(0) a, cast(null as timestamp) b, timestamp_seconds(60) c")
    assert list(df.select(*[time_label(c).alias(c) for c in "abc"]).first()) == ["N/A", "N/A", "1970-01-01 00:01:00"]
