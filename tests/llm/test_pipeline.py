"""The pipeline stage by stage on the smallest tables, and every registered query of the operators."""

import collections
import importlib.util
import os
import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repograin.llm import mixing, near_dedup, queries
from repograin.llm.scratch import stored_places, written

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def module(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    found = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(found)
    return found


@pytest.fixture(scope="module")
def pipeline():
    return module("corpus_pipeline", ROOT / "corpus_pipeline.py")


def test_stages(spark, pipeline, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnsRenamed({"n_chars": "toxic_score"})
    docs = docs.withColumnsRenamed({"lang": "mix_source"})  # names that operators use themselves
    seen = [docs]
    for number, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(number)))
        seen.append(spark.read.parquet(str(tmp_path / str(number))))
    assert all(s.columns == docs.columns for s in seen[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in seen[:-1]]
    raw, clean, exact, near, mixed = rows

    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(raw.keys() - clean.keys()) <= 2 * len(toxic) and len(toxic & clean.keys()) <= len(toxic) / 2
    by_text = collections.defaultdict(list)
    for r in clean.values():
        by_text[r.text].append(r.doc_id)
    assert exact.keys() == {max(ids) for ids in by_text.values()}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0d]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(r.text) for i, r in exact.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    assert near.keys() == {i for i in sets if find(i) == i}
    assert mixed == near
    packed = seen[-1].collect()
    assert {r.doc_id for r in packed} == mixed.keys()
    filled = collections.Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024


def test_mixed_order_is_the_row_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    targets, rest = queries.MIX_TARGETS, queries.MIX_REST
    want = [r.doc_id for r in sorted(mixing.mix(docs, targets, rest).collect(), key=lambda r: r.mix_position)]
    assert [r.doc_id for r in mixing.mixed(docs, targets, rest).collect()] == want


def test_sequences_follow_the_mixed_order(spark, pipeline, tmp_path):
    n = 3000  # weights of src0 and src4 are 1 and 5; src4 runs out after 3,600 rows
    docs = spark.range(2 * n).selectExpr(
        "id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'src0' ELSE 'src4' END AS source", "repeat('word ', cast(id % 400 AS int)) AS text"
    )
    pipeline.mix_sources(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    places = {r.doc_id: r.place for r in stored_places(mixed, "place").collect()}
    targets, rest = queries.MIX_TARGETS, queries.MIX_REST
    want = [r.doc_id for r in sorted(mixing.mix(docs, targets, rest).collect(), key=lambda r: r.mix_position)]
    assert sorted(places, key=places.get) == want and sorted(places.values()) == list(range(2 * n))
    packed = sorted(pipeline.pack(spark, mixed, SF).collect(), key=lambda r: r.sequence_id)
    assert len(packed) == 2 * n
    share = lambda run: sum(r.doc_id % 2 for r in run) / len(run)
    runs = [packed[at : at + 1024] for at in range(0, len(packed), 1024)]
    assert all(abs(share(run) - 5 / 6) < 0.02 for run in runs[:3]) and share(runs[4]) == share(runs[5]) == 0
    assert [places[r.doc_id] // 1024 for r in packed] == [i // 1024 for i in range(2 * n)]


@pytest.fixture(scope="module")
def check():
    return module("check_oracle", ROOT / "tools" / "check_oracle.py")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, check, name):
    import duckdb

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)


def test_everything_is_registered(pipeline):
    sys.path.insert(0, str(ROOT))
    entry = module("__spark_entry__", ROOT / "__spark_entry__.py")
    names = entry.queries().keys()
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)}


FOLDS = {"op7_ppm": (10, 0), "op8_toxicity": (4, 2), "op9_language": (3, 1)}
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_near_dedup": "doc_id n_shingles component_id kept",
    "op7_ppm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_language": "doc_id held_out lang_pred score",
    "op12_token_counts": "doc_id n_bytes n_tokens over_limit",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_without_sql_keeps_its_contract(spark, name):
    import zlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    rows = found.collect()
    assert {r.doc_id for r in rows} == docs.keys()
    if name in FOLDS:
        parts, held = FOLDS[name]
        assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
    if name == "op1_packing":
        for i in docs:
            own = sorted((r.start, r.length) for r in rows if r.doc_id == i)
            assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
            assert {sum(n for _, n in own)} == {r.doc_tokens for r in rows if r.doc_id == i}
    if name == "op12_token_counts":
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(queries.tokenizer_file())
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
        sizes = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
        assert got == {i: (len(t.encode()), sizes[i], sizes[i] > 1024) for i, t in docs.items()}
    if name == "op8_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_stages_take_nulls_repeated_rows_long_texts_and_empty_tables(spark, pipeline, tmp_path):
    long = "The river ran on and on past hill " * 6000
    rows = [(i, f"some plain words number {i} stand here as a text of its own", "en", f"src{i % 3}", 9, "k") for i in range(30)]
    rows += [(40, None, None, None, None, None), (41, "", "en", "src1", 0, "k"), (None, "no id but words enough for a set here", "de", "src2", 3, "k")]
    rows += [(42, long, "en", "src0", 5, "k"), (43, long + "end", "en", None, 5, "k"), (7, rows[7][1], "en", "src1", 9, "k"), (44, rows[3][1], "en", "other", 9, "k")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string"
    for folder, given in (("full", rows), ("none", [])):
        docs = spark.createDataFrame(given, schema).withColumnRenamed("lang", "_hash")
        for number, (name, stage) in enumerate(pipeline.STAGES):
            path = str(tmp_path / f"{folder}{number}")
            stage(spark, docs, SF).write.parquet(path)
            after = spark.read.parquet(path)
            assert number == len(pipeline.STAGES) - 1 or after.columns == docs.columns
            docs = after
            if folder == "full" and name == "exact dedup":
                kept = [r.doc_id for r in docs.collect()]
                assert 3 not in kept and {44, 42, 43, None, 41} <= set(kept) and kept.count(7) == 2 and 40 not in kept
            if folder == "full" and name == "near dedup":
                assert {42, 43} & {r.doc_id for r in docs.collect()} == {42}
        assert (docs.count() == 0) == (folder == "none")


def test_workers_get_small_batches_and_the_same_rows(spark, pipeline, monkeypatch):
    monkeypatch.setattr(near_dedup, "LONG_LIST", 2)  # so that groups are larger than a batch of 1 KiB
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).union(spark.createDataFrame(
        [(10_000 + i, " ".join(f"w{j + (j % 9 == i % 9) * i}" for j in range(300)), "en", "web", 0) for i in range(30)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    ))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    try:
        spark.conf.unset(BATCH)
        pipeline.drop_toxic(spark, docs, SF)
        long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("some text "), 300).alias("text"))  # 9 MB in one task
        assert max(r.bytes for r in long.mapInArrow(sizes, "bytes bigint").collect()) < 3 << 20
        seen = []
        for size in ("1k", "64m"):
            spark.conf.set(BATCH, size)
            stored = written(docs, "small-batches")
            kept = pipeline.drop_near(spark, stored, SF).select("doc_id").collect()
            packed = pipeline.pack(spark, stored.coalesce(1).orderBy("doc_id").transform(lambda d: written(d, "in-order")), SF)
            seen.append((sorted(kept), sorted(map(tuple, packed.collect()))))
            assert spark.conf.get(BATCH) == size  # a session's own setting stays
        assert seen[0] == seen[1] and 0 < len(seen[0][0]) < 90
    finally:
        spark.conf.unset(BATCH)
