"""Packing: exact round trip, window limits, little padding."""

import collections
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from repograin.llm import packing

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")
ROOT = Path(packing.__file__).resolve().parents[2]


def test_ids_equal_the_tokenizers(spark):
    rnd = random.Random(3)
    parts = [" ", " ", "a", "Bc", "\n", "é", "12", ".", "'ll", "\t", "　", "\xa0", packing.SPECIAL, "🙂", "\x00", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    encoder, whole = packing.Encoder(FILE), tokenizers.Tokenizer.from_file(FILE)
    got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 100) for x in encoder.encode(texts[at : at + 100])]
    assert got == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 8)))
    rows = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 50, 400, 900])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " ".join(word() for _ in range(20000))), (None, "no id"), (7, "again")]
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id bigint, length int")
    packed = packing.pack_documents(docs, FILE, with_ids=True).collect()
    whole = tokenizers.Tokenizer.from_file(FILE)
    sequences = collections.defaultdict(list)
    for r in packed:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    # Only id 7 occurs twice; its two rows are told apart by their token counts.
    documents = collections.defaultdict(list)
    for r in packed:
        documents[r.doc_id, r.doc_tokens].append(r)
    want = {(i, len(ids)): ids for i, t in rows for ids in [whole.encode(t or "", add_special_tokens=False).ids + [0]]}
    assert documents.keys() == want.keys()
    for key, pieces in documents.items():
        assert sum((r.ids for r in sorted(pieces, key=lambda r: r.start)), []) == want[key]
    total = sum(r.length for r in packed)
    assert len(sequences) * packing.WINDOW <= 1.05 * total + packing.WINDOW


def test_best_fit_takes_the_tightest_window():
    rnd = random.Random(1)
    lengths = sorted((rnd.randint(1, 100) for _ in range(500)), reverse=True)
    numbers, offsets = packing.best_fit_decreasing(lengths, 100)
    free: list[int] = []
    for size, number, offset in zip(lengths, numbers, offsets):
        fits = [f for f in free if f >= size]
        if fits:
            assert free[number] == min(fits)
        else:
            assert number == len(free)
            free.append(100)
        assert offset == 100 - free[number]
        free[number] -= size


def test_sequences_are_padded_except_at_powers_of_two(spark):
    rows = [(0, 0, 0, 3, [1, 2, 3]), (1, 0, 3, 2, [4, 5]), (2, 1, 0, 4, [6] * 4)]
    packed = spark.createDataFrame(rows, "doc_id bigint, sequence_id bigint, offset bigint, length bigint, ids array<int>")
    got = {r.sequence_id: r.ids for r in packing.sequences(packed, window=16).collect()}
    assert got == {0: [1, 2, 3, 4, 5] + [0] * 11, 1: [6] * 4}


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), FILE).count() == 0


def test_a_small_cache_gives_the_same_ids():
    texts = [" ".join(f"word{i * j % 97}, é{i}" for j in range(30)) for i in range(40)]
    small, large = packing.Encoder(FILE, 50), packing.Encoder(FILE)
    assert [small.encode([t]) for t in texts] == [large.encode([t]) for t in texts]
    assert len(small.known) <= 150 < len(large.known)  # a batch and the cores of its stretches may exceed the bound


def test_cores_are_encoded_once():
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    texts = ["x " + " ".join(f"{a}{end}\n{b}{end} {b}{end}" for a in words) for b in words for end in (",", ".")]
    encoder = packing.Encoder(FILE)
    whole, given = encoder._whole, []
    encoder._whole = lambda texts: given.extend(texts) or whole(texts)
    got = [ids for at in range(0, len(texts), 16) for ids in encoder.encode(texts[at : at + 16])]
    assert sum(map(len, given)) < 10 * sum(map(len, words))
    assert got == whole(texts)


def test_runs_and_odd_stretches_keep_the_ids(monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(packing, "RUN_BYTES", 200)
    parts = ["word", "Ärger", "x1", "a)", "(b", "'s", "", "½", "e\u0301", "tab\tin", "***", "日本", packing.SPECIAL]
    ends = ["", ",", ".", "...", "?!", ";:", "\n", ".\n", "\n\n", "\r\n", ",\nnext", ".\nNext.\nmore,", "\n,", "\x0b"]
    stretch = lambda: rnd.choice(parts) + rnd.choice(ends)
    texts = [" ".join(stretch() for _ in range(rnd.randint(0, 4))) for _ in range(3000)] + ["word, " * 100 + "end.\n"]
    whole = tokenizers.Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)
    want = [np.asarray(x.ids, "<u4").tobytes() for x in whole]
    assert packing.Encoder(FILE).encode(texts) == want
    assert packing.Encoder(FILE, 30).encode(texts) == want


def test_settings_do_not_change_the_packing(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "1 + id * 37 % 1024 AS length").cache()
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(map(tuple, packing.pack_pieces(pieces).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def _growth_of_a_worker(run_bytes: int) -> float:
    """MB by which one worker process grows at most while it cuts a batch of 12 MB into pieces, packed as the pipeline does."""
    code = f"""
import random, resource
import pyarrow as pa
from repograin.llm import packing
rnd = random.Random(1)
words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(60_000)]
texts = [" ".join(rnd.choices(words, k=200)) for _ in range(6_500)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
del texts
size = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
run = packing._pieces({FILE!r}, 1024, 0, False, False, 1 << 17, {run_bytes})
assert sum(x.num_rows for x in run(iter([batch.slice(0, 1)]))) == 1
before = size()
assert sum(x.num_rows for x in run(iter([batch]))) >= batch.num_rows
print(size() - before)
"""
    return float(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=ROOT).stdout)


def test_a_worker_stays_small_in_small_runs():
    assert _growth_of_a_worker(corpus_pipeline.RUN_BYTES) < 45


def test_slices_have_the_texts_of_one_run():
    texts = [None, "", "é" * 40, "b" * 200, None, "c" * 30, "d" * 60, "e", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [x.column(1).to_pylist() for x in packing._slices(batch.slice(1), 100)]
    assert got == [["", "é" * 40], ["b" * 200], [None, "c" * 30, "d" * 60, "e", ""]]
    assert list(packing._slices(batch.slice(0, 0), 100)) == []
    many = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([None] * 5000, pa.string())], ["doc_id", "text"])
    assert [x.num_rows for x in packing._slices(many, 100)] == [2048, 2048, 904]


def test_run_bytes_do_not_change_the_pieces(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["word", "x,", "Ärger.\n", "end.", "日本"]) for _ in range(rnd.choice([0, 5, 90, 3000]))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    pieces = [sorted(map(tuple, packing.document_pieces(docs, FILE, run_bytes=n).collect())) for n in (1, 1 << 10, 1 << 22)]
    assert pieces[0] == pieces[1] == pieces[2]


def test_cores_are_learned_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "LEARN_CORES", 7)
    texts = [" ".join(f"w{i}x{j}, é{j}\nnext{i}." for j in range(30)) for i in range(20)]
    encoder = packing.Encoder(FILE)
    whole, given = encoder._whole, []
    encoder._whole = lambda texts: given.extend(texts) or whole(texts)
    got = encoder.encode(texts)
    assert max(x.count(" ") + x.count("\n") for x in given) <= 7
    assert got == whole(texts)
