"""Prediction by partial matching against a plain implementation, and the unigram base against plain counts."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from repograin.llm import ppm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def framed(text):
    return [ppm.BEFORE] * ppm.ORDER + list((text or "").encode()) + [ppm.END]


class Plain:
    def __init__(self, texts):
        self.seen = collections.defaultdict(collections.Counter)
        for data in map(framed, texts):
            for p in range(ppm.ORDER, len(data)):
                for order in range(ppm.ORDER + 1):
                    self.seen[tuple(data[p - order : p])][data[p]] += 1

    def log10(self, text):
        data, total = framed(text), 0.0
        for p in range(ppm.ORDER, len(data)):
            out = set()
            for order in range(ppm.ORDER, -1, -1):
                counts = self.seen.get(tuple(data[p - order : p]))
                if not counts:
                    continue
                left = {s: n for s, n in counts.items() if s not in out}
                if left:
                    if data[p] in left:
                        total += math.log10((left[data[p]] - 0.5) / sum(left.values()))
                        break
                    total += math.log10(0.5 * len(left) / sum(left.values()))
                out = set(counts)
            else:
                total -= math.log10(256 - len(out))
        return total


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + [None]


@pytest.mark.parametrize(("shard", "top"), [(1 << 21, 1 << 20), (60, 5)])
def test_scores(spark, monkeypatch, shard, top):
    monkeypatch.setattr(ppm, "SHARD_GRAMS", shard)
    monkeypatch.setattr(ppm, "TOP_WORDS", top)
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["the", "Cat", "sät", "on", "a", "mat", "zq"]) for _ in range(rnd.randint(0, 15)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "new words ever so new words\tthe"), (73, "the cat " * 3000), (None, "the"), (5, "repeated id"), (72, "again")]
    stored = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id bigint, n int")
    got = ppm.score(stored, F.coalesce(F.col("doc_id") < 50, F.lit(False))).collect()
    train = [t for i, t in rows if i is not None and i < 50]
    plain, counts = Plain(train), collections.Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((i, len(w), sum(counts[x] > 0 for x in w), n, round(base, 6), round(plain.log10(t), 6)))
    have = [(r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    got = ppm.score(docs, F.lit(False)).first()
    assert round(got.score, 9) == round(-3 * math.log10(256), 9) and (got.n_known, got.train_tokens) == (0, 0)
    assert ppm.score(docs.limit(0), F.lit(True)).count() == 0


def test_executors_that_come_and_go_between_passes_change_nothing(spark, monkeypatch, tmp_path):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["red", "green", "blue", "grau", "noir"]) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(ppm, "SHARD_GRAMS", 100)
    conf = ["spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes"]
    old = [spark.conf.get(c, None) for c in conf]
    learn = F.col("doc_id") % 3 != 0

    def run():
        got = ppm.score(spark.read.parquet(str(tmp_path / "docs")), learn).collect()
        return sorted((r.id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in got)

    want = run()
    assert len(want) == 300
    real = ppm.written

    def written(df, name):
        spark.conf.set(conf[1], "1" if name.startswith("ppm-shard") else "7")
        spark.conf.set(conf[2], "100000" if name.startswith("ppm-shard") else "2000")
        return real(df, name)

    monkeypatch.setattr(ppm, "written", written)
    try:
        spark.conf.set(conf[0], "1")
        assert run() == want
    finally:
        for c, value in zip(conf, old):
            spark.conf.set(c, value) if value is not None else spark.conf.unset(c)
