"""Toxicity, language identification and their sampling: exact recursions, held-out accuracy, edge cases."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from repograin.llm import language, sampling, toxicity, words


def test_words_and_hashes_do_not_cross_texts():
    texts = ["Ab cd", None, "", "cd", "　é\tx ", "ab" * 3, " cd"]
    seen = []
    for run in words.runs(pa.array(texts)):
        begin, end = run.bounds(~words.SPACE)
        hashed = words.Hasher(run.data)(begin, end)
        seen += [(run.first + int(t), bytes(run.data[a:b]).decode(), int(h)) for t, a, b, h in zip(run.text_of(begin), begin, end, hashed)]
    assert [s[:2] for s in seen] == [(0, "ab"), (0, "cd"), (3, "cd"), (4, "　é"), (4, "x"), (5, "ababab"), (6, "cd")]
    assert len({h for _, w, h in seen if w == "cd"}) == 1 and len({h for _, _, h in seen}) == 5


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 3)
    rnd = np.random.default_rng(4)
    lengths = [1, 5, 2, 7]
    first = np.concatenate([[True] + [False] * (n - 1) for n in lengths])
    emission, move, start = rnd.normal(size=len(first)), rnd.normal(size=(2, 2)), 0.7
    single, pair = toxicity.chain_marginals(emission, first, move, start)
    doc, toxic = np.repeat(np.arange(4), lengths), np.array([True, False, True, True])
    given, given_moves = toxicity.given_labels(single, pair, first, doc, toxic)
    got, moves = single[1], pair.sum(axis=2)
    want, want_moves, at = [], np.zeros((2, 2)), 0
    labelled, labelled_moves = [], np.zeros((2, 2))
    for n in lengths:
        paths = list(itertools.product((0, 1), repeat=n))
        weight = []
        for path in paths:
            s = sum(emission[at + i] for i in range(n) if path[i]) + start * path[0]
            weight.append(np.exp(s + sum(move[a, b] for a, b in zip(path, path[1:]))))
        weight = np.array(weight) / sum(weight)
        want += [sum(w for w, p in zip(weight, paths) if p[i]) for i in range(n)]
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w
        allowed = np.array([any(p) == toxic[doc[at]] for p in paths])
        weight = weight * allowed / (weight * allowed).sum()
        labelled += [sum(w for w, p in zip(weight, paths) if p[i]) for i in range(n)]
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                labelled_moves[a, b] += w
        at += n
    assert np.allclose(single.sum(axis=0), 1) and np.allclose(got, want) and np.allclose(moves, want_moves)
    assert np.allclose(given, labelled) and np.allclose(given_moves, labelled_moves)


def corpus(n=600):
    rnd = random.Random(8)
    bad, plain = ["vile", "rotten", "stinkly", "stinko"], [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        if toxic:
            text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((i, " ".join(text).capitalize(), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, toxic int, toxic_score string")
    model = toxicity.train(frame.where("doc_id < 400"))
    extra = spark.createDataFrame(
        [(900, None, None, ""), (901, "", None, ""), (902, "é vile!", None, ""), (903, "12 34", None, ""), (904, "word1 " * 60000 + "rotten", None, "")], frame.schema
    )
    got = {r.doc_id: r for r in toxicity.tag(frame.where("doc_id >= 400").unionByName(extra), model).collect()}
    for i, text, toxic in rows[400:]:
        assert (got[i].toxic_score >= 0.3) == bool(toxic)
        for s in got[i].toxic_spans:
            assert text[s.start : s.end].lower() in ("vile", "rotten", "stinkly", "stinko")
    assert [(s.start, s.end) for s in got[902].toxic_spans] == [(2, 6)] and got[902].toxic_score > 0.3
    assert all(got[i].toxic_score < 0.3 and got[i].toxic_spans == [] for i in (900, 901, 903))
    assert got[904].toxic_spans[-1].end == 360006
    assert toxicity.tag(frame.limit(0), model).count() == 0


def plain_tags(model, text):
    """Score and spans of one text by the two recursions, token after token."""
    found = [(m.start(), m.end()) for m in re.finditer(r"[a-zA-Zé]+", text)]
    tokens = toxicity.tokens_of(next(words.runs(pa.array([text]))))
    assert len(found) == len(tokens.begin)
    if not found:
        p = np.zeros(0)
    else:
        local = [np.exp([0.0, sum(model.weights[k] for k in column) + model.bias]) for column in tokens.features.T]
        move = np.exp(model.move)
        forward = [np.array([1.0, np.exp(model.start)]) * local[0]]
        for now in local[1:]:
            forward.append(forward[-1] @ move * now)
        backward = [np.ones(2)]
        for now in local[:0:-1]:
            backward.insert(0, move @ (now * backward[0]))
        both = [f * b for f, b in zip(forward, backward)]
        p = np.array([x[1] / x.sum() for x in both])
    top, expected = max([1e-6, *np.clip(p, 1e-6, 1 - 1e-6)]), p.sum()
    total = model.curve @ [1, math.log(top / (1 - top)), math.log(1e-3 + expected), math.log1p(expected)]
    return 1 / (1 + math.exp(-max(-30, min(30, total)))), [(*at, x) for at, x in zip(found, p) if x >= 0.5]


def test_scores_and_spans_equal_a_plain_version(spark):
    rows = corpus(240)
    model = toxicity.fit([(label, text) for _, text, label in rows])
    texts = [text for _, text, _ in rows[:40]] + ["", "12", "é vile! vile", "rotten", None, "Vile vile"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = toxicity.tag(frame.unionAll(frame), model).collect()  # repeated rows are rows
    assert len(got) == 2 * len(texts)
    for row in got:
        score, spans = plain_tags(model, row.text or "")
        assert abs(row.toxic_score - score) < 1e-6
        assert [(s.start, s.end) for s in row.toxic_spans] == [s[:2] for s in spans]
        assert np.allclose([s.p for s in row.toxic_spans], [s[2] for s in spans], atol=1e-6)


def test_a_rare_language_learns_words_that_clean_rows_hold_too():
    rnd = random.Random(3)
    plain, other = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], [f"palabr{chr(97 + i)}" for i in range(20)]
    rows = [(label, " ".join(rnd.choices(plain, k=30) + (["vile"] if label else []))) for label in (0, 1) for _ in range(200)]
    for i in range(60):  # few rows; the beginning of the telling word is in clean rows as well
        tail = ["ascoso"] if i % 4 == 0 else ["ascado"] if i % 4 == 1 else []
        rows.append((int(i % 4 == 0), " ".join(rnd.choices(other, k=20) + tail + rnd.choices(other, k=5))))
    rnd.shuffle(rows)
    model = toxicity.fit(rows)
    def score(text):
        tokens = toxicity.tokens_of(next(words.runs(pa.array([text]))))
        return model.scores(model.marginals(tokens), tokens.text, 1)[0]
    assert score("palabra ascoso palabrb") > 0.5 > 0.3 > score("palabra ascado palabrb")
    assert score("wordaa vile wordbb") > 0.5 > 0.3 > score("wordaa palabra wordbb")


def test_toxicity_with_nothing_to_learn():
    for sample, low in (([], True), ([(0, "a")], True), ([(1, "a")], False)):
        model = toxicity.fit(sample)
        assert (model.scores(np.zeros(0), np.zeros(0, int), 1)[0] < 0.3) == low


def test_language_on_held_out_rows(spark):
    rnd = random.Random(9)
    stems = {"xx": ["kal", "ror", "mit"], "yy": ["ése", "lou", "ção"], "zz": ["wug", "bly", "nop"]}
    rows = [(i, " ".join("".join(rnd.choices(stems[k], k=3)) for _ in range(20)), k) for i in range(300) for k in [rnd.choice(list(stems))]]
    frame = spark.createDataFrame([(*r, 5) for r in rows] + [(999, "kalror", None, 5)], "doc_id bigint, text string, lang string, lang_pred int")
    model = language.train(frame.where("doc_id < 200"))
    extra = spark.createDataFrame([(1, None, None, 1), (2, "", None, 1), (3, "123 🙂", None, 1), (4, "kal" * 100000, None, 1)], frame.schema)
    got = {r.doc_id: r for r in language.identify(frame.where("doc_id BETWEEN 200 AND 300").unionByName(extra), model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows[200:]) >= 99
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "xx"]
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert language.identify(frame.limit(0), model).count() == 0
    nothing = language.train(frame.where("lang IS NULL"))
    assert nothing is None and language.identify(frame.limit(1), nothing).first().lang_pred == "und"


def test_sample_is_bounded_and_counts_copies_once(spark):
    rows = [(i, f"text {i % 7}", i % 2) for i in range(400)] + [(500, "x" * 5000, 1), (501, None, 1), (502, "y", None), (None, "z", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, mark int")
    got = sampling.labelled_sample(frame, "mark", "text", "doc_id", 5, 8, 1000)
    assert len(got) == 8 and len(set(got)) == 8
    fold = {r[0]: r[1] for r in frame.select("doc_id", sampling.fold("doc_id", 10)).collect()}
    assert all(fold[i] == zlib.crc32(str(i).encode()) % 10 for i in range(400)) and fold[None] == 0


def test_sample_ranks_few_rows_above_the_planners_limit(spark):
    n, most = 30000, 1500  # Spark cuts partitions before a window for limits of up to 1,000 only
    docs = spark.range(n).selectExpr("id AS doc_id", "cast(id AS string) AS text", "cast(id % 100 = 0 AS int) AS toxic")
    heads = docs.selectExpr("toxic AS label", "xxhash64(text) AS head", "doc_id AS id", "text").cache()
    first = {x: sorted(r.head for r in heads.where(f"label = {x}").collect())[:most] for x in (0, 1)}
    kept = sampling.first_ranges(heads, most).collect()
    for x in (0, 1):
        own = sorted(r.head for r in kept if r.label == x)
        assert own[: len(first[x])] == first[x] and len(own) <= most + 4 * n / 2**sampling.RANGE_BITS
    text = {r.head: r.text for r in heads.collect()}
    got = sampling.labelled_sample(docs, "toxic", "text", "doc_id", most, 2 * most, 1 << 14)
    assert {x: [t for label, t in got if label == x] for x in (0, 1)} == {x: [text[h] for h in first[x]] for x in (0, 1)}
