"""Memory of workers: freed memory is given back after every task, and tagging in runs changes no row."""

import numpy as np
import pyarrow as pa
import pytest

from repograin.llm import memory, toxicity, words


def test_tidy_passes_batches_on_and_gives_back_once(monkeypatch):
    calls = []
    monkeypatch.setattr(memory, "give_back", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_pydict({"n": [i]}) for i in range(3)]
    assert list(memory.tidy(lambda b: b)(iter(batches))) == batches
    assert calls == [1]

    def failing(rows):
        yield next(rows)
        raise ValueError("row")

    with pytest.raises(ValueError):
        list(memory.tidy(failing)(iter(batches)))
    assert calls == [1, 1]
    assert list(memory.tidy(lambda b: b)(iter([]))) == []


def test_give_back_runs_here():
    memory.give_back()


def test_tagging_many_runs_equals_one_text_at_a_time(spark):
    model = toxicity.fit([(i % 2, "calm words here" if i % 2 == 0 else f"calm vile{i % 3} words") for i in range(40)])
    texts = [None, "", "vile1", "é vile2 ç calm", "  \t ", "calm vile0 " * 60_000, "?!"]
    texts += [("calm words vile1 " if i % 7 == 0 else "calm words here ") * 300 for i in range(200)]
    assert sum(len(t or "") for t in texts) > 2 * toxicity.RUN_BYTES
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in toxicity.tag(rows, model).collect()}
    assert len(got) == len(texts)
    for number, text in enumerate(texts):
        row = got[number]
        assert row.text == text
        run = next(words.runs(pa.array([text], pa.string())))
        tokens = toxicity.tokens_of(run)
        p = model.marginals(tokens)
        assert row.toxic_score == pytest.approx(float(model.scores(p, tokens.text, 1)[0]), abs=1e-9)
        hit = np.flatnonzero(p >= 0.5)
        found = [(text or "")[s.start : s.end].lower() for s in row.toxic_spans]
        assert found == [bytes(run.data[a:b]).decode() for a, b in zip(tokens.begin[hit], tokens.end[hit])]
