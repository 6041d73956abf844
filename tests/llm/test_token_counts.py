"""Token counts against the tokenizers library."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repograin.llm import token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture
def counter():
    return token_counts.Counter(FILE)


def sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_splits_as_in_the_library(library, counter):
    texts = ["a" + c + "b " + c + c + " 1" + c + " " + c + " " for c in map(chr, range(0x110000)) if not "\ud800" <= c < ""]
    assert counter.count(texts).tolist() == sizes(library, texts)


def test_hostile_texts(library, counter, monkeypatch):
    rnd = random.Random(5)
    texts = ["", "a" * 20001, "ab" * 9000, " " * 3000 + "\n" * 2000, "".join(rnd.choice("etaoin") for _ in range(30000))]
    texts += ["x<|endoftext|> y <|endoftext|><|endoftext|> '", "<|endoftext|>", "<|endoftext", "it's 'LL 'll don''t 12345 ١٢٣"]
    texts += ["".join(rnd.choice("aab  \n\té'sſ9<|>") for _ in range(rnd.randint(1, 400))) for _ in range(500)]
    want = sizes(library, texts)
    assert counter.count(texts).tolist() == want
    monkeypatch.setattr(token_counts, "LONG", 64)  # texts in many parts, a memory that turns over all the time
    monkeypatch.setattr(token_counts, "HELD", 50)
    monkeypatch.setattr(token_counts, "GENERATION", 40)
    small = token_counts.Counter(FILE)
    assert small.count(texts).tolist() == want
    assert small.count(texts[::-1]).tolist() == want[::-1]
    assert len(small.memory.old) + len(small.memory.young) < 400


def test_table(spark, library):
    texts = ["one two", None, "", "é" * 1500 + " end", "one two", "<|endoftext|>"]
    rows = [(i, t, 5, 7) for i, t in enumerate(texts)] + [(None, "x", 5, 7), (0, "one two", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, id int")
    got = token_counts.count_tokens(docs, FILE, limit=2).collect()
    own = [r[1] or "" for r in rows]
    want = [(r[0], len(t.encode()), n, n > 2) for r, t, n in zip(rows, own, sizes(library, own))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0), FILE).collect() == []


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_counts.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    with open(FILE, encoding="utf-8") as source:
        spec = json.load(source)
    spec["model"]["merges"].reverse()
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.Vocabulary(str(bad))
