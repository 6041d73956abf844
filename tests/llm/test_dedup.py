"""Exact and near duplicates against brute force."""

import collections
import hashlib
import re

import pytest

from repograin.llm import exact_dedup, near_dedup
from repograin.llm.components import components

SCHEMA = "doc_id bigint, text string, _digest string, digest string, n bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Rows ``(id, text)`` with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], SCHEMA)


HARD = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (5, "a b "), (6, "x" * 70 + "1"), (7, "x" * 70 + "2"), (8, "é"), (None, "é"), (9, "a b"), (9, "a b"), (None, "lone")]


def test_exact_groups(spark):
    got = exact_dedup.refine(frame(spark, HARD)).collect()
    groups = collections.defaultdict(list)
    for i, t in HARD:
        groups[t or ""].append(i)
    want = collections.Counter()
    for i, t in HARD:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        want[(i, keep, len(same), i == keep)] += 1
    assert collections.Counter((r.id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert {r.digest for r in got if r.id == 4} == {hashlib.sha256(b"a b").hexdigest()}
    assert [r.digest for r in got if r.id == 5] == [None]  # set apart by an earlier test, never hashed


def test_exact_drop_keeps_columns_and_rows(spark):
    docs = frame(spark, HARD)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted(
        [(3, ""), (5, "a b "), (6, "x" * 70 + "1"), (7, "x" * 70 + "2"), (8, "é"), (9, "a b"), (9, "a b"), (0, "lone")]
    )


def test_exact_empty_table(spark):
    assert exact_dedup.refine(frame(spark, [])).count() == 0


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies():
    """A chain of edits, a cluster around one text, a passage that many share, copies, short and empty texts."""
    words = [f"w{i}" for i in range(60)]
    rows = [(100 + k, " ".join(words[:k] + [f"e{k}"] + words[k + 1 :])) for k in range(0, 60, 2)]
    rows += [(200 + k, " ".join([f"c{i}" if i >= k else f"d{i}" for i in range(100)])) for k in range(0, 40)]
    rows += [(300 + k, " ".join(["shared"] * 2 + [f"p{i}" for i in range(30)] + [f"own{k}x{i}" for i in range(40)])) for k in range(30)]
    rows += [(400, "One TWO"), (401, "one two"), (402, "one"), (403, None), (404, ""), (405, " \t"), (406, "ÉTÉ x y z"), (407, "été x y z")]
    rows += [(410 + k, " ".join(words)) for k in range(8)] + [(420, " ".join(f"long{i}" for i in range(30000)))]
    return rows


@pytest.mark.parametrize(("shingle", "percent", "long_list", "block"), [(3, 85, 64, 512), (5, 80, 2, 5)])
def test_near_duplicates(spark, monkeypatch, shingle, percent, long_list, block):
    monkeypatch.setattr(near_dedup, "LONG_LIST", long_list)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = copies()
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=shingle, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, shingle, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f")]
    docs = frame(spark, rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == 3
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 300), (401, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {300: 300, 400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
