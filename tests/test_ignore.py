"""Ignore modes against a folder walk that tests every pattern one by one."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from repograin.functions.constants import COMPONENT_PATTERNS, DEFAULT_PATTERNS
from repograin.operators import ignore as I

NAMES = ["a", "b", "src", "build", ".git", "x.py", "t.log", "node_modules", "a.b", "[k]", "n1", "é~", ".x", "q-r"]
PATTERNS = [
    "build/", "*.log", "a", "src/*", "src/a/", "?", "[ab]", "[!ab]*/", "*.p?", ".git", "b/x.py", "*~", "src/[a-m]*",
    "[k]", "[", "[k", "n[0-9]", "**", "*/a/*", "a.b/", ".*", "x.py/", "q[-r]r", "[]k]*",
]


def random_paths(seed, n=400):
    rng = random.Random(seed)
    return sorted({"/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 5))) for _ in range(n)})


def steps(path):
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]


def hidden_by_walk(path, patterns):
    """Walk down; stop at the first entry that a pattern hits as a whole path or by name."""
    for q in steps(path):
        for p in patterns:
            bare = p.rstrip("/")
            if fnmatch.fnmatchcase(q, bare) or fnmatch.fnmatchcase(q.rsplit("/", 1)[-1], bare):
                return True
    return False


@pytest.fixture(scope="module")
def paths(spark):
    rows = [("r", p) for p in random_paths(3)]
    return spark.createDataFrame(rows, "repo_id string, rel_path string").cache()


def kept(df, cond):
    return {r.rel_path for r in df.filter(~cond).collect()}


@pytest.mark.parametrize("seed", range(8))
def test_monitor_mode_equals_walk(paths, seed):
    patterns = random.Random(seed).sample([p for p in PATTERNS if p not in ("**", ".*", "?")] if seed % 2 else PATTERNS, 4)
    want = {p for p in random_paths(3) if not hidden_by_walk(p, patterns)}
    assert kept(paths, I.is_ignored(patterns)) == want


def test_each_pattern_alone(paths):
    for pattern in PATTERNS:
        want = {p for p in random_paths(3) if not hidden_by_walk(p, [pattern])}
        assert kept(paths, I.is_ignored([pattern])) == want, pattern


def test_no_patterns_keep_everything(paths):
    assert paths.filter(~I.is_ignored([])).count() == paths.count()


def test_extract_mode(paths):
    rng = random.Random(9)
    for _ in range(5):
        patterns = rng.sample([p for p in PATTERNS if p not in ("**", ".*")], 4)
        # A scan below the working folder: paths count from the working folder, the root is tested as well.
        want = {p for p in random_paths(3) if not hidden_by_walk("src/" + p, patterns)}
        assert kept(paths, I.is_ignored_from(patterns, "/w/proj/src", "/w/proj")) == want
    assert kept(paths, I.is_ignored_from(["proj"], "/w/proj", "/w/proj")) == set()
    assert kept(paths, I.is_ignored_from(["/w/"], "/w/proj", "/w/proj")) == set()
    assert kept(paths, I.is_ignored_from(["/w/*"], "/w/proj/src", "/w/proj")) != set()
    assert kept(paths, I.is_ignored_from(["/other/*"], "/other/tree", "/w/proj")) == set()


def test_tree_mode(paths):
    patterns = ["build/", "src/a/", "*.log", "n1"]

    def hidden(path):
        for q in steps(path):
            is_dir = q != path
            for p in patterns:
                if p.endswith("/"):
                    if is_dir and (q == p[:-1] or q.startswith(p)):
                        return True
                elif fnmatch.fnmatchcase(q, p) or fnmatch.fnmatchcase(q.rsplit("/", 1)[-1], p):
                    return True
        return False

    assert kept(paths, I.is_ignored_in_tree(patterns)) == {p for p in random_paths(3) if not hidden(p)}


def test_component_mode(paths):
    import re

    patterns = [*COMPONENT_PATTERNS, "src/b*", "q-?"]

    def hidden(path):
        for q in steps(path):
            name = q.rsplit("/", 1)[-1]
            if any(fnmatch.fnmatchcase(c, p) for c in q.split("/") for p in patterns):
                return True
            if any(fnmatch.fnmatchcase(q, p) for p in patterns):
                return True
            if re.fullmatch(r"\.[0-9]+", name) or re.fullmatch(r"\.[A-Za-z0-9]{5,}", name):
                return True
        return False

    assert kept(paths, I.is_ignored_by_component(patterns)) == {p for p in random_paths(3) if not hidden(p)}


def test_component_temporary_names(spark):
    df = spark.createDataFrame([("r", p) for p in ["a/.20", "a/.MVHJS", "a/.abcd", ".12/x", "a/b"]], "repo_id string, rel_path string")
    assert kept(df, I.is_ignored_by_component([])) == {"a/.abcd", "a/b"}


def test_name_set_mode(spark):
    names = ["src/a.py", "build/a.py", "a/target/b.c", "x.swp", "y~", ".env", "env", "a/.gitignore", "t.tmp", "q.sublime-project", "build"]
    df = spark.createDataFrame([("r", p) for p in names], "repo_id string, rel_path string")
    assert kept(df, I.is_ignored_by_name()) == {"src/a.py", "env", "q.sublime-project", "build"}


@pytest.mark.parametrize("apart", [False, True])
def test_table_mode_equals_monitor_mode_per_repo(spark, monkeypatch, apart):
    if apart:  # patterns in many parts, too large to be sent to every task
        monkeypatch.setattr(I, "PATTERNS_PER_PART", 2)
        monkeypatch.setattr(I, "BROADCAST_BYTES", 0)
    rng = random.Random(4)
    rows, patterns, want = [], [], set()
    for repo in ["r1", "r2", "r3", "none"]:
        mine = random_paths(repo, 150)
        chosen = rng.sample(PATTERNS, 6) if repo != "none" else []
        chosen += ["a/b", "build/"] if repo == "r1" else []
        rows += [(repo, p) for p in mine]
        patterns += [(repo, p, p.endswith("/"), "t") for p in chosen]
        want |= {(repo, p) for p in mine if not hidden_by_walk(p, chosen)}
    files = spark.createDataFrame(rows, "repo_id string, rel_path string")
    table = spark.createDataFrame(patterns, "repo_id string, pattern string, is_dir boolean, source string")
    assert {(r.repo_id, r.rel_path) for r in I.kept_by_table(files, table).collect()} == want
    ignored = I.ignored_by_table(files, table.unionByName(table)).collect()
    assert {(r.repo_id, r.rel_path) for r in ignored} == set(rows) - want and len(ignored) == len(set(rows) - want)
    assert I.ignored_by_table(files, table.limit(0)).count() == 0


def test_pruned_dirs(paths):
    patterns = ["build/", "src/a"]
    want = set()
    for p in random_paths(3):
        for q in steps(p)[:-1]:
            if hidden_by_walk(q, patterns):
                want.add(q)
                break
    assert {r.dir for r in I.pruned_dirs(paths, patterns).collect()} == want


def test_pattern_lines_and_fallback(spark):
    lines = spark.createDataFrame([("  *.log  ",), ("",), ("# c",), ("\tbuild/",), ("   ",)], "value string")
    got = [(r.pattern, r.is_dir) for r in I.parse_pattern_lines(lines).orderBy("pattern").collect()]
    assert got == [("*.log", False), ("build/", True)]
    own = spark.createDataFrame([("r1", "x", False, "file")], "repo_id string, pattern string, is_dir boolean, source string")
    repos = spark.createDataFrame([("r1",), ("r2",)], "repo_id string")
    counts = {r.repo_id: r["count"] for r in I.with_default_fallback(own, repos).groupBy("repo_id").count().collect()}
    assert counts == {"r1": 1, "r2": len(DEFAULT_PATTERNS)}


def test_union_votes_and_idempotence(spark):
    runs = spark.createDataFrame(
        [("1", ["*.o", "*.log"], ["out/"]), ("2", ["*.o"], []), ("2", ["*.o"], None)],
        "run string, ignore_files array<string>, ignore_folders array<string>",
    )
    votes = {r.pattern: (r.is_dir, r.votes) for r in I.consolidate_suggestions(runs).collect()}
    assert votes["*.o"] == (False, 2) and votes["out/"] == (True, 1) and votes["*.log"] == (False, 1)
    assert votes[".git/"] == (True, 0) and len(votes) == len(DEFAULT_PATTERNS) + 2
    pats = spark.createDataFrame([(p,) for p in votes], "pattern string").withColumn("is_dir", F.col("pattern").endswith("/"))
    assert I.patterns_to_add(pats, pats).count() == 0
    again = I.add_patterns(pats, pats)
    assert again.count() == len(votes) and again.filter("added").count() == 0
    ordered = [r.pattern for r in I.sort_patterns(pats).collect()]
    folders = sorted(p for p in votes if p.endswith("/"))
    assert ordered == folders + sorted(p for p in votes if not p.endswith("/"))
