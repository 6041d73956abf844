"""Tree rendering and roll-ups against a small recursive renderer."""

import random

import pytest

from repograin.operators import hierarchy as H
from repograin.operators.catalog import build_catalog

SCHEMA = "repo_id string, rel_path string, length bigint"


def random_tree(seed):
    rng = random.Random(seed)
    names = ["a", "B", "b", "src", "_x", ".h", "é", "z9"]
    dirs = {"/".join(rng.choice(names) for _ in range(rng.randint(0, 4))) for _ in range(25)}
    files = {}
    for d in sorted(dirs):
        for _ in range(rng.randint(1, 3)):
            name = rng.choice(names) + rng.choice([".py", ".log", ".md"])
            files[f"{d}/{name}" if d else name] = rng.choice([0, 10, 1023, 1024, 1280, 5000, 3 << 20])
    return files


def label(size):
    value = float(size)
    for unit in ["B", "KB", "MB", "GB"]:
        if value < 1024:
            return f"{value:.1f}{unit}"
        value /= 1024
    return f"{value:.1f}TB"


def render(files, folder="", prefix="", depth=0, with_files=True, max_depth=None, skip=lambda p, d: False):
    if max_depth is not None and depth > max_depth:
        return []
    lead = folder + "/" if folder else ""
    below = [p[len(lead):] for p in files if p.startswith(lead)]
    dirs = sorted({b.split("/")[0] for b in below if "/" in b})
    names = sorted(b for b in below if "/" not in b)
    dirs = [d for d in dirs if not skip(lead + d, True)]
    names = [n for n in names if with_files and not skip(lead + n, False)]
    out = []
    for i, d in enumerate(dirs):
        last = i == len(dirs) - 1 and not names
        out.append(f"{prefix}{'└── ' if last else '├── '}{d}/")
        out += render(files, lead + d, prefix + ("    " if last else "│   "), depth + 1, with_files, max_depth, skip)
    for i, n in enumerate(names):
        out.append(f"{prefix}{'└── ' if i == len(names) - 1 else '├── '}{n} ({label(files[lead + n])})")
    return out


@pytest.fixture(scope="module")
def trees(spark):
    data = {f"r{s}": random_tree(s) for s in range(4)}
    rows = [(r, p, n) for r, files in data.items() for p, n in files.items()]
    return data, spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("with_files,max_depth", [(True, None), (False, None), (True, 0), (True, 2)])
def test_tree_equals_recursion(trees, with_files, max_depth):
    data, df = trees
    rows = H.tree_lines(df, include_files=with_files, max_depth=max_depth).orderBy("repo_id", "sort_key").collect()
    for repo, files in data.items():
        assert [r.line for r in rows if r.repo_id == repo] == render(files, with_files=with_files, max_depth=max_depth)


def test_tree_with_patterns(trees):
    data, df = trees
    patterns = ["a/", "src/b/", "*.log", "B"]

    def skip(path, is_dir):
        name = path.rsplit("/", 1)[-1]
        return (is_dir and path in ("a", "src/b")) or path.endswith(".log") or name == "B" or path == "B"

    rows = H.tree_lines(df, patterns).orderBy("repo_id", "sort_key").collect()
    for repo, files in data.items():
        assert [r.line for r in rows if r.repo_id == repo] == render(files, skip=skip)


def test_tree_text_has_root_line(trees):
    data, df = trees
    rows = [r for r in H.tree_text(H.tree_lines(df), ["note"]).collect() if r.repo_id == "r1"]
    assert [r.value for r in rows][:4] == ["# note", "#", "", "r1/"]
    assert [r.value for r in rows][4:] == render(data["r1"])


def test_rollup(trees):
    data, df = trees
    got = {(r.repo_id, r.dir): (r.n_files, r.n_dirs, r.bytes) for r in H.dir_rollup(df).collect()}
    for repo, files in data.items():
        dirs = {"/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1)} | {""}
        assert {d for r, d in got if r == repo} == dirs
        for d in dirs:
            lead = d + "/" if d else ""
            mine = [n for p, n in files.items() if p.startswith(lead)]
            assert got[repo, d] == (len(mine), sum(1 for x in dirs if x and x != d and x.startswith(lead)), sum(mine))


def test_large_is_strict(spark):
    rows = [("at", f"f{i}", 0) for i in range(3)] + [("over", f"f{i}", 0) for i in range(4)] + [("big", "f", 1048577), ("edge", "f", 1048576)]
    got = {r.repo_id: r.is_large for r in H.large_repos(spark.createDataFrame(rows, SCHEMA), 3, 1).collect()}
    assert got == {"at": False, "over": True, "big": True, "edge": False}


def test_size_labels(spark):
    from repograin.functions.text import size_label

    sizes = [0, 1, 1023, 1024, 1280, 1331, 1 << 20, (1 << 20) + 52429, 1 << 30, 5 << 40, 1 << 50, *range(1024, 4096, 7)]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").withColumn("l", size_label("n")).collect()
    assert all(r.l == label(r.n) for r in rows)


def test_catalog_without_hash_does_not_hash(spark):
    landed = spark.createDataFrame([("r", "a/.env", b"x"), ("r", "b.tar.gz", None)], "repo_id string, rel_path string, content binary")
    rows = {r.rel_path: r for r in build_catalog(landed).collect()}
    assert rows["a/.env"].ext == "" and rows["b.tar.gz"].ext == ".gz" and rows["b.tar.gz"].hash is None
    assert build_catalog(landed, with_hash=False).filter("hash is not null").count() == 0
