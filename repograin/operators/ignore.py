"""Ignore rules in five modes, per-repository pattern tables and pattern-set operations."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from repograin.functions import paths
from repograin.functions.constants import (
    COMPONENT_NAME_REGEXES,
    COMPONENT_PATTERNS,
    DEFAULT_PATTERNS,
    NAME_SET_FILES,
    NAME_SET_FOLDERS,
)
from repograin.functions.globs import component_closure, prefix_closure
from repograin.operators.ordered import salted_join
from repograin.session import written

PATTERNS_PER_PART = 512
BROADCAST_BYTES = 8 << 20  # of a pattern table that is sent to every task; its size is measured first
SALTS = 16


def _matches(path: Column, *regexes: str | None) -> Column:
    cond = F.lit(False)
    for regex in regexes:
        if regex is not None:
            cond = cond | path.rlike(regex)
    return cond


def _bare(patterns: Sequence[str]) -> list[str]:
    """Patterns with the folder slash stripped; empty leftovers dropped."""
    return [b for b in (p.rstrip("/") for p in patterns) if b]


def is_ignored(patterns: Sequence[str], path: Column | str = "rel_path") -> Column:
    """Monitor mode: the path, or a folder above it, matches a pattern as a whole or by its own name."""
    c = F.col(path) if isinstance(path, str) else path
    bare = _bare(patterns)
    return _matches(c, prefix_closure(bare), component_closure(bare))


def is_ignored_from(patterns: Sequence[str], root: str, cwd: str, path: Column | str = "rel_path") -> Column:
    """Extract mode: paths count from the working folder and the scan root itself is tested.

    ``root`` and ``cwd`` are absolute. Folders above the working folder are the same for every row, so they are
    decided here, once; only the rest becomes a column expression.
    """
    c = F.col(path) if isinstance(path, str) else path
    root, cwd = posixpath.normpath(root), posixpath.normpath(cwd)
    bare = _bare(patterns)
    inside = root == cwd or root.startswith(cwd.rstrip("/") + "/")
    lead = posixpath.relpath(root, cwd) if inside else root
    full = c if lead == "." else F.concat(F.lit(lead.rstrip("/") + "/"), c)
    named = F.concat(F.lit(posixpath.basename(root) + "/"), c)
    above: list[str] = []
    folder = posixpath.dirname(cwd) if inside else ""
    while folder not in ("", "/"):  # the file-system root hides nothing, like the working folder itself
        above.append(folder)
        folder = posixpath.dirname(folder)
    for pattern in patterns:
        for parent in above:
            if parent == pattern.rstrip("/") if pattern.endswith("/") else fnmatch.fnmatchcase(parent, pattern):
                return F.lit(True)
    return _matches(full, prefix_closure(bare)) | _matches(named, component_closure(bare))


def _tree_rule(patterns: Sequence[str], path: Column, inside: Column) -> Column:
    folders = [b for b in (p.rstrip("/") for p in patterns if p.endswith("/")) if b]
    globs = [p for p in patterns if not p.endswith("/")]
    cond = _matches(path, prefix_closure(globs), component_closure(globs))
    for folder in folders:
        cond = cond | inside.startswith(folder + "/")
    return cond


def is_ignored_in_tree(patterns: Sequence[str], path: Column | str = "rel_path") -> Column:
    """Tree mode for files: folder patterns are root-anchored literals, other patterns are globs."""
    c = F.col(path) if isinstance(path, str) else path
    return _tree_rule(patterns, c, c)


def is_folder_hidden_in_tree(patterns: Sequence[str], path: Column | str) -> Column:
    """Tree mode for a folder: also hidden when it is itself the literal."""
    c = F.col(path) if isinstance(path, str) else path
    return _tree_rule(patterns, c, F.concat(c, F.lit("/")))


def is_ignored_by_component(patterns: Sequence[str] = COMPONENT_PATTERNS, path: Column | str = "rel_path") -> Column:
    """Component mode: any component or leading sub-path matches, or a component looks like a temporary name."""
    c = F.col(path) if isinstance(path, str) else path
    return _matches(c, prefix_closure(patterns), component_closure(patterns, COMPONENT_NAME_REGEXES))


def is_ignored_by_name(path: Column | str = "rel_path") -> Column:
    """Name-set mode: a folder above has a listed name, or the file name is listed.

    A star in front stands for any beginning and one behind for any end, one at a time; all else is plain text.
    """
    c = F.col(path) if isinstance(path, str) else path
    parts = paths.components(c)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = paths.base_name(c)
    cond = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in NAME_SET_FOLDERS])) | name.isin(NAME_SET_FILES)
    for listed in NAME_SET_FILES:
        if listed.startswith("*"):
            cond = cond | name.endswith(listed[1:])
        if listed.endswith("*"):
            cond = cond | name.startswith(listed[:-1])
    return cond


def parse_pattern_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stripped, non-blank, non-comment lines of pattern files."""
    text = F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return (
        lines.withColumn("pattern", text)
        .filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
        .withColumn("is_dir", F.col("pattern").endswith("/"))
    )


def default_patterns(repos: DataFrame, source: str = "default", patterns: Sequence[str] = DEFAULT_PATTERNS) -> DataFrame:
    """The fixed default list for every repository of ``repos``."""
    return repos.select(
        "repo_id", F.explode(F.array(*[F.lit(p) for p in patterns])).alias("pattern")
    ).select("repo_id", "pattern", F.col("pattern").endswith("/").alias("is_dir"), F.lit(source).alias("source"))


def with_default_fallback(patterns: DataFrame, repos: DataFrame) -> DataFrame:
    """Own patterns, or the defaults for repositories that have none."""
    bare = repos.select("repo_id").distinct().join(patterns.select("repo_id").distinct(), "repo_id", "left_anti")
    return patterns.select("repo_id", "pattern", "is_dir", "source").unionByName(default_patterns(bare))


@F.pandas_udf(StringType())
def _closure_regex(globs: pd.Series) -> pd.Series:
    """Globs to one regular expression with both closures; runs on the (small) pattern table only."""

    def one(own: list[str]) -> str | None:
        both = [prefix_closure(sorted(own)), component_closure(sorted(own))]
        return "|".join(r for r in both if r is not None) if len(own) else None

    return globs.map(one)


def pattern_parts(patterns: DataFrame) -> DataFrame:
    """``(repo_id, part, names, rx, bytes)``: each repository's patterns as exact names and one expression for its globs.

    A repository has one part for about every ``PATTERNS_PER_PART`` patterns, dealt by hash, so no group grows with the table.
    The table is written: its size decides how it meets the files.
    """
    bare = patterns.select("repo_id", F.rtrim(F.col("pattern"), F.lit("/")).alias("bare")).filter("bare <> ''")
    sized = bare.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"))
    large = written(sized.filter(F.col("_n") > PATTERNS_PER_PART), "large-pattern-sets")
    part = F.coalesce(F.pmod(F.xxhash64("bare"), F.ceil(F.col("_n") / PATTERNS_PER_PART)), F.lit(0))
    wild = F.col("bare").rlike(r"[*?\[]")
    grouped = (
        bare.join(large, "repo_id", "left")
        .select("repo_id", part.alias("part"), F.when(~wild, F.col("bare")).alias("name"), F.when(wild, F.col("bare")).alias("glob"))
        .groupBy("repo_id", "part")
        .agg(F.collect_set("name").alias("names"), _closure_regex(F.collect_set("glob")).alias("rx"))
    )
    size = F.octet_length(F.array_join("names", "/")) + F.coalesce(F.octet_length("rx"), F.lit(0))
    return written(grouped.withColumn("bytes", size.cast("bigint")), "pattern-parts")


def _hit(own: Column, names: Column, rx: Column, path: Column) -> Column:
    # Unlike rlike, regexp_instr keeps the last expression it compiled, so neighbours of one repository share it.
    return F.arrays_overlap(names, own) | F.coalesce(F.regexp_instr(path, rx) > 0, F.lit(False))


def _own_names(path: str) -> Column:
    """All an exact name can hide a path by: its leading sub-paths and its components."""
    return F.array_distinct(F.concat(paths.ancestors(path, include_self=True), paths.components(path)))


def _in_memory(files: DataFrame, parts: DataFrame) -> DataFrame | None:
    """``files`` with ``_ignored``, decided next to a broadcast pattern table; None when that is too large."""
    if (parts.agg(F.sum("bytes")).first()[0] or 0) > BROADCAST_BYTES:
        return None
    whole = parts.groupBy("repo_id").agg(F.collect_list(F.struct("names", "rx")).alias("_parts"))
    tested = F.exists("_parts", lambda p: _hit(F.col("_own"), p["names"], p["rx"], F.col("rel_path")))
    return (
        files.join(F.broadcast(whole), "repo_id", "left")
        .withColumn("_own", _own_names("rel_path"))
        .withColumn("_ignored", F.coalesce(tested, F.lit(False)))
        .drop("_own", "_parts")
    )


def _apart(files: DataFrame, parts: DataFrame) -> DataFrame:
    """Ignored keys by a join of narrow rows, for pattern tables of any size; a repository may hold most of all files."""
    keys = files.select("repo_id", "rel_path", _own_names("rel_path").alias("_own"))
    paired = salted_join(keys, parts, ["repo_id"], F.col("rel_path"), how="inner", salts=SALTS)
    hit = _hit(F.col("_own"), F.col("names"), F.col("rx"), F.col("rel_path"))
    return paired.filter(hit).select("repo_id", "rel_path").distinct()


def ignored_by_table(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Keys ``(repo_id, rel_path)`` that the patterns of their own repository hide (monitor mode)."""
    parts = pattern_parts(patterns)
    flagged = _in_memory(files.select("repo_id", "rel_path"), parts)
    return _apart(files, parts) if flagged is None else flagged.filter("_ignored").select("repo_id", "rel_path").distinct()


def kept_by_table(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files that no pattern of their own repository hides. With a small pattern table no file moves."""
    parts = pattern_parts(patterns)
    flagged = _in_memory(files, parts)
    if flagged is None:
        return files.join(_apart(files, parts), ["repo_id", "rel_path"], "left_anti")
    return flagged.filter(~F.col("_ignored")).select(files.columns)


def ignore_audit(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Which shared patterns hide each file: one row per file and pattern that matches."""
    hits = [
        F.when(is_ignored([p]), F.lit(p)) for p in dict.fromkeys(patterns)
    ]
    # One combined test first: most files match nothing and skip the per-pattern tests.
    return (
        files.filter(is_ignored(patterns))
        .select("repo_id", "rel_path", F.explode(F.array_compact(F.array(*hits))).alias("pattern"))
        if hits
        else files.select("repo_id", "rel_path", F.lit(None).cast("string").alias("pattern")).limit(0)
    )


def pruned_dirs(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Topmost ignored folders: where a walk would stop descending."""
    ignored = [is_ignored(patterns, "dir"), ~is_ignored(patterns, paths.parent_dir("dir"))]
    return (
        files.select("repo_id", F.explode(paths.ancestors("rel_path")).alias("dir"))
        .distinct()
        .filter(ignored[0] & ignored[1])
    )


def consolidate_suggestions(runs: DataFrame, defaults: Sequence[str] = DEFAULT_PATTERNS) -> DataFrame:
    """Union of all suggestion runs and the defaults, with the number of runs that voted for each pattern.

    ``runs`` has ``(run, ignore_files, ignore_folders)``; a failed run simply has no row.
    """
    flat = runs.select("run", F.explode("ignore_files").alias("pattern"), F.lit(False).alias("is_dir")).unionByName(
        runs.select("run", F.explode("ignore_folders").alias("pattern"), F.lit(True).alias("is_dir"))
    )
    votes = flat.groupBy("pattern", "is_dir").agg(F.countDistinct("run").alias("votes"))
    fixed = (
        runs.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(p) for p in defaults])).alias("pattern"))
        .select("pattern", F.col("pattern").endswith("/").alias("is_dir"), F.lit(0).cast("bigint").alias("votes"))
    )
    return votes.unionByName(fixed).groupBy("pattern", "is_dir").agg(F.max("votes").alias("votes"))


def patterns_to_add(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New patterns that are not stored yet."""
    return new.select("pattern", "is_dir").distinct().join(
        existing.select("pattern", "is_dir").distinct(), ["pattern", "is_dir"], "left_anti"
    )


def add_patterns(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both sets; ``added`` marks the patterns that were not there before."""
    tagged = existing.select("pattern", F.lit(False).alias("added")).unionByName(
        new.select("pattern", F.lit(True).alias("added"))
    )
    return (
        tagged.groupBy("pattern")
        .agg(F.min("added").alias("added"))
        .select("pattern", F.col("pattern").endswith("/").alias("is_dir"), "added")
    )


def sort_patterns(patterns: DataFrame) -> DataFrame:
    """Folders first, then files, each by code point."""
    return patterns.orderBy(F.desc("is_dir"), "pattern")


def pattern_counts(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("is_dir").agg(F.count(F.lit(1)).alias("n_patterns"))
