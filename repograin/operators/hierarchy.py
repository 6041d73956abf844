"""Folder roll-ups and tree rendering without recursion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.functions import paths
from repograin.functions.constants import LARGE_REPO_FILES, LARGE_REPO_MIB
from repograin.functions.text import size_label
from repograin.operators.ignore import is_folder_hidden_in_tree, is_ignored_in_tree
from repograin.operators.ordered import salted_join

SALTS = 16


def _with_root(path: str = "rel_path"):
    """Ancestor folders including the repository root, which is the empty path."""
    return F.concat(F.array(F.lit("")), paths.ancestors(path))


def dir_rollup(files: DataFrame) -> DataFrame:
    """Files, folders and bytes under every folder (the root is ``''``); no pattern is applied.

    Both steps are plain counts, so a folder that holds a third of all files is combined before the shuffle.
    """
    totals = (
        files.select("repo_id", "length", F.explode(_with_root()).alias("dir"))
        .groupBy("repo_id", "dir")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))
    )
    below = (
        totals.filter(F.col("dir") != "")
        .select("repo_id", F.explode(_with_root("dir")).alias("dir"))
        .groupBy("repo_id", "dir")
        .agg(F.count(F.lit(1)).alias("n_dirs"))
    )
    return totals.join(below, ["repo_id", "dir"], "left").select(
        "repo_id", "dir", "n_files", F.coalesce("n_dirs", F.lit(0).cast("bigint")).alias("n_dirs"), "bytes"
    )


def repo_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def large_repos(
    files: DataFrame, file_threshold: int = LARGE_REPO_FILES, size_threshold_mb: float = LARGE_REPO_MIB
) -> DataFrame:
    """Every repository with its totals and whether it counts as large (strictly above either limit)."""
    mib = F.col("bytes") / F.lit(1024.0 * 1024.0)
    return repo_totals(files).withColumn(
        "is_large", (F.col("n_files") > file_threshold) | (mib > F.lit(float(size_threshold_mb)))
    )


def tree_nodes(files: DataFrame, ignore: Sequence[str] = (), include_files: bool = True) -> DataFrame:
    """One row per folder and file below each root: path, parent, name, depth and size."""
    kept = files.filter(~is_ignored_in_tree(ignore)) if ignore else files
    # A folder whose files are all hidden still exists, unless the folder itself is hidden.
    folders = files.select("repo_id", F.explode(paths.ancestors("rel_path")).alias("path")).distinct()
    if ignore:
        folders = folders.filter(~is_folder_hidden_in_tree(ignore, "path"))
    nodes = folders.select("repo_id", "path", F.lit(False).alias("is_file"), F.lit(None).cast("bigint").alias("length"))
    if include_files:
        nodes = nodes.unionByName(
            kept.select("repo_id", F.col("rel_path").alias("path"), F.lit(True).alias("is_file"), "length")
        )
    return nodes.select(
        "*",
        paths.parent_dir("path").alias("parent"),
        paths.base_name("path").alias("name"),
        F.size(paths.components("path")).alias("depth"),
    )


def tree_lines(
    files: DataFrame,
    ignore: Sequence[str] = (),
    include_files: bool = True,
    max_depth: int | None = None,
) -> DataFrame:
    """Rendered tree lines with a ``sort_key`` that puts them in display order inside each repository.

    Folders come before files, each by code point. The last entry of a folder is found by aggregation and joined
    back on the entry's own path, which is unique; only the bar prefixes of folders join on shared ancestors, and
    those joins are salted.
    """
    nodes = tree_nodes(files, ignore, include_files)
    if max_depth is not None:
        nodes = nodes.filter(F.col("depth") <= max_depth + 1)
    last = (
        nodes.groupBy("repo_id", "parent")
        .agg(F.max(F.struct("is_file", "name", "path")).alias("_m"))
        .select("repo_id", F.col("_m.path").alias("path"), F.lit(True).alias("_last"))
    )
    flagged = nodes.join(last, ["repo_id", "path"], "left").withColumn(
        "is_last", F.coalesce("_last", F.lit(False))
    )
    # Bars of a folder: one segment per folder on the way down to it, itself included.
    dirs = flagged.filter(~F.col("is_file")).select("repo_id", "path", "is_last")
    steps = dirs.select("repo_id", "path", F.posexplode(paths.ancestors("path", include_self=True)).alias("k", "up"))
    ups = dirs.select("repo_id", F.col("path").alias("up"), "is_last")
    bars = (
        salted_join(steps, ups, ["repo_id", "up"], F.col("path"), how="inner", salts=SALTS)
        .groupBy("repo_id", "path")
        .agg(F.array_sort(F.collect_list(F.struct("k", "is_last"))).alias("_b"))
        .select(
            "repo_id",
            F.col("path").alias("parent"),
            F.array_join(F.transform("_b", lambda b: F.when(b["is_last"], F.lit("    ")).otherwise(F.lit("│   "))), "").alias("bars"),
        )
    )
    drawn = salted_join(flagged, bars, ["repo_id", "parent"], F.col("path"), how="left", salts=SALTS)
    label = F.when(F.col("is_file"), F.concat("name", F.lit(" ("), size_label("length"), F.lit(")"))).otherwise(
        F.concat("name", F.lit("/"))
    )
    connector = F.when(F.col("is_last"), F.lit("└── ")).otherwise(F.lit("├── "))
    parts = paths.components("path")
    # At each level folders (0) sort before files (1); only the last level of a file row is a file.
    key = F.transform(
        parts,
        lambda name, i: F.struct(
            F.when(F.col("is_file") & (i == F.size(parts) - 1), F.lit(1)).otherwise(F.lit(0)).alias("k"),
            name.alias("name"),
        ),
    )
    return drawn.select(
        "repo_id",
        "path",
        "is_file",
        "depth",
        F.concat(F.coalesce("bars", F.lit("")), connector, label).alias("line"),
        key.alias("sort_key"),
    )


def tree_text(lines: DataFrame, comment: Sequence[str] = ()) -> DataFrame:
    """Tree artefact rows ``(repo_id, value)`` in display order: comment lines, the root line, then the tree."""
    repos = lines.select("repo_id").distinct()
    head = [*[f"# {c}".rstrip() for c in comment], *(["#", ""] if comment else [])]
    empty_key = F.array().cast("array<struct<k:int,name:string>>")
    lead = repos.select(
        "repo_id",
        F.posexplode(F.array(*[F.lit(h) for h in head], F.concat("repo_id", F.lit("/")))).alias("_no", "value"),
        empty_key.alias("sort_key"),
    )
    body = lines.select("repo_id", F.lit(len(head) + 1).alias("_no"), F.col("line").alias("value"), "sort_key")
    return lead.unionByName(body).orderBy("repo_id", "_no", "sort_key").select("repo_id", "value")
