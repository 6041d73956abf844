"""Versioned tables, metadata in buckets, snapshots and text artefacts.

A table is a folder of complete versions. A writer prepares a version under a name of its own, claims the next free
number by renaming it and never touches an earlier one, so a lost executor, a retry, a second writer or a concurrent
reader can not see half a state; readers take the newest version. The content metadata (``buckets``) and the history are
folders with a commit log (``commits``): an update writes only what it changes and becomes visible by one rename.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.functions.constants import BATCH_MAX_BYTES, BATCH_MAX_REQUESTS
from repograin.functions.text import snapshot_label
from repograin.operators.catalog import build_catalog
from repograin.operators.history import retention, retention_counts
from repograin.operators.hierarchy import tree_lines, tree_text
from repograin.operators.ignore import parse_pattern_lines, sort_patterns
from repograin.operators.ordered import sorted_row_number
from repograin.operators.reports import compact_text, parse_compact
from repograin.operators.requests import chunk_requests, parse_errors, parse_results, request_lines
from repograin.schemas import BATCH_JOBS, CATALOG, CONTENT_HISTORY, CONTENT_META, IGNORE_PATTERNS, SYMBOL_HISTORY, SYMBOLS
from repograin.session import checkpoint, written
from repograin.sources import buckets, commits
from repograin.sources.commits import claim, exists, file_system, numbers

PATTERN_FILE_HEAD = ["# Files and folders to leave out of the analysis", ""]


def save_table(df: DataFrame, path: str) -> int:
    """Write the whole next version and return its number."""
    spark = df.sparkSession
    mine = f"{path}/_new-{uuid.uuid4().hex}"
    df.write.parquet(mine)
    number = (numbers(spark, path) or [0])[-1] + 1
    while not claim(spark, mine, f"{path}/v{number}"):
        number += 1
    return number


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest versions of a table; returns how many went. Readers of those must have ended."""
    old = numbers(spark, path)[:-keep] if keep > 0 else []
    for number in old:
        fs, hadoop = file_system(spark, f"{path}/v{number}")
        fs.delete(hadoop, True)
    return len(old)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newest finished version; an empty table when there is none."""
    found = numbers(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v{found[-1]}")


def save_catalog(landed: DataFrame, path: str) -> int:
    """The narrow catalog of a run (paths, lengths, times, hashes), in one pass over the contents, which are not copied."""
    narrow = build_catalog(landed).drop("content")
    return save_table(narrow.sortWithinPartitions("repo_id", "rel_path"), path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, CATALOG)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return buckets.load(spark, path, CONTENT_META)


def save_metadata(meta: DataFrame, path: str, n_buckets: int | None = None) -> int:
    """The whole state, in buckets that the continuous form rewrites one by one; returns the number of the state."""
    return buckets.save(meta, path, n_buckets)


def load_symbols(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, SYMBOLS)


def save_symbols(symbols: DataFrame, path: str) -> int:
    """Sorted by repository and file, so that prefix queries skip row groups.

    A range partitioning samples its input first; the written table keeps that from parsing every text twice.
    """
    ordered = written(symbols, "symbols").repartitionByRange("repo_id", "file", "line").sortWithinPartitions(
        "repo_id", "file", "line", "type_ord", "pos"
    )
    return save_table(ordered, path)


def _label(spark: SparkSession, as_of: str) -> str:
    return spark.range(1).select(snapshot_label(F.lit(as_of).cast("timestamp"))).first()[0]


def _append_history(rows: DataFrame, path: str, as_of: str, kind: str) -> None:
    """Write a snapshot, then name it in the commit log; saving the same snapshot again replaces it, an empty one counts too."""
    spark = rows.sparkSession
    stamped = rows.withColumn("kind", F.lit(kind)).withColumn("snapshot_ts", F.lit(as_of).cast("timestamp"))
    entry = {"kind": kind, "label": _label(spark, as_of), "data": commits.write_data(stamped, path)}

    def put(content: dict) -> dict:
        others = [e for e in content.get("snapshots", []) if (e["kind"], e["label"]) != (kind, entry["label"])]
        return {**content, "snapshots": [*others, entry]}

    commits.update(spark, path, put)


def import_history(rows: DataFrame, path: str) -> None:
    """Load many snapshots at once, in one commit: ``rows`` have ``kind`` and ``snapshot_ts`` (to the second)."""
    spark = rows.sparkSession
    folders = {"_kind": F.col("kind"), "_label": snapshot_label("snapshot_ts")}
    data = commits.write_data(rows.withColumns(folders).repartition("_kind", "_label"), path, "_kind", "_label")
    new = []
    for kind in commits.children(spark, f"{path}/data/{data}"):
        for label in commits.children(spark, f"{path}/data/{data}/{kind}") if kind.startswith("_kind=") else ():
            names = [x.partition("=")[2] for x in (kind, label)]
            new.append({"kind": names[0], "label": names[1], "data": f"{data}/{kind}/{label}"})
    replaced = {(e["kind"], e["label"]) for e in new}

    def put(content: dict) -> dict:
        others = [e for e in content.get("snapshots", []) if (e["kind"], e["label"]) not in replaced]
        return {**content, "snapshots": [*others, *new]}

    commits.update(spark, path, put)


def _snapshots(spark: SparkSession, path: str, *kinds: str) -> list[dict]:
    """Entries of the newest state: one per snapshot."""
    return [e for e in commits.read(spark, path).content.get("snapshots", []) if not kinds or e["kind"] in kinds]


def _rows_of(spark: SparkSession, path: str, schema: str, entries: list[dict]) -> DataFrame:
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{e['data']}" for e in entries])


def load_history(spark: SparkSession, path: str, schema: str, as_of: str | None = None) -> DataFrame:
    """All snapshots and backups, or the one snapshot of ``as_of``, whose files alone are read."""
    if as_of is None:
        return _rows_of(spark, path, schema, _snapshots(spark, path))
    label = _label(spark, as_of)
    found = [e for e in _snapshots(spark, path, "snapshot") if e["label"] == label]
    if not found:
        raise FileNotFoundError(f"no snapshot {as_of} in {path}")
    return _rows_of(spark, path, schema, found)


def save_symbol_history(symbols: DataFrame, path: str, as_of: str) -> None:
    _append_history(symbols, path, as_of, "snapshot")


def save_content_history(meta: DataFrame, path: str, as_of: str) -> None:
    _append_history(meta, path, as_of, "snapshot")


def load_symbol_history(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    return load_history(spark, path, SYMBOL_HISTORY, as_of)


def load_content_history(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    return load_history(spark, path, CONTENT_HISTORY, as_of)


def backup_symbols(spark: SparkSession, table: str, history: str, as_of: str) -> bool:
    """Copy the current state into the history as a backup; False when there is nothing to copy."""
    if not numbers(spark, table):
        return False
    _append_history(load_symbols(spark, table), history, as_of, "backup")
    return True


def backup_content(spark: SparkSession, table: str, history: str, as_of: str) -> bool:
    if not commits.read(spark, table).number:
        return False
    _append_history(load_metadata(spark, table), history, as_of, "backup")
    return True


def delete_old_history(spark: SparkSession, path: str, keep: int) -> DataFrame:
    """Remove each repository's rows from all but its newest ``keep`` snapshots; returns ``repo_id, n_kept, n_deleted``.

    Only snapshots that lose rows are rewritten, as new data. One commit exchanges all of them, so a run that is lost
    before it leaves the whole history; a snapshot that was saved again meanwhile stays as it was saved. The data that went out of
    use is removed by ``vacuum_history``.
    """
    entries = {e["label"]: e for e in _snapshots(spark, path, "snapshot")}
    keys = _rows_of(spark, path, "repo_id STRING, snapshot_ts TIMESTAMP, kind STRING", list(entries.values()))
    marked = written(retention(keys, keep), "retention")
    gone = marked.filter(~F.col("keep")).select("repo_id", "snapshot_ts")
    labels = [r[0] for r in gone.select(snapshot_label("snapshot_ts")).distinct().collect()]  # at most one per entry
    if labels:
        rows = spark.read.parquet(*[f"{path}/data/{entries[label]['data']}" for label in labels])
        same = [rows["repo_id"].eqNullSafe(gone["repo_id"]), rows["snapshot_ts"] == gone["snapshot_ts"]]
        left = rows.join(gone, same, "left_anti").withColumn("snapshot", snapshot_label("snapshot_ts"))
        data = commits.write_data(left, path, "snapshot")
        found = {n.partition("=")[2] for n in commits.children(spark, f"{path}/data/{data}")}

        def exchange(content: dict) -> dict:
            out = []
            for e in content.get("snapshots", []):
                if e["label"] not in labels or e != entries[e["label"]]:
                    out.append(e)
                elif e["label"] in found:
                    out.append({**e, "data": f"{data}/snapshot={e['label']}"})
            return {**content, "snapshots": out}

        commits.update(spark, path, exchange)
    return retention_counts(marked)


def vacuum_history(spark: SparkSession, path: str, keep: int = 2, older_than_s: float = 86400) -> int:
    """Remove data of snapshots that were replaced or purged; see ``commits.vacuum``."""
    used = lambda content: {e["data"].partition("/")[0] for e in content.get("snapshots", [])}
    return commits.vacuum(spark, path, used, keep, older_than_s)


def vacuum_metadata(spark: SparkSession, path: str, keep: int = 2, older_than_s: float = 86400) -> int:
    """Remove buckets that were rewritten; see ``commits.vacuum``."""
    return commits.vacuum(spark, path, buckets.used, keep, older_than_s)


def read_text_lines(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines of text files with a global, gap-free ``line_no`` in file order; ``keys`` are partition folders."""
    reader = spark.read
    if keys:
        reader = reader.schema("value STRING, " + ", ".join(f"{k} STRING" for k in keys))
    raw = reader.text(path) if not keys else reader.format("text").load(path)
    placed = checkpoint(
        raw.select(
            *keys, "value",
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        )
    ).withColumn("_id", F.monotonically_increasing_id())
    numbered = sorted_row_number(placed, [*keys, "path", "_start", "_id"], "line_no")
    return numbered.drop("_start", "_id")


def read_patterns(spark: SparkSession, path: str, repo_id: str, source: str = "file") -> DataFrame:
    """Patterns of one ignore file; an absent file gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], IGNORE_PATTERNS)
    parsed = parse_pattern_lines(spark.read.text(path))
    return parsed.select(F.lit(repo_id).alias("repo_id"), "pattern", "is_dir", F.lit(source).alias("source"))


def write_patterns(patterns: DataFrame, path: str) -> None:
    """One ignore file: header, folders, files, each part sorted."""
    spark = patterns.sparkSession
    kinds = spark.createDataFrame([(True, "# Folders"), (False, "# Files")], "is_dir boolean, value string")
    present = patterns.select("is_dir").distinct()
    heads = kinds.join(F.broadcast(present), "is_dir").select("is_dir", F.lit(0).alias("k"), F.lit("").alias("pattern"), "value")
    body = patterns.select("is_dir", F.lit(1).alias("k"), "pattern", F.col("pattern").alias("value"))
    head = spark.createDataFrame([(True, -2 + i, "", v) for i, v in enumerate(PATTERN_FILE_HEAD)], "is_dir boolean, k int, pattern string, value string")
    rows = head.unionByName(heads).unionByName(body)
    rows.orderBy(F.desc("is_dir"), "k", "pattern").select("value").write.mode("overwrite").text(path)


def write_compact(symbols: DataFrame, path: str) -> None:
    """Compact text artefact, one folder per repository, parts in order."""
    compact_text(symbols).write.mode("overwrite").partitionBy("repo_id").text(path)


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of compact text artefacts."""
    lines = read_text_lines(spark, path, ("repo_id",))
    return parse_compact(lines)


def write_trees(files: DataFrame, path: str, ignore: list[str]) -> dict[str, str]:
    """Two renderings of one scan: folders only, and folders with files and sizes."""
    out = {"folder_tree": f"{path}/folders", "file_tree": f"{path}/files"}
    folders = tree_text(tree_lines(files, ignore, include_files=False), ["Directory structure (folders only)"])
    both = tree_text(
        tree_lines(files, ignore), ["Directory structure (folders and files)", "File sizes are shown in parentheses"]
    )
    folders.write.mode("overwrite").partitionBy("repo_id").text(out["folder_tree"])
    both.write.mode("overwrite").partitionBy("repo_id").text(out["file_tree"])
    return out


def write_requests(
    requests: DataFrame, path: str, max_requests: int = BATCH_MAX_REQUESTS, max_bytes: int = BATCH_MAX_BYTES,
) -> None:
    """JSON-lines files, one folder per chunk. A chunk is bounded in rows and bytes, so one task can write it.

    A request above ``max_bytes`` is an error: no file could hold it.
    """
    lines = request_lines(requests)
    # Numbering reads its input more than once: the narrow size table is written first.
    sizes = written(lines.select("repo_id", "custom_id", "bytes"), "request-sizes")
    longest = sizes.agg(F.max("bytes")).first()[0] or 0
    if longest > max_bytes:
        raise ValueError(f"a request has {longest} bytes; a file may have {max_bytes}")
    chunks = chunk_requests(sizes, max_requests=max_requests, max_bytes=max_bytes)
    numbered = lines.join(chunks.select("repo_id", "custom_id", "seq", "chunk", "part"), ["repo_id", "custom_id"])
    (
        numbered.repartition("chunk", "part")
        .sortWithinPartitions("chunk", "part", "seq")
        .select("chunk", "part", "value")
        .write.mode("overwrite").partitionBy("chunk", "part").text(path)
    )


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Answers of result files. ``line_no`` orders them: by the folder in the order given, by file name, by place in the file.

    Nothing is sorted or numbered for that: it is what a line knows of itself when it is read. Inside a split, ids grow
    from line to line, whatever number Spark starts from.
    """
    parts = []
    for number, path in enumerate(paths):
        split = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start")]
        place = F.struct(F.lit(number).alias("folder"), split[0].alias("file"), split[1].alias("start"), F.monotonically_increasing_id().alias("id"))
        parts.append(spark.read.text(path).select("value", place.alias("line_no")))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return parse_results(lines)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return parse_errors(spark.read.text(path))


def append_jobs(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("append").parquet(path)


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], BATCH_JOBS)
    return spark.read.schema(BATCH_JOBS).parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Any ordered one-column report as text."""
    rows.select("value").write.mode("overwrite").text(path)


__all__ = [
    "append_jobs", "backup_content", "backup_symbols", "delete_old_history", "drop_old_versions", "import_history", "load_catalog", "load_content_history",
    "load_history", "load_jobs",
    "load_metadata", "load_symbol_history", "load_symbols", "load_table", "read_compact", "read_errors",
    "read_patterns", "read_results", "read_text_lines", "save_catalog", "save_content_history", "save_metadata",
    "save_symbol_history", "save_symbols", "save_table", "sort_patterns", "vacuum_history", "vacuum_metadata", "write_compact",
    "write_lines", "write_patterns", "write_requests", "write_trees",
]
