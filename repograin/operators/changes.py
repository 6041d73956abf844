"""Change detection and incremental merge between two catalog states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.session import written

KEY = ["repo_id", "rel_path"]


def _hashes(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*KEY, F.col("hash").alias(f"{alias}_hash"), F.lit(True).alias(f"_{alias}"))


def change_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per path of either state: ``new``, ``modified``, ``deleted`` or ``unchanged``.

    Hashes compare null-safe: two unreadable versions count as unchanged.
    """
    joined = _hashes(old, "old").join(_hashes(new, "new"), KEY, "full")
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("modified")
    )
    return joined.select(*KEY, change.alias("change"), "old_hash", "new_hash")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo_id", "change").agg(F.count(F.lit(1)).alias("n_files"))


def changed_condition(force: bool = False, retry_empty: bool = False) -> Column:
    """True where a left-joined old entry (``_old``, ``old_hash``, ``old_summary``) calls for an update."""
    cond = F.col("_old").isNull() | ~F.col("old_hash").eqNullSafe(F.col("hash"))
    if retry_empty:
        cond = cond | (F.coalesce(F.col("old_summary"), F.lit("")) == "")
    return F.lit(True) if force else cond


def files_to_update(files: DataFrame, meta: DataFrame, force: bool = False, retry_empty: bool = False) -> DataFrame:
    """Files that are new or whose hash changed. Runs before any text work, so unchanged text is never touched."""
    if force:
        return files
    old = meta.select(
        *KEY,
        F.col("hash").alias("old_hash"),
        F.col("summary").alias("old_summary") if retry_empty else F.lit(None).cast("string").alias("old_summary"),
        F.lit(True).alias("_old"),
    )
    return (
        files.join(old, KEY, "left")
        .filter(changed_condition(retry_empty=retry_empty))
        .drop("old_hash", "old_summary", "_old")
    )


def only_keys(wide: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``wide`` whose key is listed.

    The list is written first, so the planner knows its size and keeps wide rows in place where that is small.
    """
    return wide.join(written(keys.select(*KEY), "keys"), KEY, "left_semi")


def live_metadata(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file still exists."""
    return meta.join(files.select(*KEY), KEY, "left_semi")


def removed_metadata(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file is gone."""
    return meta.join(files.select(*KEY), KEY, "left_anti")


def upsert(meta: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace whole entries by key; entries without an update stay as they are. ``updates`` has one row per key."""
    fields = ["hash", "last_updated", "summary"]
    new = updates.select(*KEY, F.struct(*fields).alias("_new"))
    old = meta.select(*KEY, F.struct(*fields).alias("_old"))
    merged = old.join(new, KEY, "full").withColumn("_e", F.coalesce("_new", "_old"))
    return merged.select(*KEY, *[F.col(f"_e.{f}").alias(f) for f in fields])


def merge_state(
    files: DataFrame,
    meta: DataFrame,
    summaries: DataFrame,
    as_of: Column,
    force: bool = False,
    retry_empty: bool = False,
) -> DataFrame:
    """The next metadata state of an incremental run, in one pass over three co-partitioned inputs.

    Deleted entries drop out because the files drive the join. A changed file takes the new hash and time at
    once; its summary is replaced when one arrived and kept (or empty for new files) when none did.
    """
    old = meta.select(
        *KEY,
        F.col("hash").alias("old_hash"),
        F.col("last_updated").alias("old_updated"),
        F.col("summary").alias("old_summary"),
        F.lit(True).alias("_old"),
    )
    fresh = summaries.select(*KEY, F.nullif("summary", F.lit("")).alias("new_summary"))
    joined = files.select(*KEY, "hash").join(old, KEY, "left").join(fresh, KEY, "left")
    changed = changed_condition(force, retry_empty)
    kept = F.coalesce("old_summary", F.lit(""))
    return joined.select(
        *KEY,
        F.when(changed, F.col("hash")).otherwise(F.col("old_hash")).alias("hash"),
        F.when(changed, as_of).otherwise(F.col("old_updated")).alias("last_updated"),
        F.when(changed, F.coalesce("new_summary", kept)).otherwise(kept).alias("summary"),
    )


def run_stats(changes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Counts of one incremental run per repository, taken from the real change classes."""
    got = summaries.filter(F.col("summary") != "").select(*KEY, F.lit(True).alias("_got"))
    todo = F.col("change").isin("new", "modified")
    return (
        changes.join(got, KEY, "left")
        .groupBy("repo_id")
        .agg(
            F.count_if(todo & F.col("_got").isNotNull()).alias("processed"),
            F.count_if(todo & F.col("_got").isNull()).alias("errors"),
            F.count_if(F.col("change") == "deleted").alias("deleted"),
            F.count_if(F.col("change") != "deleted").alias("total_files"),
            F.count_if(F.col("change") == "unchanged").alias("unchanged"),
        )
    )
