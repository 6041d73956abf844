"""Snapshots: listing, latest version, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repograin.functions.constants import HISTORY_KEEP
from repograin.functions.text import snapshot_label
from repograin.session import checkpoint


def snapshots(history: DataFrame) -> DataFrame:
    """Distinct snapshots per repository with their row totals; backups are left out."""
    return (
        history.filter(F.col("kind") == "snapshot")
        .groupBy("repo_id", "snapshot_ts")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("label", snapshot_label("snapshot_ts"))
    )


def newest_first(listing: DataFrame) -> DataFrame:
    return listing.orderBy("repo_id", F.desc("snapshot_ts"))


def latest(history: DataFrame) -> DataFrame:
    """Newest snapshot time per repository; none for a repository without snapshots."""
    return (
        history.filter(F.col("kind") == "snapshot")
        .groupBy("repo_id")
        .agg(F.max("snapshot_ts").alias("snapshot_ts"))
    )


def retention(history: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """Each snapshot with ``keep``: true for the newest ``keep`` of its repository.

    The ranking filter runs map-side first (window group limit), so a repository with most of the snapshots
    sends only a few rows per task; the rest is found by an anti join on the unique snapshot key.
    """
    # The distinct snapshots are few and read three times below; the history itself is read once.
    all_ts = checkpoint(history.filter(F.col("kind") == "snapshot").select("repo_id", "snapshot_ts").distinct())
    order = Window.partitionBy("repo_id").orderBy(F.desc("snapshot_ts"))
    kept = all_ts.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= keep).drop("_rn")
    dropped = all_ts.join(kept, ["repo_id", "snapshot_ts"], "left_anti")
    return kept.withColumn("keep", F.lit(True)).unionByName(dropped.withColumn("keep", F.lit(False)))


def retention_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("repo_id").agg(
        F.count_if("keep").alias("n_kept"), F.count_if(~F.col("keep")).alias("n_deleted")
    )
