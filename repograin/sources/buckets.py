"""Tables keyed by ``repo_id, rel_path`` in buckets, of which an update rewrites only those it touches.

A bucket is a hash of the repository and of one of ``SPREAD`` shares of its paths, so a repository with a large part of all files
lies in several buckets and a small one in few. Each bucket is one folder of immutable files; the manifest says which folder is
current, so all buckets of an update change by one rename. See ``commits``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.sources import commits
from repograin.sources.commits import State

BUCKETS = 32  # of a new table; a large one is saved with more
SPREAD = 8


def bucket_of(buckets: int) -> Column:
    share = F.pmod(F.xxhash64("rel_path"), F.lit(SPREAD))
    return F.pmod(F.xxhash64("repo_id", share), F.lit(buckets)).cast("int")


def count_of(state: State) -> int:
    return state.content.get("buckets", BUCKETS)


def load(
    spark: SparkSession, path: str, schema: str, state: State | None = None, only: Iterable[int] | None = None
) -> DataFrame:
    """Rows of the newest state, or of a given one; ``only`` reads some buckets and leaves the others' files alone."""
    folders = (state or commits.read(spark, path)).content.get("folders", {})
    wanted = sorted(folders, key=int) if only is None else [str(b) for b in sorted(set(only)) if str(b) in folders]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{folders[b]}/bucket={b}" for b in wanted])


def touched(keys: DataFrame, state: State) -> list[int]:
    """The buckets of ``keys``: at most as many as the table has."""
    return sorted(r[0] for r in keys.select(bucket_of(count_of(state)).alias("b")).distinct().collect())


def _write(rows: DataFrame, path: str, buckets: int) -> dict[str, str]:
    """Folder by bucket, of the buckets that have rows."""
    dealt = rows.withColumn("bucket", bucket_of(buckets)).repartition("bucket").sortWithinPartitions("bucket", "repo_id", "rel_path")
    name = commits.write_data(dealt, path, "bucket")
    found = (n.partition("=")[2] for n in commits.children(rows.sparkSession, f"{path}/data/{name}") if n.startswith("bucket="))
    return dict.fromkeys(found, name)


def save(rows: DataFrame, path: str, buckets: int | None = None) -> int:
    """Replace the whole table. ``buckets`` may change their number."""
    spark = rows.sparkSession
    n = buckets or count_of(commits.read(spark, path))
    folders = _write(rows, path, n)
    return commits.update(spark, path, lambda old: {**old, "buckets": n, "folders": folders})


def rewrite(
    spark: SparkSession,
    path: str,
    schema: str,
    state: State,
    only: list[int],
    change: Callable[[DataFrame], DataFrame],
    **marks: dict,
) -> int:
    """Replace the rows of some buckets by ``change`` of them, as the state that follows ``state``.

    ``marks`` are entries to merge into the manifest in the same commit. Raises ``Conflict`` when ``state`` is not the newest any more.
    """
    content = {**state.content, "buckets": count_of(state)}
    if only:
        new = _write(change(load(spark, path, schema, state, only)), path, count_of(state))
        stay = {b: f for b, f in content.get("folders", {}).items() if int(b) not in set(only)}
        content["folders"] = {**stay, **new}
    for name, values in marks.items():
        content[name] = {**content.get(name, {}), **values}
    return commits.commit(spark, path, content, state.number)


def used(content: dict) -> set[str]:
    """The data that a manifest names; for ``commits.vacuum``."""
    return set(content.get("folders", {}).values())
