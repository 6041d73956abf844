"""Tables that cut lineage, and bucket tables with a fixed row bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograin.session import scratch_path, shared_folder, written

BUCKETS = 1 << 16  # proven row bound of a bucket table; see ``bucket_table``


def bucket_of(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def bucket_table(keys: DataFrame, *columns: str) -> DataFrame:
    """The hash buckets that ``keys`` touch, to be broadcast: at most ``BUCKETS`` rows whatever the size of ``keys``.

    A row whose bucket is absent surely has no partner in ``keys``; a row whose bucket is present may have one.
    """
    return keys.select(bucket_of(*columns).alias("_bucket")).distinct()


MOST_LISTED = 1 << 20  # keys whose hashes are sent to every task


def less_listed(rows: DataFrame, key: Column, listed: DataFrame, listed_key: Column, less: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``less(rows)``, where ``less`` removes some of the rows whose key is in the written table ``listed``, and no other.

    Rows stay where they are unless the hash of their key is listed; only those are handed on. Hashes are sent to the
    tasks while there are at most ``MOST_LISTED``; above that all rows are handed on.
    """
    if listed.count() > MOST_LISTED:
        return less(rows)
    hashes = F.broadcast(listed.select(F.xxhash64(listed_key).alias("_hash")).distinct())
    marked = rows.withColumn("_hash", F.xxhash64(key))
    clear, doubtful = (marked.join(hashes, "_hash", how).drop("_hash") for how in ("left_anti", "left_semi"))
    return clear.unionByName(less(doubtful))


def stored_places(docs: DataFrame, out: str) -> DataFrame:
    """``docs``, a plain read of Parquet files that Spark wrote, with the row number in the order of writing, from 0.

    Files go by the number of the task that wrote them. One row per file is broadcast.
    """
    meta = docs.metadataColumn("_metadata")
    rows = docs.select("*", meta["file_path"].alias("_file"), meta["row_index"].alias("_row"))
    number = lambda pattern: F.regexp_extract("_file", pattern, 1).try_cast("bigint")
    in_order = Window.orderBy(number(r"/part-(\d+)-[^/]*$"), number(r"-c(\d+)[^/-]*$"), "_file")
    earlier = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    sizes = written(rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")), "stored-files")
    bases = sizes.select("_file", F.coalesce(earlier, F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_file").withColumn(out, F.col("_base") + F.col("_row")).drop("_file", "_row", "_base")


__all__ = ["BUCKETS", "bucket_of", "bucket_table", "less_listed", "scratch_path", "shared_folder", "stored_places", "written"]
