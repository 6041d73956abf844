"""Exact duplicates by progressive refinement, with DataFrame functions only.

Three scans, each over less: lengths; a hash of the first bytes, for rows whose length occurs twice; a hash of the
whole text, for rows whose length and first bytes occur twice. What a scan needs from the one before is a table of
hash buckets with a fixed row bound, so no text is ever shuffled and nothing that grows with the data is broadcast.
A full bucket only lets more rows through to the next test; it never decides equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm.columns import guarded
from repograin.llm.scratch import bucket_of, bucket_table, less_listed, written

PREFIX_BYTES = 64


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept``, ``digest`` and the ``carry`` columns.

    * Texts are equal when their bytes are; null counts as empty. The largest id of a group stays, a null id counts
      as the smallest. Of repeated rows with the same id and text, all bear the same ``keep_id`` and ``kept``.
    * ``digest`` (SHA-256, hex) is null for rows that an earlier test set apart: they have no equal.
    * ``carry`` names further expressions over ``docs`` to return; an empty table gives an empty result.
    """
    carry = carry or {}
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("id"),
        body.alias("_body"),
        F.octet_length(body).alias("_len"),
        F.xxhash64(F.octet_length(body), F.substring(body, 1, PREFIX_BYTES)).alias("_prefix"),
        *[expr.alias(name) for name, expr in carry.items()],
    )
    same_length = rows.groupBy("_len").count().where("count > 1")
    lengths = bucket_table(same_length, "_len")
    second = rows.withColumn("_bucket", bucket_of("_len")).join(F.broadcast(lengths), "_bucket", "left_semi")
    same_prefix = second.groupBy("_prefix").count().where("count > 1")
    prefixes = bucket_table(same_prefix, "_prefix").withColumn("_again", F.lit(True))
    third = (
        rows.withColumn("_bucket", bucket_of("_prefix"))
        .join(F.broadcast(prefixes), "_bucket", "left")
        .select("id", *carry, F.when(F.col("_again"), F.sha2("_body", 256)).alias("digest"))
    )
    hashed = written(third, "exact-hashed")
    # Written, so that both sides of the join are plain exchanges, whose hot keys Spark can split.
    groups = written(
        hashed.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.max("id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1"),
        "exact-groups",
    )
    return hashed.join(groups, "digest", "left").select(
        "id",
        F.when(F.col("_n").isNull(), F.col("id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("_n").isNull() | F.col("id").eqNullSafe(F.col("_keep"))).alias("kept"),
        "digest",
        *carry,
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns as they are, less the rows that have an equal text under a larger id.

    Rows to drop are named by id and digest; only rows with such an id are joined. A row repeated with the same id and text stays as
    often as it occurs.
    """
    marked = refine(docs, id_col, text_col)
    dropped = written(
        marked.where(~F.col("kept")).select(F.col("id").alias("_id"), F.col("digest").alias("_digest")).distinct(),
        "exact-dropped",
    )

    def left(rows: DataFrame, key: str, text: str) -> DataFrame:
        own = F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)
        same = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest"))
        less = lambda some: some.withColumn("_own", own).join(dropped, same, "left_anti").drop("_own")
        return less_listed(rows, F.col(key), dropped, F.col("_id"), less)

    return guarded(docs, left, id_col, text_col)
