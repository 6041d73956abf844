"""Bounded samples of labelled rows for fitting classifiers, and the hash folds that keep rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograin.llm.scratch import written

RANGE_BITS = 12  # equal ranges of a 64-bit hash, as a power of two

def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def first_ranges(heads: DataFrame, per_label: int) -> DataFrame:
    """The rows of stored ``heads`` (``label, head``) among which are the ``per_label`` smallest heads of each label.

    Counts of equal ranges of the hash tell where a label has enough. So one task orders a label's range counts, and
    later ``per_label`` rows and those of one range at most, and not all rows of a label.
    """
    part = F.shiftright("head", 64 - RANGE_BITS)  # keeps the sign, and so the order
    counts = heads.groupBy("label", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("before") < per_label)
    last = needed.groupBy("label").agg(F.max("part").alias("last"))
    return heads.join(F.broadcast(last), "label").where(part <= F.col("last")).drop("last")  # one row per label


def labelled_sample(
    docs: DataFrame,
    label: str,
    text_col: str,
    id_col: str,
    per_label: int,
    total: int,
    most_bytes: int,
    labels: DataFrame | None = None,
) -> list[tuple]:
    """``(label, text)`` of at most ``per_label`` rows of each label and ``total`` rows, in a fixed order.

    The label is a column of ``docs``, or of ``labels``, which has one row per id. Rows come in the order of a hash of
    their text's head, one row per such hash: copies count once. Texts above ``most_bytes`` bytes are not sampled, so
    the sample has at most ``total * most_bytes`` bytes. Choosing moves ids and hashes only, never texts.
    """
    head = F.xxhash64(F.substring(F.col(text_col), 1, 64)).alias("head")
    key = F.col(id_col).alias("id")
    given = [F.col(label).alias("label")] if labels is None else []
    narrow = docs.where(F.octet_length(text_col).between(1, most_bytes)).select(key, head, *given)
    if labels is not None:
        narrow = narrow.join(labels.select(key, F.col(label).alias("label")), "id")
    firsts = narrow.where("label IS NOT NULL").groupBy("label", "head").agg(F.min("id").alias("id"))
    order = Window.partitionBy("label").orderBy("head")
    few = first_ranges(written(firsts, "sample-heads"), per_label)
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)
    picked = ranked.orderBy("rank", "label", "head").limit(total).select("label", "rank", F.col("head").alias("_head"), F.col("id").alias("_id"))
    same = [F.col("id").eqNullSafe(F.col("_id")), F.col("head") == F.col("_head")]
    found = docs.select(key, head, F.col(text_col).alias("text")).join(F.broadcast(picked), same)  # ``total`` rows at most
    texts = found.groupBy("rank", "label", "head").agg(F.min("text").alias("text"))  # rows repeated with one id count once
    return [(r["label"], r["text"]) for r in texts.orderBy("rank", "label", "head").collect()]
