"""Continuous metadata update from catalog files that land over time.

A micro-batch hashes what landed, compares narrow rows (key, time, hash) with the state of the buckets they fall into, and
rewrites only the buckets that change. One commit makes the new buckets current and notes the batch, so a batch that is replayed after
a failure is applied once. Contents are read for their hash and, where a summariser is given, filtered by the narrow list of
changed versions; they are never shuffled for the comparison.

Deletions need a complete catalog of a repository, so they stay in the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repograin.functions.text import decode
from repograin.operators import changes as C
from repograin.plans.updates import Summariser, summarise
from repograin.schemas import CONTENT_META
from repograin.session import written
from repograin.sources import buckets, commits

LANDED = "repo_id STRING, rel_path STRING, mtime TIMESTAMP, content BINARY"
PLACE = {"_file": "_metadata.file_path", "_row": "_metadata.row_index"}  # of a landed row
TRIES = 5


def newest_per_path(hashed: DataFrame) -> DataFrame:
    """The newest version of each path, from narrow rows ``repo_id, rel_path, mtime, hash[, _file, _row]``.

    Of versions with one time the largest hash counts. Files without a time or without content (unreadable ones) keep their
    row, too; they count as older than any other.
    """
    fields = [c for c in ("mtime", "hash", *PLACE) if c in hashed.columns]
    top = hashed.groupBy(*C.KEY).agg(F.max(F.struct(*fields)).alias("_top"))
    return top.select(*C.KEY, *[F.col(f"_top.{f}").alias(f) for f in fields])


def due(newest: DataFrame, meta: DataFrame) -> DataFrame:
    """Versions that are not older than what the state has of their path and differ from it.

    A file without a time may be newer. ``kept`` is the summary so far.
    """
    old = meta.select(
        *C.KEY, F.col("hash").alias("_hash"), F.col("last_updated").alias("_seen"), F.col("summary").alias("kept"), F.lit(True).alias("_old")
    )
    not_older = F.coalesce(F.col("mtime") >= F.col("_seen"), F.lit(True))
    changed = F.col("_old").isNull() | (not_older & ~F.col("hash").eqNullSafe(F.col("_hash")))
    return newest.join(old, C.KEY, "left").filter(changed).drop("_hash", "_seen", "_old")


def _texts(batch: DataFrame, todo: DataFrame) -> DataFrame:
    """Texts of the listed versions. The list is written and of known size, so contents stay where they are while it is small."""
    if set(PLACE) <= set(batch.columns):
        rows = batch.join(todo.select(*PLACE), list(PLACE), "left_semi")
    else:
        version = [*C.KEY, "mtime", "hash"]
        listed = todo.select(*[F.col(c).alias(f"_{c}") for c in version])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in version]
        rows = batch.withColumn("hash", F.md5("content")).join(listed, same, "left_semi")
    return rows.select(*C.KEY, decode("content").alias("text"))


def apply_batch(
    batch: DataFrame, store: str, summariser: Summariser | None, stream: str | None = None, number: int | None = None
) -> list[int]:
    """Upsert one micro-batch; returns the buckets that were rewritten.

    Running it twice gives the same state. With ``stream`` and ``number`` the commit notes the batch, and a batch that
    was committed before is left out at once.
    """
    spark, path = batch.sparkSession, f"{store}/content"
    place = [c for c in PLACE if c in batch.columns]
    hashed = batch.select(*C.KEY, "mtime", F.md5("content").alias("hash"), *place)
    newest = None
    for _ in range(TRIES):
        state = commits.read(spark, path)
        if stream is not None and state.content.get("streams", {}).get(stream, -1) >= number:
            return []
        newest = newest or written(newest_per_path(hashed), "stream-newest")
        seen = buckets.load(spark, path, CONTENT_META, state, buckets.touched(newest, state))
        todo = written(due(newest, seen), "stream-due")
        updates = todo.select(*C.KEY, "hash", F.col("mtime").alias("last_updated"), F.coalesce("kept", F.lit("")).alias("summary"))
        if summariser is not None:
            # Answers are costly: they are written before they are used. A version that landed twice is answered once or alike.
            answers = written(summarise(_texts(batch, todo), summariser), "stream-answers").groupBy(*C.KEY).agg(F.max("summary").alias("_new"))
            updates = updates.join(answers, C.KEY, "left").withColumn("summary", F.coalesce(F.nullif("_new", F.lit("")), "summary")).drop("_new")
        changing = buckets.touched(todo, state)
        marks = {"streams": {stream: number}} if stream is not None else {}
        if not changing and not marks:
            return []
        try:
            buckets.rewrite(spark, path, CONTENT_META, state, changing, lambda rows: C.upsert(rows, updates), **marks)
            return changing
        except commits.Conflict:
            continue  # another writer changed the state; compare with the newer one
    raise commits.Conflict(f"{path}: {TRIES} writers were faster")


def start(
    spark: SparkSession, landing: str, store: str, state: str, summariser: Summariser | None = None
) -> StreamingQuery:
    """Process everything that has landed since the last run, in micro-batches, then stop."""
    stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", "1000").parquet(landing)
    return (
        stream.select("*", *[F.col(source).alias(name) for name, source in PLACE.items()])
        .writeStream.option("checkpointLocation", state)
        .foreachBatch(lambda batch, number: apply_batch(batch, store, summariser, state, number))
        .trigger(availableNow=True)
        .start()
    )
