"""A training corpus from raw documents: drop toxic ones, exact and near copies, mix the sources, pack into windows.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and reread as the docs
of the next. All but the last return the columns of ``documents`` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.llm import exact_dedup, mixing, near_dedup, packing, queries, toxicity
from repograin.llm.columns import guarded
from repograin.llm.scratch import stored_places, written


#: Bytes of an Arrow batch on its way to a worker. At Spark's 64 MiB a whole task of texts is one batch, which executor
#: and worker both hold; rows and results do not depend on it.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Set ``BATCH_BYTES`` for the session, unless it has a setting of its own: a stage is written after it returned."""
    spark.conf.set(BATCH, spark.conf.get(BATCH, str(BATCH_BYTES)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. Null and empty texts have nothing toxic and stay."""
    small_batches(spark)
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = lambda rows, text: toxicity.tag(rows, model, text).where(F.col("toxic_score") < queries.TOXIC_AT)
    return guarded(docs, keep, "text")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; null counts as empty."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources meet their target weights."""
    targets, rest = queries.MIX_TARGETS, queries.MIX_REST
    order = lambda rows, key, source: mixing.mixed(rows, targets, rest, source_col=source, id_col=key)
    return guarded(docs, order, "doc_id", "source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in windows of 1024 tokens; windows follow the stored mixed order."""
    small_batches(spark)
    placed = stored_places(docs.select("doc_id", "text"), "place")
    own = {"cache_words": CACHE_WORDS, "run_bytes": RUN_BYTES}
    return packing.pack_documents(placed, queries.tokenizer_file(), place_col="place", **own)


#: Stretches that a packing worker remembers, and bytes of text it encodes at once: workers and executors have done other
#: stages before and keep some memory.
CACHE_WORDS, RUN_BYTES = 1 << 17, 1 << 19

STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None  # classifiers, components and packing are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
