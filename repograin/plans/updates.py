"""End-to-end update jobs over a store folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.functions import paths
from repograin.operators import changes as C
from repograin.operators import requests as R
from repograin.operators.catalog import build_catalog, with_text
from repograin.operators.symbols import extract_symbols
from repograin.schemas import BATCH_ASKED
from repograin.sources import stores

Summariser = Callable[[str, str, str | None], dict]


def summarise(todo: DataFrame, summariser: Summariser, tasks: int | None = None) -> DataFrame:
    """Call a user function per non-empty file: ``fn(path, content, language) -> {"summary": text}``.

    It runs on executors; a call that fails gives a null summary with its ``error`` and never stops the job. ``tasks``
    spreads slow calls evenly when few files are left over from many splits.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, errors = [], []
            for row in frame.itertuples(index=False):
                answer, error = None, None
                try:
                    answer = (summariser(row.rel_path, row.text, row.language) or {}).get("summary")
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append(answer)
                errors.append(error)
            yield pd.DataFrame({"repo_id": frame["repo_id"], "rel_path": frame["rel_path"], "summary": out, "error": errors})

    inputs = todo.filter(F.char_length("text") > 0).select(
        "repo_id", "rel_path", "text", paths.display_language("rel_path").alias("language")
    )
    if tasks:
        inputs = inputs.repartition(tasks, "repo_id", "rel_path")
    return inputs.mapInPandas(run, "repo_id string, rel_path string, summary string, error string")


def _finish(
    spark: SparkSession, store: str, files: DataFrame, meta: DataFrame, summaries: DataFrame, as_of: str, force: bool
) -> DataFrame:
    """Merge, save, snapshot and count; the statistics come from the same inputs as the merge."""
    state = C.merge_state(files, meta, summaries, F.lit(as_of).cast("timestamp"), force)
    stats = C.run_stats(C.change_feed(meta, files), summaries)
    stores.save_metadata(state, f"{store}/content")
    stores.save_content_history(stores.load_metadata(spark, f"{store}/content"), f"{store}/content_history", as_of)
    return stats


def _catalog(spark: SparkSession, landed: DataFrame, store: str) -> DataFrame:
    """The narrow catalog of this run, stored: everything but the changed texts comes from it."""
    stores.save_catalog(landed, f"{store}/catalog")
    return stores.load_catalog(spark, f"{store}/catalog")


def _changed_texts(landed: DataFrame, files: DataFrame, meta: DataFrame, force: bool) -> DataFrame:
    """Texts of the files that need work, with the hash of what was read.

    The comparison runs on keys and hashes alone; texts never shuffle for it.
    """
    rows = landed if force else C.only_keys(landed, C.files_to_update(files.select(*C.KEY, "hash"), meta))
    return with_text(build_catalog(rows))


def update_content(
    spark: SparkSession, landed: DataFrame, store: str, summariser: Summariser, as_of: str, force: bool = False
) -> DataFrame:
    """Incremental content update: hash, compare, summarise what changed, merge, drop deleted, snapshot."""
    files = _catalog(spark, landed, store)
    meta = stores.load_metadata(spark, f"{store}/content")
    stores.backup_content(spark, f"{store}/content", f"{store}/content_history", as_of)
    todo = _changed_texts(landed, files, meta, force)
    # Calls to the summariser are costly: their result is written once and read back.
    number = stores.save_table(summarise(todo, summariser), f"{store}/summaries")
    summaries = spark.read.parquet(f"{store}/summaries/v{number}")
    return _finish(spark, store, files, meta, summaries, as_of, force)


def prepare_batch(
    spark: SparkSession, landed: DataFrame, store: str, out: str, excluded_types: Sequence[str] = (),
    force: bool = False, **limits: int,
) -> DataFrame:
    """First half of the batch form: write request files for what changed; returns size and cost per repository.

    What was asked is stored with the hash of the text that was sent, for ``finish_batch``.
    """
    meta = stores.load_metadata(spark, f"{store}/content")
    todo = _changed_texts(landed, _catalog(spark, landed, store), meta, force)
    requests = R.exclude_types(R.batch_requests(todo, qualified=True), excluded_types)
    stores.write_requests(requests, out, **limits)
    asked = requests.select(*C.KEY, "custom_id").join(todo.select(*C.KEY, "hash"), C.KEY)
    earlier = stores.load_table(spark, f"{store}/asked", BATCH_ASKED).join(asked.select("custom_id"), "custom_id", "left_anti")
    stores.save_table(asked.unionByName(earlier), f"{store}/asked")
    return R.batch_cost(requests)


def finish_batch(spark: SparkSession, landed: DataFrame, store: str, results: str | Sequence[str], as_of: str) -> DataFrame:
    """Second half: read result files, merge answers with the hashes they were asked for, drop deleted, snapshot.

    ``results`` is one folder or file, or several batches' in the order in which they came; the last answer counts.
    A file that changed after its request takes the answer with the old hash and so stays due.
    """
    files = _catalog(spark, landed, store)
    meta = stores.load_metadata(spark, f"{store}/content")
    folders = [results] if isinstance(results, str) else results
    answers = R.last_summaries(stores.read_results(spark, *folders))
    asked = stores.load_table(spark, f"{store}/asked", BATCH_ASKED)
    asked = C.files_to_update(C.live_metadata(asked, files), meta)
    summaries = asked.join(answers, "custom_id").select(*C.KEY, "hash", "summary")
    # Only answered files change state in the batch form.
    state = C.upsert(
        C.live_metadata(meta, files),
        summaries.select(*C.KEY, "hash", F.lit(as_of).cast("timestamp").alias("last_updated"), "summary"),
    )
    stats = C.run_stats(C.change_feed(meta, files), summaries)
    stores.save_metadata(state, f"{store}/content")
    stores.save_content_history(stores.load_metadata(spark, f"{store}/content"), f"{store}/content_history", as_of)
    return stats


def update_symbols(spark: SparkSession, landed: DataFrame, store: str, as_of: str) -> DataFrame:
    """Back up, extract again, save the table, the compact text and a snapshot; returns the stored table."""
    stores.backup_symbols(spark, f"{store}/symbols", f"{store}/symbol_history", as_of)
    files = with_text(build_catalog(landed, with_hash=False))
    stores.save_symbols(extract_symbols(files), f"{store}/symbols")
    stored = stores.load_symbols(spark, f"{store}/symbols")
    stores.write_compact(stored, f"{store}/symbols_text")
    stores.save_symbol_history(stored, f"{store}/symbol_history", as_of)
    return stored
