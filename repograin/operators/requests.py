"""Summarisation requests and answers as tables: build, filter, chunk, parse and merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions import paths
from repograin.functions.constants import (
    BATCH_MAX_BYTES,
    BATCH_MAX_CHARS,
    BATCH_MAX_REQUESTS,
    COST_PER_REQUEST,
    SINGLE_MAX_CHARS,
)
from repograin.functions.text import summary_from_answer, token_estimate
from repograin.operators.ordered import sorted_previous, sorted_row_number
from repograin.schemas import BATCH_ERROR, BATCH_RESULT
from repograin.session import checkpoint

# Fixed values of the request envelope.
METHOD = "POST"
URL = "/v1/chat/completions"
MAX_TOKENS = 4000
TEMPERATURE = 0.3
DEFAULT_MODEL = "summary-model"
TRUNCATION_NOTE = "(...truncated due to length)"

SYSTEM_TEXT = "You read source files and write short, exact summaries of them."
PROMPT_HEAD = "Summarise one file of a code repository.\n\nPath: "
PROMPT_TASK = (
    "\n\nState what the file is for, then list its functions, classes and important variables with one line each, "
    "and say how it connects to the rest of the repository.\n\nContent:\n"
)
PROMPT_TAIL = '\n\nAnswer with a JSON object that has the key "summary" holding markdown text.'


def batch_prompt(path: Column, language: Column, text: Column, max_chars: int = BATCH_MAX_CHARS) -> Column:
    """Batch form: the content is cut silently; a missing language reads ``Unknown``."""
    return F.concat(
        F.lit(PROMPT_HEAD), path, F.lit("\nLanguage: "), F.coalesce(language, F.lit("Unknown")),
        F.lit(PROMPT_TASK), F.substring(text, 1, max_chars), F.lit(PROMPT_TAIL),
    )


def single_prompt(path: Column, language: Column, text: Column, max_chars: int = SINGLE_MAX_CHARS) -> Column:
    """One-by-one form: the language is optional and a cut is announced."""
    return F.concat(
        F.lit(PROMPT_HEAD), path,
        F.when(language.isNull(), F.lit("")).otherwise(F.concat(F.lit(" (Language: "), language, F.lit(")"))),
        F.lit(PROMPT_TASK), F.substring(text, 1, max_chars),
        F.when(F.char_length(text) > max_chars, F.lit("\n" + TRUNCATION_NOTE)).otherwise(F.lit("")),
        F.lit(PROMPT_TAIL),
    )


def request_id(qualified: bool) -> Column:
    """Path, or repository and path where one batch covers several repositories."""
    return F.concat_ws("::", "repo_id", "rel_path") if qualified else F.col("rel_path")


def batch_requests(
    files: DataFrame, model: str = DEFAULT_MODEL, max_chars: int = BATCH_MAX_CHARS, qualified: bool = False
) -> DataFrame:
    """One nested request per non-empty file; ``custom_id`` is the path (see ``request_id``).

    ``rel_path`` stays beside it: types are read from the path, not from the id.
    """
    prompt = batch_prompt(F.col("rel_path"), paths.display_language("rel_path"), F.col("text"), max_chars)
    message = [
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_TEXT).alias("content")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
    ]
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(*message).alias("messages"),
        F.lit(MAX_TOKENS).alias("max_tokens"),
        F.lit(TEMPERATURE).alias("temperature"),
    )
    return files.filter(F.char_length("text") > 0).select(
        "repo_id",
        "rel_path",
        request_id(qualified).alias("custom_id"),
        F.lit(METHOD).alias("method"),
        F.lit(URL).alias("url"),
        body.alias("body"),
    )


def request_lines(requests: DataFrame) -> DataFrame:
    """JSON line of each request and its size on disk, newline included."""
    line = F.to_json(F.struct("custom_id", "method", "url", "body"))
    return requests.select("repo_id", "custom_id", line.alias("value")).withColumn(
        "bytes", F.octet_length("value").cast("bigint") + 1
    )


def type_key(path: Column | str) -> Column:
    """File type of a request: the extension of its path, or the whole path when it has none."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.nullif(paths.split_ext(c), F.lit("")), c)


def _path_of(requests: DataFrame) -> str:
    """The path column of a request table; bare lists of plain ids are their own paths."""
    return "rel_path" if "rel_path" in requests.columns else "custom_id"


def type_histogram(requests: DataFrame) -> DataFrame:
    return (
        requests.filter(F.coalesce(F.col("custom_id"), F.lit("")) != "")
        .groupBy(type_key(_path_of(requests)).alias("file_type"))
        .agg(F.count(F.lit(1)).alias("n_requests"))
    )


def exclude_types(requests: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Drop requests of the listed types; paths without an extension are listed and excluded by their full name."""
    if not excluded:
        return requests
    named = F.coalesce(F.col("custom_id"), F.lit("")) != ""
    return requests.filter(named & ~type_key(_path_of(requests)).isin(list(excluded)))


def char_totals(files: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Characters and the token estimate; characters are summed before the division."""
    return files.groupBy(*by).agg(F.sum(F.char_length("text").cast("bigint")).alias("total_chars")).withColumn(
        "est_tokens", token_estimate(F.col("total_chars"))
    )


def batch_cost(requests: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("n_requests")).withColumn(
        "est_cost", F.round(F.col("n_requests") * F.lit(COST_PER_REQUEST), 4)
    )


def chunk_requests(
    sizes: DataFrame,
    order: Sequence[str] = ("repo_id", "custom_id"),
    max_requests: int = BATCH_MAX_REQUESTS,
    max_bytes: int = BATCH_MAX_BYTES,
) -> DataFrame:
    """Chunk numbers for narrow ``(keys, bytes)`` rows in global order; ``sizes`` should be a stored table.

    ``chunk`` counts by requests. ``part`` splits a chunk further by bytes: lines go by where they start, in steps of
    the limit less the longest line but one byte, so no part exceeds the limit. Lines above half the limit do not count
    there; each has a part of its own, with the negative ``seq`` as its number. A line above the limit stays alone, too;
    whoever sends it has to refuse it (``stores.write_requests`` does).
    """
    small = F.col("bytes") * 2 <= max_bytes
    longest = sizes.agg(F.max(F.when(small, F.col("bytes")))).first()[0] or 1
    counted = sizes.withColumn("_small", F.when(small, F.col("bytes")).otherwise(0))
    numbered = sorted_row_number(counted, list(order), "seq", {"start_byte": "_small"}).drop("_small")
    part = F.when(small, F.floor(F.col("start_byte") / F.lit(max_bytes - longest + 1))).otherwise(-F.col("seq"))
    return numbered.withColumn("chunk", F.floor((F.col("seq") - 1) / F.lit(max_requests)).cast("bigint")).withColumn(
        "part", part.cast("bigint")
    )


def chunk_sizes(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("chunk", "part").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("bytes").alias("bytes")
    )


def job_rows(chunked: DataFrame, created_at: float, window: str = "24h") -> DataFrame:
    """One ``batch_jobs`` row per chunk part; ids are filled in by whoever submits the files."""
    numbered = checkpoint(sorted_row_number(chunk_sizes(chunked), ["chunk", "part"], "_n"))
    total = numbered.count()
    return numbered.select(
        F.lit(None).cast("string").alias("batch_id"),
        F.concat_ws("-", "chunk", "part").alias("input_file_id"),
        F.col("_n").cast("int").alias("chunk_index"),
        F.lit(total).cast("int").alias("total_chunks"),
        F.lit(created_at).alias("created_at"),
        F.lit(window).alias("completion_window"),
    )


def parse_results(lines: DataFrame) -> DataFrame:
    """Summaries from result lines ``(value, line_no)``; blank, broken and empty answers give no row."""
    r = F.from_json("value", BATCH_RESULT)
    content = F.try_element_at(F.col("_r.response.body.choices"), F.lit(1))["message"]["content"]
    return (
        lines.filter(F.trim("value") != "")
        .withColumn("_r", r)
        .filter(F.coalesce(F.col("_r.custom_id"), F.lit("")) != "")
        .filter(F.size(F.coalesce(F.col("_r.response.body.choices"), F.array())) > 0)
        .select(
            F.col("_r.custom_id").alias("custom_id"),
            "line_no",
            summary_from_answer(F.coalesce(content, F.lit("")), "batch").alias("summary"),
        )
        .filter(F.col("summary") != "")
    )


def last_summaries(results: DataFrame) -> DataFrame:
    """One summary per id: the one of the last line."""
    return results.groupBy("custom_id").agg(F.max_by("summary", "line_no").alias("summary"))


def merge_results(meta: DataFrame, results: DataFrame, as_of: Column, qualified: bool = True) -> DataFrame:
    """Metadata with the summaries of known ids replaced; unknown ids are dropped.

    Ids name repository and path. Plain paths (``qualified=False``) only fit metadata of a single repository.
    """
    fresh = last_summaries(results).select("custom_id", F.col("summary").alias("_s"))
    return meta.withColumn("custom_id", request_id(qualified)).join(fresh, "custom_id", "left").select(
        "repo_id",
        "rel_path",
        "hash",
        F.when(F.col("_s").isNotNull(), as_of).otherwise(F.col("last_updated")).alias("last_updated"),
        F.coalesce("_s", "summary").alias("summary"),
    )


def parse_errors(lines: DataFrame) -> DataFrame:
    """Error rows with default code and message; lines that are not JSON objects give no row."""
    checked = F.from_json("value", BATCH_ERROR + ", _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    return (
        lines.filter(F.trim("value") != "")
        .withColumn("_e", checked)
        .filter(F.col("_e").isNotNull() & F.col("_e._broken").isNull())
        .select(
            F.col("_e.custom_id").alias("custom_id"),
            F.coalesce("_e.error.code", F.lit("Unknown")).alias("code"),
            F.coalesce("_e.error.message", F.lit("Unknown error")).alias("message"),
        )
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("code", "message").agg(F.count(F.lit(1)).alias("n_errors"))


def job_state(status: Column | str) -> Column:
    """``completed``, ``failed`` or, for anything else, ``pending``."""
    c = F.col(status) if isinstance(status, str) else status
    return F.when(c.isin("completed", "failed"), c).otherwise(F.lit("pending"))


def state_counts(jobs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Jobs per state, with the two questions a poller asks: all done, any failed."""
    state = job_state("status")
    return jobs.groupBy(*by).agg(
        F.count_if(state == "completed").alias("completed"),
        F.count_if(state == "failed").alias("failed"),
        F.count_if(state == "pending").alias("pending"),
        F.bool_and(state != "pending").alias("all_done"),
        F.bool_or(state == "failed").alias("any_failed"),
    )


def status_transitions(polls: DataFrame, job: str, order: Sequence[str]) -> DataFrame:
    """Polls whose status differs from the job's previous poll (the first poll always counts)."""
    seen = sorted_previous(polls, [job], order, "status", "previous")
    return seen.filter(F.col("previous").isNull() | (F.col("previous") != F.col("status")))
