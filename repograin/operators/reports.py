"""Text forms of symbols and summaries: markdown, plain, compact (with reader) and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.functions import paths
from repograin.functions.constants import EXT_LANG, SYMBOLS_PER_LINE
from repograin.functions.text import preview, short_tag, time_label
from repograin.operators.ordered import block_carry_last, block_lists

SYMBOL_TABLE_HEAD = ["| File | Line | Type | Name |", "|------|------|------|------|"]
SUMMARY_TABLE_HEAD = ["| File | Summary | Last Updated |", "|------|---------|--------------|"]
LINE_BLOCK = 4096  # lines per block when symbols of a file are numbered
COMPACT_TITLE = "Symbols by file, line:tag:name"


def symbols_markdown(symbols: DataFrame, short_names: bool = False) -> DataFrame:
    """One table row per symbol; ``short_names`` shows base names, as stored-symbol queries do."""
    shown = paths.base_name("file") if short_names else F.col("file")
    return symbols.select(
        "repo_id", "file", "line", "type_ord", "pos",
        F.format_string("| %s | %d | %s | %s |", shown, F.col("line"), F.col("type"), F.col("name")).alias("value"),
    )


def symbols_text(symbols: DataFrame) -> DataFrame:
    """Indented lines grouped by base name: same-named files of a repository share one heading."""
    return symbols.select(
        "repo_id",
        paths.base_name("file").alias("heading"),
        "line",
        F.format_string("  %4d %-3s %s", F.col("line"), short_tag("type"), F.col("name")).alias("value"),
    )


def symbols_listing(symbols: DataFrame) -> DataFrame:
    """Fixed-width listing of the stand-alone extractor."""
    return symbols.select(
        "repo_id", "file", "line", "type_ord", "pos",
        F.format_string("%-60s %-6d %-10s %s", F.col("file"), F.col("line"), F.col("type"), F.col("name")).alias("value"),
    )


def symbols_summary(symbols: DataFrame) -> DataFrame:
    return symbols.select(
        "repo_id", "file", "line", "type_ord", "pos",
        F.format_string("  %d:%s:%s", F.col("line"), short_tag("type"), F.col("name")).alias("value"),
    )


def symbols_json(symbols: DataFrame) -> DataFrame:
    """One JSON object per symbol; absent ``cell`` and ``block`` are left out."""
    return symbols.select(
        "repo_id", "file", "line", "type_ord", "pos",
        F.to_json(F.struct("file", "line", "type", "name", "cell", "block")).alias("value"),
    )


def symbols_compact(symbols: DataFrame, per_line: int = SYMBOLS_PER_LINE) -> DataFrame:
    """Compact lines ``line:tag:name line:tag:name ...``, at most ``per_line`` symbols each, none dropped."""
    token = F.concat_ws(":", F.col("line").cast("string"), short_tag("type"), F.col("name"))
    order = ["line", "type_ord", "pos"]
    return block_lists(symbols, ["repo_id", "file"], "line", order, token, per_line, LINE_BLOCK).select(
        "repo_id", "file", "part", F.size("values").alias("n_symbols"), F.array_join("values", " ").alias("value")
    )


def compact_text(symbols: DataFrame) -> DataFrame:
    """The compact artefact: title, total, then per file a header line, its lines and a blank line, in order."""
    parts = symbols_compact(symbols)
    body = parts.select("repo_id", "file", F.lit(1).alias("k"), "part", "value")
    files = parts.select("repo_id", "file").distinct()
    around = files.select(
        "repo_id", "file",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("part"), F.col("file").alias("value")),
                F.struct(F.lit(2).alias("k"), F.lit(0).cast("bigint").alias("part"), F.lit("").alias("value")),
            )
        ),
    )
    totals = symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    head = totals.select(
        "repo_id", F.lit("").alias("file"), F.lit(-1).alias("k"),
        F.posexplode(
            F.array(
                F.lit(COMPACT_TITLE + ":"), F.lit("-" * 80),
                F.concat(F.lit("Total symbols: "), F.col("n").cast("string")), F.lit(""),
            )
        ).alias("part", "value"),
    ).withColumn("part", F.col("part").cast("bigint"))
    return head.unionByName(around).unionByName(body).orderBy("repo_id", "file", "k", "part").select("repo_id", "value")


def _is_header(line: Column) -> Column:
    """A file header: no colon, and the last component has a known extension."""
    known = paths.suffix(line).isin(list(EXT_LANG))
    return known & ~line.contains(":")


def parse_compact(lines: DataFrame, store: str = "repo_id", line_no: str = "line_no") -> DataFrame:
    """Symbols from compact text lines ``(store, line_no, value)``.

    Each line belongs to the latest header above it. Types come back as tags, and names with spaces are split,
    as the format loses both.
    """
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    named = lines.select(store, line_no, text.alias("_t"))
    carried = block_carry_last(named, [store], line_no, F.when(_is_header(F.col("_t")), F.col("_t")), "file")
    skip = (
        F.col("_t").startswith("#") | F.col("_t").startswith("-") | F.col("_t").startswith("Total")
        | F.col("_t").startswith(COMPACT_TITLE) | (F.col("_t") == "") | _is_header(F.col("_t"))
    )
    tokens = (
        carried.filter(F.col("file").isNotNull() & ~skip)
        .select(store, "file", line_no, F.posexplode(F.split("_t", r"\s+")).alias("pos", "_tok"))
        .withColumn("_p", F.split("_tok", ":", -1))
        .filter(F.size("_p") >= 3)
        .withColumn("line", F.expr("try_cast(_p[0] as int)"))
        .filter(F.col("line").isNotNull())
    )
    return tokens.select(
        store, "file", line_no, "pos", "line", F.col("_p")[1].alias("type"),
        F.array_join(F.slice("_p", F.lit(3), F.size("_p")), ":").alias("name"),
    )


def summary_report(meta: DataFrame) -> DataFrame:
    """Markdown rows of non-empty summaries: path, preview, time."""
    return meta.filter(F.coalesce("summary", F.lit("")) != "").select(
        "repo_id", "rel_path",
        F.format_string("| %s | %s | %s |", F.col("rel_path"), preview("summary"), time_label("last_updated")).alias("value"),
    )


def summary_text(meta: DataFrame) -> DataFrame:
    """Plain report block per non-empty summary."""
    bar = "=" * 60
    return meta.filter(F.coalesce("summary", F.lit("")) != "").select(
        "repo_id", "rel_path",
        F.concat(
            F.lit(f"{bar}\nFile: "), "rel_path", F.lit("\nLast Updated: "), time_label("last_updated"),
            F.lit(f"\n{bar}\n"), "summary",
        ).alias("value"),
    )


def summary_json(meta: DataFrame) -> DataFrame:
    return meta.filter(F.coalesce("summary", F.lit("")) != "").select(
        "repo_id", "rel_path",
        F.to_json(F.struct(F.col("rel_path").alias("file"), "summary", "last_updated")).alias("value"),
    )


def list_report(rows: DataFrame, head: list[str], order: list[str]) -> DataFrame:
    """A whole report as ordered text: heading lines first, then the rows in order."""
    lead = rows.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(h) for h in head])).alias("_h", "value")
    )
    body = rows.select(F.lit(len(head)).alias("_h"), "value", *order)
    return lead.unionByName(body, allowMissingColumns=True).orderBy("_h", *order).select("value")
