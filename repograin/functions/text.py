"""Text, size, label and model-answer expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograin.functions.constants import CHARS_PER_TOKEN, PREVIEW_CHARS, TYPE_TAGS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode(content: Column | str) -> Column:
    """Bytes to text; malformed UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(_col(content).cast("string"))


def lines(text: Column | str) -> Column:
    return F.split(_col(text), "\n", -1)


def token_estimate(total_chars: Column) -> Column:
    """Integer division of an already summed character count."""
    return F.floor(total_chars / F.lit(CHARS_PER_TOKEN))


def size_label(size: Column | str) -> Column:
    """``B``/``KB``/``MB``/``GB``/``TB`` with one decimal, rounded half to even."""
    x = _col(size).cast("double")
    label = None
    for power, unit in enumerate(["B", "KB", "MB", "GB"]):
        value = F.format_string("%.1f" + unit, F.bround(x / float(1024**power), 1))
        cond = x < float(1024 ** (power + 1))
        label = F.when(cond, value) if label is None else label.when(cond, value)
    return label.otherwise(F.format_string("%.1fTB", F.bround(x / float(1024**4), 1)))


def preview(text: Column | str, width: int = PREVIEW_CHARS) -> Column:
    """First ``width`` characters with dots when something was cut."""
    c = _col(text)
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def time_label(ts: Column | str) -> Column:
    """Readable timestamp; missing and zero epochs are ``N/A``."""
    c = _col(ts)
    return F.when(
        c.isNull() | (F.unix_micros(c.cast("timestamp")) == 0), F.lit("N/A")
    ).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


def snapshot_label(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd_HH-mm-ss")


def short_tag(symbol_type: Column | str) -> Column:
    """Three-letter tag used by the stored compact form."""
    return F.substring(_col(symbol_type), 1, 3)


def table_tag(symbol_type: Column | str) -> Column:
    """Tag from the fixed table, else the first three letters."""
    c = _col(symbol_type)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(TYPE_TAGS.items())])
    return F.coalesce(F.try_element_at(table, c), short_tag(c))


def summary_from_answer(answer: Column | str, mode: str = "single") -> Column:
    """Summary text from a model answer.

    ``single``: JSON object with ``summary``; else the widest ``{...}`` inside the text; else the raw text.
    ``batch``: JSON object with ``summary``, else the raw text.
    ``legacy``: as ``single``, but text without any JSON object becomes an error message.
    """
    c = _col(answer)

    whole = F.try_variant_get(F.try_parse_json(c), "$.summary", "string")
    if mode == "batch":
        return F.coalesce(whole, c)
    inner_text = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    inner = F.try_variant_get(F.try_parse_json(F.nullif(inner_text, F.lit(""))), "$.summary", "string")
    if mode == "single":
        # An answer that is JSON as a whole but has no summary is returned as it is.
        return F.when(F.try_parse_json(c).isNotNull(), F.coalesce(whole, c)).otherwise(F.coalesce(inner, c))
    if mode == "legacy":
        is_json = F.try_parse_json(c).isNotNull() | F.try_parse_json(F.nullif(inner_text, F.lit(""))).isNotNull()
        return F.when(is_json, F.coalesce(whole, inner, F.lit(""))).otherwise(
            F.concat(F.lit("Error parsing API response: "), c)
        )
    raise ValueError(f"unknown mode {mode!r}")
