"""Path parts as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograin.functions.constants import DISPLAY_LANGUAGE, EXT_LANG


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: Column | str) -> Column:
    """Last path component."""
    return F.substring_index(_col(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """Last ``.x`` of the name; empty for ``.env``, ``a.`` and names without a dot."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def split_ext(path: Column | str) -> Column:
    """Like :func:`suffix`, but leading dots do not count and a bare trailing dot is an extension."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def parent_dir(path: Column | str) -> Column:
    """Everything before the last component; empty at the top level."""
    return F.regexp_replace(_col(path), r"/?[^/]*$", "")


def components(path: Column | str) -> Column:
    return F.split(_col(path), "/", -1)


def ancestors(path: Column | str, include_self: bool = False) -> Column:
    """Proper ancestor folders of a path, outermost first (plus the path itself on request)."""
    parts = components(path)
    last = F.size(parts) if include_self else F.size(parts) - 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """Small fixed map as a literal: folded into the projection, no join needed."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def display_language(path: Column | str) -> Column:
    return _lookup(F.lower(suffix(path)), DISPLAY_LANGUAGE)


def grammar_language(path: Column | str) -> Column:
    return _lookup(suffix(path), EXT_LANG)


def normal_ext(ext: str) -> str:
    """Query argument to extension: lower case, leading dot added."""
    ext = ext.lower()
    return ext if ext.startswith(".") else "." + ext
