"""Keep a caller's columns apart from an operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def guarded(docs: DataFrame, use: Callable[..., DataFrame], *needed: str) -> DataFrame:
    """Apply ``use`` to ``docs`` under plain column names, so that no extra column can clash with one of its own.

    ``use`` gets the renamed table and the new names of the ``needed`` columns and returns rows of the table, perhaps
    with further columns; the result has the old columns again, in their order.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    return use(docs.toDF(*plain), *[plain[names.index(n)] for n in needed]).select(*plain).toDF(*names)
