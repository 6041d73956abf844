"""Ordered operators that stay distributed when one key holds a large share of the rows.

A plain window over a hot key sorts that key in one task. Two ways around it are offered:

* ``block_*``: the row position is a dense number (line number, cell index), so it is cut into fixed-size blocks.
  Windows run inside ``(key, block)``; only one partial per block crosses blocks.
* ``sorted_*``: any order. Rows are range-partitioned and sorted once, the result is checkpointed so that slice
  boundaries are the same for every reader, and each slice adds the total of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograin.session import checkpoint, written

BLOCK = 1 << 16
TASK_ROWS = 1 << 18  # rows that one task ranks or gathers into lists, about
SLICE_ROWS = 1 << 21  # rows that one task sorts, about
_SLICE_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def _block_of(position: str, block: int) -> Column:
    return F.floor(F.col(position) / F.lit(block)).cast("bigint")


def _join_partials(rows: DataFrame, partials: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(partials, on, "left")


def block_running_sum(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key (exclusive; 0 for the first row)."""
    keys = list(keys)
    rows = df.withColumn("_blk", _block_of(position, block)).withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    partials = (
        rows.groupBy(*keys, "_blk")
        .agg(F.sum("_v").alias("_s"))
        .select(*keys, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _join_partials(rows, partials, [*keys, "_blk"])
        .withColumn(out, F.col("_carry") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_blk", "_v", "_carry")
    )


def block_carry_last(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of the key."""
    keys = list(keys)
    rows = df.withColumn("_blk", _block_of(position, block)).withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    partials = (
        rows.groupBy(*keys, "_blk")
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(position))).alias("_l"))
        .select(*keys, "_blk", F.last("_l", ignorenulls=True).over(before).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _join_partials(rows, partials, [*keys, "_blk"])
        .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_blk", "_v", "_carry")
    )


def _block_ranked(
    df: DataFrame, keys: list[str], position: str, order: Sequence[str], out: str, block: int
) -> tuple[DataFrame, int]:
    """``block_row_number`` and the number of tasks it deals the rows out to."""
    rows = df.withColumn("_blk", _block_of(position, block))
    counts = checkpoint(rows.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n")))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    partials = counts.select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    ranked = rows.repartition(tasks, *keys, "_blk").withColumn("_in", F.row_number().over(inside))
    # Both sides are dealt out alike and the rows are sorted already, so a merge join needs no further sort of them.
    carried = _join_partials(ranked, partials.repartition(tasks, *keys, "_blk").hint("merge"), [*keys, "_blk"])
    return carried.withColumn(out, F.col("_carry") + F.col("_in")).drop("_blk", "_carry", "_in"), tasks


def block_row_number(
    df: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], out: str, block: int = BLOCK
) -> DataFrame:
    """1-based row number in the key by ``order``; ``position`` must be the leading order column.

    A task sorts about ``TASK_ROWS`` rows (more where one block has more), whatever the session's shuffle setting.
    """
    return _block_ranked(df, list(keys), position, order, out, block)[0]


def block_lists(
    df: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], value: Column, per_row: int, block: int = BLOCK
) -> DataFrame:
    """``value`` of each key as arrays in ``order`` of at most ``per_row`` entries: ``keys, part, values``, none dropped."""
    keys = list(keys)
    ranked, tasks = _block_ranked(df, keys, position, order, "_rn", block)
    return (
        ranked.select(
            *keys, F.floor((F.col("_rn") - 1) / per_row).cast("bigint").alias("part"),
            F.struct("_rn", value.alias("v")).alias("_s"),
        )
        .repartition(tasks, *keys, "part")
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list("_s")).alias("_l"))  # at most per_row entries
        .select(*keys, "part", F.transform("_l", lambda s: s["v"]).alias("values"))
    )


def sorted_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Globally sorted rows with ``_slice`` (range partition) and ``_at`` (place in the global order).

    Rows are written first: a range sort reads its input twice (sample, then sort), and their count gives the number
    of slices, so that a slice has about ``SLICE_ROWS`` rows at most, whatever the session's shuffle setting.
    """
    rows = written(df, "unsorted")
    n = slices or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    placed = checkpoint(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    return placed.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_slice", F.shiftright("_at", _SLICE_BITS)
    )


def _slice_offsets(rows: DataFrame, **sums: Column) -> DataFrame:
    """Per slice, the totals of all earlier slices. One row per slice, so it is safe to broadcast."""
    totals = rows.groupBy("_slice").agg(*[c.alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_slice", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums]
    )


def sorted_row_number(
    df: DataFrame, order: Sequence[str], out: str, running: dict[str, str] | None = None, slices: int | None = None
) -> DataFrame:
    """Global 1-based row number, plus exclusive running sums ``{out_column: value_column}`` on request."""
    running = running or {}
    rows = sorted_slices(df, order, slices)
    offsets = _slice_offsets(
        rows, n=F.count(F.lit(1)), **{name: F.sum(value) for name, value in running.items()}
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << _SLICE_BITS) - 1))
    ranked = rows.join(F.broadcast(offsets), "_slice").withColumn(out, F.col("_o_n") + place + 1)
    inside = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for name, value in running.items():
        ranked = ranked.withColumn(name, F.col(f"_o_{name}") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return ranked.drop("_slice", "_at", "_o_n", *[f"_o_{name}" for name in running])


def sorted_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, slices: int | None = None
) -> DataFrame:
    """``value`` of the preceding row of the same key (null for the first one)."""
    keys = list(keys)
    rows = sorted_slices(df, [*keys, *order], slices)
    whole = F.struct(*keys, F.col(value).alias("_val"))
    # The row that precedes a slice is the last row of the closest earlier slice that has any.
    lasts = rows.groupBy("_slice").agg(F.max_by(whole, "_at").alias("_last"))
    fill = Window.orderBy("_slice")
    lasts = lasts.select("_slice", F.lag("_last").over(fill).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy("_at")
    joined = rows.join(F.broadcast(lasts), "_slice", "left").withColumn(
        "_prev", F.coalesce(F.lag(whole).over(inside), F.col("_before"))
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_prev.{k}").eqNullSafe(F.col(k))
    return joined.withColumn(out, F.when(same, F.col("_prev._val"))).drop("_slice", "_at", "_before", "_prev")


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, how: str = "left", salts: int = 8):
    """Equi-join in which ``small`` has one row per key and a key of ``big`` may be hot.

    Each key of ``big`` is spread over ``salts`` tasks by ``spread`` (a column that varies inside the key);
    ``small`` is repeated once per salt.
    """
    on = list(on)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
