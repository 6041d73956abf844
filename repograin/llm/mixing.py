"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

The stream is cut into slots of one source block each. In a phase, source i has a quota q_i of the Q slots of a cycle,
so its j-th block of the cycle (from 0) is released at slot floor(j * Q / q_i) and due by slot ceil((j + 1) * Q / q_i).
Earliest deadline first among released blocks then keeps every source within less than one block of its share at every
slot, and a cycle ends with no debt. All cycles of a phase are alike: one cycle is scheduled, and every block finds its
slot by arithmetic. When a source has less than its part of a cycle left, one shorter cycle uses it up; the others go on
with their weights scaled up. No row is dropped or repeated.

Size of the parts: a schedule has at most 2 * sources phases of about ``CYCLE`` slots, fixed by the caller's list of
targets, and is the only thing that is broadcast. Rows are numbered inside hashed chunks of a source, so a source that
holds most rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograin.llm.scratch import written

CYCLE = 1000  # slots of a cycle: weights are met to a thousandth
BLOCK_ROWS = 8
CHUNK_ROWS = 1 << 10  # of all sources; results depend on it, and so it follows no setting


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)


def phases(blocks: Column, weights: list[float], cycle: int = CYCLE) -> Column:
    """``array<struct<cycles, quota array<bigint>>>``: how often which quotas apply until all ``blocks`` are used."""
    share = F.array(*[F.lit(float(w)) for w in weights])

    def step(state: Column, _: Column) -> Column:
        left = state["left"]
        live = F.zip_with(left, share, lambda n, w: F.when(n > 0, w).otherwise(0.0))
        all_live = F.aggregate(live, F.lit(0.0), lambda s, x: s + x)
        # A source with less than its part of a cycle left shortens the cycle to what it has.
        part = lambda total: F.coalesce(
            F.least(F.lit(1.0), F.array_min(F.zip_with(left, share, lambda n, w: F.when(n > 0, n * total / (w * cycle))))), F.lit(1.0)
        )
        even = lambda total, p: F.zip_with(
            left,
            share,
            lambda n, w: F.when(n > 0, F.least(n, F.greatest(F.round(w / total * cycle * p), F.when(p == 1, 1).otherwise(0)).cast("bigint"))).otherwise(
                F.lit(0).cast("bigint")
            ),
        )
        times = lambda quota: F.coalesce(
            F.array_min(F.zip_with(left, quota, lambda n, q: F.when(q > 0, F.floor(n / q)))), F.lit(0).cast("bigint")
        )
        after = lambda quota, c: F.struct(
            F.zip_with(left, quota, lambda n, q: n - q * c).alias("left"),
            F.concat(state["done"], F.array(F.struct(c.alias("cycles"), quota.alias("quota")))).alias("done"),
        )
        return _let(
            all_live,
            lambda total: _let(
                part(total), lambda p: _let(even(total, p), lambda quota: _let(times(quota), lambda c: after(quota, c)))
            ),
        )

    empty = F.from_json(F.lit("[]"), "array<struct<cycles:bigint,quota:array<bigint>>>")
    run = F.aggregate(
        F.sequence(F.lit(1), F.lit(2 * len(weights))), F.struct(blocks.alias("left"), empty.alias("done")), step
    )
    return F.filter(run["done"], lambda p: p["cycles"] > 0)


def earliest_deadline_first(quota: Column, sources: int) -> Column:
    """``array<int>``: the source of each slot of one cycle."""
    total = _sum(quota)
    numbers = F.sequence(F.lit(0), F.lit(sources - 1))

    def due(state: Column, slot: Column, i: Column) -> Column:
        q, n = F.element_at(quota, i + 1), F.element_at(state["done"], i + 1)
        released = (n < q) & (F.floor(n * total / q) <= slot)
        return F.when(released, F.struct(F.ceil((n + 1) * total / q).alias("deadline"), i.alias("source")))

    def step(state: Column, slot: Column) -> Column:
        first = F.array_min(F.transform(numbers, lambda i: due(state, slot, i)))["source"]
        return _let(
            first,
            lambda s: F.struct(
                F.transform(state["done"], lambda n, i: n + F.when(i == s, 1).otherwise(0)).alias("done"),
                F.concat(state["order"], F.array(s)).alias("order"),
            ),
        )

    none = F.array_repeat(F.lit(0).cast("bigint"), sources)
    start = F.struct(none.alias("done"), F.array().cast("array<int>").alias("order"))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), total - 1), start, step)["order"]


def schedule(blocks: DataFrame, weights: list[float], cycle: int = CYCLE) -> DataFrame:
    """One row per phase and source with blocks in it, from one row with an array of block counts, ``blocks``.

    ``phase, source, first_block, cycles, quota, slots`` (slots of its blocks in a cycle), ``cycle_slots, first_slot``.
    """
    n = len(weights)
    listed = blocks.select(F.posexplode(phases(F.col("blocks"), weights, cycle)).alias("phase", "_p")).select(
        "phase", F.col("_p.cycles").alias("cycles"), F.col("_p.quota").alias("_quota")
    )
    ordered = listed.withColumn("_order", earliest_deadline_first(F.col("_quota"), n))
    earlier = Window.partitionBy("source").orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    size = F.size("_order").cast("bigint")
    return (
        ordered.select("*", F.posexplode("_quota").alias("source", "quota"))
        .withColumn("cycle_slots", size)
        .withColumn("first_block", before(F.col("cycles") * F.col("quota")))
        .withColumn("first_slot", before(F.col("cycles") * F.col("cycle_slots")))
        .where("quota > 0")
        .withColumn("_at", F.sequence(F.lit(0).cast("bigint"), size - 1))
        .withColumn("slots", F.expr("filter(_at, t -> _order[cast(t as int)] = source)"))
        .select("phase", "source", "first_block", "cycles", "quota", "slots", "cycle_slots", "first_slot")
    )


def mix(
    docs: DataFrame,
    targets: dict[str, float],
    rest: float,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    cycle: int = CYCLE,
) -> DataFrame:
    """``docs`` with ``mix_source`` (its number in ``targets``), ``mix_phase``, ``mix_block``, ``mix_slot`` and
    ``mix_position``; ordering by ``mix_position`` is the mixed stream.

    ``targets`` are weights by source name, in any scale. Rows of other sources, and of none (null), form one more
    source with the weight ``rest``. Inside a source rows go by a hash of their id; equal ids in any order. Only a
    source's last block may hold fewer than ``block_rows`` rows. Empty tables give an empty result; input columns that
    bear the new names are replaced.
    """
    names = list(targets)
    if not names or min(*targets.values(), rest) <= 0:
        raise ValueError("weights must be above zero")
    weights = [*targets.values(), rest]
    number = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
    source = F.coalesce(F.try_element_at(number, F.col(source_col).cast("string")), F.lit(len(names)))
    chunks = max(1, -(-docs.count() // CHUNK_ROWS))
    rows = (
        docs.withColumn("mix_source", source)
        .withColumn("_mix_hash", F.xxhash64(F.col(id_col)))
        .withColumn("_mix_chunk", F.pmod(F.xxhash64("_mix_hash"), F.lit(chunks)).cast("int"))
    )
    counts = written(rows.groupBy("mix_source", "_mix_chunk").agg(F.count(F.lit(1)).alias("_mix_n")), "mix-counts")
    earlier = Window.partitionBy("mix_source").orderBy("_mix_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "mix_source", "_mix_chunk", F.coalesce(F.sum("_mix_n").over(earlier), F.lit(0)).alias("_mix_base")
    )
    sizes = counts.groupBy("mix_source").agg(F.sum("_mix_n").alias("n"))
    by_source = sizes.agg(F.map_from_entries(F.collect_list(F.struct("mix_source", F.ceil(F.col("n") / block_rows).alias("n")))).alias("m"))
    blocks = by_source.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(names))),
            lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("bigint")),
        ).alias("blocks")
    )
    plan = written(schedule(blocks, weights, cycle).withColumnsRenamed({c: f"_mix_{c}" for c in PLAN}), "mix-plan")
    inside = Window.partitionBy("mix_source", "_mix_chunk").orderBy("_mix_hash", F.col(id_col))
    rank = F.col("_mix_base") + F.row_number().over(inside) - 1
    ranked = rows.join(bases, ["mix_source", "_mix_chunk"]).withColumn("_mix_rank", rank)
    ranked = ranked.withColumn("mix_block", F.floor(F.col("_mix_rank") / block_rows))
    into = F.col("mix_block") - F.col("_mix_first_block")
    here = (F.col("mix_source") == F.col("_mix_source")) & (into >= 0) & (into < F.col("_mix_cycles") * F.col("_mix_quota"))
    place = F.element_at("_mix_slots", (into % F.col("_mix_quota")).cast("int") + 1)
    slot = F.col("_mix_first_slot") + F.floor(into / F.col("_mix_quota")) * F.col("_mix_cycle_slots") + place
    return (
        ranked.join(F.broadcast(plan), here)  # bounded by the number of targets, see above
        .withColumn("mix_phase", F.col("_mix_phase"))
        .withColumn("mix_slot", slot)
        .withColumn("mix_position", slot * block_rows + F.col("_mix_rank") % block_rows)
        .drop("_mix_hash", "_mix_chunk", "_mix_base", "_mix_rank", *[f"_mix_{c}" for c in PLAN])
    )


PLAN = ("phase", "source", "first_block", "cycles", "quota", "slots", "cycle_slots", "first_slot")


def mixed(docs: DataFrame, targets: dict[str, float], rest: float, **options) -> DataFrame:
    """``docs`` in mixed order, with its columns as they are."""
    return mix(docs, targets, rest, **options).orderBy("mix_position").select(docs.columns)
