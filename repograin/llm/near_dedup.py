"""Near duplicates by bottom-k sketches, checked on full shingle sets.

1. One pass hashes every document's word shingles with one hash function and keeps the ``SKETCH`` smallest values, the
   size of the set and a 128-bit digest of it. Equal sets are one class from here on.
2. Inverted lists of the retained values give candidates. Two sketches of sets above the threshold share at least half
   of their values, up to ``SKETCH`` = 48 a deviation of five sigma or more; hence they share one of the rarer half of
   either. Only those values are listed, the rarest first, so common lines and passages make few lists.
3. Lists of at most ``LONG_LIST`` classes give all their pairs. The union sketch estimates their similarity, and what
   may pass is checked exactly on the full sets.
4. Longer lists first compare every class with one leader; what is linked is one component, and lists that lie in one
   component are done. The classes of the others form families (lists that share a class); a family is dealt to blocks
   of bounded size, and each pair of blocks is one group that compares full sets by matrix products and returns
   the links that join something. Every pair of a family is compared once; pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm import words
from repograin.llm.columns import guarded
from repograin.llm.components import components
from repograin.llm.memory import tidy
from repograin.llm.scratch import bucket_of, bucket_table, less_listed, written
from repograin.llm.ship import ship

SHINGLE = 5
PERCENT = 80
SKETCH = 48
LONG_LIST = 64
BLOCK = 512  # classes, and
BLOCK_SHINGLES = 1 << 18  # shingles that a block of a family holds, about

_WORD = ~words.SPACE


def shingle_sets(run: words.Run, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a run, sorted within each text, and where each text's begin (one entry more)."""
    begin, end = run.bounds(_WORD)
    text = run.text_of(begin)
    word = words.Hasher(run.data)(begin, end)
    count = np.bincount(text, minlength=len(run))
    # A shingle starts at each word that has enough followers; in a shorter text, at the first word, over all of them.
    place = np.arange(len(word)) - np.concatenate([[0], np.cumsum(count)])[text]
    left = count[text] - place
    code = np.zeros(len(word), np.uint64)
    for k in range(shingle):
        follower = np.zeros(len(word), np.uint64)
        follower[: len(word) - k] = word[k:] if k else word
        code = words.mix(np.where(left > k, follower, np.uint64(0)) + code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    starts = (left >= shingle) | (place == 0)
    code, text = code[starts] >> np.uint64(1), text[starts]  # 63 bits order alike as signed and unsigned numbers
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    code, text = code[fresh], text[fresh]
    return code, np.searchsorted(text, np.arange(len(run) + 1))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.runs(batch.column(1)):
                code, starts = shingle_sets(part, shingle)
                n = np.diff(starts)
                sums = lambda x: np.subtract(*(np.concatenate([[np.uint64(0)], np.cumsum(x)])[s] for s in (starts[1:], starts[:-1])))
                first, second = sums(words.mix(code)), sums(words.mix(code ^ np.uint64(0x5851F42D4C957F2D)))
                kept = np.minimum(n, SKETCH)
                at = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(kept)[:-1]]), kept) + np.arange(kept.sum())
                ids = batch.column(0).slice(part.first, len(part))
                columns = [ids, pa.array(n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), _lists(code[at], kept)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "sketch"])

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.runs(batch.column(1)):
                code, starts = shingle_sets(part, shingle)
                ids = batch.column(0).slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([ids, _lists(code, np.diff(starts))], ["c", "s"])

    return run


def _shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets ``a`` with the sets ``b``, exact."""
    sizes = np.array([*map(len, a), *map(len, b)])
    values, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = np.bincount(column[row < len(a)], minlength=len(values)) > 0
    right = np.bincount(column[row >= len(a)], minlength=len(values)) > 0
    number = np.cumsum(left & right) - 1  # only values on both sides count
    use = (left & right)[column]
    row, column = row[use], number[column[use]]
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        dense = np.zeros((len(sizes), 4096), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        out += dense[: len(a)] @ dense[len(a) :].T
    return out


def _compare_blocks(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame["i"].iloc[0]
        a, b = frame[frame["blk"] == first], frame[frame["blk"] == frame["j"].iloc[0]]
        shared = _shared_counts(list(a["s"]), list(b["s"]))
        n, m = a["s"].map(len).to_numpy()[:, None], b["s"].map(len).to_numpy()[None, :]
        linked = (100 * shared >= percent * (n + m - shared)) & (shared > 0)
        left, right = a["c"].to_numpy(), b["c"].to_numpy()
        root: dict[int, int] = dict(zip(frame["c"], frame["comp"]))
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(linked)):
            p, q = find(root[left[x]]), find(root[right[y]])
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((left[x], right[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b, n_a, n_b`` whose full sets pass."""
    side = lambda k: sets.select(F.col("c").alias(k), F.col("s").alias(f"s_{k}"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))
        .select("a", "b")
    )


def _may_pass(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch does not rule them out: half of it in both, or the threshold where sketches are whole."""
    side = lambda k: classes.select(F.col("c").alias(k), F.col("sketch").alias(f"k_{k}"))
    union = F.slice(F.array_sort(F.array_union("k_a", "k_b")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(union, "k_a"), "k_b"))
    whole = (F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH)
    exact = 100 * F.size(F.array_intersect("k_a", "k_b")) >= percent * F.size(F.array_union("k_a", "k_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.when(whole, exact).otherwise(2 * both >= F.size(union))).drop("k_a", "k_b")


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``: linked if Jaccard >= ``percent`` / 100.

    Words are maximal runs of other bytes than ASCII white space, with A-Z as a-z. A text with fewer words than a
    shingle has one shingle of all its words; without words, or null, it has none and is linked with nothing. The
    component is the smallest id reachable, and the row with that id is kept. A row without id links with nothing and
    is kept, with no component. ``percent`` of 80 or more; rows repeated with the same id are one document.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(
        texts.mapInArrow(tidy(_sketches(shingle)), "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>"),
        "near-sketches",
    )
    key = ["n", "h1", "h2"]
    classes = written(
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("c"), F.first("sketch").alias("sketch")),
        "near-classes",
    )

    values = classes.select("c", "n", F.explode("sketch").alias("v"))
    common = written(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-values")
    # Of each sketch, how many of its rarest values must be listed: all but as many as two passing sketches share, less one.
    # Where a set and all its possible partners are whole in their sketches, that number is known; else it is one half.
    size = F.least(F.col("n"), F.lit(SKETCH))
    least = F.when(100 * F.col("n") <= percent * SKETCH, F.ceil(F.lit(percent) * size / 100)).otherwise(F.ceil(size / 2))
    shared_values = (
        values.join(common, "v").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("_by_df"))
    )
    # Values of one class only are the rarest; they fill the listed part first.
    alone = size - F.size("_by_df")
    entries = written(
        shared_values.withColumn("_take", (size - least + 1 - alone).cast("int"))
        .where("_take > 0")
        .select("c", "n", F.explode(F.slice("_by_df", 1, F.col("_take"))["v"]).alias("v")),
        "near-entries",
    )
    lengths = written(entries.groupBy("v").agg(F.count(F.lit(1)).alias("len"), F.min_by("c", F.xxhash64("v", "c")).alias("leader")).where("len > 1"), "near-lists")

    short = entries.join(lengths.where(F.col("len") <= LONG_LIST).select("v"), "v")
    one, two = (short.select("v", F.col("c").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    pairs = one.join(two, "v").where("a < b").select("a", "b", "n_a", "n_b")
    long_entries = written(entries.join(lengths.where(F.col("len") > LONG_LIST), "v").select("v", "c", "n", "leader"), "near-long")
    heads = long_entries.where("c = leader").select("v", F.col("n").alias("n_leader"))
    led = long_entries.join(heads, "v").where("c <> leader").select(
        F.least("c", "leader").alias("a"),
        F.greatest("c", "leader").alias("b"),
        F.when(F.col("c") < F.col("leader"), F.col("n")).otherwise(F.col("n_leader")).alias("n_a"),
        F.when(F.col("c") < F.col("leader"), F.col("n_leader")).otherwise(F.col("n")).alias("n_b"),
    )
    likely = written(_may_pass(_sized(pairs.unionByName(led), percent), classes, percent), "near-likely")

    wanted = likely.select(F.explode(F.array("a", "b")).alias("c")).unionByName(long_entries.select("c")).distinct()
    wanted = written(wanted.withColumnRenamed("c", "doc_id"), "near-wanted")
    nearby = texts.withColumn("_bucket", bucket_of("doc_id")).join(F.broadcast(bucket_table(wanted, "doc_id")), "_bucket", "left_semi")
    bodies = nearby.join(wanted, "doc_id")
    sets = written(bodies.select("doc_id", "text").mapInArrow(tidy(_full_sets(shingle)), "c bigint, s array<bigint>"), "near-sets")
    links = written(_verified(likely, sets, percent), "near-links")

    found = components(links)
    at = long_entries.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("component", "c"))
    at = written(at.select("v", "c", "n", "comp"), "near-long-at")
    mixed = written(at.groupBy("v").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("v"), "near-mixed")
    left = written(at.join(mixed, "v"), "near-left")
    if left.take(1):
        # Lists are nodes beside classes: (0, class) and (1, value).
        node = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).alias("id"))
        family = components(left.select(node(0, "c").alias("a"), node(1, "v").alias("b")))
        of = family.where("node.kind = 0").select(F.col("node.id").alias("c"), F.col("component.id").alias("fam"))
        members = left.select("c", "comp", "n").distinct().join(of, "c")
        by_count, by_size = F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)
        sizes = members.groupBy("fam").agg(F.greatest(by_count, by_size).cast("int").alias("blocks"))
        members = members.join(written(sizes, "near-families"), "fam").withColumn("blk", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
        # Each class goes to every pair of blocks that its own is part of.
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = members.withColumn("_o", other).select("c", "comp", "fam", "blk", F.least("blk", "_o").alias("i"), F.greatest("blk", "_o").alias("j"))
        blocks = dealt.join(sets, "c").groupBy("fam", "i", "j")
        more = written(blocks.applyInPandas(_compare_blocks(percent), "a bigint, b bigint"), "near-more")
        found = components(links.unionByName(more))

    comp = written(
        classes.select(*key, "c").join(found.withColumnRenamed("node", "c"), "c", "left").select(*key, F.coalesce("component", "c").alias("_comp")),
        "near-components",
    )
    own = F.coalesce("_comp", F.col("doc_id"))
    return rows.select("doc_id", *key).join(comp, key, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), own == F.col("doc_id")).otherwise(F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its columns as they are, one document of each component. ``docs`` must be a stored table."""
    marked = near_duplicates(docs, id_col, text_col, **options)
    dropped = written(marked.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct(), "near-dropped")

    def left(rows: DataFrame, key: str) -> DataFrame:
        own = F.col(key).cast("bigint")
        return less_listed(rows, own, dropped, F.col("_id"), lambda some: some.join(dropped, own == F.col("_id"), "left_anti"))

    return guarded(docs, left, id_col)
