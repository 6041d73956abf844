"""Language-model scores by prediction by partial matching over bytes, next to a unigram base over words.

The model is a trie of byte contexts up to ``ORDER`` bytes with the counts of what follows, learned from all training
texts. A byte that a context has never seen is reached by an escape to the next shorter context, whose counts then
leave out every byte the longer one has seen (symbol exclusion). Of a context's counts, each seen byte gives one half
away: the escape probability is distinct / (2 * total). A text ends with a symbol of its own, so scores are probabilities of whole texts.

How it scales
* Counts are taken per task, over all bytes, and summed by one shuffle of (gram, count) rows.
* The trie is cut into shards by the last two context bytes, so an escape chain stays inside a shard down to order 2;
  orders 1 and 0 are one table of at most 65,536 rows. One shard of about ``SHARD_GRAMS`` grams at a time is shipped to
  the tasks, which add up the positions that belong to it. Small tries are one shard.
* Word counts are summed the same way. The most frequent words, at most ``TOP_WORDS``, are shipped; a document lists
  its rare words, and those are looked up by a join on the word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.llm import words
from repograin.llm.scratch import written
from repograin.llm.ship import ship

ORDER = 5
BEFORE, END = 0xFE, 0xFF  # bytes that UTF-8 never uses: stand before a text, and for its end
SHARD_GRAMS = 1 << 20
TOP_WORDS = 1 << 18
HOLD = 1 << 20  # rows a task holds back before it adds up what it has counted
ROWS, RUN_BYTES = 2000, 1 << 19  # texts and bytes that a task works on at a time

_WORD = ~words.SPACE


# ---------------------------------------------------------------------------------------------------------- counting


def _framed(run: words.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with ``ORDER`` bytes before and the end symbol after: bytes, places of the symbols, their texts."""
    n = len(run)
    own = np.arange(n).repeat(np.diff(run.offsets))
    shift = (ORDER + 1) * own + ORDER
    data = np.full(len(run.data) + (ORDER + 1) * n, BEFORE, np.uint8)
    at = np.arange(len(run.data)) + shift
    data[at] = run.data
    ends = run.offsets[1:] + (ORDER + 1) * np.arange(n) + ORDER
    data[ends] = END
    places = np.concatenate([at, ends])
    return data, places, np.concatenate([own, np.arange(n)])


def _grams(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Context and symbol of each place as one number, the symbol in the lowest byte."""
    code = np.zeros(len(data), np.uint64)
    for back in range(ORDER, -1, -1):
        code[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    return code[places]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


class _Counter:
    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, values: np.ndarray) -> None:
        keys, counts = np.unique(values, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > HOLD:
            keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def full(self) -> bool:
        return self.size > HOLD

    def take(self, kind: int) -> Iterator[pa.RecordBatch]:
        if self.keys:
            keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
            for at in range(0, len(keys), 1 << 18):
                k, c = keys[at : at + (1 << 18)], counts[at : at + (1 << 18)]
                columns = [np.full(len(k), kind, np.int8), k.view(np.int64), c.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "key", "n"])
        self.__init__()


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, vocabulary = _Counter(), _Counter()
    for batch in _few(batches):
        for run in words.runs(batch.column(0), lower=False, size=RUN_BYTES):
            data, places, _ = _framed(run)
            grams.add(_grams(data, places))
            run.data = words.LOWER[run.data]
            begin, end = run.bounds(_WORD)
            vocabulary.add(words.Hasher(run.data)(begin, end))
        if grams.full():
            yield from grams.take(0)
        if vocabulary.full():
            yield from vocabulary.take(1)
    yield from grams.take(0)
    yield from vocabulary.take(1)


# ------------------------------------------------------------------------------------------------------------- model


@dataclass
class Level:
    """The grams of one order: code (context and symbol) and count, sorted; of each context, what it has seen."""

    code: np.ndarray
    count: np.ndarray
    node: np.ndarray  # sorted contexts
    total: np.ndarray  # of each node
    distinct: np.ndarray


def _level(code: np.ndarray, count: np.ndarray) -> Level:
    node, first = np.unique(code >> np.uint64(8), return_index=True)
    total = np.add.reduceat(count, first) if len(first) else count[:0]
    return Level(code, count, node, total.astype(float), np.diff(np.append(first, len(code))).astype(float))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class Trie:
    """Contexts of all orders that the given grams of the highest order and the (order 1) ``low`` grams make up."""

    def __init__(self, code: np.ndarray, count: np.ndarray, low_code: np.ndarray, low_count: np.ndarray):
        self.levels: dict[int, Level] = {}
        for order in range(ORDER, 1, -1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            self.levels[order] = _level(*_summed(code & mask, count))
        for order in (1, 0):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            self.levels[order] = _level(*_summed(low_code & mask, low_count))
        self.excluded: dict[int, np.ndarray] = {}
        for order in range(ORDER, 0, -1):  # what a node's symbols count in its parent
            own, parent = self.levels[order], self.levels[order - 1]
            mask = np.uint64((1 << 8 * order) - 1)
            place, _ = _at(parent.code, own.code & mask)
            owner = np.searchsorted(own.node, own.code >> np.uint64(8))
            n = len(own.node)
            self.excluded[order] = np.bincount(owner, weights=parent.count[place] if len(parent.code) else None, minlength=n)
        top = self.levels[ORDER]
        place, _ = _at(top.node, top.code >> np.uint64(8))
        self.slots = Slots(top.code)
        self.top = np.log10((top.count - 0.5) / top.total[place]) if len(top.code) else np.zeros(0)

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context."""
        place = self.slots.find(code)
        out = np.zeros(len(code))
        seen = place >= 0
        out[seen] = self.top[place[seen]]
        rest = np.flatnonzero(~seen)
        if len(rest):
            distinct, inverse = np.unique(code[rest], return_inverse=True)
            out[rest] = self._escaped(distinct)[inverse]
        return out

    def _escaped(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        open_ = np.ones(len(code), bool)
        total_out = np.zeros(len(code))  # excluded from the next level: counts and symbols
        distinct_out = np.zeros(len(code))
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            own = code & np.uint64((1 << 8 * (order + 1)) - 1)
            node, known = _at(level.node, own >> np.uint64(8))
            gram, found = _at(level.code, own)
            known &= open_
            if not known.any():
                continue
            total = np.where(known, level.total[node] - total_out, 0.0)
            distinct = np.where(known, level.distinct[node] - distinct_out, 0.0)
            left = known & (total > 0)
            hit = left & found
            out[hit] += np.log10((level.count[gram[hit]] - 0.5) / total[hit])
            open_ &= ~hit
            miss = left & ~found
            out[miss] += np.log10(0.5 * distinct[miss] / total[miss])
            if order:
                total_out = np.where(known, self.excluded[order][node], total_out)
                distinct_out = np.where(known, level.distinct[node], distinct_out)
            else:
                distinct_out = np.where(known, level.distinct[node], distinct_out)
        out[open_] -= np.log10(np.maximum(256 - distinct_out[open_], 1))
        return out


class Slots:
    """Open-addressing table over 64-bit keys, filled and read by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length() + 1)
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        slot, waiting = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(waiting):
            free = self.place[slot] < 0
            self.place[slot[free]] = waiting[free]  # of several for one slot the last stays
            left = self.place[slot] != waiting
            slot, waiting = (slot[left] + 1) & ((1 << self.bits) - 1), waiting[left]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, -1 where it is absent."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        slot = self._slot(wanted)
        out = self.place[slot].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != wanted))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.place[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[np.maximum(out[todo], 0)] != wanted[todo])]
        return out


# ----------------------------------------------------------------------------------------------------------- scoring


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = rows.select("key", "n").toArrow()
    keys, counts = (table.column(c).to_numpy() for c in ("key", "n"))
    keys = keys.view(np.uint64) if len(keys) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _groups(code: np.ndarray) -> np.ndarray:
    return ((code >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)


def _score_part(shared, with_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, mine, slots, logs = shared.value
        for batch in _few(batches):
            n = batch.num_rows
            score, tokens, known, base = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            rare, rare_count = [], np.zeros(n, np.int64)
            for part in words.runs(batch.column(1), lower=False, size=RUN_BYTES):
                rows, size = slice(part.first, part.first + len(part)), len(part)
                data, places, text = _framed(part)
                code = _grams(data, places)
                if mine is not None:
                    own = mine[_groups(code)]
                    code, text = code[own], text[own]
                score[rows] = np.bincount(text, weights=trie.score(code), minlength=size)
                if not with_words:
                    continue
                part.data = words.LOWER[part.data]
                begin, end = part.bounds(_WORD)
                text, hashed = part.text_of(begin), words.Hasher(part.data)(begin, end)
                place = slots.find(hashed)
                common = place >= 0
                tokens[rows] = np.bincount(text, minlength=size)
                known[rows] = np.bincount(text[common], minlength=size)
                base[rows] = np.bincount(text[common], weights=logs[place[common]], minlength=size)
                rare.append(hashed[~common].view(np.int64))
                rare_count[rows] = np.bincount(text[~common], minlength=size)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(rare_count)]).astype(np.int32)),
                pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)),
            )
            cells = [*(batch.column(i) for i in (0, 2, 3)), *(pa.array(x) for x in (score, tokens, known, base)), lists]
            yield pa.RecordBatch.from_arrays(cells, ["id", *ROW, "score", "n_tokens", "n_known", "base", "rare"])

    return run


ROW = ["file", "place"]  # of a text in the stored table: the same however a pass splits the files


def _stored(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns and each row's place; a table that is not read from files is written first."""
    place = lambda rows: (rows.metadataColumn("_metadata")[c] for c in ("file_path", "row_index"))
    try:
        return docs.select(*columns, *[c.alias(name) for c, name in zip(place(docs), ROW)])
    except AnalysisException:
        rows = written(docs.select(*columns), "ppm-texts")
        return rows.select("*", *[c.alias(name) for c, name in zip(place(rows), ROW)])


def score(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``learn_from`` says which rows the model and the word counts are learned from. Scores are log10 probabilities of the
    whole text; ``base_score`` is the smoothed unigram sum over lower-cased words and one end. Null text is empty: it
    scores its end alone. Without training rows every byte is as likely as any other. Rows with equal ids are scored on
    their own. ``docs`` is read once per shard; passes are joined by file and row number, so executors may come and go
    between them.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = _stored(docs, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), learn_from.alias("_learn"))
    counted = texts.where("_learn").select("text").mapInArrow(_count, "kind tinyint, key bigint, n bigint")
    counts = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")
    grams, vocabulary = counts.where("kind = 0"), counts.where("kind = 1")

    train_rows = texts.where("_learn").count()
    sizes = vocabulary.agg(F.count(F.lit(1)), F.sum("n")).first()
    end = 1 if train_rows else 0
    train_tokens, distinct = (sizes[1] or 0) + train_rows, sizes[0] + end
    smooth = train_tokens + 0.1 * (distinct + 1)
    # The least count with which a word is shipped, from how many words lie in each band of counts.
    bands = vocabulary.groupBy(F.floor(F.log2("n") * 8).alias("band")).count().orderBy(F.desc("band")).collect()
    room, least = TOP_WORDS, 1 << 10
    for band, n in bands:  # at most 8 * 63 rows
        room -= n
        if room < 0:
            break
        least = band
    top, top_counts = _arrays(vocabulary.where(F.floor(F.log2("n") * 8) >= least))
    logs = np.log10((top_counts + 0.1) / smooth)

    by_group = np.zeros(1 << 16, np.int64)
    group = F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF)
    for g, n in grams.groupBy(group.alias("g")).count().collect():  # at most 65,536 rows
        by_group[g] = n
    shards = max(1, -(-int(by_group.sum()) // SHARD_GRAMS))
    shard_of, load = np.zeros(1 << 16, np.int64), np.zeros(shards, np.int64)
    for g in np.argsort(-by_group, kind="stable") if shards > 1 else ():
        shard_of[g] = load.argmin()
        load[shard_of[g]] += by_group[g]
    low = _arrays(grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")))
    kind = texts.schema["id"].dataType.simpleString()
    parts = []
    for s in range(shards):
        mine = shard_of == s if shards > 1 else None
        held = grams if mine is None else grams.where(group.isin([int(g) for g in np.flatnonzero(mine & (by_group > 0))]))
        trie = Trie(*_arrays(held), *low)
        shared = spark.sparkContext.broadcast((trie, mine, Slots(top), logs))
        scored = texts.select("id", "text", *ROW).mapInArrow(
            _score_part(shared, s == 0),
            f"id {kind}, file string, place bigint, score double, n_tokens bigint, n_known bigint, base double, rare array<bigint>",
        )
        parts.append(written(scored, f"ppm-shard-{s}"))
        shared.unpersist()
    first = parts[0]
    totals = first
    if shards > 1:
        added = parts[1].select(*ROW, "score")
        for p in parts[2:]:
            added = added.unionByName(p.select(*ROW, "score"))
        added = added.groupBy(*ROW).agg(F.sum("score").alias("_more"))
        totals = first.join(added, ROW).withColumn("score", F.col("score") + F.col("_more")).drop("_more")
    rare = first.select(*ROW, F.explode("rare").alias("key")).groupBy(*ROW, "key").agg(F.count(F.lit(1)).alias("m"))
    looked = rare.join(vocabulary.select("key", "n"), "key", "left").groupBy(*ROW).agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("_known"),
        F.sum(F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(smooth))).alias("_base"),
    )
    ending = float(np.log10(((train_rows if end else 0) + 0.1) / smooth))
    return totals.drop("rare").join(looked, ROW, "left").select(
        "id",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("_known", F.lit(0)) + end).cast("bigint").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) + F.lit(ending)).alias("base_score"),
        "score",
    )
