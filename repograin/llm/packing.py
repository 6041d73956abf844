"""Best-fit decreasing packing of tokenised documents into windows of fixed size.

1. Tokenise whole texts in tasks; cut overlong documents into full windows plus one tail.
2. Write the pieces, deal them out to blocks by hash and pack each block on its own: tails in decreasing length, each
   into the tightest open window. A segment tree over the remaining capacities finds that window in log(window) steps.

A block holds about ``BLOCK_PIECES`` pieces, whatever the corpus size and the number of tasks that Spark makes of them.
Blocks depend on document ids only, so a lost task packs the same pieces the same way again.

Where the documents have an order to keep (``place_col``), blocks are ranges of ``BLOCK_PIECES`` pieces of it instead,
sequences are numbered in block order, and in a block by their earliest piece: no piece moves farther than its range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm.memory import tidy
from repograin.llm.scratch import written
from repograin.llm.ship import ship
from repograin.operators.ordered import block_running_sum

WINDOW = 1024
END_ID = 0
BLOCK_PIECES = 1 << 10  # results depend on it, and so it follows no setting
PLACE_BLOCK = 1 << 14  # documents whose piece counts are summed in one task
CACHE_WORDS = 1 << 20  # stretches whose ids a worker remembers, some 170 bytes each; a full cache starts anew

RUN_TEXTS, RUN_BYTES = 2048, 1 << 22  # texts that are encoded together, at most (a longer text by itself)
LEARN_CORES = 1 << 12  # cores that the tokenizer gets as one text; it notes hundreds of bytes on each token of a text
TAIL = ".,;:!?"  # punctuation that the split rule never joins to a letter or digit before it
SPECIAL = "<|endoftext|>"  # fixed value: the vocabulary's one special token


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The vocabulary never merges across the pieces of its split rule, and a single space always goes to what follows
    it. So texts are cut at their spaces, Arrow finds the distinct stretches of a run of texts, and the ids of the texts
    are gathered from those of the stretches. A stretch is taken apart further at single line feeds and before
    punctuation at its end; what is left, its cores, is encoded once and remembered. Where white space meets a space the
    rule looks farther; such texts, and those that spell the special token out, are encoded by themselves.
    """

    def __init__(self, file: str, cache_words: int = CACHE_WORDS, run_bytes: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # its own memory of words only costs where each is asked for once
        self.cache_words = cache_words
        self.run_bytes = run_bytes or RUN_BYTES
        self.known: dict[str, bytes] = {}  # cores and stretches put together of them, for " " + stretch
        self.bare: dict[str, bytes] = {}  # cores without a space before them: after a line feed or where a text begins
        self.joined: list[str] = []  # what is put together; an eighth of the memory, and the first to be forgotten
        self.tails: dict[str, bytes] = {}
        self.feed = self._whole(["\n"])[0]
        # Tokens of a byte-level vocabulary are spelled with one character per byte.
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _learn(self, store: dict[str, bytes], before: str, cores: list[str]) -> None:
        """Encode ``LEARN_CORES`` cores at a time as one text; the bytes of its tokens tell where each core ends."""
        skip = len(self.feed) if before == "\n" else 0  # a line feed is a piece of its own, a space is not
        for at in range(0, len(cores), LEARN_CORES):
            part = cores[at : at + LEARN_CORES]
            ids = self._whole([before + before.join(part)])[0]
            token_ends = np.cumsum(self.bytes_of[np.frombuffer(ids, "<u4")])
            ends = np.cumsum([len(x.encode()) + 1 for x in part])
            cuts = [0, *((np.searchsorted(token_ends, ends) + 1) * 4).tolist()]
            store.update(zip(part, [ids[a + skip : b] for a, b in zip(cuts, cuts[1:])]))

    def _forget_joined(self) -> None:
        for x in self.joined:
            del self.known[x]
        self.joined.clear()

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = self._whole([tail])[0]
        return self.tails[tail]

    @staticmethod
    def _cut(x: str) -> tuple[str, ...] | None:
        """Core and punctuation in turn, a pair for each stretch between line feeds; None if ``x`` may not be cut out."""
        lines, out = x.split("\n"), []
        for line in lines:
            core = line.rstrip(TAIL)
            if not core.isalnum():
                break
            out += [core, line[len(core) :]]
        else:
            return tuple(out)
        if x != x.strip() or x == "" or SPECIAL in x:
            return None
        if len(lines) > 1 and not all(line and line == line.strip() for line in lines):
            return x, ""  # white space meets a line feed: this stretch stays whole
        out = []
        for line in lines:
            core = line.rstrip(TAIL)
            core = core if core and core[-1].isalnum() else line
            out += [core, line[len(core) :]]
        return tuple(out)

    def _ids(self, stretches: list[str], bare: bool = False) -> list[bytes | None]:
        """Ids of distinct stretches, each with the space before it unless ``bare``; None where one may not be cut out."""
        first = self.bare if bare else self.known
        ids = list(map(first.get, stretches))
        left = [at for at, x in enumerate(ids) if x is None]
        plain = [x for at in left if (x := stretches[at]).isalnum()]
        apart = {at: cut for at in left if not (x := stretches[at]).isalnum() and (cut := self._cut(x))}
        after_space = set(plain).union([cut[0] for cut in apart.values()]).difference(first)
        after_feed = {core for cut in apart.values() if len(cut) > 2 for core in cut[2::2]}.difference(self.bare)
        new = len(self.bare) + len(after_space) + len(after_feed)
        if len(self.known) + new > self.cache_words:
            self._forget_joined()
        if len(self.known) + new > self.cache_words:
            for store in (self.known, self.bare, self.joined, self.tails):
                store.clear()
            return self._fresh(stretches, bare)
        self._learn(first, "\n" if bare else " ", list(after_space))
        self._learn(self.bare, "\n", list(after_feed.difference(self.bare)))  # ``first`` may be the same
        if len(self.joined) + len(apart) > self.cache_words // 8:
            self._forget_joined()
        for at, cut in apart.items():
            x = first[cut[0]]
            if cut[1]:
                x += self._tail(cut[1])
            for core, tail in zip(cut[2::2], cut[3::2]):
                x += self.feed + self.bare[core] + (self._tail(tail) if tail else b"")
            ids[at] = x
            if not bare and len(cut) + len(cut[1]) > 2:
                self.known[stretches[at]] = x
                self.joined.append(stretches[at])
        for at in left:
            if ids[at] is None:
                x = stretches[at]
                ids[at] = first.get(x) if x else b"" if bare else None
        return ids

    def _fresh(self, stretches: list[str], bare: bool) -> list[bytes | None]:
        """``_ids`` with an empty memory; what does not fit into it goes in halves."""
        if len(stretches) > max(1, self.cache_words // 16):
            half = len(stretches) // 2
            return self._ids(stretches[:half], bare) + self._ids(stretches[half:], bare)
        kept, self.cache_words = self.cache_words, 1 << 62
        try:
            return self._ids(stretches, bare)
        finally:
            self.cache_words = kept

    def _run(self, texts: list[str]) -> list[bytes]:
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        starts = pieces.offsets.to_numpy()
        which = coded.indices.to_numpy().copy()
        stretches = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # What a text begins with has no space before it.
        heads = [stretches[x] for x in which[starts[:-1]].tolist()]
        which[starts[:-1]] = np.arange(len(stretches), len(stretches) + len(texts))
        of_stretch = self._ids(stretches)
        of_stretch += self._ids(heads, bare=True)
        size = np.array([-1 if x is None else len(x) // 4 for x in of_stretch], np.int32)
        alone = np.minimum.reduceat(size[which], starts[:-1]) < 0
        np.maximum(size, 0, out=size)
        vocabulary = np.frombuffer(b"".join([x or b"" for x in of_stretch]), "<u4")
        lengths = size[which]
        ends = np.cumsum(lengths, dtype=np.int32)
        places = np.repeat((np.cumsum(size, dtype=np.int32) - size)[which] - (ends - lengths), lengths)
        places += np.arange(len(places), dtype=np.int32)
        ids = vocabulary[places].tobytes()
        cuts = [0, *(4 * ends[starts[1:] - 1].astype(np.int64)).tolist()]
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for at in np.flatnonzero(alone).tolist():
            out[at] = self._whole([texts[at]])[0]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        run: list[str] = []
        size = 0
        for text in texts:
            if run and (len(run) == RUN_TEXTS or size + len(text) > self.run_bytes):
                out += self._run(run)
                run, size = [], 0
            run.append(text)
            size += len(text)
        return out + self._run(run) if run else out


_encoders: dict[tuple[str, int, int], Encoder] = {}  # of this worker process, which Spark keeps for later tasks


def _slices(batch: pa.RecordBatch, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with the texts of one run; so a task holds one run as Python objects, not a whole batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, before + run_bytes, side="right"))
        upto = min(max(upto, at + 1), at + RUN_TEXTS)
        yield batch.slice(at, upto - at)
        at, before = upto, ends[upto - 1]


def _pieces(file: str, window: int, end_id: int, with_ids: bool, placed: bool, cache_words: int, run_bytes: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task; Spark runs the tasks
        if (file, cache_words, run_bytes) not in _encoders:
            _encoders[file, cache_words, run_bytes] = Encoder(file, cache_words, run_bytes)
        encoder = _encoders[file, cache_words, run_bytes]
        for batch in batches:
            for part in _slices(batch, run_bytes):
                texts = [t or "" for t in part.column(1).to_pylist()]
                out: list[tuple] = []
                heads = list(zip(*(part.column(i).to_pylist() for i in (0, 2)[: 1 + placed])))
                for head, ids in zip(heads, encoder.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        own = ids[4 * start : 4 * (start + window)]
                        row = (head[0], start, len(own) // 4, zlib.crc32(own), total, *head[1:])
                        out.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if with_ids else row)
                columns = list(zip(*out))
                kinds = [pa.int64()] * (5 + placed) + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["place"] * placed + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return run


def document_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
    place_col: str | None = None,
    cache_words: int = CACHE_WORDS,
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``place``, ``ids``) per piece: full windows, then the tail.

    Null text is empty: such a document is its end id alone. ``cache_words`` bounds what a worker remembers and
    ``run_bytes`` what it encodes at once, not the result.
    """
    placed = place_col is not None
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema += ", place bigint" * placed + ", ids array<int>" * with_ids
    ship(docs.sparkSession)
    place = [F.col(place_col).cast("bigint")] if placed else []
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), *place)
    return rows.mapInArrow(tidy(_pieces(tokenizer_file, window, end_id, with_ids, placed, cache_words, run_bytes)), schema)


class BestFit:
    """Open windows by remaining capacity. ``tree`` counts them: leaf c holds those with capacity c, a node its leaves."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, number: int) -> None:
        self.open[capacity].append(number)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``size``: (capacity, number)."""
        node = size + self.leaves
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):  # up, to the next subtree on the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:  # down, to its leftmost open leaf
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` come in decreasing order."""
    open_windows, count, numbers, offsets = BestFit(window), 0, [], []
    for size in lengths:
        capacity, number = open_windows.take(size) or (window, count)
        count += number == count
        numbers.append(number)
        offsets.append(window - capacity)
        if capacity > size:
            open_windows.put(capacity - size, number)
    return numbers, offsets


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to written pieces."""
    ship(pieces.sparkSession)
    blocks = max(1, -(-pieces.count() // BLOCK_PIECES))

    def pack(table: pa.Table) -> pa.Table:
        length, start = (table.column(c).to_numpy() for c in ("length", "start"))
        doc = table.column("doc_id").fill_null(-1).to_numpy()
        table = table.take(np.lexsort((start, doc, -length)))
        numbers, offsets = best_fit_decreasing(table.column("length").to_pylist(), window)
        block = table.column("_block").to_numpy().astype(np.int64)
        return (
            table.drop_columns("_block")
            .append_column("sequence_id", pa.array(np.asarray(numbers, dtype=np.int64) * blocks + block))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks))
    return (
        pieces.withColumn("_block", block)
        .groupBy("_block")
        .applyInArrow(pack, f"{fields}, sequence_id bigint, offset bigint")
    )


def pack_placed_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Like ``pack_pieces``, but along ``place``, the row numbers of the documents; ``place`` is left out."""
    ship(pieces.sparkSession)
    count = F.ceil(F.col("doc_tokens") / window)
    counts = pieces.where("start = 0").select("place", count.alias("_n"))
    before = written(block_running_sum(counts, [], "place", F.col("_n"), "_before", PLACE_BLOCK).drop("_n"), "pieces-before")

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(np.lexsort((table.column("_piece").to_numpy(), -table.column("length").to_numpy())))
        numbers, offsets = best_fit_decreasing(table.column("length").to_pylist(), window)
        piece = table.column("_piece").to_numpy()
        first = np.full(max(numbers) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, numbers, piece)
        rank = np.argsort(np.argsort(first))
        base = piece // BLOCK_PIECES * BLOCK_PIECES  # a range has no more sequences than pieces
        return (
            table.drop_columns(["_block", "_piece"])
            .append_column("sequence_id", pa.array(base + rank[numbers]))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "place")
    return (
        pieces.join(before, "place")
        .withColumn("_piece", F.col("_before") + F.floor(F.col("start") / window))
        .withColumn("_block", F.floor(F.col("_piece") / BLOCK_PIECES))
        .drop("place", "_before")
        .groupBy("_block")
        .applyInArrow(pack, f"{fields}, sequence_id bigint, offset bigint")
    )


def pack_documents(
    docs: DataFrame, tokenizer_file: str, window: int = WINDOW, place_col: str | None = None, **options
) -> DataFrame:
    """Pack whole documents. ``with_ids=True`` keeps the token ids with each piece; see ``sequences``.

    ``place_col`` has the row number of each document, from 0 without gaps, in an order that sequences are to follow.
    """
    pieces = written(document_pieces(docs, tokenizer_file, window=window, place_col=place_col, **options), "pieces")
    return pack_pieces(pieces, window) if place_col is None else pack_placed_pieces(pieces, window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """Token arrays ready for training, from pieces packed ``with_ids``: one row per sequence (at most ``window`` ids).

    Sequences are padded to ``window``, except where their length is a power of two.
    """
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    filled = packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("filled"))
    whole = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    padding = F.when(whole, 0).otherwise(F.lit(window) - F.col("filled")).cast("int")
    return filled.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), padding)).alias("ids"), "filled")
