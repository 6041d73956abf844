"""Token counts of whole texts by rank-synchronous merging of byte pairs in numpy arrays.

Tasks split texts into pre-tokens by the vocabulary's rule and hold those that are new to the worker as one ragged array of
byte symbols. In every round each sequence finds its pair of lowest rank, and all sequences merge theirs at once, every
place it occurs at from left to right; sequences without a pair that merges are done. What is left of each is its count.
Merging all places of one pair together gives what merging them one by one gives, as a pair's own parts are always made
before it; the loader checks that of the vocabulary.

Counts of short pre-tokens are remembered in two generations of bounded size: when the younger one is full it replaces the
older one, so that what is in use stays. Each text is counted on its own, so lost tasks are simply run again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm.ppm import Slots
from repograin.llm.ship import ship

LIMIT = 1024
HELD = 1 << 17  # pre-tokens that a task holds before it counts them
LONG = 1 << 20  # characters after which a longer text is cut at its next single space
GENERATION = 1 << 18  # pre-tokens in each generation of the memory
SHORT = 32  # characters of a pre-token that is worth remembering

# The split rule of the byte-level vocabulary, and the bytes that its alphabet spells as themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
OWN_SPELLING = (range(33, 127), range(161, 173), range(174, 256))

NONE = np.iinfo(np.int64).max
CUT = regex.compile(r"(?<=\S)(?= \S)")  # a single space between others: a pre-token begins there, whatever stands around


def alphabet() -> list[str]:
    """The character that spells each byte; bytes that have none of their own get the next ones from 256 on."""
    plain = {b for part in OWN_SPELLING for b in part}
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class Vocabulary:
    """Merge rules of a byte-level pair vocabulary, as arrays."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as source:
            spec = json.load(source)
        model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        known = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if not known or split.get("add_prefix_space") or spec.get("normalizer") or any(odd):
            raise ValueError(f"{file}: not a plain byte-level pair vocabulary")
        ids = model["vocab"]
        self.symbol = np.array([ids[c] for c in alphabet()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.full(max(ids.values()) + 1, -1, np.int64)  # the rank that makes a symbol
        made[self.merged] = np.arange(len(pairs))
        if len(np.unique(self.merged)) < len(pairs) or np.any(np.maximum(made[left], made[right]) >= np.arange(len(pairs))):
            raise ValueError(f"{file}: a pair comes before its own parts")
        self.ranks = Slots((left << 32 | right).astype(np.uint64))
        added = [t for t in spec.get("added_tokens") or []]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{file}: added tokens that take in what stands around them")
        words = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, words))) if words else None
        self.split = regex.compile(SPLIT)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.ranks.find((left << 32 | right).astype(np.uint64))
        return np.where(found < 0, NONE, found)

    def sizes(self, pretokens: list[str]) -> np.ndarray:
        """Symbols that are left of each pre-token when nothing merges any more."""
        spelled = [p.encode() for p in pretokens]
        size = np.array([len(s) for s in spelled], np.int64)
        symbols = self.symbol[np.frombuffer(b"".join(spelled), np.uint8)]
        own = np.arange(len(size)).repeat(size)  # the sequence of each symbol
        # The rank of each symbol's pair with the next one; none at the end of a sequence.
        ranks = np.full(len(symbols), NONE)
        inside = np.flatnonzero(own[1:] == own[:-1])
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            length = np.diff(np.append(first, len(own)))
            best = np.minimum.reduceat(ranks, first)
            done = best == NONE
            if done.any():
                size[own[first[done]]] = length[done]
                left = ~done.repeat(length)
                symbols, own, ranks = symbols[left], own[left], ranks[left]
                best, length = best[~done], length[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == best.repeat(length))
            # Places in a row share symbols (a a a): of those every second one counts, from the left.
            begin = np.append(True, np.diff(hit) > 1)
            start = np.flatnonzero(begin)
            hit = hit[(np.arange(len(hit)) - start[np.cumsum(begin) - 1]) % 2 == 0]
            symbols[hit] = self.merged[ranks[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            place = hit - np.arange(len(hit))  # of the merged symbols, when their right halves are gone
            symbols, own, ranks = symbols[stay], own[stay], ranks[stay]
            stale = np.zeros(len(symbols) + 1, bool)
            stale[place] = stale[place - 1] = True  # the last element takes what lies before the first symbol
            changed = np.flatnonzero(stale[: len(symbols)])
            ranks[changed] = NONE
            changed = changed[changed < len(symbols) - 1]
            changed = changed[own[changed] == own[changed + 1]]
            ranks[changed] = self.rank(symbols[changed], symbols[changed + 1])
        return size


class Memory:
    """Numbers by text, the latest ones: two generations, of which the younger replaces the older when it is full."""

    def __init__(self):
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def table(self, wanted: set[str], learn: Callable[[list[str]], list[int]]) -> dict[str, int]:
        """A table that has all ``wanted`` texts; what neither generation knows is learned."""
        missing = wanted.difference(self.young)
        found = {w: self.old[w] for w in missing.intersection(self.old)}
        new = list(missing.difference(found))
        found.update(zip(new, learn(new)))
        kept = {w: n for w, n in found.items() if len(w) <= SHORT}
        if len(self.young) + len(kept) > GENERATION:
            used = {w: self.young[w] for w in wanted.intersection(self.young)}
            self.old, self.young = self.young, used
        self.young.update(kept)
        return self.young if len(kept) == len(found) else self.young | found


class Counter:
    """Counts of whole texts. What spells an added token out is cut at that before anything else."""

    def __init__(self, file: str):
        self.vocabulary = Vocabulary(file)
        self.memory = Memory()

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of bounded size where it has single spaces to be cut at."""
        at = 0
        while at < len(text):
            end = at + LONG
            if end < len(text):
                cut = CUT.search(text, end)
                end = cut.start() if cut else len(text)
            yield self.vocabulary.split.findall(text[at:end])
            at = end

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, however long it is; an added token is one. About ``HELD`` pre-tokens are held at a time."""
        out = np.zeros(len(texts), np.int64)
        added, sizes = self.vocabulary.added, self.vocabulary.sizes
        rows: list[int] = []
        held: list[list[str]] = []

        def flush() -> None:
            known = self.memory.table(set().union(*held), lambda new: sizes(new).tolist())
            np.add.at(out, rows, np.array([sum(map(known.__getitem__, p)) for p in held], np.int64))
            rows.clear()
            held.clear()

        pretokens = 0
        for row, text in enumerate(texts):
            pieces = added.split(text) if added and added.search(text) else [text]
            out[row] += len(pieces) - 1
            for part in (part for piece in pieces for part in self.parts(piece)):
                rows.append(row)
                held.append(part)
                pretokens += len(part)
                if pretokens >= HELD:
                    flush()
                    pretokens = 0
        if held:
            flush()
        return out


_counters: dict[str, Counter] = {}  # of this worker process, which Spark keeps for later tasks


def count_tokens(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_bytes`` (UTF-8), ``n_tokens, over_limit``.

    ``tokenizer_file`` is a byte-level pair vocabulary in the ``tokenizers`` format, read by the tasks; any other kind is an
    error. Added tokens that a text spells out count one each, as is that library's default. Null text is empty and has no
    tokens; a null id stays null; repeated rows are counted each; other columns are left out; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _counters:
            _counters[tokenizer_file] = Counter(tokenizer_file)
        counter = _counters[tokenizer_file]
        for batch in batches:
            n = counter.count(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
