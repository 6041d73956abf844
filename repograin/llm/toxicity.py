"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so token labels are soft: a clean document has no toxic token, a toxic one has at least one.
A first guess spreads over the words (and beginnings of words) that toxic documents of the sample hold more often than
others; from then on the field's own marginals, given that constraint, are the labels it is drawn towards. No language
and no word needs a share of the sample. The field has two tags and hashed features of a token and its neighbours.
Forward-backward marginals give each token's probability; a logistic curve over a document's marginals, fitted on
held-back rows of the sample, gives its score.

Training sees a bounded sample on the driver. The model has a fixed size. Both recursions run over many documents at
once: products of 2 x 2 matrices are associative, so a long sequence is cut into columns that advance side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm import words
from repograin.llm.memory import tidy
from repograin.llm.sampling import labelled_sample
from repograin.llm.ship import ship

BITS = 20
KINDS = 7  # feature kinds: word, heads of 3, 4, 5 and 6 bytes, previous and next word
RUN_BYTES = 1 << 19  # texts are worked off in runs of about this size; bounds the arrays of a task
CAUTION = 1.64  # a first guess counts a word from the lower end (5 %) of its log odds
ROWS = 256  # tokens a column of the recursion has at most


@dataclass
class Tokens:
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray  # the text of each token
    first: np.ndarray  # marks the first token of a text
    features: np.ndarray  # KINDS x tokens, buckets


def tokens_of(run: words.Run) -> Tokens:
    """Runs of letters as tokens, with their feature buckets."""
    begin, end = run.bounds(words.LETTERS)
    text = run.text_of(begin)
    first = np.ones(len(begin), bool)
    first[1:] = text[1:] != text[:-1]
    last = np.append(first[1:], True)[: len(begin)]
    hashed = words.Hasher(run.data)
    word = hashed(begin, end)
    kinds = [word, *(hashed(begin, np.minimum(end, begin + n)) for n in (3, 4, 5, 6))]
    before, after = np.roll(word, 1), np.roll(word, -1)
    before[first], after[last] = 0, 0
    features = np.empty((KINDS, len(begin)), np.int32)
    for k, value in enumerate((*kinds, before, after)):
        features[k] = words.mix(value + np.uint64(k + 1)) >> np.uint64(64 - BITS)
    return Tokens(begin, end, text, first, features)


def _emission(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The sum of each token's weights, one kind after the other."""
    out = np.zeros(features.shape[1])
    for kind in features:
        out += weights[kind]
    return out


def chain_marginals(emission: np.ndarray, first: np.ndarray, move: np.ndarray, start: float, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each tag per token (2 x tokens), and of each pair of tags per token that follows another.

    ``emission`` is the score of tag 1 against tag 0; ``move`` holds the transition scores; ``first`` marks where a
    sequence begins, which forgets all before it. Without ``pairs`` only the tokens' own probabilities are found.
    """
    n = len(emission)
    if not n:
        return np.zeros((2, 0)), np.zeros((2, 2, 0))
    rows = min(ROWS, n)
    columns = -(-n // rows)
    e = np.exp(np.clip(emission, -30, 30))
    m = np.empty((2, 2, rows * columns))
    m[:, :, n:] = np.eye(2)[:, :, None]
    m[0, 0, :n], m[1, 0, :n] = np.exp(move[0, 0]), np.exp(move[1, 0])
    m[0, 1, :n], m[1, 1, :n] = np.exp(move[0, 1]) * e, np.exp(move[1, 1]) * e
    m[:, 0, :n][:, first] = 1.0
    m[:, 1, :n][:, first] = np.exp(start) * e[first]
    m /= m.sum(axis=(0, 1))
    step = m.reshape(2, 2, columns, rows)

    product = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, columns)).copy()
    for t in range(rows):
        product = np.einsum("ikc,kjc->ijc", product, step[:, :, :, t])
        product /= product.sum(axis=(0, 1))
    entry, leave = np.empty((2, columns)), np.empty((2, columns))
    a, b = np.array([1.0, 0.0]), np.array([1.0, 1.0])
    for c in range(columns):
        entry[:, c] = a
        a = a @ product[:, :, c]
        a /= a.sum()
    for c in reversed(range(columns)):
        leave[:, c] = b
        b = product[:, :, c] @ b
        b /= b.sum()
    forward, backward = np.empty((2, columns, rows)), np.empty((2, columns, rows))
    a, b = entry, leave
    for t in range(rows):
        a = a[0] * step[0, :, :, t] + a[1] * step[1, :, :, t]
        a = a / a.sum(axis=0)
        forward[:, :, t] = a
    for t in reversed(range(rows)):
        backward[:, :, t] = b
        b = step[:, 0, :, t] * b[0] + step[:, 1, :, t] * b[1]
        b = b / b.sum(axis=0)
    forward, backward = forward.reshape(2, -1)[:, :n], backward.reshape(2, -1)[:, :n]
    joint = forward * backward
    joint /= joint.sum(axis=0)
    if not pairs:
        return joint, np.zeros((2, 2, 0))
    inner = np.flatnonzero(~first)
    pair = forward[:, None, inner - 1] * m[:, :, inner] * backward[None, :, inner]
    pair /= pair.sum(axis=(0, 1))
    return joint, pair


def given_labels(single: np.ndarray, pair: np.ndarray, first: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the marginals become under the labels: tag 1 nowhere in a clean document, at least once in a toxic one.

    Returns the probability of tag 1 per token and the expected number of moves between tags (2 x 2). ``doc`` is the
    document of each token, ``toxic`` the label of each document. Both are exact: the chance of no tag 1 at all is the
    product of the chances that tag 0 follows tag 0.
    """
    tiny, inner = 1e-300, np.flatnonzero(~first)
    stay = np.log(np.maximum(single[0], tiny))
    stay[inner] = np.log(np.maximum(pair[0, 0], tiny)) - np.log(np.maximum(single[0, inner - 1], tiny))
    clean = np.minimum(np.bincount(doc, weights=stay, minlength=len(toxic)), 0)
    none, some = np.exp(clean), np.maximum(-np.expm1(clean), 1e-9)
    marginal = np.where(toxic[doc], np.minimum(single[1] / some[doc], 1), 0.0)
    under = toxic[doc[inner]]
    moves = pair[:, :, under] / some[doc[inner[under]]]
    moves = moves.sum(axis=2)
    moves[0, 0] += (~under).sum() - (none / some)[doc[inner[under]]].sum()
    return marginal, moves


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    move: np.ndarray
    start: float
    curve: np.ndarray  # logistic weights over ``_summary``

    def marginals(self, tokens: Tokens) -> np.ndarray:
        return chain_marginals(_emission(self.weights, tokens.features) + self.bias, tokens.first, self.move, self.start, pairs=False)[0][1]

    def scores(self, marginals: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_summary(marginals, text, n) @ self.curve, -30, 30)))


def _summary(marginals: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of each document: a constant, its largest log odds, the log of its expected number of toxic tokens, one more."""
    top = np.full(n, 1e-6)
    np.maximum.at(top, text, np.clip(marginals, 1e-6, 1 - 1e-6))
    expected = np.bincount(text, weights=marginals, minlength=n)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log(1e-3 + expected), np.log1p(expected)], axis=1)


#: What the curve is without evidence: the largest marginal is the score.
CURVE = np.array([0.0, 1.0, 0.0, 0.0])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, ridge: float = 5.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights, drawn towards ``prior`` where there are few rows."""
    w, loss = prior.copy(), lambda v: (weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + ridge / 2 * ((v - prior) ** 2).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * (w - prior)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
    return w


def fit(sample: list[tuple], toxic_share: float | None = None, most_tokens: int = 600_000, rounds: int = 60, guessed: int = 10) -> Model:
    """Train on ``(label, text)`` rows, label 1 for toxic. Rows beyond ``most_tokens`` tokens are left out.

    ``toxic_share`` is the share of toxic rows that scores are to reflect, where it differs from the sample's. The
    first ``guessed`` of ``rounds`` steps use the first guess of the token labels.

    With no rows, or of one label only, the model gives every document the score that this label has (0 without rows).
    """
    weights = np.zeros(1 << BITS, np.float32)
    if len({int(label) for label, _ in sample}) < 2:
        sure = 8.0 if sample and int(sample[0][0]) else -8.0
        return Model(weights, -20.0, np.zeros((2, 2)), 0.0, np.array([sure, 0.0, 0.0, 0.0]))
    parts, toxic, seen = [], [], 0
    for label, text in sample:
        part = tokens_of(next(words.runs(pa.array([text], pa.string()))))
        seen += len(part.begin)
        if seen > most_tokens and len(set(toxic)) == 2:
            break
        parts.append((part.first, part.features))
        toxic.append(bool(label))
    toxic = np.array(toxic)
    text = np.repeat(np.arange(len(toxic)), [len(p[0]) for p in parts])
    first = np.concatenate([p[0] for p in parts])
    features = np.concatenate([p[1] for p in parts], axis=1)
    del parts
    held = np.arange(len(toxic)) % 4 == 3  # for the curve
    learn = ~held[text]
    begin, doc = first[learn], text[learn]
    used = np.zeros(1 << BITS, bool)
    for kind in features:
        used[kind[learn]] = True
    used = np.flatnonzero(used)
    dense = np.zeros(1 << BITS, np.int32)
    dense[used] = np.arange(len(used))
    place = np.stack([dense[kind[learn]] for kind in features])
    guess = _first_guess(place[:5], len(used), doc, toxic, held)
    marked = np.bincount(doc, weights=guess, minlength=len(toxic)) > 0
    use = (~toxic | marked)[doc]  # a toxic document in which nothing stands out could only be learned by heart
    begin, doc, place, guess = begin[use], doc[use], place[:, use], guess[use]
    inner = np.flatnonzero(~begin)
    guess_moves = np.array([[(a[inner - 1] * b[inner]).sum() for b in (1 - guess, guess)] for a in (1 - guess, guess)])
    w, pace = np.zeros(len(used)), np.full(len(used), 1e-2)
    other, other_pace = np.zeros(6), np.full(6, 1e-2)
    for step in range(rounds):  # steepest ascent of the labels' likelihood with a pace of its own for each weight
        bias, move, start = other[0] - 3.0, other[1:5].reshape(2, 2), other[5]
        single, pair = chain_marginals(_emission(w, place) + bias, begin, move, start)
        wanted, wanted_moves = (guess, guess_moves) if step < guessed else given_labels(single, pair, begin, doc, toxic)
        gap = wanted - single[1]
        slope = sum(np.bincount(kind, weights=gap, minlength=len(used)) for kind in place) - 0.02 * w
        pace += slope**2
        w += 0.5 * slope / np.sqrt(pace)
        slope = np.array([gap.sum(), *(wanted_moves - pair.sum(axis=2)).ravel(), gap[begin].sum()]) - 0.02 * other
        other_pace += slope**2
        other += 0.3 * slope / np.sqrt(other_pace)
    weights[used] = w
    model = Model(weights, other[0] - 3.0, other[1:5].reshape(2, 2), float(other[5]), np.zeros(4))
    p = chain_marginals(_emission(weights, features) + model.bias, first, model.move, model.start, pairs=False)[0][1]
    # The sample has as many rows of either label; weights bring back the share of toxic rows among all.
    share = np.array([(~toxic).mean(), toxic.mean()])
    weight = (np.array([1 - toxic_share, toxic_share]) / share)[toxic.astype(int)] if toxic_share else np.ones(len(toxic))
    rest = held if held.any() and len(set(toxic[held])) == 2 else np.ones(len(toxic), bool)
    model.curve = _logistic(_summary(p, text, len(toxic))[rest], toxic[rest].astype(float), weight[rest], CURVE)
    return model


def _first_guess(place: np.ndarray, buckets: int, doc: np.ndarray, toxic: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A first probability of each token: how its best word or beginning compares with the best of its toxic document.

    A bucket counts by the lower end (``CAUTION`` deviations) of its log odds between toxic and clean documents, so what one document holds by
    chance does not count, and no least share or ratio decides.
    """
    documents = np.array([(~toxic & ~held).sum(), (toxic & ~held).sum()])
    odds = np.zeros(buckets)
    for kind in place:
        bucket, of = np.divmod(np.unique(kind * np.int64(len(toxic)) + doc), len(toxic))
        count = np.stack([np.bincount(bucket[toxic[of] == label], minlength=buckets) for label in (False, True)]) + 0.5
        rate = np.log(count / (documents[:, None] + 1))
        odds = np.maximum(odds, rate[1] - rate[0] - CAUTION * np.sqrt((1 / count).sum(axis=0)))
    best = np.zeros(len(doc))
    for kind in place:
        np.maximum(best, odds[kind], out=best)
    top = np.zeros(len(toxic))
    np.maximum.at(top, doc, best)
    return np.where(toxic[doc] & (best > 0.3), np.exp(3 * (best - top[doc])), 0.0)


def train(
    docs: DataFrame,
    labels: DataFrame | None = None,
    label_col: str = "toxic",
    text_col: str = "text",
    id_col: str = "doc_id",
    per_label: int = 1500,
    most_bytes: int = 1 << 14,
) -> Model:
    """Fit on a sample of ``docs``: ``per_label`` rows of each label, of up to ``most_bytes`` bytes each, at most.

    Labels are a column of ``docs``, or of ``labels`` with one row per id.
    """
    rows = docs if labels is None else labels
    share = rows.where(F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) != 0).cast("double"))).first()[0]
    return fit(labelled_sample(docs, label_col, text_col, id_col, per_label, 2 * per_label, most_bytes, labels), share)


def tag(docs: DataFrame, model: Model, text_col: str = "text", span_at: float = 0.5) -> DataFrame:
    """Add ``toxic_score`` (0 to 1) and ``toxic_spans``, tokens with a marginal of ``span_at`` or more.

    Spans are ``struct<start, end, p>`` in characters of the text, end exclusive. Null and empty texts, and texts
    without letters, have no tokens: no spans, and the score of a document with nothing toxic in it. Read whole.
    Columns of ``docs`` that bear the new names are replaced.
    """
    docs = docs.drop("toxic_score", "toxic_spans")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            for part in words.runs(batch.column(batch.schema.get_field_index(text_col)), size=RUN_BYTES):
                tokens = tokens_of(part)
                p = own.marginals(tokens)
                scores = own.scores(p, tokens.text, len(part))
                hit = np.flatnonzero(p >= span_at)
                counts = np.bincount(tokens.text[hit], minlength=len(part))
                characters = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
                base = characters[part.offsets[tokens.text[hit]]]
                starts, ends = ((characters[x[hit]] - base).astype(np.int32) for x in (tokens.begin, tokens.end))
                cells = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), pa.array(p[hit])], fields=list(kind.value_type))
                spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), cells)
                own_rows = batch.slice(part.first, len(part))  # a batch per run: neither side holds a second copy of a whole one
                yield pa.RecordBatch.from_arrays(
                    [*own_rows.columns, pa.array(scores), spans.cast(kind)], [*batch.schema.names, "toxic_score", "toxic_spans"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{kinds}, toxic_score double, toxic_spans array<struct<start:int,end:int,p:double>>")
