"""Language identification: averaged embeddings of hashed subwords under a linear softmax, trained by SGD in numpy.

Subwords are the 2- to 4-byte grams of the lower-cased text, with every run of other bytes than letters as one space.
Training reads a bounded sample of labelled rows on the driver; the model has a fixed size and is shipped to tasks as
one table of class scores per subword bucket. A fifth of the sample is held back to fit the softmax temperature and the
rejection threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm import words
from repograin.llm.sampling import labelled_sample
from repograin.llm.ship import ship

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
UNKNOWN = "und"

_SHAPE = words.LOWER.copy()
_SHAPE[~words.LETTERS] = 0x20


def _grams(run: words.Run) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of a run, and the text of each."""
    data = _SHAPE[run.data]
    text = np.repeat(np.arange(len(run)), np.diff(run.offsets))
    letter = data != 0x20
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of several spaces the first
    keep[1:] |= text[1:] != text[:-1]
    data, text = data[keep].astype(np.uint64), text[keep]
    buckets, owners = [], []
    code = data
    for n in range(2, max(GRAMS) + 1):
        if len(data) < n:
            break
        code = (code[:-1] << np.uint64(8)) | data[n - 1 :]
        if n in GRAMS:
            within = text[: len(code)] == text[n - 1 :]
            buckets.append(words.mix(code[within] + np.uint64(n << 40)) >> np.uint64(48))
            owners.append(text[: len(code)][within])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # class scores of each bucket
    bias: np.ndarray
    temperature: float
    threshold: float  # answers with a lower probability are rejected

    def logits(self, run: words.Run) -> np.ndarray:
        buckets, owners = _grams(run)
        n = np.maximum(np.bincount(owners, minlength=len(run)), 1)[:, None]
        sums = [np.bincount(owners, weights=self.scores[buckets, k], minlength=len(run)) for k in range(len(self.labels))]
        return np.stack(sums, axis=1) / n + self.bias if sums else np.zeros((len(run), 0))

    def predict(self, run: words.Run) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(run) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(sample: list[tuple], dim: int = 16, epochs: int = 8, rate: float = 0.5, accuracy: float = 0.99) -> Model | None:
    """Train on ``(label, text)`` rows; None without any. ``accuracy`` is what accepted answers shall reach at least."""
    if not sample:
        return None
    labels = sorted({label for label, _ in sample})
    truth = np.array([labels.index(label) for label, _ in sample])
    grams = []
    for run in words.runs(pa.array([text for _, text in sample], pa.string())):
        buckets, owners = _grams(run)
        cuts = np.searchsorted(owners[order := np.argsort(owners, kind="stable")], np.arange(len(run) + 1))
        grams += [np.unique(buckets[order[a:b]], return_counts=True) for a, b in zip(cuts, cuts[1:])]
    random = np.random.default_rng(7)
    table = random.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    held = np.arange(len(sample)) % 5 == 4 if len(sample) >= 50 else np.zeros(len(sample), bool)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(np.flatnonzero(~held)):
            own, count = grams[i]
            if not len(own):
                continue
            share = (count / count.sum()).astype(np.float32)
            mean = share @ table[own]
            error = _softmax((mean @ weights + bias)[None])[0]
            error[truth[i]] -= 1
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= 0.1 * step * error
            # A mean spreads its gradient over hundreds of subwords; scaled so that each moves as if it were alone.
            table[own] -= (step * 30 * share)[:, None] * back
    model = Model(labels, table @ weights, bias, 1.0, 0.0)
    check = np.flatnonzero(held if held.any() else ~held)
    logits = np.array([(n / max(n.sum(), 1)) @ model.scores[b] + bias for b, n in (grams[i] for i in check)])
    likelihood = lambda t: -np.log(_softmax(logits / t)[np.arange(len(check)), truth[check]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=likelihood))
    p = _softmax(logits / model.temperature)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum((p.argmax(axis=1) == truth[check])[order]) / np.arange(1, len(check) + 1)
    good = np.flatnonzero(right >= accuracy)
    model.threshold = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return model


def train(
    rows: DataFrame,
    label_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    per_label: int = 1000,
    total: int = 6000,
    most_bytes: int = 1 << 14,
) -> Model | None:
    """Fit on a sample of ``rows``: ``per_label`` rows per label, ``total`` rows of up to ``most_bytes`` bytes at most."""
    return fit(labelled_sample(rows, label_col, text_col, id_col, per_label, total, most_bytes))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` (its probability, 0 to 1) and ``lang_accepted`` (not below the threshold).

    A text that is null or has no letter gets ``und`` with the score 1, as does every text where there was nothing to
    learn from (score 0). Texts are read whole. Columns of ``docs`` that bear the new names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted", "_lettered")
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: buckets x labels of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            schema = batch.schema
            texts, lettered = batch.column(schema.get_field_index(text_col)), batch.column(batch.num_columns - 1)
            names = np.full(batch.num_rows, UNKNOWN, dtype=object)
            scores = np.zeros(batch.num_rows)
            if own:
                for part in words.runs(texts):
                    best, p = own.predict(part)
                    rows = slice(part.first, part.first + len(part))
                    names[rows], scores[rows] = np.array(own.labels, dtype=object)[best], p
            none = ~lettered.to_numpy(zero_copy_only=False)
            names[none], scores[none] = UNKNOWN, 1.0
            accepted = scores >= (own.threshold if own else 2.0)
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores), pa.array(accepted)]
            fields = [*schema.names[:-1], "lang_pred", "lang_score", "lang_accepted"]
            yield pa.RecordBatch.from_arrays(columns, fields)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("_lettered", lettered).mapInArrow(
        run, f"{kinds}, lang_pred string, lang_score double, lang_accepted boolean"
    )
