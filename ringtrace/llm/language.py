"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are the byte n-grams of its lower-cased letter runs, hashed to rows of an
embedding table; their mean goes through a linear layer and a softmax.  Both layers are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows; a part of the
sample is held back to fit a temperature (so that scores are probabilities) and the score below
which a prediction is rejected.  As both layers are linear, a word's n-grams come down to one
row of summed logits, which each worker keeps in a dictionary of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ringtrace.llm.common import slices

BUCKET_BITS, WIDTH, SIZES = 15, 16, (2, 3, 4)
#: Labelled rows that a model is fitted to at most (those of the smallest hash).
SAMPLE_ROWS = 2000
EPOCHS, RATE, SEED = 8, 0.5, 7
#: Small samples are gone through more often, until there are so many steps.
LEAST_STEPS = 12_000
#: The share of rightly labelled held-back rows that rejection may cost, and the highest score rejected.
REJECTED_SHARE, REJECTED_SCORE = 0.002, 0.5
UNKNOWN = "und"

#: What counts as a word character but is no letter: numbers other than digits.
_NUMBERS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
LETTERS = re.compile(rf"[^\W\d_{re.escape(_NUMBERS)}]+")
#: Runs of letters and such numbers: far faster.
_PLAIN = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 400_000


def subwords(word: str) -> list[int]:
    data = b"<" + word.encode("utf-8", "replace") + b">"
    mask = (1 << BUCKET_BITS) - 1
    return [zlib.crc32(data[i : i + n]) & mask for n in SIZES for i in range(len(data) - n + 1)]


def letter_runs(text: str) -> list[str]:
    """Runs of letters of a text, in lower case."""
    runs = _PLAIN.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [x for run in runs for x in ([run] if run.isalpha() else LETTERS.findall(run))]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and their shares."""
    counts: Counter = Counter()
    for word, n in Counter(letter_runs(text)).items():
        for h in subwords(word):
            counts[h] += n
    at = np.fromiter(counts.keys(), np.int32, len(counts))
    share = np.fromiter(counts.values(), np.float64, len(counts))
    return at, share / max(share.sum(), 1)


@dataclass
class Model:
    """Logits of each hashed n-gram (after the temperature), their bias, the labels and the rejection score."""

    labels: list[str]
    logits: np.ndarray
    bias: np.ndarray
    reject_below: float


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """Fit to (n-grams, shares, label) rows; every fifth row only calibrates.

    Fewer than 25 rows are too few to part: all of them fit, and all calibrate.  A row's n-grams take 12 bytes each, 390 kB at most.
    """
    labels = sorted({r[2] for r in rows})
    if not labels:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0), 1.0)
    number = {x: k for k, x in enumerate(labels)}
    held = rows[::5] if len(rows) >= 25 else rows
    fitted = [r for k, r in enumerate(rows) if k % 5] if len(rows) >= 25 else rows
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH))
    weights, bias = rng.normal(0, 1 / WIDTH, (WIDTH, len(labels))), np.zeros(len(labels))
    epochs = max(EPOCHS, LEAST_STEPS // len(fitted))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(fitted)):
            at, share, label = fitted[k]
            mean = share @ table[at]
            error = softmax(mean @ weights + bias)
            error[number[label]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # shares are small: rows move in proportion to them, scaled so that a text of one n-gram moves it once
            table[at] -= rate * np.outer(share / max(share.max(), 1e-12), back) * 0.1
    logits = table @ weights
    raw = np.array([share @ logits[at] + bias for at, share, _ in held])
    truth = np.array([number[r[2]] for r in held])
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(raw)), truth], 1e-12)).mean() for t in heats]
    heat = heats[int(np.argmin(loss))]
    scores = softmax(raw / heat)
    right = scores.argmax(axis=1) == truth
    below = float(np.quantile(scores.max(axis=1)[right], REJECTED_SHARE)) if right.any() else 0.0
    return Model(labels, logits / heat, bias / heat, min(below, REJECTED_SCORE))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``labelled`` (doc_id, text, lang): of its non-null rows, the ``sample_rows`` of the smallest hash.

    Only these rows' hashed n-gram counts come to the driver.  No usable row gives a model without
    labels, which predicts ``und`` throughout.
    """
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = usable.select("doc_id", F.xxhash64(F.lit("language"), "doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_rows).select("doc_id").distinct()
    # the sample's ids are bounded by sample_rows; an id gives one row, however many rows repeat it
    found = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi")
    sample = found.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.text", "row.lang")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                at, share = features(text)
                if len(at):
                    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((doc, lang, at.tobytes(), share.tobytes()), kinds)], ["doc_id", "lang", "at", "share"])

    found = sample.mapInArrow(rows, "doc_id bigint, lang string, at binary, share binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.lang, r.at))
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float64), r["lang"]) for r in found[:sample_rows]])


class _Words(dict):
    """Row numbers of words in a growing table of summed logits and n-gram counts."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.labels) + 1))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def table(self) -> np.ndarray:
        if self.new:
            hashed = [subwords(w) for w in self.new]
            sizes = np.fromiter(map(len, hashed), np.int64, len(hashed))
            flat = np.fromiter((h for x in hashed for h in x), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.model.logits[flat], np.cumsum(sizes) - sizes, axis=0)
            while len(self.rows) < len(self):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[len(self) - len(self.new) : len(self)] = np.hstack([sums, sizes[:, None]])
            self.new = []
        return self.rows


def predicted(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` (with a text column) with lang_pred, score and rejected (names after ``prefix``).

    A null text, or one without a letter, is ``und`` with score 0 and rejected, and so is every
    text if the model has no labels.  Whole texts of any length are read.  Equal texts get equal results;
    of labels with equal scores the first in the alphabet is taken.  An empty table gives an empty one.
    ``docs`` must not have the new names; ``prefix`` keeps them apart.
    """
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "rejected")]
    at_text = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, k = _Words(model), len(model.labels)
        for batch in slices(batches):
            found = []
            for text in batch.column(at_text).to_pylist():
                runs = letter_runs(text) if text else []
                found.append(np.fromiter(map(words.__getitem__, runs), np.int64, len(runs)))
                if len(words.new) > 20_000:
                    words.table()
            table = words.table()
            out: list[list] = [[], [], []]
            for own in found:
                if not len(own) or not k:
                    best, score = UNKNOWN, 0.0
                else:
                    total = table[own].sum(axis=0)
                    p = softmax(total[:k] / total[k] + model.bias)
                    best, score = model.labels[int(p.argmax())], float(p.max())
                out[0].append(best)
                out[1].append(score)
                out[2].append(best == UNKNOWN or score < model.reject_below)
            if len(words) > KEPT_WORDS:
                words = _Words(model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())], [*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(rows, schema)


def held_out(doc_id: Column) -> Column:
    """One row in five, by a checksum of its id: never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
