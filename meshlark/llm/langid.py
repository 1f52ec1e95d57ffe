"""Language identification.

Character 1- to 3-grams are hashed into 32,768 features with TF-IDF weights; the document
frequencies are counted over all training documents. A sparse multinomial logistic
regression is trained on a bounded sample with follow-the-regularised-leader (per
coordinate learning rates, elastic-net penalty) and calibrated with one temperature.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample

FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
#: Bound of the training sample: rows of each language.
PER_LANGUAGE = 800
UNKNOWN = "und"
_SHIFT = np.uint64(64 - FEATURE_BITS)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed 1- to 3-grams of a text in lower case, blanks at its ends, and how often each occurs."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = c * _A
        two = (one[:-1] ^ (c[1:] * _B)) * _C
        three = (two[:-1] ^ (c[2:] * _A)) * _B
    at, counts = np.unique((np.concatenate((one, two, three)) >> _SHIFT).astype(np.int32), return_counts=True)
    return at, counts


@dataclass
class LanguageModel:
    """Weights of the features (features x languages), bias, idf and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its chance; ``und`` and 0 without letters or without languages."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, counts = gram_counts(text)
        p = softmax(self.logits(at, tfidf(counts, self.idf[at])) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """1 + log of the counts, times idf, at unit length."""
    v = (1 + np.log(counts)) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each feature, and how many texts there are; summed by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, dtype=np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                seen[gram_counts(text or "")[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[seen[at], n])], names=["feature", "docs"])

    rows = texts.mapInArrow(task, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).collect()
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for feature, docs in rows:
        out[feature] = docs
    return out[:-1], int(out[-1])


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> LanguageModel:
    """Follow-the-regularised-leader over (features, values, class) in the order given."""
    k = len(languages)
    z, n = np.zeros((len(idf) + 1, k)), np.zeros((len(idf) + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for at, value, cls in rows:
            at, value = np.r_[at, len(idf)], np.r_[value, 1.0]
            w = weights(at)
            p = softmax(value @ w)
            p[cls] -= 1
            g = value[:, None] * p
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    w = weights(np.arange(len(idf) + 1))
    return LanguageModel(languages, w[:-1], w[-1], idf)


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least smoothed log loss, by golden section on its logarithm.

    With n rows of k classes the right one counts (n + 1) / (n + k) and the others share the
    rest, so that rows without any error do not ask for boundless certainty. Warns if the
    best lies at an end of the search: such logits say nothing about the classes.
    """
    n, k = logits.shape
    if k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), classes] = (n + 1) / (n + k)
    # Scales of the logits differ: the search is about their mean spread.
    spread = max(1e-9, float((logits.max(axis=1) - logits.min(axis=1)).mean()))

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        top = z.max(axis=1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - (z * target).sum(axis=1)).mean())

    low, high, g = np.log(spread) - 8.0, np.log(spread) + 8.0, (5**0.5 - 1) / 2
    a, b = low, high
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    if min(a - low, high - b) < 1e-3:
        warnings.warn("the temperature is at an end of its range", stacklevel=2)
    return float(np.exp((a + b) / 2))


def train_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from the rows of ``docs`` with a language (and ``where``, if given).

    Document frequencies cover all those rows; the weights are fitted on about
    ``per_language`` rows of each language. The temperature is set by logits of models
    fitted without a fifth of the sample on that fifth. Without any such row the model
    knows no language and answers ``und``. Rows of one id are drawn together.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False))))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    sample, _ = labelled_sample(rows, "lang", "id", per_language)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [gram_counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)), b.column(2)], names=["fold", "at", "counts", "lang"])

    drawn = sample.select(F.xxhash64(F.lit(5), "id").alias("fold"), "text", "lang").mapInArrow(features, "fold long, at array<int>, counts array<int>, lang string")
    got = sorted(((r[0], np.array(r[1]), np.array(r[2]), r[3]) for r in drawn.toLocalIterator()), key=lambda r: (r[0], r[3]))
    languages = sorted({r[3] for r in got})
    ready = [(at, tfidf(c, idf[at]), languages.index(lang)) for _, at, c, lang in got]
    if not languages:
        return LanguageModel([], np.zeros((FEATURES, 0)), np.zeros(0), idf)
    model = train_ftrl(ready, languages, idf)
    if len(ready) >= 20:
        logits, classes = [], []
        for k in range(5):
            part = train_ftrl([x for i, x in enumerate(ready) if i % 5 != k], languages, idf)
            logits += [part.logits(at, v) for at, v, _ in ready[k::5]]
            classes += [c for _, _, c in ready[k::5]]
        model.temperature = fit_temperature(np.array(logits), np.array(classes))
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows give
    repeated rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features x languages: of fixed size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
