"""Toxicity scores: boosted trees over dense features of a text, calibrated isotonically.

The features are densities of a fixed and of a learned lexicon (words, and the beginnings
of words for inflected forms), how near hits are to words of the second person, and rates
of capitals, punctuation and obfuscation. No row is described by a lexicon, or judged by
trees, that have seen its label: both are fitted once for each fold of the sample without
that fold, and the calibration looks only at such scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost, isotonic
from .common import WORD_CACHE, WordCodes, discard, filter_rows, kept, mix64, shingle_set, written
from .sampling import labelled_sample

#: Bound of the training sample: rows of each label. Folds that the sample is cut into.
PER_LABEL, FOLDS = 8_000, 5
#: Letters of word beginnings that the lexicon learns besides whole words.
PREFIXES = (4, 5)

# A small lexicon of insults, and words of the second person.
INSULTS = [
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "imbecile", "jerk", "garbage", "vermin", "filth",
]
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "ti", "tus", "su", "vosotros",
]
_LEET = bytes.maketrans(b"013457@$", b"oieastas")

#: Words are runs of letters, digits and non-ASCII characters; @, $ and * inside words stay.
_TABLE = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c in b"@$*" else 32 for c in range(256))
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_SYMBOL = np.array([48 <= c <= 57 or c in b"@$*" for c in range(256)])
FEATURES = ("words", "insults", "insult_density", "hits", "hit_density", "hit_weight", "most_weight", "starts", "start_density", "start_weight", "leet_hits", "second_density", "near_second", "capitals", "capital_pairs", "marks", "double_marks", "obfuscation")


def units(words: list[bytes]) -> set[bytes]:
    """The distinct words of a text, and with a leading ``^`` the beginnings of the longer ones."""
    found = set(words)
    return found | {b"^" + w[:n] for w in found for n in PREFIXES if len(w) > n}


def split_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


class _Words(dict):
    """Word -> index into ``kinds``: (insult, weight, start weight, leet hit, second person)."""

    def __init__(self, weights: dict[bytes, float], most: int = WORD_CACHE):
        super().__init__()
        kept(None)
        self.most = most
        self.weights, self.kinds, self.index = weights, [(0.0,) * 5], {(0.0,) * 5: 0}
        self.insults, self.second = {w.encode() for w in INSULTS}, {w.encode() for w in SECOND_PERSON}

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        start = max((self.weights.get(b"^" + w[:n], 0.0) for n in PREFIXES if len(w) > n), default=0.0)
        plain = w.translate(_LEET)
        leet = plain != w and (plain in self.insults or plain in self.weights)
        kind = (float(w in self.insults), self.weights.get(w, 0.0), start, float(leet), float(w in self.second))
        if kind not in self.index:
            self.index[kind] = len(self.kinds)
            self.kinds.append(kind)
        self[w] = self.index[kind]
        return self[w]


def features(text: str | None, words: _Words) -> list[float]:
    """The dense features of a text, in the order of ``FEATURES``."""
    text = text or ""
    found = split_words(text)
    n = len(found)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    letters, capital = _LETTER[raw], (raw >= 65) & (raw <= 90)
    mark = (raw == 33) | (raw == 63)
    odd = int((letters[:-2] & _SYMBOL[raw[1:-1]] & letters[2:]).sum()) if len(raw) > 2 else 0
    some = max(1, int(letters.sum()))
    at = np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=n)
    busy = np.flatnonzero(at)
    kinds = np.array([words.kinds[i] for i in at[busy].tolist()]).reshape(-1, 5)
    insult, weight, start, leet, second = kinds.T
    hit = busy[(insult > 0) | (weight > 0) | (start > 0)]
    you = busy[second > 0]
    near = 0.0
    if len(hit) and len(you):
        i = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(hit - you[np.minimum(i, len(you) - 1)]), np.abs(hit - you[np.maximum(i - 1, 0)]))
        near = float((gap <= 5).mean())
    per = 1 / max(1, n)
    hits, starts = int((weight > 0).sum()), int((start > 0).sum())
    return [
        float(np.log1p(n)), insult.sum(), insult.sum() * per, hits, hits * per, weight.sum(), weight.max(initial=0.0), starts, starts * per, start.sum(), leet.sum(), len(you) * per, near,
        int(capital.sum()) / some, int((capital[1:] & capital[:-1]).sum()) / some, int(mark.sum()) / max(1, len(raw)), int((mark[1:] & mark[:-1]).sum()) / max(1, len(raw)), odd / some,
    ]


@dataclass
class ToxicityModel:
    """A learned lexicon, trees over the features, and the knots of the calibration."""

    weights: dict[bytes, float] = field(default_factory=dict)
    trees: Trees | None = None
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.trees is None or not rows:
            return np.zeros(len(rows))
        return np.interp(self.trees.raw(np.array(rows)), self.at, self.chance)


def _lexicons(sample: DataFrame) -> list[dict[bytes, float]]:
    """Log odds of units that occur mostly in texts with label 1, counted by Spark.

    One lexicon for each fold, from the rows outside it, and the last one from all rows.
    Entries occur in at least four texts with label 1, so the bounded sample bounds them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = [u for u in units(split_words(text or "")) if len(u) > 2]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([label] * len(found), pa.int32()), pa.array([fold] * len(found), pa.int32())], names=["unit", "label", "fold"])

    totals = {(r[0], r[1]): r[2] for r in sample.groupBy("label", "fold").count().collect()}
    one = F.col("label").cast("long")
    outside = [*(F.col("fold") != k for k in range(FOLDS)), F.lit(True)]
    sums = [F.sum(F.when(out, x).otherwise(0)).alias(f"{name}{k}") for k, out in enumerate(outside) for name, x in (("ones", one), ("zeros", 1 - one))]
    odds = []
    for k in range(FOLDS + 1):
        ones, zeros = (sum(n for (label, fold), n in totals.items() if label == v and fold != k) for v in (1, 0))
        if not ones or not zeros:
            odds.append(F.lit(None).cast("double").alias(f"odds{k}"))
            continue
        value = F.log((F.col(f"ones{k}") + 0.5) / (ones + 1)) - F.log((F.col(f"zeros{k}") + 0.5) / (zeros + 1))
        odds.append(F.when((F.col(f"ones{k}") >= max(4, ones // 300)) & (value > 2), value).alias(f"odds{k}"))
    counted = sample.select("text", "label", "fold").mapInArrow(task, "unit binary, label int, fold int").groupBy("unit").agg(*sums)
    out: list[dict[bytes, float]] = [{} for _ in range(FOLDS + 1)]
    for r in counted.select("unit", *odds).filter(F.coalesce(*(f"odds{k}" for k in range(FOLDS + 1))).isNotNull()).toLocalIterator():
        for k in range(FOLDS + 1):
            if r[k + 1] is not None:
                out[k][bytes(r[0])] = float(r[k + 1])
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, per_label: int = PER_LABEL) -> ToxicityModel:
    """A model from the labelled rows (those with ``where``, if given).

    ``where`` is a condition on the labels, whose id is called ``id`` there.
    About ``per_label`` rows of each label are drawn; of texts with equal sets of shingles
    one stays. Near copies mostly fall into one of ``FOLDS`` folds. Features come from
    lexicons fitted outside a row's fold; the calibration compares labels with scores of
    trees fitted outside it, weighted to the numbers of the labels. The final lexicon and
    trees use the whole sample. Without rows of both labels all scores are 0. Null labels,
    texts and ids teach nothing but their own row; repeated rows count once.
    """
    wanted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    if where is not None:
        wanted = wanted.filter(F.coalesce(where, F.lit(False)))
    chosen, counts = labelled_sample(wanted, "label", "id", per_label)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most 4 * per_label ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            found = [shingle_set(t, 5, codes) for t in b.column(0).cast(pa.binary()).to_pylist()]
            with np.errstate(over="ignore"):
                fold = [int(x[0] % np.uint64(FOLDS)) if len(x) else 0 for x in found]
                first, second = ([int(f(x).sum(dtype=np.uint64).astype(np.int64)) for x in found] for f in (lambda x: x, mix64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fold, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["text", "label", "fold", "first", "second"])

    drawn = texts.select("text", "label").mapInArrow(sets, "text string, label int, fold int, first long, second long")
    sample = written(drawn.groupBy("label", "fold", "first", "second").agg(F.min("text").alias("text")))
    lexicons = _lexicons(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [_Words(x, WORD_CACHE // FOLDS) for x in lexicons[:FOLDS]]
        for b in batches:
            got = [features(t, words[f]) for t, f in zip(b.column(2).to_pylist(), b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.float64()))], names=["fold", "label", "x"])

    got = sorted((r[0], r[1], tuple(r[2])) for r in sample.select("fold", "label", "text").mapInArrow(rows, "fold int, label int, x array<double>").toLocalIterator())
    discard(sample)
    fold, y, x = np.array([r[0] for r in got]), np.array([r[1] for r in got], dtype=float), np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    if len(set(y)) < 2:
        return ToxicityModel()
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            raw[fold == k] = boost(x[fold != k], y[fold != k]).raw(x[fold == k]) if (fold != k).any() else 0.0
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return ToxicityModel(lexicons[-1], boost(x, y), *isotonic(raw, y, weight))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row, from its whole text alone.

    Null and empty texts are scored like texts without words. Repeated rows give repeated
    rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(sent.value.weights)
        for b in batches:
            score = sent.value.score([features(t, words) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score, 0.0, 1.0))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns kept. No shuffle. Null texts are scored as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make_keep():
        words = _Words(sent.value.weights)
        return lambda texts: sent.value.score([features((t or b"").decode(), words) for t in texts]) < limit

    return filter_rows(docs, text_col, make_keep)
