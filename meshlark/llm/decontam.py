"""Benchmark decontamination: which words of a document repeat a test item.

Texts are normalised to words. A window of ten item words always holds one whole run of
five words that begins at a multiple of five, so an Aho-Corasick automaton over those runs,
as codes of words, finds every window, with about one state for each word of the items.
A find is carried on to both sides as long as document and item agree; from ten words on
all of them are hit. Each text is scanned once, and hits are mapped back to code points of
the original text. The items are sent to the tasks, so their size is checked: beyond
``BLOCK_WORDS`` words a further automaton follows in the same scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, kept, utf8

#: Words of items in one automaton: about 100 bytes of memory each.
BLOCK_WORDS = 2_000_000

#: A-Z in lower case; everything but letters, digits and non-ASCII bytes becomes a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_HIT = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_RUN = pa.struct([("first", pa.int32()), ("end", pa.int32())])


def normal_words(text: bytes | None) -> list[bytes]:
    """The words of a text: runs of ASCII letters and digits and of non-ASCII characters."""
    return (text or b"").translate(_TABLE).split()


class Matcher:
    """The automaton of some items, and their words as codes."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.size, self.codes, self.names, self.words = size, {}, [], []
        at: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        step = (size + 1) // 2
        for name, text in items:
            words = [self.codes.setdefault(w, len(self.codes) + 1) for w in normal_words(text)]
            n = len(self.words)
            self.names.append(name)
            self.words.append(words)
            if 0 < len(words) <= size:  # the whole item is one window
                at.setdefault(tuple(words), []).append((n, 0))
            elif words:
                for m in range(0, len(words) - step + 1, step):
                    at.setdefault(tuple(words[m : m + step]), []).append((n, m))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, places in at.items():
            self.automaton.add_word(run, (len(run), places))
        if at:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Runs (first, end) of words that lie in windows, and the items (by number) that they are of."""
        if not words or self.automaton.kind != ahocorasick.AHOCORASICK:
            return [], []
        doc = tuple(map(self.codes.get, words, repeat(0)))
        runs, items, done = [], set(), {}
        for last, (n, places) in self.automaton.iter(doc):
            start = last - n + 1
            for item, m in places:
                if done.get((item, start - m), 0) > start:  # already reached from a find before it
                    continue
                want = self.words[item]
                a, b = start, last + 1
                while a > 0 and a - start + m > 0 and doc[a - 1] == want[a - 1 - start + m]:
                    a -= 1
                while b < len(doc) and b - start + m < len(want) and doc[b] == want[b - start + m]:
                    b += 1
                done[item, start - m] = b
                if b - a >= min(self.size, len(want)):
                    runs.append((a, b))
                    items.add(item)
        return runs, sorted(items)


def _matcher(key: str, items: Broadcast, size: int) -> Matcher:
    """The matcher of a block of items, built once in each worker process."""
    return kept(key, lambda: Matcher(items.value, size))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _points(text: bytes, runs: list[list[int]]) -> list[dict]:
    """Runs of words with their places in the text, in code points."""
    raw = np.frombuffer(text, dtype=np.uint8)
    is_word = np.r_[False, np.frombuffer(text.translate(_TABLE), dtype=np.uint8) != 32, False]
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return [{"first_word": a, "end_word": b, "start": int(points[edges[2 * a]]), "end": int(points[edges[2 * b - 1]])} for a, b in runs]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> list[tuple[str, Broadcast]]:
    """The items, sent to the tasks in blocks of bounded size."""
    blocks, words = [[]], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        text = (row[1] or "").encode()
        n = len(normal_words(text))
        if blocks[-1] and words + n > block_words:
            blocks.append([])
            words = 0
        blocks[-1].append((row[0], text))
        words += n
    return [(uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(b)) for b in blocks]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of ``docs`` the words that lie in a window of a test item.

    Words are runs of ``[0-9A-Za-z]`` and non-ASCII characters, A-Z in lower case. A window
    is ``window`` consecutive words of an item; an item with fewer words is one window, one
    without words has none.

    Returns ``id_col``, ``n_words``, ``hits`` (merged runs: words first_word to end_word,
    code points start to end of the text, ends exclusive) and ``items`` (ids as sorted
    strings). One row a document, repeated rows too; null and empty texts have no words.
    Items with a null id count as hits but aren't named; items with one id are one. Other
    columns are not read.
    """
    blocks = _blocks(items, item_id_col, item_text_col, block_words)

    def scan(key: str, sent: Broadcast, last: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, sent, window)
            for b in batches:
                n, runs, named = [], [], []
                texts = utf8(b.column(1))
                for text, before, names in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = normal_words(text)
                    found, which = matcher.find(words)
                    n.append(len(words))
                    runs.append(_merged([*found, *((r["first"], r["end"]) for r in before)]))
                    named.append(sorted({*names, *(matcher.names[i] for i in which)} - {None}))
                if last:
                    hits = [_points(t, r) if r else [] for t, r in zip(texts, runs, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.list_(_HIT)), pa.array(named, pa.list_(pa.string()))], names=["id", "n_words", "hits", "items"])
                else:
                    merged = pa.array([[{"first": x, "end": y} for x, y in r] for r in runs], pa.list_(_RUN))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), merged, pa.array(named, pa.list_(pa.string()))], names=["id", "text", "runs", "items"])

        return task

    kind = docs.schema[id_col].dataType.simpleString()
    none = "array<struct<first:int,end:int>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast(none).alias("runs"), F.array().cast("array<string>").alias("items"))
    for key, sent in blocks[:-1]:
        rows = rows.mapInArrow(scan(key, sent, False), f"id {kind}, text string, runs {none}, items array<string>")
    rows = rows.mapInArrow(scan(*blocks[-1], True), f"id {kind}, n_words long, hits array<struct<first_word:int,end_word:int,start:int,end:int>>, items array<string>")
    return rows.withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without any hit, each judged alone, all columns kept; null texts stay."""
    for key, sent in _blocks(items, item_id_col, item_text_col, block_words):

        def make_keep(key=key, sent=sent):
            matcher = _matcher(key, sent, window)
            return lambda texts: [not matcher.find(normal_words(t))[0] for t in texts]

        docs = filter_rows(docs, text_col, make_keep)
    return docs
