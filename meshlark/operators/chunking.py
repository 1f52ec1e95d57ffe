"""Texts in chunks, and the ingestion of chunks with vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces

WORDS_PER_TOKEN = 1 / 0.75
_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s|$)|$(?![\s\S]))", re.S)
_PARAGRAPH = re.compile(r"(?:\r\n\r\n|\n\n)")

#: (content, start, end), offsets in code points, ends exclusive.
Span = tuple[str, int, int]


def words_of(tokens: int) -> int:
    """A budget of tokens in words: 512 are 682, 64 are 85."""
    return int(tokens * WORDS_PER_TOKEN + 1e-9)


def _places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def _windows(text: str, at: list[tuple[int, int]], size: int, step: int, base: int = 0) -> list[Span]:
    """Windows of ``size`` words, whose places are ``at``, every ``step`` words."""
    out = []
    for i in range(0, len(at), step):
        a, b = at[i][0], at[min(i + size, len(at)) - 1][1]
        out.append((text[a:b], base + a, base + b))
    return out


def fixed_chunks(text: str, tokens: int = 512, overlap: int = 64) -> list[Span]:
    """Windows of words; each begins ``size - overlap`` words after the last. A short text is one chunk."""
    if not text:
        return []
    size, at = words_of(tokens), _places(text)
    return [(text, 0, len(text))] if len(at) <= size else _windows(text, at, size, max(1, size - words_of(overlap)))


def sentences(text: str) -> list[Span]:
    """Up to a full stop, exclamation or question mark before white space or the end; the rest is one more."""
    return [(m[0], *m.span()) for m in _SENTENCE.finditer(text)]


def sentence_chunks(text: str, tokens: int = 512, overlap: int = 64) -> list[Span]:
    """Whole sentences as long as they fit. A longer sentence is cut into word windows.

    The next chunk goes back over trailing sentences until they hold the overlap, but
    always past the first sentence of the chunk before.
    """
    parts = sentences(text or "")
    if not parts:
        return []
    size, back = words_of(tokens), words_of(overlap)
    counts = [len(_WORD.findall(s)) for s, _, _ in parts]
    if sum(counts) <= size:
        return [(text, 0, len(text))]
    out, i = [], 0
    while i < len(parts):
        first, held = i, counts[i]
        i += 1
        while i < len(parts) and held + counts[i] <= size:
            held += counts[i]
            i += 1
        if i == first + 1 and held > size:
            out += _windows(parts[first][0], _places(parts[first][0]), size, size, parts[first][1])
        else:
            out.append((text[parts[first][1] : parts[i - 1][2]], parts[first][1], parts[i - 1][2]))
        if back and i < len(parts):
            j, shared = i - 1, counts[i - 1]
            while shared < back and j > first:
                j -= 1
                shared += counts[j]
            if j > first:
                i = j
    return out


def paragraphs(text: str) -> list[Span]:
    """Cut at blank lines; parts without words are left out."""
    out, start = [], 0
    for m in [*_PARAGRAPH.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[start:end].strip():
            out.append((text[start:end], start, end))
        start = m.end() if m else end
    return out


def paragraph_chunks(text: str, tokens: int = 512, overlap: int = 64) -> list[Span]:
    """Whole paragraphs as long as they fit; a longer one is cut by sentences. No overlap between paragraphs."""
    parts = paragraphs(text or "")
    if not parts:
        return []
    size = words_of(tokens)
    counts = [len(_WORD.findall(s)) for s, _, _ in parts]
    if len(_WORD.findall(text)) <= size:
        return [(text, 0, len(text))]
    out, i = [], 0
    while i < len(parts):
        first, held = i, counts[i]
        i += 1
        while i < len(parts) and held + counts[i] <= size:
            held += counts[i]
            i += 1
        if i == first + 1 and held > size:
            out += [(s, parts[first][1] + a, parts[first][1] + b) for s, a, b in sentence_chunks(parts[first][0], tokens, overlap)]
        else:
            out.append((text[parts[first][1] : parts[i - 1][2]], parts[first][1], parts[i - 1][2]))
    return out


def whole(text: str, tokens: int = 0, overlap: int = 0) -> list[Span]:
    return [(text, 0, len(text))] if text else []


CHUNKERS: dict[str, Callable] = {"fixed": fixed_chunks, "sentence": sentence_chunks, "paragraph": paragraph_chunks, "whole": whole}


def chunk(docs: DataFrame, id_col: str, text_col: str, method: str = "fixed", tokens: int = 512, overlap: int = 64) -> DataFrame:
    """A row for each chunk: ``id_col``, chunk, content, start, end."""
    cut = CHUNKERS[method]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            rows = [(i, n, *s) for i, t in enumerate(b.column(1).to_pylist()) for n, s in enumerate(cut(t or "", tokens, overlap))]
            at, n, content, start, end = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(content, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["id", "chunk", "content", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, chunk int, content string, start int, end int").withColumnRenamed("id", id_col)


class _Codes(dict):
    """The first nine bits of the MD5 digest of each word asked for.

    Words are UTF-8. At most ``most`` words of up to ``longest`` bytes are remembered, so
    that long words, of which texts can hold any number, take no memory.
    """

    def __init__(self, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> int:
        h = hashlib.md5(word, usedforsecurity=False).digest()
        code = h[0] << 1 | h[1] >> 7
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = code
        return code


#: One for all batches of a worker.
_CODES = _Codes()


def hashing_embedder(dimensions: int = 64, unit: bool = True) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: signed hashed word counts, the same everywhere; at unit length if ``unit``.

    Words are runs without ASCII blanks, in lower case. Of a word's MD5 digest the first
    byte says the dimension, and the highest bit of the second one the sign.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out, code = np.zeros((len(texts), dimensions), dtype=np.float32), _CODES.__getitem__
        for i, t in enumerate(texts):
            words = t.lower().encode("utf-8", "replace").split()  # bytes are cut at ASCII blanks only
            n = np.bincount(np.fromiter(map(code, words), np.int64, len(words)), minlength=512)
            np.add.at(out[i], np.arange(256) % dimensions, n[1::2] - n[::2])
            if unit:
                out[i] /= max(1e-12, float(np.linalg.norm(out[i])))
        return out

    return embed


def embed(rows: DataFrame, text_col: str, embedder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """Adds ``embedding``; the embedder gets lists of at most ``batch`` texts and must return as many vectors.

    It may also return pairs (index, vector) in any order; each goes to the text of its
    index, and each index must come once.
    """

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(texts), batch):
            part = [t or "" for t in texts.slice(i, batch).to_pylist()]
            got = embedder(part)
            if len(got) and isinstance(got[0], tuple):
                placed = dict(got)
                if len(placed) != len(got) or placed.keys() - set(range(len(part))):
                    raise ValueError("an index comes twice or belongs to no text")
                got = [placed[k] for k in sorted(placed)]
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
            out += [np.asarray(v, dtype=np.float32) for v in got]
        ends = np.cumsum([0, *map(len, out)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.float32()))

    return rows.withColumn("embedding", vectors(text_col))


def ingest(docs: DataFrame, id_col: str, text_col: str, path: str, method: str = "fixed", tokens: int = 512, overlap: int = 64, embedder: Callable | None = None) -> DataFrame:
    """Chunks with vectors, appended to a Parquet table; returns what that table holds now."""
    rows = embed(chunk(docs, id_col, text_col, method, tokens, overlap), "content", embedder or hashing_embedder())
    rows.write.mode("append").parquet(path)
    return docs.sparkSession.read.parquet(path)
