"""Document fingerprints by one-permutation MinHash.

Shingle hashes are dealt into bins once; each bin keeps its least hash. An empty bin takes
the value of the first full bin in an order of bins of its own (optimal densification:
every empty bin draws independently and evenly from the full ones). Of each bin the low
bits are stored, and the likeness of two fingerprints is corrected for bits that agree by
chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, RANGE_BYTES, WordCodes, byte_ranges, mix64, shingle_set

#: Bins and stored bits of a bin: the standard error at likeness 1/3 is about 0.023.
BINS, BITS, SHINGLE = 512, 4, 5
_NONE = -(2**63)


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """For each bin an order of all bins, from a hash."""
    with np.errstate(over="ignore"):
        keys = mix64(np.arange(bins * bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    return np.argsort(keys.reshape(bins, bins), axis=1).astype(np.int32)


def bin_minima(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The densified least hash of each bin. ``hashes``: sorted, distinct, not empty."""
    of = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    out, full = np.zeros(bins, dtype=np.uint64), np.zeros(bins, dtype=bool)
    at = of[first].astype(np.int64)
    out[at], full[at] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        orders = _orders(bins)
        for width in (8, bins):
            seen = full[orders[empty, :width]]
            which = seen.argmax(axis=1)
            got = seen[np.arange(len(empty)), which]
            out[empty[got]] = out[orders[empty[got], which[got]]]
            empty = empty[~got]
            if not len(empty):
                break
    return out


def fingerprint(text: bytes | None, codes: WordCodes, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> bytes:
    """The packed low bits of all bins; empty for a text without words."""
    hashes = shingle_set(text, shingle, codes)
    if not len(hashes):
        return b""
    low = (bin_minima(hashes, bins) & np.uint64(2**bits - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, -bits:]).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """The estimated Jaccard similarity of the shingle sets, 0 to 1. Two empty ones are alike."""
    if not a or not b:
        return float(a == b)
    same = (np.unpackbits(np.frombuffer(a, np.uint8)).reshape(-1, bits) == np.unpackbits(np.frombuffer(b, np.uint8)).reshape(-1, bits)).all(axis=1)
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (same.mean() - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (binary) of every row.

    Shingles are five words (A-Z in lower case, split at ASCII blanks); a text with fewer
    words is one shingle. Equal texts have equal fingerprints; null and empty texts have
    the empty one. Repeated rows give repeated rows. Other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            got = [fingerprint(t, codes) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, fingerprint binary").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows dealt into ranges of falling ids, each range followed by the row after it.

    Columns: part, guest (1 for the row that belongs to the next range), id, text; sorted
    within partitions. The last range is followed by the very first row. Ranges hold about
    ``range_bytes`` of text, more where there would be over ``PARTS`` of them; their first
    keys are sent to the tasks, 16 bytes each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))).alias("key"), F.xxhash64(text).alias("fp"), F.octet_length(text).cast("long").alias("size"), F.col(id_col).alias("id"), text.alias("text"))
    ranges = byte_ranges(rows.select("key", "fp", "size"), range_bytes).at_most(PARTS)
    sent, width = docs.sparkSession.sparkContext.broadcast(ranges), len(ranges)

    @F.arrow_udf("long")
    def place(key: pa.Array, fp: pa.Array) -> pa.Array:
        first, second = key.to_numpy(), fp.to_numpy()
        return pa.array(sent.value.of(first, second) * 2 + sent.value.heads(first, second))

    home = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    placed = rows.drop("size").withColumn("at", place("key", "fp"))
    part = F.floor(F.col("at") / 2)
    homes = F.when(F.col("at") % 2 == 1, F.array(home(part, 0), home(F.pmod(part - 1, F.lit(width)), 1))).otherwise(F.array(home(part, 0)))
    dealt = placed.select(F.explode(homes).alias("home"), "key", "fp", "id", "text").select("home.part", "home.guest", "key", "fp", "id", "text")
    return dealt.repartition(width, "part").sortWithinPartitions("part", "guest", "key", "fp").drop("key", "fp")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness to each other.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or
    all) of the next row's, in falling order of ids, the first row following the last.
    Null ids come last, equal ids in order of a hash of their texts. Null texts are empty.
    Returns ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint`` (base64), ``near_edited``, ``near_next``: a row for each row.
    Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, last = WordCodes(), None

        def row(doc, text: str, mark: bytes, after: str, after_mark: bytes) -> tuple:
            half = len(text) // 2
            edited = (text[: len(text) - half] + after[:half]).encode()
            other = fingerprint(edited, codes)
            return (doc, len(text), hashlib.sha256(edited).hexdigest(), base64.b64encode(mark).decode(), base64.b64encode(other).decode(), likeness(mark, other), likeness(mark, after_mark))

        for b in batches:
            out = []
            for part, guest, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if guest and (last is None or last[0] != part):
                    continue  # a repeated guest: this range is done
                mark = fingerprint(text.encode(), codes)
                if last is not None:
                    out.append(row(*last[1:], text, mark))
                last = None if guest else (part, doc, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), [b.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names=names)

    found = with_next(docs, id_col, text_col, range_bytes).mapInArrow(task, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", id_col)
