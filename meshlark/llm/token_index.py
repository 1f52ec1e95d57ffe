"""Token ids in binary shards with a minimal perfect hash index.

Texts are encoded where they are read; the id payloads are dealt into ranges of ascending
keys, and each range is streamed into a shard file, with the numbers of ids of its
documents behind them. A key's documents follow each other, so its place is one entry for
each shard that holds any, however many they are. A second, small job deals these places by
key hash and writes for each part a minimal perfect hash from keys to places, with stored
fingerprints that tell foreign keys apart. Files go to a
folder that all executors share and carry the task attempt in their names; only files
named in committed results count.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, RANGE_BYTES, byte_ranges, discard, kept, mix64, shared_dir, written

MAGIC = b"TOKIDS01"
#: Keys in one part of the index: about 24 bytes each in memory.
INDEX_KEYS = 1_000_000
#: Ways in which rows of one id and text may be dealt apart.
_OWN = 4096
#: Pieces that one worker keeps at most (about 60 MB).
CACHE = 250_000

# The splitting pattern of byte-level BPE, written for texts of ASCII (but for
# the separators 1C to 1F) and of Latin letters, and the letters that stand for bytes.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"
_SPLIT = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+").findall
_OTHER = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LATIN}]")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Pieces(dict):
    """Piece of a text -> its ids as raw bytes. When full, what was not asked for since the last time goes."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE // 2:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encoder.piece_ids(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Texts to raw id bytes with the tokenizers library, as its ``encode`` gives them.

    Byte-level BPE never merges across the pieces of its splitting pattern. For such a
    tokenizer, texts of ASCII and Latin letters are split here, the library's model encodes
    each distinct piece once, and a text is the chain of its pieces' ids. All other texts,
    those that hold a special token's string, and all texts of other tokenizers are encoded
    whole by the library.
    """

    def __init__(self, path: str, end_id: int | None = 0):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        added = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or [])
        self.whole = re.compile(f"{_OTHER.pattern}|{added}" if added else _OTHER.pattern).search
        self.pieces, self.tokenize = _Pieces(self), self.tokenizer.model.tokenize
        self.raw = "H" if self.dtype.itemsize == 2 else "I"

    def piece_ids(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            plain = piece.replace(" ", _BYTE_LETTERS[32])
        else:
            plain = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array(self.raw, [t.id for t in self.tokenize(plain)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        rest = [i for i, t in enumerate(texts) if not self.by_piece or self.whole(t)]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, self.dtype).tobytes() + self.end
        look = self.pieces.__getitem__
        return [b"".join(map(look, _SPLIT(t))) + self.end if x is None else x for t, x in zip(texts, out, strict=True)]


def _encoder(path: str, end_id: int | None) -> Encoder:
    return kept((path, end_id), lambda: Encoder(path, end_id))


#: What stands for a null key: it sorts first. No document may have this id.
_NONE = -(2**63)


def key_hash(key: int | None) -> int:
    """The hash of a key as Spark's xxhash64 has it, unsigned."""
    raw = (_NONE if key is None else int(key)).to_bytes(8, "little", signed=True)
    return xxhash.xxh64_intdigest(raw, seed=42)


class PerfectHash:
    """Keys (distinct 64-bit hashes) to 0 .. n-1: levels of bit arrays, two bits a key left on each.

    A key's place is the number of set bits before its own; counts at every 64 bits make
    that a look at one word.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        self.starts = np.r_[0, np.cumsum(sizes)][:-1]
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @staticmethod
    def spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words, sizes, level = [], [], 0
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            at = cls.spot(keys, level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys, level = keys[~alone], level + 1
        return cls(np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(sizes, dtype=np.int64))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; keys that were not built in get any place or -1."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist(), strict=True)):
            at = self.spot(keys[open_], level, size) + start
            word, bit = self.words[at // 64], (at % 64).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.before[at[hit] // 64] + below
            open_ = open_[~hit]
        return out


@dataclass
class TokenStore:
    """The manifest of a written store: shard files, their first positions and their ids, and index files."""

    dtype: str
    shards: list[tuple[str, int, int]]
    index: list[str]

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of a key's documents: one index part, one probe, one read each."""
        h = key_hash(key)
        part = (h - (h >> 63 << 64)) % len(self.index)
        found = _Index(self.index[part]).find(np.array([h], dtype=np.uint64))
        out = []
        for _, s, offset, doc, docs in found:
            shard = _Shard(self.shards[s][0], self.shards[s][2], np.dtype(self.dtype))
            out += [ids for _, ids in shard.documents(offset, doc, docs)]
        return out


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs, at


class _Shard:
    """A shard file of ``total`` ids, read from front to back."""

    def __init__(self, path: str, total: int, dtype: np.dtype):
        fs, at = _open(path)
        self.file, self.total, self.dtype = fs.open_input_file(at), total, dtype
        self.first, self.counts = 0, np.zeros(0, np.uint32)

    def _count(self, doc: int) -> int:
        if not self.first <= doc < self.first + len(self.counts):
            self.first, self.counts = doc, np.frombuffer(self.file.read_at(4 * 65_536, len(MAGIC) + self.total * self.dtype.itemsize + 4 * doc), np.uint32)
        return int(self.counts[doc - self.first])

    def documents(self, offset: int, doc: int, docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """Offset and ids of ``docs`` documents, from number ``doc`` at ``offset`` on."""
        for at in range(doc, doc + docs):
            count = self._count(at)
            yield offset, np.frombuffer(self.file.read_at(count * self.dtype.itemsize, len(MAGIC) + offset * self.dtype.itemsize), self.dtype)
            offset += count


class _Index:
    """One part of the index, read into memory."""

    def __init__(self, path: str):
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            a = np.load(io.BytesIO(f.read()))
        self.hash, self.a = PerfectHash(a["words"], a["sizes"]), {k: a[k] for k in a.files}

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the key, shard, offset, first document, documents) for each place of each known key."""
        if not len(self.a["marks"]):
            return
        at = self.hash.places(keys)
        mark = (mix64(keys) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for i in np.flatnonzero((at >= 0) & (self.a["marks"][at] == mark)).tolist():
            first = int(self.a["first"][at[i]])
            for j in range(first, first + int(self.a["many"][at[i]])):
                yield i, *(int(self.a[c][j]) for c in ("shard", "offset", "doc", "docs"))


def _index_bytes(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, doc: np.ndarray, docs: np.ndarray) -> bytes:
    order = np.lexsort((offset, shard, keys))
    keys, shard, offset, doc, docs = keys[order], shard[order], offset[order], doc[order], docs[order]
    distinct, first, many = np.unique(keys, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    at = mph.places(distinct)
    by = {"first": np.zeros(len(at), np.uint32), "many": np.zeros(len(at), np.uint32), "marks": np.zeros(len(at), np.uint32)}
    by["first"][at], by["many"][at], by["marks"][at] = first, many, (mix64(distinct) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = io.BytesIO()
    np.savez(out, words=mph.words, sizes=mph.sizes, shard=shard.astype(np.uint32), offset=offset.astype(np.uint64), doc=doc.astype(np.uint32), docs=docs.astype(np.uint32), **by)
    return out.getvalue()


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, with_ids: bool = True) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (raw little-endian bytes, 2 or 4 an id) of every row, end mark included.

    Without ``with_ids`` the column ``ids`` is left out. Null texts are empty. Repeated rows
    give repeated rows. Other columns are not read.
    """
    width = id_bytes(tokenizer_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer_path, end_id)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                ids = coder.encode([t or "" for t in s.column(1).to_pylist()])
                columns = [s.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns[: 2 + with_ids], names=["id", "n_tokens", "ids"][: 2 + with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, n_tokens long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("id", id_col)


def id_bytes(tokenizer_path: str) -> int:
    """Bytes of one id in the files of a tokenizer: 2 or 4."""
    return _encoder(tokenizer_path, 0).dtype.itemsize


def write_store(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> TokenStore:
    """Encodes every text, writes shards in ascending order of ids, and an index over them.

    Null texts are empty; each document ends with ``end_id`` (None: no end mark). Ids are
    integers; null ones come first and are looked up as null. Repeated ids keep all their
    documents, in order of a hash of their texts. A shard holds about ``range_bytes`` of
    text, more where there would be over ``PARTS`` shards; rows of one id, and of one id and
    text, spread over as many shards as they fill. ``tokenizer_path`` must be readable on the executors; ``folder`` (default: the
    shared folder) by all of them. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The low bits are the row's own, so that rows of one id and text fall into several ranges.
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_OWN))
    fp = F.xxhash64(text).bitwiseAND(F.lit(-_OWN)).bitwiseOR(own)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("key"), fp.alias("fp"), text.alias("text"))
    ranges = byte_ranges(rows.select("key", "fp", F.octet_length("text").cast("long")), range_bytes).at_most(PARTS)
    sent, width = spark.sparkContext.broadcast(ranges), len(ranges)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer_path, end_id)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                shard = sent.value.of(s.column(0).to_numpy(), s.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), s.column(0), s.column(1), pa.array(coder.encode(s.column(2).to_pylist()), pa.binary())], names=["shard", "key", "fp", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, attempt = _encoder(tokenizer_path, end_id).dtype.itemsize, TaskContext.get().taskAttemptId()
        now, out, done, counts, run, path = None, None, 0, array("I"), None, ""

        def close() -> None:
            if out is not None:
                out.write(counts.tobytes())
                out.close()

        def batch(runs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*runs, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "shard", "path", "offset", "ids", "doc", "docs"])

        for b in batches:
            runs = []
            for shard, key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, done, counts, path = shard, 0, array("I"), posixpath.join(folder, f"shard-{shard:06d}-{attempt}.ids")
                    fs, at = _open(path)
                    out = fs.open_output_stream(at)
                    out.write(MAGIC)
                if run is None or run[:2] != [key, shard]:
                    if run:
                        runs.append(run)
                    run = [key, shard, path, done, 0, len(counts), 0]
                out.write(ids)
                n = len(ids) // size
                counts.append(n)
                run[4], run[6], done = run[4] + n, run[6] + 1, done + n
            if runs:
                yield batch(runs)
        close()
        if run:
            yield batch([run])

    dealt = rows.mapInArrow(encode, "shard int, key long, fp long, ids binary").repartition(width, "shard").sortWithinPartitions("shard", "key", "fp", "ids").drop("fp")
    places = written(dealt.mapInArrow(save, "key long, shard int, path string, offset long, ids long, doc long, docs long"))
    totals = {r["shard"]: r for r in places.groupBy("shard").agg(F.first("path").alias("path"), F.sum("ids").alias("n"), F.count("*").alias("keys")).collect()}
    base, shards, rows = 0, [], 0
    for s in range(width):
        path, n, keys = (totals[s]["path"], totals[s]["n"], totals[s]["keys"]) if s in totals else ("", 0, 0)
        shards.append((path, base, n))
        base, rows = base + n, rows + keys
    count = max(1, -(-rows // INDEX_KEYS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]
        whole = pa.Table.from_batches(held) if held else None
        if whole is None:
            return
        made, parts_ = [], whole.column("part").to_numpy()
        for p in np.unique(parts_).tolist():
            mine = np.flatnonzero(parts_ == p)
            col = {c: whole.column(c).to_numpy()[mine] for c in ("hash", "shard", "offset", "doc", "docs")}
            path = posixpath.join(folder, f"index-{p:06d}-{TaskContext.get().taskAttemptId()}.mph")
            fs, at = _open(path)
            with fs.open_output_stream(at) as f:
                f.write(_index_bytes(col["hash"].view(np.uint64), *(col[c] for c in ("shard", "offset", "doc", "docs"))))
            made.append((p, path))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made])], names=["part", "path"])

    hashed = places.select(F.xxhash64("key").alias("hash"), "shard", "offset", "doc", "docs")
    by_part = hashed.select(F.pmod("hash", F.lit(count)).cast("int").alias("part"), "*").repartition(count, "part").mapInArrow(index, "part int, path string").collect()
    files = dict(by_part)
    missing = [p for p in range(count) if p not in files]
    for p in missing:
        files[p] = posixpath.join(folder, f"index-{p:06d}-empty.mph")
        fs, at = _open(files[p])
        with fs.open_output_stream(at) as f:
            none = np.zeros(0, dtype=np.uint64)
            f.write(_index_bytes(none, none, none, none, none))
    discard(places)
    return TokenStore(_encoder(tokenizer_path, end_id).dtype.str, shards, [files[p] for p in range(count)])


def look_up(keys: DataFrame, store: TokenStore, id_col: str = "doc_id") -> DataFrame:
    """Places of keys: ``id_col``, shard, offset, doc, docs. Unknown keys have no row, others one
    for each shard that holds any of their documents; equal keys are asked for once. Null is
    a key too."""
    sent = keys.sparkSession.sparkContext.broadcast(store)  # a path for each of at most ``PARTS`` shards

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, _Index] = {}
        for b in batches:
            part, ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            for p in np.unique(part).tolist():
                if p not in loaded:
                    loaded = {p: _Index(sent.value.index[p])}
                mine = np.flatnonzero(part == p)
                rows = [(int(ids[mine[i]]), *x) for i, *x in loaded[p].find(hashes[mine])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "shard", "offset", "doc", "docs"])

    asked = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id")).distinct()
    hashed = asked.select(F.pmod(F.xxhash64("id"), F.lit(len(store.index))).cast("int").alias("part"), "id", F.xxhash64("id").alias("hash"))
    found = hashed.sortWithinPartitions("part").mapInArrow(task, "id long, shard int, offset long, doc long, docs long")
    return found.select(F.when(F.col("id") != _NONE, F.col("id")).alias(id_col), "shard", "offset", "doc", "docs")


def read_ids(places: DataFrame, store: TokenStore, id_col: str = "doc_id") -> DataFrame:
    """The payloads of looked-up places: ``id_col``, ``start`` (ids of all documents before),
    ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit integers)."""
    sent = places.sparkSession.sparkContext.broadcast(store)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, now, file, rows = np.dtype(sent.value.dtype), None, None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])

        for b in batches:
            for key, shard, offset, doc, docs in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                path, base, total = sent.value.shards[shard]
                if shard != now:
                    now, file = shard, _Shard(path, total, dtype)
                for at, ids in file.documents(offset, doc, docs):
                    rows.append((key, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 8192:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    dealt = places.select(F.col(id_col).alias("id"), "shard", "offset", "doc", "docs").repartition("shard").sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(task, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
