"""Line de-duplication over the whole corpus.

Hashes of the line keys are range-partitioned with a secondary sort by document and
position, so that a line held by a third of all documents simply fills several
partitions. Each task streams its sorted run and keeps the first document of a run. Runs
cut by a partition's edge are settled from one small summary per edge. The result is a
compressed keep bitmap per changed document; the texts are not shuffled for the search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, look_up_spread, written

#: Lines of a run that wait in memory for its third document; more of them are settled by a join.
HELD = 65_536

#: Characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NONE = -(2**63)

_FOUND = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("doc", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("docs", T.IntegerType()),
        T.StructField("last", T.LongType()),
    ]
)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line whose key has ``min_chars`` code points: hash, document, position."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc"),
        F.xxhash64(text).alias("fp"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    key = F.translate(F.btrim("line", F.lit(BLANKS)), _UPPER, _LOWER)
    return lines.filter(F.length("line") >= min_chars).select("doc", "fp", "pos", key.alias("key")).filter(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "fp", "pos"
    )


class _Run:
    """The lines with one key as far as they have been read in this partition."""

    def __init__(self, h1: int, h2: int, doc: int, first: bool):
        self.h1, self.h2, self.doc, self.last, self.docs, self.first = h1, h2, doc, doc, 1, first
        self.held: list[tuple[int, int, int]] = []
        self.late = 0  # lines that no longer wait in memory

    def edge(self, part: int) -> tuple:
        return ("edge", self.h1, self.h2, self.doc, None, None, part, self.docs, self.last)


def _stream(min_docs: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run: _Run | None = None
        schema = pa.schema([("kind", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("fp", pa.int64()), ("pos", pa.int32()), ("part", pa.int32()), ("docs", pa.int32()), ("last", pa.int64())])

        def drops(doc, fp, pos, kind="drop", h1=None, h2=None):
            return (kind, h1, h2, doc, fp, pos, None, None, None)

        def take(run: _Run, doc: int, fp: int, pos: int, out: list) -> None:
            if doc != run.last:
                run.docs, run.last = run.docs + 1, doc
            if run.first:  # an earlier partition may hold this run's first document
                out.append(drops(doc, fp, pos, "open", run.h1, run.h2))
            elif doc != run.doc:
                if run.docs < min_docs:
                    run.held.append((doc, fp, pos))
                    if len(run.held) >= HELD:
                        out.extend(drops(*x, "late", run.h1, run.h2) for x in run.held)
                        run.held, run.late = [], run.late + len(run.held)
                else:
                    out.extend(drops(*x) for x in run.held)
                    run.held = []
                    out.append(drops(doc, fp, pos))

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, fp, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            out: list[tuple] = []
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], len(h1)]
            # Runs of one line neither begin nor end a batch: nothing of them is dropped.
            alone = (ends - starts == 1) & (starts > 0) & (ends < len(h1))
            for s, e in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
                if run is None or (run.h1, run.h2) != (int(h1[s]), int(h2[s])):
                    if run is not None and run.first:
                        out.append(run.edge(part))
                    elif run is not None and run.late and run.docs >= min_docs:
                        out.append(("key", run.h1, run.h2, run.doc, None, None, None, None, run.late))
                    run = _Run(int(h1[s]), int(h2[s]), int(doc[s]), run is None)
                for d, f, p in zip(doc[s:e].tolist(), fp[s:e].tolist(), pos[s:e].tolist(), strict=True):
                    take(run, d, f, p, out)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
        if run is not None:
            out = [run.edge(part), *(drops(*x, "open", run.h1, run.h2) for x in run.held)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return search


def _settled(edges: list, min_docs: int) -> list[tuple[int, int, int]]:
    """(h1, h2, keeping document) of the runs at partition edges that lose lines."""
    out, by = [], {}
    for e in sorted(edges, key=lambda e: e["part"]):
        by.setdefault((e["h1"], e["h2"]), []).append(e)
    for (h1, h2), parts in by.items():
        docs = sum(e["docs"] for e in parts) - sum(a["last"] == b["doc"] for a, b in zip(parts, parts[1:], strict=False))
        if docs >= min_docs:
            out.append((h1, h2, parts[0]["doc"]))
    return out


@F.udf(T.BinaryType(), useArrow=True)
def _bitmap(dropped: list[int]) -> bytes:
    keep = np.ones(max(dropped) // 8 * 8 + 8, dtype=np.uint8)  # whole bytes: no padding bits
    keep[np.asarray(dropped)] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Compressed keep bitmaps of the documents that lose lines.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines except in the largest id that holds them.

    Returns ``id_col``, ``text_fp`` (xxhash64 of the text), ``n_dropped``, ``bitmap``
    (zlib of packed bits, 1 = keep; lines past its end stay). Ids are integers. Rows with
    one id count as one document; a null id counts as one document below all others. Null
    and empty texts are one empty line. Repeated rows lose the same lines. Other columns
    are not read.
    """
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("fp"), F.col("pos")]
    hashes = written(line_hashes(docs, id_col, text_col, min_chars))  # the range sampler reads them too
    found = written(hashes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _FOUND))
    discard(hashes)
    # Two edges a partition at most, however many lines there are.
    edges = found.filter("kind = 'edge'").select("h1", "h2", "doc", "part", "docs", "last").collect()
    settled = docs.sparkSession.createDataFrame(_settled(edges, min_docs), "h1 long, h2 long, keeper long")
    at_edges = found.filter("kind IN ('open', 'late')").join(F.broadcast(settled), ["h1", "h2"]).filter("doc != keeper")
    late, keys = found.filter("kind = 'late'").select("h1", "h2", "doc", "fp", "pos"), found.filter("kind = 'key'").select("h1", "h2", F.col("last").alias("lines"))
    waited = look_up_spread(late, keys, ["h1", "h2"], "lines", late.count())
    dropped = found.filter("kind = 'drop'").select("doc", "fp", "pos").unionByName(at_edges.select("doc", "fp", "pos")).unionByName(waited.select("doc", "fp", "pos"))
    per_doc = dropped.groupBy("doc", "fp").agg(F.collect_set("pos").alias("dropped"))
    return per_doc.select(
        F.when(F.col("doc") != _NONE, F.col("doc")).alias(id_col), F.col("fp").alias("text_fp"), F.size("dropped").cast("long").alias("n_dropped"), _bitmap("dropped").alias("bitmap")
    )


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, list[str]]:
    """Number of lines, and those that the bitmap keeps."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[: len(lines)].tolist()
    return len(lines), [x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :]


def _joined(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as ``_docs`` beside their bitmaps as ``_maps`` (null for unchanged rows); names are told apart by these."""
    left, right = docs.alias("_docs"), bitmaps.select(F.col(id_col).alias("id"), "text_fp", "n_dropped", "bitmap").alias("_maps")
    same = F.col(f"_docs.`{id_col}`").cast("long").eqNullSafe(F.col("_maps.id")) & (F.xxhash64(F.coalesce(F.col(f"_docs.`{text_col}`"), F.lit(""))) == F.col("_maps.text_fp"))
    return left.join(right, same, "left")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text_col``, ``bitmap`` and ``n_dropped`` of every row, the last two null where nothing is dropped."""
    return _joined(docs, bitmaps, id_col, text_col).select(F.col(f"_docs.`{id_col}`"), F.col(f"_docs.`{text_col}`"), F.col("_maps.bitmap"), F.col("_maps.n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text_col``; all columns stay, whatever their names.

    With ``drop_emptied``, rows that lost lines and have nothing but blanks left go too.
    """

    @F.udf(T.StringType(), useArrow=True)
    def rest(text: str, bitmap: bytes) -> str:
        return None if bitmap is None else "\n".join(kept_lines(text, bitmap)[1])

    rest = rest.asNondeterministic()  # else the filter below would run it a second time
    text, bitmap = F.col(f"_docs.`{text_col}`"), F.col("_maps.bitmap")
    new = F.when(bitmap.isNull(), text).otherwise(rest(F.when(bitmap.isNotNull(), text), bitmap))  # unchanged texts stay in the JVM
    mine = F.struct(*(F.col(f"_docs.`{c}`") if c != text_col else new.alias(c) for c in docs.columns))
    out = _joined(docs, bitmaps, id_col, text_col).select(mine.alias("_row"), bitmap.isNull().alias("_same"))
    if drop_emptied:
        out = out.filter(F.col("_same") | (F.btrim(F.col(f"_row.`{text_col}`"), F.lit(BLANKS)) != ""))
    return out.select("_row.*")
