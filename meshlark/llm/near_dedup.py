"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Each document becomes its set of shingle hashes, a MinHash signature and band keys.
   Documents with equal sets form a class; one of its texts stands for it from here on.
2. Band keys shared by at least two classes give candidates. Each class is first compared
   with one other: of the least classes of its bands, the one that it shares most bands
   with. A group of copies is tied together so, at a cost in proportion to its size.
3. Bands that still hold classes of several components are open. The signatures of an open
   band's classes meet in tasks of ``SCREEN`` at most on a side, and are compared by
   batches; a pair is given up as soon as the chance that it reaches the threshold falls
   below the miss probability. A pair counts in the first band that it shares only.
4. Of what is left, each class's ``FAN`` likest are verified on the full sets. If a class has
   more of them, the bands that it still shares with other components after that are
   compared on full sets, in tasks of ``BLOCK`` texts on a side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordCodes, kept, look_up_spread, mix64, scratch, shared_dir, shingle_set, utf8, written
from .components import connected_components
from .fingerprint import bin_minima

#: Values of a signature, and those compared in one step.
HASHES, STEP = 384, 32
#: Texts and bytes of text on each side of a task that compares texts.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Signatures, about, on each side of a task that compares these; a class's likest partners that are verified first.
SCREEN, FAN = 4096, 8
#: Blocks of texts numbered together, on average.
_RUN = 4
#: Chance that a pair at the threshold shares no band, or that one step gives it up.
MISS = 1e-6
_NONE = -(2**63)


def band_rows(percent: int, miss: float = MISS) -> int:
    """The most rows a band can have so that a pair at the threshold is missed with ``miss`` at most."""
    s = percent / 100
    fit = [r for r in range(1, 33) if HASHES % r == 0 and (1 - s**r) ** (HASHES // r) <= miss]
    return max(fit)


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For 1, 2, ... steps the least number of equal values that keeps a pair.

    With an even prior, the similarity after k of h equal values is Beta(k + 1, h - k + 1),
    so P(similarity >= s) is the chance of at most k heads in h + 1 tosses with odds s.
    """
    s, out = percent / 100, []
    for h in range(STEP, HASHES + 1, STEP):
        total, k = 0.0, 0
        for k in range(h + 2):
            total += comb(h + 1, k) * s**k * (1 - s) ** (h + 1 - k)
            if total >= miss:
                break
        out.append(k)
    return tuple(out)


def signature_of(hashes: np.ndarray) -> np.ndarray:
    """Low 16 bits of the densified minima: unlike values agree in one of 65,536 cases, like ones always."""
    return bin_minima(hashes, HASHES).astype(np.uint16)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the number of the band is part of it."""
    bands = signature.astype(np.uint64).reshape(-1, rows)
    acc = np.arange(len(bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
    return acc


def _sketches(docs: DataFrame, shingle: int, rows: int) -> DataFrame:
    """id, fp, size, n, f1, f2 (of the set of shingles), bands. No words: n = 0 and no bands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            n, f1, f2, bands = [], [], [], []
            for text in utf8(batch.column(3)):
                hashes = shingle_set(text, shingle, codes)
                n.append(len(hashes))
                with np.errstate(over="ignore"):
                    f1.append(int(hashes.sum(dtype=np.uint64).astype(np.int64)))
                    f2.append(int(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                bands.append(band_keys(signature_of(hashes), rows).view(np.int64) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "fp", "size", "n", "f1", "f2", "bands"])

    return docs.select("id", "fp", "size", "text").mapInArrow(task, "id long, fp long, size long, n long, f1 long, f2 long, bands array<long>")


def _signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """node, sig of ``texts`` (node, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            sigs = [signature_of(shingle_set(t, shingle, codes)).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], names=["node", "sig"])

    return texts.select("node", "text").mapInArrow(task, "node long, sig binary")


def _survivors(values: np.ndarray, i: int, js: np.ndarray, keep: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``js`` whose signatures stay likely enough to reach the threshold with i's, and their equal values."""
    equal = np.zeros(len(js), dtype=np.int64)
    for step, least in enumerate(keep):
        if not len(js):
            break
        at = slice(step * STEP, (step + 1) * STEP)
        equal = equal + (values[js, at] == values[i, at]).sum(axis=1)
        js, equal = js[equal >= least], equal[equal >= least]
    return js, equal


class _Links:
    """The documents of one task and the links found between them."""

    def __init__(self, rows: list[tuple], shingle: int, rows_per_band: int, codes: WordCodes, band: int | None):
        """``rows``: side, node, component so far, text. ``band``: compares only pairs that share it and none before it."""
        self.ids, self.sides, self.band = [r[1] for r in rows], np.array([r[0] for r in rows]), band
        self.sets = [shingle_set(r[3], shingle, codes) for r in rows]
        self.values = np.array([signature_of(s) for s in self.sets])
        if band is not None:
            self.bands = np.array([band_keys(x, rows_per_band) for x in self.values]).view(np.int64)
        self.sizes = np.array([len(s) for s in self.sets])
        self.part = np.array([r[2] for r in rows])

    def candidates(self, i: int) -> np.ndarray:
        """Later documents of other components, and of the other side if there are two."""
        js = np.arange(i + 1, len(self.ids))
        js = js[(self.part[js] != self.part[i]) & ((self.sides[i] == 0) | (self.sides[js] != self.sides[i]))]
        if self.band is not None and len(js):
            shared = self.bands[js] == self.bands[i]
            js = js[shared.any(axis=1) & (self.bands[i][shared.argmax(axis=1)] == self.band)]
        return js

    def find(self, percent: int, miss: float) -> Iterator[tuple[int, int]]:
        keep = least_matches(percent, miss)
        for i in np.flatnonzero(self.sides < 2).tolist():
            js = self.candidates(i)
            small, large = np.minimum(self.sizes[js], self.sizes[i]), np.maximum(self.sizes[js], self.sizes[i])
            js, equal = _survivors(self.values, i, js[100 * small >= percent * large], keep)
            for j in js[np.argsort(-equal, kind="stable")].tolist():
                if self.part[j] != self.part[i] and self.linked(i, j, percent):
                    self.part[self.part == self.part[j]] = self.part[i]
                    yield self.ids[i], self.ids[j]

    def linked(self, i: int, j: int, percent: int) -> bool:
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return 100 * both >= percent * (len(self.sets[i]) + len(self.sets[j]) - both)


def _verified(tasks: DataFrame, shingle: int, rows: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b) among the nodes of one ``task``. Columns: task, band, side, node, part, text.

    If a task has two sides (1 and 2), only pairs across them are compared; side 0 means
    all pairs. With a ``band``, only pairs whose first shared band it is. Nodes of one
    ``part`` need no comparison. Rows are dealt by task and streamed; a task's rows and
    bytes are bounded by its maker.
    """

    def links(band: int | None, held: list[tuple], codes: WordCodes) -> list[tuple[int, int]]:
        return list(_Links(held, shingle, rows, codes, band).find(percent, miss)) if len(held) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, now, held = WordCodes(), (None, None), []
        for batch in batches:
            out = []
            for task, band, side, node, part, text in zip(*(batch.column(i).to_pylist() for i in range(5)), utf8(batch.column(5)), strict=True):
                if (task, band) != now:
                    out += links(now[1], held, codes)
                    now, held = (task, band), []
                if not held or held[-1][:2] != (side, node):  # repeated rows bring a text several times
                    held.append((side, node, part, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        out = links(now[1], held, codes)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    dealt = tasks.select("task", "band", "side", "node", "part", "text").repartition("task").sortWithinPartitions("task", "band", "side", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _screened(members: DataFrame, sizes: DataFrame, signatures: DataFrame, rows: int, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) that may be links, a's likest ``FAN``; a row with b null tells that a has more.

    ``members``: band, node, part; ``sizes``: band, docs. The nodes of a band are dealt into
    pieces by hash, and each two pieces, or a piece and itself, are a task.
    """
    keep = least_matches(percent, miss)

    def pairs(band: int, held: list[tuple]) -> list[tuple]:
        if len(held) < 2:
            return []
        sides, nodes, parts = (np.array([h[i] for h in held]) for i in range(3))
        values = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint16).reshape(len(held), HASHES)
        out = []
        for i in np.flatnonzero(sides < 2).tolist():
            js = np.arange(i + 1, len(held))
            js, equal = _survivors(values, i, js[(parts[js] != parts[i]) & ((sides[i] == 0) | (sides[js] != sides[i]))], keep)
            if len(js):
                shared = (values[js] == values[i]).reshape(len(js), -1, rows).all(axis=2)
                first = band_keys(values[i], rows).view(np.int64)[shared.argmax(axis=1)] == band
                js, equal = js[first & shared.any(axis=1)], equal[first & shared.any(axis=1)]
            best = np.argsort(-equal, kind="stable")[: FAN + 1]  # one more tells that there are more
            out += [(int(nodes[i]), int(nodes[j]), int(e)) for j, e in zip(js[best], equal[best], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        now, held = None, []
        for batch in batches:
            out = []
            for *task, side, node, part, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != now:
                    out += pairs(now[0], held) if now else []
                    now, held = task, []
                held.append((side, node, part, sig))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "equal"])
        out = pairs(now[0], held) if now else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "equal"])

    total = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0))).head()[0]
    wide = look_up_spread(members, sizes.withColumn("ways", F.ceil(F.col("docs") / SCREEN).cast("int")), ["band"], "docs", total)
    mine = wide.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    side = F.when(F.col("piece") == F.col("other"), 0).when(F.col("piece") < F.col("other"), 1).otherwise(2)
    tasks = mine.select("band", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), side.alias("side"), "node", "part")
    dealt = tasks.join(signatures.hint("merge"), "node").select("band", "low", "high", "side", "node", "part", "sig")
    found = dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "side", "node").mapInArrow(run, "a long, b long, equal long")
    first = Window.partitionBy("a").orderBy(F.col("equal").desc(), "b")
    ranked = found.distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= FAN + 1)
    return ranked.select("a", F.when(F.col("rank") <= FAN, F.col("b")).alias("b"))


def _blocked(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` (group, node, size, ...) with ``block``: bounded runs of a group's nodes.

    A group is dealt by hash into pieces of some blocks, and each piece is cut where its
    running weight passes a block's; a weight is a text's bytes and a fixed part.
    """
    weight = F.col("size") + BLOCK_BYTES // BLOCK
    heavy = written(rows.groupBy(*group).agg(F.sum(weight).alias("_weight"), F.count("*").alias("_docs")))
    total = heavy.agg(F.coalesce(F.sum("_docs"), F.lit(0))).head()[0]
    pieces = F.ceil(F.col("_weight") / (_RUN * BLOCK_BYTES))
    dealt = look_up_spread(rows, heavy, group, "_docs", total).withColumn("_piece", F.pmod(F.xxhash64("node"), pieces))
    before = F.sum(weight).over(Window.partitionBy(*group, "_piece").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("block", F.concat_ws(".", "_piece", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_BYTES))).drop("_piece", "_weight")


def _hub_tasks(pairs: DataFrame) -> DataFrame:
    """Nodes and the ``leader`` that each is compared with, a leader's nodes in blocks: task, band (null), side, node."""
    blocks = written(_blocked(pairs, ["leader"]).select("leader", "node", F.concat_ws("/", "leader", "block").alias("task")))
    hubs = blocks.select("task", F.lit(1).alias("side"), F.col("leader").alias("node")).distinct()
    return hubs.unionByName(blocks.select("task", F.lit(2).alias("side"), "node")).withColumn("band", F.lit(None).cast("long"))


def _ties(members: DataFrame) -> DataFrame:
    """Each node with the leader that it shares most bands with: node, leader, size."""
    shared = members.filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    return written(shared.groupBy("node").agg(F.max_by("leader", F.struct("shared", -F.col("leader"))).alias("leader"), F.first("size").alias("size")))


def _open_bands(parted: DataFrame, of: str = "true") -> DataFrame:
    """Bands that hold several components, and a node for which ``of`` is true: band, docs."""
    found = parted.groupBy("band").agg(F.count("*").alias("docs"), F.min("part").alias("low"), F.max("part").alias("high"), F.bool_or(F.expr(of)).alias("some"))
    return written(found.filter("low <> high AND some").select("band", "docs"))


def _band_tasks(members: DataFrame) -> DataFrame:
    """Each two blocks of texts of a band: task, band, side, node, part. ``members``: band, node, size, part."""
    blocks = written(_blocked(members, ["band"]).select("band", "node", "part", "block"))
    names = blocks.select("band", "block").distinct()
    pairs = names.join(names.withColumnRenamed("block", "block2").hint("merge"), "band").filter("block <= block2")
    pairs = written(pairs.withColumn("task", F.concat_ws("|", "band", "block", "block2")))
    same = F.col("block") == F.col("block2")
    left = pairs.select("band", "block", "task", F.when(same, 0).otherwise(1).alias("side"))
    right = pairs.filter(~same).select("band", F.col("block2").alias("block"), "task", F.lit(2).alias("side"))
    return blocks.join(left.unionByName(right).hint("merge"), ["band", "block"]).select("task", "band", "side", "node", "part")


def _grouped(texts: DataFrame, shingle: int, percent: int, miss: float, sketch_path: str, named_path: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and of each set of shingles the id and text that its component keeps."""
    rows = band_rows(percent, miss)
    sketches = written(_sketches(texts, shingle, rows), sketch_path)
    least = sketches.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "fp", "size", "bands")).alias("least"), F.count("*").alias("docs"))
    classes = written(least.select(F.monotonically_increasing_id().alias("node"), "n", "f1", "f2", "docs", "least.*"))
    exploded = classes.select("node", "size", F.explode("bands").alias("band"))
    shared = written(exploded.groupBy("band").agg(F.count("*").alias("docs"), F.min("node").alias("leader")).filter("docs > 1"))
    members = written(look_up_spread(exploded, shared, ["band"], "docs", classes.count() * (HASHES // rows)))
    # The text of each candidate, taken from the corpus once.
    known = written(members.select("node").distinct().join(classes.select("node", "id", "fp").hint("merge"), "node"))
    candidates = written(texts.select("id", "fp", "text").join(known.hint("merge"), ["id", "fp"]).select("node", "text"))

    def verify(tasks: DataFrame) -> DataFrame:
        return written(_verified(tasks.join(candidates.hint("merge"), "node"), shingle, rows, percent, miss))

    def components(links: DataFrame, before: DataFrame) -> DataFrame:
        known_links = before.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return written(connected_components(known_links.unionByName(links)))

    def parted(linked: DataFrame) -> DataFrame:
        part = F.coalesce("component", "node").alias("part")
        return written(members.join(linked.hint("merge"), "node", "left").select("node", "size", "band", part))

    linked = written(connected_components(verify(_hub_tasks(_ties(members)).withColumn("part", F.col("node")))))
    now = parted(linked)
    open_ = _open_bands(now)
    if not open_.isEmpty():
        still = written(look_up_spread(now, open_, ["band"], "docs", open_.agg(F.sum("docs")).head()[0]))
        parts = written(still.select("node", "part").distinct())
        signatures = written(_signatures(candidates.join(parts.hint("merge"), "node", "left_semi"), shingle))
        found = written(_screened(still.select("band", "node", "part"), open_, signatures, rows, percent, miss))
        pairs = found.filter("b IS NOT NULL").select(F.col("a").alias("leader"), F.col("b").alias("node"))
        named = written(pairs.join(classes.select("node", "size").hint("merge"), "node"))
        linked = components(verify(_hub_tasks(named).join(parts.hint("merge"), "node")), linked)
        more = found.filter("b IS NULL").select(F.col("a").alias("node"), F.lit(True).alias("more"))
        if not more.isEmpty():
            now = written(parted(linked).join(more.hint("merge"), "node", "left"))
            open_ = _open_bands(now, "more")
            if not open_.isEmpty():
                still = look_up_spread(now, open_, ["band"], "docs", open_.agg(F.sum("docs")).head()[0])
                linked = components(verify(_band_tasks(still.select("band", "node", "size", "part"))), linked)
    # The least id and text of each component, for its nodes and then for their rows.
    members_of = written(linked.join(classes.select("node", "id", "fp").hint("merge"), "node"))
    firsts = written(members_of.groupBy("component").agg(F.min(F.struct("id", "fp")).alias("first"), F.count("*").alias("docs")))
    first = look_up_spread(members_of.select("component", "node"), firsts, ["component"], "docs", members_of.count()).select("node", "first")
    named = classes.select("node", "n", "f1", "f2", "docs", F.struct("id", "fp").alias("own")).join(first.hint("merge"), "node", "left")
    return sketches, written(named.select("n", "f1", "f2", "docs", F.coalesce("first", "own").alias("first")), named_path)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """Groups of near-duplicate documents.

    A text's set holds its runs of ``shingle`` words (A-Z in lower case, split at ASCII
    blanks); fewer words are one shingle, no words none. Documents are linked if
    ``100 * intersection >= percent * union``, confirmed on the full sets; a pair at the
    threshold is missed with a chance of about ``miss``.

    Returns ``id_col``, ``text_fp`` (xxhash64 of the text), ``n_shingles``,
    ``component_id`` (the least id reachable) and ``kept``: one row for each row of
    ``docs``. Ids are integers. Each row is a document of its own, also where ids are null
    or repeat: a null id counts as the least one and is returned as null, and rows of one
    id are linked only by their texts. Kept is the row with the least id, of those the one
    with the least ``text_fp``; rows that repeat both are all kept. Texts without words are
    linked with nothing and kept. Other columns are not read.
    """
    text = F.col(text_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("fp"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), text.alias("text"))
    spark = docs.sparkSession
    paths = shared_dir(spark), shared_dir(spark)
    with scratch(spark):  # all but the two tables that the result reads
        sketches, named = _grouped(texts, shingle, percent, miss, *paths)
    own = sketches.select("id", "fp", "n", "f1", "f2")
    out = look_up_spread(own, named, ["n", "f1", "f2"], "docs", sketches.count()).unionByName(own.filter("n = 0").withColumn("first", F.struct("id", "fp")))
    real = lambda c: F.when(c != _NONE, c)
    return out.select(real(F.col("id")).alias(id_col), F.col("fp").alias("text_fp"), F.col("n").alias("n_shingles"), real(F.col("first.id")).alias("component_id"), ((F.col("id") == F.col("first.id")) & (F.col("fp") == F.col("first.fp"))).alias("kept"))


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they are."""
    gone = written(groups.filter("NOT kept").select(F.col(id_col).cast("long").alias("id"), "text_fp").distinct()).alias("_gone")
    same = docs[id_col].cast("long").eqNullSafe(F.col("_gone.id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("_gone.text_fp"))
    return docs.join(gone, same, "left_anti")
