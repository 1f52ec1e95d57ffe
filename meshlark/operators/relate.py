"""Writing links: set-based checks that split candidates into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = ["src_type", "src_id", "link", "tgt_type", "tgt_id", "assoc_id"]


def _same(a: DataFrame, b: DataFrame, columns: list[str]):
    cond = F.lit(True)
    for c in columns:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def relate(candidates: DataFrame, existing: DataFrame, objects: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New edges and refused ones.

    ``objects``: (type, id) of all objects; ``links``: (src_type, link, tgt_type,
    self_loops). A candidate is refused, for the first of these reasons: undeclared-link,
    missing-source, missing-target, self-loop. Edges that exist already are neither new
    nor refused. Null ids are missing.
    """
    known = objects.select("type", "id").distinct()
    src = known.select(F.col("type").alias("src_type"), F.col("id").alias("src_id"), F.lit(True).alias("_src"))
    tgt = known.select(F.col("type").alias("tgt_type"), F.col("id").alias("tgt_id"), F.lit(True).alias("_tgt"))
    rules = links.select("src_type", "link", "tgt_type", F.col("self_loops").alias("_loops"))
    checked = candidates.select(*EDGE).distinct().join(rules, ["src_type", "link", "tgt_type"], "left").join(src, ["src_type", "src_id"], "left").join(tgt, ["tgt_type", "tgt_id"], "left")
    loop = (F.col("src_type") == F.col("tgt_type")) & (F.col("src_id") == F.col("tgt_id")) & ~F.col("_loops")
    reason = F.when(F.col("_loops").isNull(), "undeclared-link").when(F.col("_src").isNull(), "missing-source").when(F.col("_tgt").isNull(), "missing-target").when(loop, "self-loop")
    judged = checked.select(*EDGE, reason.alias("reason"))
    fresh = judged.filter("reason is null").select(*EDGE).alias("a")
    old = existing.select(*EDGE).alias("b")
    accepted = fresh.join(old, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in EDGE], "left_anti")
    return accepted, judged.filter("reason is not null")


def relate_batch(candidates: DataFrame, existing: DataFrame, objects: DataFrame, links: DataFrame, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """All or nothing: new edges if no candidate is refused, else none, and the first refusal (position, reason)."""
    accepted, refused = relate(candidates, existing, objects, links)
    a, b = candidates.alias("a"), refused.alias("b")
    failed = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in EDGE]).groupBy().agg(F.min(F.struct(F.col(f"a.{position}").alias("position"), F.col("b.reason").alias("reason"))).alias("_f"))
    first = failed.select("_f.*").filter("position IS NOT NULL")
    return accepted.join(F.broadcast(first.select(F.lit(True).alias("_any"))), F.lit(True), "left_anti"), first  # a row at most


def relate_attributed(candidates: DataFrame, existing: DataFrame, objects: DataFrame, links: DataFrame, associations: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New edges with an association, the association objects to store, and refused candidates.

    As ``relate``; a new edge whose association is null or not in ``associations`` is
    refused as missing-association. An object is stored only with a new edge.
    """
    accepted, refused = relate(candidates, existing, objects, links)
    given = associations.select(F.col(id_col).alias("assoc_id")).distinct()
    new = accepted.join(given, "assoc_id", "left_semi").select(*EDGE)
    bare = accepted.join(given, "assoc_id", "left_anti").select(*EDGE, F.lit("missing-association").alias("reason"))
    stored = associations.join(new.select(F.col("assoc_id").alias(id_col)).distinct(), id_col, "left_semi")
    return new, stored, refused.unionByName(bare)


def unrelate(edges: DataFrame, removals: DataFrame) -> DataFrame:
    """Edges without the plain ones (no association) named in ``removals``; unknown ones are no error."""
    keys = EDGE[:-1]
    a, b = edges.alias("a"), removals.select(*keys).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
    return a.join(b, [*same, F.col("a.assoc_id").isNull()], "left_anti")


def unrelate_attributed(edges: DataFrame, associations: DataFrame, removals: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Edges and association objects after removals by association; an object that another edge still uses stays."""
    a, b = edges.alias("a"), removals.select(*EDGE).alias("b")
    left = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in EDGE], "left_anti")
    gone = removals.select("assoc_id").distinct().join(left.select("assoc_id"), "assoc_id", "left_anti")
    kept = associations.join(gone, associations[id_col] == gone["assoc_id"], "left_anti")
    return left, kept


def missing_endpoints(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges whose source or target does not exist."""
    src = objects.select(F.col("type").alias("src_type"), F.col("id").alias("src_id"))
    tgt = objects.select(F.col("type").alias("tgt_type"), F.col("id").alias("tgt_id"))
    return edges.join(src, ["src_type", "src_id"], "left_anti").select(*EDGE).unionByName(edges.join(tgt, ["tgt_type", "tgt_id"], "left_anti").select(*EDGE)).distinct()
