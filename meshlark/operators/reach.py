"""Traversal over instances to any depth: which objects are reached, and in how few links."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import project_id
from ..sources.lineage import shared_folder
from .objectset import Graph

#: Columns of an edge: the types and ids of its ends.
EDGE = ["src_type", "src_id", "tgt_type", "tgt_id"]


def link_edges(graph: Graph, type_name: str, link: str) -> DataFrame:
    """The edges of a declared link between two types: one for each pair of objects that it joins."""
    of = graph.registry.resolve(type_name, None)
    x = of.link(link)
    if x.edges:
        rows = graph.table(x.edges)
        if "link" in rows.columns:
            rows = rows.filter((F.col("link") == link) & (F.col("tgt_type") == x.target))
        return rows.select(F.lit(of.name).alias("src_type"), "src_id", F.lit(x.target).alias("tgt_type"), "tgt_id")
    to = graph.registry.resolve(x.target, of.domain)
    left = graph.table(of.name).select(F.col(x.source_key).alias("_key"), project_id(*of.key).alias("src_id"))
    right = graph.table(to.name).select(F.col(x.target_key).alias("_key"), project_id(*to.key).alias("tgt_id"))
    return left.join(right, "_key").select(F.lit(of.name).alias("src_type"), "src_id", F.lit(to.name).alias("tgt_type"), "tgt_id")


def association_edges(graph: Graph, association: str, source_role: str, target_role: str) -> DataFrame:
    """Edges from one end of an association's rows to another, each pair once."""
    of = graph.registry.resolve(association, None)
    ends = {r.name: r for r in of.roles}
    a, b = ends[source_role], ends[target_role]
    ids = graph.table(of.name).select(F.col(a.column).cast("string").alias("src_id"), F.col(b.column).cast("string").alias("tgt_id")).dropna().distinct()
    return ids.select(F.lit(a.target).alias("src_type"), "src_id", F.lit(b.target).alias("tgt_type"), "tgt_id")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their inverses, from one run of ``edges``."""
    ends = lambda *columns: F.struct(*(F.col(c).alias(name) for c, name in zip(columns, EDGE, strict=True)))
    return edges.select(F.inline(F.array(ends(*EDGE), ends(*EDGE[2:], *EDGE[:2]))))


def reachable(start: DataFrame, edges: list[DataFrame], max_depth: int | None = None) -> DataFrame:
    """Every object that a walk from ``start`` (type, id) leads to: type, id, depth (of the shortest walk).

    Each round follows the edges of the objects found in the round before, and only of
    these; what was reached earlier is left out by the grouping that takes each end once, so
    cycles end the walk and an object keeps its least depth. The walk ends with the round that finds nothing, or at
    ``max_depth``. Edges are dealt and sorted by their source once, and held in columns on
    the executors' disks until the walk ends; a round reads those of its own types alone,
    and its finds are a table in the shared folder. Start objects have depth 0, also those
    without edges; null ids are no objects. Repeated edges and starts count once.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth is at least 0")
    spark = start.sparkSession
    folder, kind, found = shared_folder(spark), "type string, id string, depth int", []

    def kept(rows: DataFrame) -> DataFrame:
        path = f"{folder}/depth-{len(found)}"
        rows.select("type", "id", F.lit(len(found)).alias("depth")).write.parquet(path)
        found.append(path)
        return spark.read.schema(kind).parquet(path)

    # With a number of its own, the dealing stays as it is and the joins below needn't repeat it.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = reduce(DataFrame.unionByName, (e.select(*EDGE) for e in edges)).dropna()
    links = links.repartition(parts, "src_type", "src_id").sortWithinPartitions("src_type", "src_id").persist(StorageLevel.DISK_ONLY)
    try:
        links.count()
        frontier = kept(start.select(F.col("type").cast("string").alias("type"), F.col("id").cast("string").alias("id")).dropna().distinct())
        while max_depth is None or len(found) <= max_depth:
            types = [r[0] for r in frontier.select("type").distinct().collect()]  # as many as the model has at most
            if not types:
                break
            steps = links.filter(F.col("src_type").isin(types)).join(frontier.select(F.col("type").alias("src_type"), F.col("id").alias("src_id")), ["src_type", "src_id"], "left_semi")
            ends = steps.select(F.col("tgt_type").alias("type"), F.col("tgt_id").alias("id"), F.lit(False).alias("known"))
            known = spark.read.schema(kind).parquet(*found).select("type", "id", F.lit(True).alias("known"))
            frontier = kept(ends.unionByName(known).groupBy("type", "id").agg(F.max("known").alias("known")).filter("not known"))
    finally:
        links.unpersist()
    return spark.read.schema(kind).parquet(*found)
