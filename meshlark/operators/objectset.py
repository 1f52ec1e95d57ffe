"""Object sets: lazy, immutable queries over one object type of a registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import project_id
from ..functions.vectors import similarity
from ..registry import Link, ObjectType, Registry

#: Facets of a result: properties 1, actions 2, links 4, events 8, interfaces 16, linked objects 32.
FACETS = {"properties": 1, "actions": 2, "links": 4, "events": 8, "interfaces": 16, "linked_objects": 32}
SCHEMA, FULL = 23, 63
PAGE = 100
MAX_DEPTH = 3


@dataclass(frozen=True)
class Graph:
    """A registry and the tables of its types: ``table(type name)`` gives the DataFrame."""

    registry: Registry
    table: Callable[[str], DataFrame]

    def objects(self, name: str, domain: str | None = None) -> ObjectSet:
        """All objects of a type; the name must be unique unless a domain is given."""
        of = self.registry.resolve(name, domain)
        return ObjectSet(self, of, self.table(name))

    def interface(self, name: str) -> DataFrame:
        """The union of an interface's implementors: their columns under the interface's names, and ``_type``."""
        parts = []
        for t in self.registry.implementors(name):
            names = t.interfaces[name]
            parts.append(self.table(t.name).select(F.lit(t.name).alias("_type"), *(F.col(names.get(p, p)).alias(p) for p in self.registry.interfaces[name])))
        if not parts:
            raise LookupError(f"nothing implements {name}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


@dataclass(frozen=True)
class ObjectSet:
    """A query over ``of``; every method returns a new set, nothing runs before ``execute`` or ``stream``."""

    graph: Graph
    of: ObjectType
    df: DataFrame
    facets: int = 1

    def where(self, condition: Column) -> ObjectSet:
        return replace(self, df=self.df.filter(condition))

    def where_text(self, text: str) -> ObjectSet:
        """A condition as SQL text over declared properties only."""
        bare = re.sub(r"'(?:[^']|'')*'", "", text)
        words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", bare)}
        known = {p.name.lower() for p in self.of.properties} | {c.lower() for c in self.df.columns}
        keywords = {"and", "or", "not", "in", "is", "null", "like", "between", "true", "false", "date", "timestamp"}
        if unknown := words - known - keywords:
            raise ValueError(f"not properties of {self.of.name}: {', '.join(sorted(unknown))}")
        return self.where(F.expr(text))

    def by_id(self, object_id: str) -> ObjectSet:
        return self.where(project_id(*self.of.key) == object_id)

    def with_id(self, name: str = "_id") -> DataFrame:
        return self.df.withColumn(name, project_id(*self.of.key))

    # -- links ---------------------------------------------------------------

    def traverse(self, link: str, target: str | None = None, keep_paths: bool = False) -> ObjectSet:
        """The objects that a link leads to.

        Each object comes once, however many sources lead to it; with ``keep_paths`` once
        for each. A link to an interface gives the union of its implementors; an explicit
        ``target`` picks one type.
        """
        x = self.of.link(link)
        name = target or x.target
        if name in self.graph.registry.interfaces:
            rows = self.graph.interface(name)
            if x.target_key not in rows.columns:
                raise LookupError(f"{name} has no {x.target_key}")
            to = ObjectType(name, (rows.columns[1],), self.of.domain)
        else:
            to = self.graph.registry.resolve(name, self.of.domain if any(t.domain == self.of.domain and t.name == name for t in self.graph.registry.types) else None)
            rows = self.graph.table(name)
        how = "inner" if keep_paths else "left_semi"
        if x.edges:
            edges, mine = self.graph.table(x.edges), self.df.select(project_id(*self.of.key).alias("_src"))
            if "link" in edges.columns:
                edges = edges.filter((F.col("link") == link) & (F.col("tgt_type") == name))
            reached = edges.join(mine, edges["src_id"] == mine["_src"], how).select(F.col("tgt_id").alias("_tgt"))
            out = rows.withColumn("_own", project_id(*to.key)).join(reached, F.col("_own") == F.col("_tgt"), how).drop("_own", "_tgt")
        else:
            mine = self.df.select(F.col(x.source_key).alias("_src"))
            out = rows.join(mine, rows[x.target_key] == mine["_src"], how).drop("_src")
        return ObjectSet(self.graph, to, out, self.facets)

    def edges(self, association: str) -> ObjectSet:
        """The association objects that start at these objects (role 0 is this type)."""
        to = self.graph.registry.association_for(self.of, association)
        role = next(r for r in to.roles if r.target == self.of.name)
        mine = self.df.select(project_id(*self.of.key).alias("_src"))
        rows = self.graph.table(to.name)
        return ObjectSet(self.graph, to, rows.join(mine, rows[role.column].cast("string") == mine["_src"], "left_semi"), self.facets)

    def endpoint(self, role: str, with_edges: tuple[str, ...] = ()) -> ObjectSet:
        """The objects at one end of these associations; with ``with_edges``, one row an association with those attributes beside it."""
        r = next((r for r in self.of.roles if r.name == role), None)
        if r is None:
            raise KeyError(f"{self.of.name} has no role {role}")
        to = self.graph.registry.resolve(r.target, self.of.domain)
        rows = self.graph.table(to.name).withColumn("_own", project_id(*to.key))
        mine = self.df.select(F.col(r.column).cast("string").alias("_src"), *with_edges)
        out = rows.join(mine, F.col("_own") == F.col("_src"), "inner" if with_edges else "left_semi")
        return ObjectSet(self.graph, to, out.drop("_own", "_src"), self.facets)

    def where_edge(self, **attributes: str) -> ObjectSet:
        """Associations whose declared attributes equal the given texts; other names are an error."""
        known = {p.name for p in self.of.properties}
        if unknown := attributes.keys() - known:
            raise ValueError(f"not attributes of {self.of.name}: {', '.join(sorted(unknown))}")
        out = self
        for name, value in attributes.items():
            out = out.where(F.col(name).cast("string") == str(value))
        return out

    def walk(self, association: str, depth: int = 1, forward: bool = True, **attributes: str) -> list[ObjectSet]:
        """Objects 1 .. depth (at most 3) associations away, with the same edge filter on each level."""
        if not 1 <= depth <= MAX_DEPTH:
            raise ValueError(f"depth is 1 to {MAX_DEPTH}")
        levels, now = [], self
        for _ in range(depth):
            edge = now.edges(association).where_edge(**attributes)
            now = edge.endpoint(edge.of.roles[1 if forward else 0].name)
            levels.append(now)
        return levels

    def inverse(self, of: str, link: str, keep_paths: bool = False) -> ObjectSet:
        """From these objects back to the type ``of``, over the declared inverse of its ``link``; empty if it declares none."""
        source = self.graph.registry.resolve(of, self.of.domain)
        back = self.graph.registry.inverse(source, link)
        if back is None or back.name not in {x.name for x in self.of.links}:
            return self.graph.objects(of, self.of.domain).where(F.lit(False))
        return self.traverse(back.name, of, keep_paths)

    def narrowed(self, where: str = "", link: str = "", interface: str = "", facets: tuple[str | int, ...] = ()) -> ObjectSet:
        """A question in its fixed order: filter, then traverse, then narrow to an interface, then facets."""
        out = self
        if where:
            out = out.where_text(where)
        if link:
            out = out.traverse(link)
        if interface:
            out = out.of_interface(interface)
        return out.include(*facets) if facets else out

    # -- interfaces, facets, search --------------------------------------------

    def of_interface(self, name: str) -> ObjectSet:
        """These objects as the interface's properties; empty if the type does not implement it."""
        names = self.of.interfaces.get(name)
        rows = self.graph.interface(name).filter(F.lit(False)) if names is None else self.df.select(F.lit(self.of.name).alias("_type"), *(F.col(names.get(p, p)).alias(p) for p in self.graph.registry.interfaces[name]))
        return replace(self, df=rows)

    def include(self, *facets: str | int) -> ObjectSet:
        bits = 0
        for f in facets:
            bits |= FACETS.get(f, 0) if isinstance(f, str) else f
        return replace(self, facets=bits or 1)

    def with_facets(self) -> DataFrame:
        """The rows with a column for each facet asked for; linked objects as counts by link."""
        out = self.df
        if self.facets & FACETS["actions"]:
            out = out.withColumn("_actions", F.array(*(F.lit(a.name) for a in self.of.actions)).cast("array<string>"))
        if self.facets & FACETS["links"]:
            out = out.withColumn("_links", F.array(*(F.lit(x.name) for x in self.of.links)).cast("array<string>"))
        if self.facets & FACETS["events"]:
            out = out.withColumn("_events", F.array(*map(F.lit, self.of.events)).cast("array<string>"))
        if self.facets & FACETS["interfaces"]:
            out = out.withColumn("_interfaces", F.array(*map(F.lit, self.of.interfaces)).cast("array<string>"))
        if self.facets & FACETS["linked_objects"]:
            for x in self.of.links:
                out = self._with_count(out, x)
        return out

    def _with_count(self, rows: DataFrame, x: Link) -> DataFrame:
        """``rows`` with ``_n_<link>``: how many objects a link leads to, over keys, edge tables or the types of an interface."""
        n = f"_n_{x.name}"
        if x.edges:
            edges = self.graph.table(x.edges)
            if "link" in edges.columns:
                edges = edges.filter((F.col("link") == x.name) & (F.col("tgt_type") == x.target))
            counts, own = edges.select(F.col("src_id").alias("_k")), project_id(*self.of.key)
        else:
            far = self.graph.interface(x.target) if x.target in self.graph.registry.interfaces else self.graph.table(x.target)
            counts, own = far.select(F.col(x.target_key).alias("_k")), F.col(x.source_key)
        counts = counts.groupBy("_k").agg(F.count("*").alias(n))
        return rows.join(counts, own == counts["_k"], "left").drop("_k").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))

    def similar(self, vector: Column, column: str, top: int = 5, least: float = 0.7, metric: str = "cosine", filters: dict | None = None, post_filter: Column | None = None) -> ObjectSet:
        """The ``top`` nearest objects that reach ``least``, with ``_score``; ties by id.

        ``filters`` (column = value) and earlier conditions hold before scoring;
        ``post_filter`` after the cut, so fewer rows may come back.
        """
        if top < 1 or not 0 <= least <= 1:
            raise ValueError("top is at least 1, least is between 0 and 1")
        rows = self.df
        for name, value in (filters or {}).items():
            rows = rows.filter(F.col(name) == value)
        scored = rows.withColumn("_score", similarity(F.col(column), vector, metric)).filter(F.col("_score") >= least)
        best = scored.orderBy(F.col("_score").desc(), *self.of.key).limit(top)
        return replace(self, df=best if post_filter is None else best.filter(post_filter))

    # -- results ---------------------------------------------------------------

    def page(self, offset: int = 0, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
        """One page ordered by key, and a frame that is empty unless more rows follow."""
        ordered = self.df.orderBy(*self.of.key)
        return ordered.offset(offset).limit(size), ordered.offset(offset + size).limit(1)

    def execute(self) -> tuple[list, int, int]:
        """Rows, their number and the facets. For results that fit the driver, such as pages; ``stream`` takes any size."""
        rows = self.with_facets().collect()
        return rows, len(rows), self.facets

    def count(self) -> int:
        return self.df.count()

    def stream(self) -> Iterator:
        """Rows one after the other, a partition at a time."""
        return self.df.toLocalIterator(prefetchPartitions=True)
