"""Questions about the model itself, as joins over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compare_text
from ..registry import Registry, comparison
from ..sources.lineage import cut_lineage

SCOPES = ("Local", "Domain", "CrossDomain", "Global")


def reach(edges: DataFrame, starts: DataFrame, depth: int = 2, source: str = "src", target: str = "dst") -> DataFrame:
    """Nodes within ``depth`` steps of ``starts`` (column node) and the first step that reaches each.

    A step joins the newest nodes only; nodes that were seen are taken out. Each step is
    checkpointed, so the plan stays short, and the walk ends when nothing is new.
    """
    found = newest = cut_lineage(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        nxt = newest.join(edges, newest["node"] == edges[source]).select(F.col(target).alias("node")).distinct()
        newest = cut_lineage(nxt.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)))
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
    return found


def model_edges(frames: dict[str, DataFrame]) -> DataFrame:
    """All ways in which a change of one type reaches another: src, dst, hop (set when domains differ).

    Links and action targets within a domain, and cross-domain links both ways. Types are
    written domain.type.
    """
    name = lambda d, t: F.concat_ws(".", d, t)
    types = frames["types"].select(F.col("domain").alias("td"), F.col("type").alias("tt"))
    links = frames["links"].join(types, (F.col("target") == F.col("tt")) & (F.col("domain") == F.col("td"))).select(name("domain", "type").alias("src"), name("td", "tt").alias("dst"))
    acts = frames["actions"].filter("target <> ''").join(types, (F.col("target") == F.col("tt")) & (F.col("domain") == F.col("td"))).select(name("domain", "type").alias("src"), name("td", "tt").alias("dst"))
    cross = frames["cross_links"].select(name("source_domain", "source").alias("src"), name("target_domain", "target").alias("dst"))
    both = cross.unionByName(cross.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = links.unionByName(acts).distinct().withColumn("hop", F.lit(False))
    return near.unionByName(both.distinct().withColumn("hop", F.lit(True)))


def blast_radius(frames: dict[str, DataFrame], touched: list[str], depth: int = 16) -> tuple[DataFrame, str]:
    """Types that a change of ``touched`` (domain.type) reaches, and how far that goes.

    Local: one type of one domain, no cross-domain hop; Domain: several; CrossDomain:
    hops between up to three domains; Global: more. The edges of a model are few: the walk
    over them is made on the driver.
    """
    steps: dict[str, list[tuple[str, bool]]] = {}
    for e in model_edges(frames).collect():
        steps.setdefault(e["src"], []).append((e["dst"], e["hop"]))
    found, newest, crossed = dict.fromkeys(touched, 0), sorted(set(touched)), False
    for step in range(1, depth + 1):
        fresh = {}
        for node in newest:
            for target, hop in sorted(steps.get(node, [])):
                if target not in found and target not in fresh:
                    fresh[target] = step
                    crossed |= hop
        found |= fresh
        newest = sorted(fresh)
    domains = {n.split(".")[0] for n in found}
    if crossed:
        scope = "Global" if len(domains) > 3 else "CrossDomain"
    else:
        scope = "Local" if len(set(touched)) == 1 else "Domain"
    rows = [(n, d) for n, d in sorted(found.items()) if d]
    return frames["types"].sparkSession.createDataFrame(rows, "node string, depth int"), scope


def association_edges(frames: dict[str, DataFrame]) -> DataFrame:
    """Each association as an edge between the types of its two roles."""
    r = frames["roles"]
    a = r.filter("position = 0").select("domain", F.col("type").alias("association"), F.col("target").alias("src"))
    b = r.filter("position = 1").select("domain", F.col("type").alias("association"), F.col("target").alias("dst"))
    return a.join(b, ["domain", "association"]).select("association", "src", "dst")


def explore(frames: dict[str, DataFrame], scope: str, domain: str | None = None, type_name: str | None = None) -> DataFrame:
    """One of the model's lists, by domain and type where it has them. An unknown scope has no rows."""
    types, roles = frames["types"], frames["roles"]
    searchable = frames["properties"].filter("kind = 'vector'")
    names = lambda rows, column, *by: rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(column))
    at = ["domain", "type"]
    match scope:
        case "domains":
            rows = types.groupBy("domain").agg(F.count("*").alias("n_types"))
        case "objectTypes":
            ends = names(roles.withColumn("endpoints", F.concat_ws(":", "role", "target")), "endpoints", *at)
            rows = types.join(ends, at, "left").join(searchable.select(*at, F.lit(True).alias("searchable")).distinct(), at, "left")
            rows = rows.select(*at, "kind", "n_properties", "n_links", "n_actions", "n_events", F.coalesce("searchable", F.lit(False)).alias("searchable"), F.coalesce("endpoints", F.lit("")).alias("endpoints"))
        case "associations":
            ends = names(roles.withColumn("endpoints", F.concat_ws(":", "role", "target")), "endpoints", *at)
            rows = ends.join(names(frames["properties"].withColumnRenamed("property", "attributes"), "attributes", *at), at, "left")
        case "interfaces":
            rows = frames["interfaces"].groupBy("interface").agg(F.count("*").alias("n_types"))
        case "vectorProperties":
            rows = searchable
        case "actions" | "links" | "events":
            rows = frames[scope]
        case "workflowChains":
            rows = frames["chains"]
        case _:
            rows = types.limit(0)
    for column, value in (("domain", domain), ("type", type_name)):
        if value is not None and column in rows.columns:
            rows = rows.filter(F.col(column) == value)
    return rows


def explore_from(frames: dict[str, DataFrame], domain: str, type_name: str, depth: int = 2) -> DataFrame:
    """Types that links lead to from one type within its domain: type, link, depth (the first that reaches it)."""
    links = frames["links"].filter(F.col("domain") == domain).select(F.col("type").alias("src"), "link", F.col("target").alias("dst"))
    start = frames["types"].filter((F.col("domain") == domain) & (F.col("type") == type_name)).select(F.col("type").alias("node"))
    found = reach(links, start, depth).filter("depth > 0")
    # The links that lead to each type on its first step.
    before = reach(links, start, depth).select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    return links.join(before, "src").join(found.withColumnRenamed("node", "dst"), ["dst", "depth"]).select(F.col("dst").alias("type"), "link", "depth").distinct()


def affected_properties(frames: dict[str, DataFrame], type_name: str, name: str) -> DataFrame:
    """Properties derived from one property, directly or through others."""
    return frames["derivations"].filter((F.col("type") == type_name) & (F.col("source") == name)).select("property", F.when(F.col("direct"), "direct").otherwise("transitive").alias("how"))


def matched_points(frames: dict[str, DataFrame]) -> DataFrame:
    """Cross-domain links against the extension points of their targets: matched, wrong-interface or no-point."""
    points = frames["points"].select(F.col("domain").alias("target_domain"), F.col("type").alias("target"), F.col("point"), F.col("source_domain").alias("_from"), F.col("interface").alias("_needs"))
    rows = frames["cross_links"].join(points, ["target_domain", "target", "point"], "left")
    has = frames["interfaces"].select(F.col("domain").alias("source_domain"), F.col("type").alias("source"), F.col("interface").alias("_needs"), F.lit(True).alias("_has"))
    rows = rows.join(has, ["source_domain", "source", "_needs"], "left")
    verdict = F.when(F.col("_from").isNull() | ~F.col("_from").isin("", "*") & (F.col("_from") != F.col("source_domain")), "no-point").when((F.col("_needs") != "") & F.col("_has").isNull(), "wrong-interface").otherwise("matched")
    return rows.select("link", "source_domain", "source", "target_domain", "target", verdict.alias("verdict"))


def chain_types(frames: dict[str, DataFrame]) -> DataFrame:
    """Workflows with the types they consume and produce; unknown or ambiguous names are marked."""
    n = frames["types"].groupBy("type").agg(F.count("*").alias("n"))
    a, b = n.withColumnsRenamed({"type": "consumed", "n": "_a"}), n.withColumnsRenamed({"type": "produced", "n": "_b"})
    state = lambda c: F.when(F.col(c).isNull(), "unresolved").when(F.col(c) > 1, "ambiguous").otherwise("ok")
    return frames["chains"].join(a, "consumed", "left").join(b, "produced", "left").select("workflow", "consumed", "produced", state("_a").alias("consumed_state"), state("_b").alias("produced_state"))


def satisfied(requirement_text: str, kind: str, row_values: dict[str, Column]) -> Column:
    """Whether a precondition holds for known values.

    Links: a known truthy value; missing is false. Properties: unknown or unreadable is
    taken as satisfied. Custom ones always hold.
    """
    if kind == "link":
        v = row_values.get(requirement_text)
        return F.lit(False) if v is None else F.coalesce(v.cast("boolean"), F.lit(False))
    parts = comparison(requirement_text) if kind == "property" else None
    if parts is None or parts[0] not in row_values:
        return F.lit(True)
    return F.coalesce(compare_text(row_values[parts[0]].cast("string"), parts[1], parts[2]), F.lit(True))


def constraint_report(registry: Registry, rows: DataFrame, type_name: str, key: str) -> DataFrame:
    """For each object and action: whether all hard requirements hold, and what fails.

    Columns: ``key``, action, available, failed_hard, failed_soft (texts).
    """
    known = {c: F.col(c) for c in rows.columns}
    reports = []
    for a in registry.resolve(type_name).actions:
        hard = [F.when(~satisfied(r.text, r.kind, known), F.lit(r.text)) for r in a.requires if r.hard]
        soft = [F.when(~satisfied(r.text, r.kind, known), F.lit(r.text)) for r in a.requires if not r.hard]
        failed = lambda parts: F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
        reports.append(F.struct(F.lit(a.name).alias("action"), failed(hard).alias("failed_hard"), failed(soft).alias("failed_soft")))
    out = rows.select(key, F.explode(F.array(*reports)).alias("r")).select(key, "r.*")
    return out.select(key, "action", (F.size("failed_hard") == 0).alias("available"), F.array_join("failed_hard", "; ").alias("failed_hard"), F.array_join("failed_soft", "; ").alias("failed_soft"))


def actions_in_state(frames: dict[str, DataFrame], type_name: str, state: str) -> DataFrame:
    """Actions that a state allows, and those that no move of the lifecycle names."""
    acts = frames["actions"].filter(F.col("type") == type_name).select("action")
    moves = frames["states"].filter(F.col("type") == type_name)
    free = acts.join(moves.select("action"), "action", "left_anti")
    return moves.filter(F.col("state_from") == state).select("action").distinct().unionByName(free)


def dispatch(rows: DataFrame, key: str, act, read_only: bool = True, only_reads: bool = False, observers: tuple = ()) -> DataFrame:
    """Runs ``act(row dict)`` for every object: key, ok, error. One failure doesn't stop the others.

    Each of ``observers`` is called with (row dict, ok, error) after an act, where the act
    ran; what goes wrong in one of them changes nothing.
    """
    import contextlib

    import pandas as pd

    if only_reads and not read_only:
        raise PermissionError("the action is not read-only")
    kind = rows.schema[key].dataType.simpleString()

    def task(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                ok, error = True, None
                try:
                    act(r)
                except Exception as e:
                    ok, error = False, f"{type(e).__name__}: {e}"
                for tell in observers:
                    with contextlib.suppress(Exception):
                        tell(r, ok, error)
                out.append((r[key], ok, error))
            yield pd.DataFrame(out, columns=[key, "ok", "error"])

    return rows.mapInPandas(task, f"`{key}` {kind}, ok boolean, error string")


def reported(registry: Registry, rows: DataFrame, type_name: str, action: str, key: str, results: DataFrame) -> DataFrame:
    """Results of a dispatch with the requirements of the action that each object failed: failed_hard, failed_soft.

    The report changes no result; objects that fail nothing, and actions without
    requirements, have empty texts.
    """
    report = constraint_report(registry, rows, type_name, key).filter(F.col("action") == action).drop("action", "available")
    out = results.join(report, key, "left")
    return out.select(*results.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in ("failed_hard", "failed_soft")))


def validate_design(registry: Registry, frames: dict[str, DataFrame], touched: list[str], covered: set[str] | None = None) -> dict:
    """Violations, blast radius, smells and coverage of a change; it passes without hard findings.

    ``covered``: the types (domain.type) that tests cover; those of the change and its
    radius that they miss are named in ``uncovered``.
    """
    found = registry.issues() + registry.patterns()
    radius, scope = blast_radius(frames, touched)
    reached = [r["node"] for r in radius.collect()]
    out = {"hard": [i for i in found if i.hard], "soft": [i for i in found if not i.hard], "scope": scope, "radius": reached, "passed": not any(i.hard for i in found)}
    if covered is not None:
        out["uncovered"] = sorted({*touched, *reached} - covered)
    return out
