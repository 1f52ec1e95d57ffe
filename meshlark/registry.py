"""The declared object types of a domain model, and checks over them.

A registry is small and lives on the driver; ``frames`` gives it as DataFrames, so that
questions about the model are ordinary queries.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


class UnknownType(KeyError):
    """No object type has that name."""


class AmbiguousType(LookupError):
    """Several domains have an object type of that name."""


@dataclass(frozen=True)
class Property:
    """A named column. ``kind`` (scalar, reference, computed, vector) is inferred if not given."""

    name: str
    type: str = "string"
    required: bool = False
    kind: str = ""
    computed: bool = False
    derived_from: tuple[str, ...] = ()
    origin: str = "declared"


@dataclass(frozen=True)
class Link:
    """A directed link: rows join where ``source_key`` of the source equals ``target_key`` of the target.

    With ``edges``, the name of an edge table (src_id, tgt_id), keys are the objects' keys.
    """

    name: str
    target: str
    source_key: str = ""
    target_key: str = ""
    cardinality: str = "1-N"
    inverse: str = ""
    self_loops: bool = False
    edges: str = ""
    origin: str = "declared"


@dataclass(frozen=True)
class Role:
    """An endpoint of an association: the type it points to and the column that holds its key."""

    name: str
    target: str
    column: str


@dataclass(frozen=True)
class Requirement:
    """A precondition: ``property`` (text such as ``status == open``), ``link`` (its name) or ``custom``."""

    kind: str
    text: str
    hard: bool = True


@dataclass(frozen=True)
class Action:
    """Something that can be done to an object."""

    name: str
    requires: tuple[Requirement, ...] = ()
    modifies: tuple[str, ...] = ()
    creates: tuple[str, ...] = ()
    emits: tuple[str, ...] = ()
    from_states: tuple[str, ...] = ()
    target: str = ""
    read_only: bool = False


@dataclass(frozen=True)
class Lifecycle:
    """States of an object and the moves between them: (from, to, action)."""

    property: str
    initial: str
    states: tuple[str, ...]
    moves: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class ObjectType:
    """A type of objects; with two ``roles`` it is an association."""

    name: str
    key: tuple[str, ...]
    domain: str = "default"
    properties: tuple[Property, ...] = ()
    links: tuple[Link, ...] = ()
    roles: tuple[Role, ...] = ()
    actions: tuple[Action, ...] = ()
    events: tuple[str, ...] = ()
    interfaces: dict[str, dict[str, str]] = field(default_factory=dict)  # interface -> its property -> ours
    interface_actions: dict[str, dict[str, str]] = field(default_factory=dict)  # interface -> its action -> ours
    lifecycle: Lifecycle | None = None
    parent: str = ""
    accepts: tuple[tuple[str, str, str], ...] = ()  # extension points: name, source domain, interface
    origin: str = "declared"

    def link(self, name: str) -> Link:
        for x in self.links:
            if x.name == name:
                return x
        raise KeyError(f"{self.name} has no link {name}")

    def property(self, name: str) -> Property | None:
        return next((p for p in self.properties if p.name == name), None)


@dataclass(frozen=True)
class CrossLink:
    """A link between types of different domains."""

    name: str
    source_domain: str
    source: str
    target_domain: str
    target: str
    point: str = ""


@dataclass(frozen=True)
class Issue:
    """A finding of a check: hard issues make a model invalid."""

    code: str
    subject: str
    message: str
    hard: bool = True


@dataclass
class Registry:
    """Object types by domain and name, interfaces (name -> properties) and cross-domain links."""

    types: list[ObjectType]
    interfaces: dict[str, tuple[str, ...]] = field(default_factory=dict)
    cross_links: list[CrossLink] = field(default_factory=list)
    chains: list[tuple[str, str, str]] = field(default_factory=list)  # workflow, consumed type, produced type

    def resolve(self, name: str, domain: str | None = None) -> ObjectType:
        """The type of that name; an error if there is none or, without a domain, several."""
        found = [t for t in self.types if t.name == name and domain in (None, t.domain)]
        if not found:
            raise UnknownType(name)
        if len(found) > 1:
            raise AmbiguousType(f"{name} is in domains {', '.join(sorted(t.domain for t in found))}")
        return found[0]

    def implementors(self, interface: str) -> list[ObjectType]:
        return sorted((t for t in self.types if interface in t.interfaces), key=lambda t: t.name)

    def subtypes(self, name: str) -> list[ObjectType]:
        return sorted((t for t in self.types if t.parent == name), key=lambda t: t.name)

    def listing(self, domain: str | None = None, interface: str | None = None, with_subtypes: bool = False) -> list[ObjectType]:
        """Types by domain and interface; with subtypes, direct children of matches are added."""
        found = [t for t in self.types if domain in (None, t.domain) and (interface is None or interface in t.interfaces)]
        if with_subtypes:
            found += [c for t in list(found) for c in self.subtypes(t.name) if c not in found]
        return found

    def kind(self, p: Property) -> str:
        """Vector if declared so, then computed, then reference to a registered type, else scalar."""
        if p.kind == "vector" or p.type.startswith("array<float"):
            return "vector"
        if p.computed:
            return "computed"
        return "reference" if any(t.name == p.type for t in self.types) else "scalar"

    def inverse(self, of: ObjectType, link: str) -> Link | None:
        """The declared inverse of a link on its target type."""
        there = of.link(link)
        return next((x for x in self.resolve(there.target, of.domain).links if x.name == there.inverse), None)

    def association_for(self, of: ObjectType, name: str) -> ObjectType:
        """The association behind a link: its target, or the only one with that endpoint, or the one with a role of that name."""
        direct = next((x for x in of.links if x.name == name), None)
        if direct and self.resolve(direct.target, of.domain).roles:
            return self.resolve(direct.target, of.domain)
        found = [t for t in self.types if any(r.target == of.name for r in t.roles)]
        if len(found) > 1:
            found = [t for t in found if t.name == name or any(r.name == name for r in t.roles)]
        if len(found) != 1:
            raise LookupError(f"{name} of {of.name} fits {len(found)} associations")
        return found[0]

    # -- derivations ---------------------------------------------------------

    def derivation_closure(self, of: ObjectType) -> dict[str, set[str]]:
        """All properties that each property is derived from, directly or not; cycles are an error."""
        direct = {p.name: set(p.derived_from) for p in of.properties}
        done: dict[str, set[str]] = {}

        def visit(name: str, path: tuple[str, ...]) -> set[str]:
            if name in path:
                raise ValueError(f"{of.name}: derivation cycle {' -> '.join([*path, name])}")
            if name not in done:
                done[name] = set().union(*({d} | visit(d, (*path, name)) for d in direct.get(name, ())))
            return done[name]

        return {p: visit(p, ()) for p in direct}

    # -- checks --------------------------------------------------------------

    def issues(self) -> list[Issue]:
        """Composition checks: names, targets, hierarchy, interfaces, lifecycles, inverses, derivations."""
        out: list[Issue] = []
        seen: set[tuple[str, str]] = set()
        for t in self.types:
            at = f"{t.domain}.{t.name}"
            if (t.domain, t.name) in seen:
                out.append(Issue("duplicate-type", at, "declared twice"))
            seen.add((t.domain, t.name))
            out += [Issue("bad-name", f"{at}.{n}", "not an identifier") for n in (t.name, *(p.name for p in t.properties), *(x.name for x in t.links)) if not NAME.match(n)]
            declared = {p.name for p in t.properties}
            out += [Issue("key-missing", f"{at}.{k}", "the key is not a property") for k in t.key if k not in declared]
            for x in t.links:
                found = [o for o in self.types if o.name == x.target]
                if not found:
                    out.append(Issue("link-target-missing", f"{at}.{x.name}", f"no type {x.target}"))
                elif len(found) > 1 and not any(o.domain == t.domain for o in found):
                    out.append(Issue("link-target-ambiguous", f"{at}.{x.name}", f"{x.target} is in several domains"))
                elif x.inverse and not any(k.name == x.inverse for o in found for k in o.links):
                    out.append(Issue("inverse-missing", f"{at}.{x.name}", f"{x.target} has no link {x.inverse}", hard=False))
            if t.roles and len(t.roles) != 2:
                out.append(Issue("association-endpoints", at, "an association has two endpoints"))
            for name, mapping in t.interfaces.items():
                if name not in self.interfaces:
                    out.append(Issue("interface-missing", f"{at}:{name}", "not declared"))
                    continue
                out += [Issue("interface-uncovered", f"{at}:{name}.{p}", "no property for it") for p in self.interfaces[name] if mapping.get(p, p) not in declared]
            acts = {a.name for a in t.actions}
            out += [Issue("interface-action-missing", f"{at}:{i}.{name}", f"no action {mine}") for i, mapping in t.interface_actions.items() for name, mine in mapping.items() if mine not in acts]
            if t.lifecycle:
                out += self._lifecycle_issues(t, t.lifecycle, at)
            try:
                self.derivation_closure(t)
            except ValueError as e:
                out.append(Issue("derivation-cycle", at, str(e)))
            up, path = t.parent, [t.name]
            while up:
                if up in path:
                    out.append(Issue("hierarchy-cycle", at, " -> ".join([*path, up])))
                    break
                path.append(up)
                up = next((o.parent for o in self.types if o.name == up), "")
        for c in self.cross_links:
            if not any(t.name == c.target and t.domain == c.target_domain for t in self.types):
                out.append(Issue("cross-target-missing", f"{c.source_domain}.{c.source}.{c.name}", f"no type {c.target_domain}.{c.target}"))
        return out

    @staticmethod
    def _lifecycle_issues(t: ObjectType, cycle: Lifecycle, at: str) -> list[Issue]:
        states, actions = set(cycle.states), {a.name for a in t.actions}
        out = [Issue("lifecycle-state", f"{at}.{s}", "unknown state") for a, b, _ in cycle.moves for s in (a, b) if s not in states]
        if cycle.initial not in states:
            out.append(Issue("lifecycle-initial", at, "the initial state is unknown"))
        return out + [Issue("lifecycle-action", f"{at}.{x}", "unknown action", hard=False) for *_, x in cycle.moves if x and x not in actions]

    def patterns(self) -> list[Issue]:
        """Design smells: writes to computed properties, missing extension points, unknown precondition properties, unreachable initial states."""
        out = []
        for t in self.types:
            at = f"{t.domain}.{t.name}"
            for a in t.actions:
                out += [Issue("Computed.Write", f"{at}.{a.name}", f"writes {m}") for m in a.modifies if (p := t.property(m)) and self.kind(p) == "computed"]
                for r in a.requires:
                    left = comparison(r.text)
                    if r.kind == "property" and left and t.property(left[0]) is None:
                        out.append(Issue("Action.PreconditionPropertyMissing", f"{at}.{a.name}", f"no property {left[0]}"))
            if t.lifecycle and t.lifecycle.moves and not any(a == t.lifecycle.initial for a, _, _ in t.lifecycle.moves):
                out.append(Issue("Lifecycle.UnreachableInitial", at, f"no move leaves {t.lifecycle.initial}", hard=False))
        for c in self.cross_links:
            target = next((t for t in self.types if (t.domain, t.name) == (c.target_domain, c.target)), None)
            if target and not any(name == c.point for name, _, _ in target.accepts):
                out.append(Issue("Link.MissingExtensionPoint", f"{c.source_domain}.{c.source}.{c.name}", f"{c.target} accepts no such link"))
        return out

    def drift(self, ingested: Registry) -> list[Issue]:
        """Differences between declared types and ingested ones of the same domain and name."""
        out = []
        theirs = {(t.domain, t.name): t for t in ingested.types}
        for t in self.types:
            other, at = theirs.get((t.domain, t.name)), f"{t.domain}.{t.name}"
            if other is None:
                out.append(Issue("type-not-ingested", at, "declared only", hard=False))
                continue
            mine, its = {p.name: p for p in t.properties}, {p.name: p for p in other.properties}
            out += [Issue("property-not-ingested", f"{at}.{n}", "declared only") for n in mine if n not in its]
            out += [Issue("property-not-declared", f"{at}.{n}", "ingested only", hard=False) for n in its if n not in mine]
            out += [Issue("property-type", f"{at}.{n}", f"{mine[n].type} and {its[n].type}") for n in mine if n in its and mine[n].type != its[n].type]
        return out

    # -- identity and frames ---------------------------------------------------

    def version(self) -> str:
        """A hash of the model that does not depend on the order of declarations."""

        def plain(x):
            if isinstance(x, dict):
                return {k: plain(v) for k, v in x.items()}
            if isinstance(x, (list, tuple)):
                return sorted((plain(v) for v in x), key=json.dumps) if x and not isinstance(x[0], str) else list(x)
            return x

        body = {"types": [asdict(t) for t in self.types], "interfaces": self.interfaces, "cross": [asdict(c) for c in self.cross_links], "chains": self.chains}
        return "sha256:" + hashlib.sha256(json.dumps(plain(body), sort_keys=True).encode()).hexdigest()

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The model as tables: types, properties, derivations, links, roles, actions, requirements, events, interfaces, interface_actions, cross_links, chains."""
        t = self.types
        rows = {
            "types": ("domain string, type string, parent string, kind string, n_properties int, n_links int, n_actions int, n_events int", [(x.domain, x.name, x.parent, "association" if x.roles else "entity", len(x.properties), len(x.links), len(x.actions), len(x.events)) for x in t]),
            "properties": ("domain string, type string, property string, data_type string, kind string, required boolean", [(x.domain, x.name, p.name, p.type, self.kind(p), p.required) for x in t for p in x.properties]),
            "derivations": ("domain string, type string, property string, source string, direct boolean", [(x.domain, x.name, p, s, s in (x.property(p) or Property(p)).derived_from) for x in t for p, all_ in self.derivation_closure(x).items() for s in sorted(all_)]),
            "links": ("domain string, type string, link string, target string, cardinality string, inverse string", [(x.domain, x.name, k.name, k.target, k.cardinality, k.inverse) for x in t for k in x.links]),
            "roles": ("domain string, type string, position int, role string, target string", [(x.domain, x.name, i, r.name, r.target) for x in t for i, r in enumerate(x.roles)]),
            "actions": ("domain string, type string, action string, read_only boolean, target string", [(x.domain, x.name, a.name, a.read_only, a.target) for x in t for a in x.actions]),
            "requirements": ("domain string, type string, action string, kind string, text string, hard boolean", [(x.domain, x.name, a.name, r.kind, r.text, r.hard) for x in t for a in x.actions for r in a.requires]),
            "effects": ("domain string, type string, action string, effect string, subject string", [(x.domain, x.name, a.name, e, s) for x in t for a in x.actions for e, all_ in (("modifies", a.modifies), ("creates", a.creates), ("emits", a.emits)) for s in all_]),
            "states": ("domain string, type string, state_from string, state_to string, action string", [(x.domain, x.name, *m) for x in t if x.lifecycle for m in x.lifecycle.moves]),
            "events": ("domain string, type string, event string", [(x.domain, x.name, e) for x in t for e in x.events]),
            "interfaces": ("interface string, domain string, type string", [(i, x.domain, x.name) for x in t for i in x.interfaces]),
            "interface_actions": ("interface string, interface_action string, domain string, type string, action string", [(i, a, x.domain, x.name, mine) for x in t for i, m in x.interface_actions.items() for a, mine in m.items()]),
            "points": ("domain string, type string, point string, source_domain string, interface string", [(x.domain, x.name, *p) for x in t for p in x.accepts]),
            "cross_links": ("link string, source_domain string, source string, target_domain string, target string, point string", [(c.name, c.source_domain, c.source, c.target_domain, c.target, c.point) for c in self.cross_links]),
            "chains": ("workflow string, consumed string, produced string", list(self.chains)),
        }
        return {k: spark.createDataFrame(v, s) for k, (s, v) in rows.items()}


_COMPARISON = re.compile(r"^\s*([A-Za-z_]\w*)\s*(==|!=|>=|<=|>|<)\s*(.+?)\s*$")


def comparison(text: str) -> tuple[str, str, str] | None:
    """``name op value`` in parts, or None if the text is not of that form."""
    m = _COMPARISON.match(text.strip().removeprefix("(").removesuffix(")"))
    return (m[1], m[2], m[3].strip("'\"")) if m else None


def merge(declared: ObjectType, ingested: ObjectType) -> ObjectType:
    """Declared fields win; properties and links known only from ingestion are added and marked."""
    props = {p.name for p in declared.properties}
    links = {x.name for x in declared.links}
    return replace(
        declared,
        properties=declared.properties + tuple(replace(p, origin="ingested") for p in ingested.properties if p.name not in props),
        links=declared.links + tuple(replace(x, origin="ingested") for x in ingested.links if x.name not in links),
    )


def apply_deltas(registry: Registry, deltas: Iterable[dict]) -> Registry:
    """A registry after a stream of edits, in order.

    Edits: add_type, update_type, remove_type, add_property, rename_property,
    remove_property, add_link, remove_link. Each has ``op``, ``domain``, ``type`` and the
    fields of its kind; an edit of an unknown type is an error.
    """
    types = {(t.domain, t.name): t for t in registry.types}
    for d in deltas:
        at = (d.get("domain", "default"), d["type"])
        if d["op"] == "add_type":
            types[at] = merge(types[at], d["value"]) if at in types else replace(d["value"], origin="ingested")
            continue
        if at not in types:
            raise UnknownType(f"{at[0]}.{at[1]}")
        t = types[at]
        match d["op"]:
            case "update_type":
                types[at] = replace(t, **d["value"])
            case "remove_type":
                del types[at]
            case "add_property":
                types[at] = replace(t, properties=tuple(p for p in t.properties if p.name != d["value"].name) + (d["value"],))
            case "rename_property":
                types[at] = replace(t, properties=tuple(replace(p, name=d["to"]) if p.name == d["name"] else p for p in t.properties))
            case "remove_property":
                types[at] = replace(t, properties=tuple(p for p in t.properties if p.name != d["name"]))
            case "add_link":
                types[at] = replace(t, links=tuple(x for x in t.links if x.name != d["value"].name) + (d["value"],))
            case "remove_link":
                types[at] = replace(t, links=tuple(x for x in t.links if x.name != d["name"]))
            case other:
                raise ValueError(f"unknown edit {other}")
    return replace(registry, types=list(types.values()))


class SourceFailed(RuntimeError):
    """A source of edits failed; the cause says how."""


def drain(registry: Registry, sources: dict[str, Iterable[dict]]) -> Registry:
    """A registry after all edits of all sources, in the order of the sources; what goes wrong names its source."""
    for name, deltas in sources.items():
        try:
            registry = apply_deltas(registry, deltas)
        except Exception as e:
            raise SourceFailed(f"source {name} failed") from e
    return registry


def schema_changes(old: ObjectType, new: ObjectType) -> list[tuple[str, str]]:
    """(level, change) between two versions of a type: breaking, notice or compatible."""
    mine, its = {p.name: p for p in old.properties}, {p.name: p for p in new.properties}
    out = [("breaking", f"removed {n}") for n in mine if n not in its]
    out += [("breaking" if its[n].required else "compatible", f"added {n}") for n in its if n not in mine]
    for n in mine.keys() & its.keys():
        if mine[n].type != its[n].type:
            out.append(("breaking", f"type of {n}"))
        if mine[n].required != its[n].required:
            out.append(("breaking" if its[n].required else "notice", f"required of {n}"))
    return sorted(out)
