import pytest
from pyspark.sql import functions as F

from meshlark.functions import identity
from meshlark.functions.vectors import similarity, vector_literal
from meshlark.operators import relate as R
from meshlark.operators.objectset import Graph
from meshlark.registry import (Action, AmbiguousType, CrossLink, Lifecycle, Link, ObjectType, Property, Registry, Requirement, Role, UnknownType, apply_deltas, comparison, merge, schema_changes)


def tiny():
    node = ObjectType("node", ("id",), "a", (Property("id"), Property("weight", "int")), (Link("knows", "node", edges="edges"), Link("tied", "tie")))
    tie = ObjectType("tie", ("id",), "a", (Property("id"), Property("from_id"), Property("to_id"), Property("status")), roles=(Role("source", "node", "from_id"), Role("target", "node", "to_id")))
    return Registry([node, tie])


@pytest.fixture
def g(spark):
    tables = {
        "node": spark.createDataFrame([("n1", 1), ("n2", 2), ("n3", 3)], "id string, weight int"),
        "tie": spark.createDataFrame([("t1", "n1", "n2", "open"), ("t2", "n2", "n3", "shut"), ("t3", "n1", "gone", "open"), ("t4", "n3", "n3", "open")], "id string, from_id string, to_id string, status string"),
        "edges": spark.createDataFrame([("n1", "knows", "node", "n2"), ("n3", "knows", "node", "n2"), ("n1", "knows", "node", "gone"), ("n1", "other", "node", "n3")], "src_id string, link string, tgt_type string, tgt_id string"),
    }
    return Graph(tiny(), tables.__getitem__)


def ids(s):
    return sorted(r["id"] for r in s.df.collect())


def test_targets_come_once_or_by_path(g):
    assert ids(g.objects("node").traverse("knows")) == ["n2"]  # an unknown target is left out
    assert ids(g.objects("node").traverse("knows", keep_paths=True)) == ["n2", "n2"]


def test_filter_after_a_hop_holds(g):
    assert ids(g.objects("node").traverse("knows").where(F.col("weight") > 2)) == []


def test_associations_walk_and_self_loop(g):
    levels = g.objects("node").by_id("n1").walk("tied", 2)
    assert [ids(x) for x in levels] == [["n2"], ["n3"]]
    assert ids(g.objects("node").by_id("n3").walk("tied", 1)[0]) == ["n3"]
    assert ids(g.objects("node").by_id("n2").walk("tied", 1, status="open")[0]) == []
    with pytest.raises(ValueError):
        g.objects("node").walk("tied", 4)
    with pytest.raises(ValueError):
        g.objects("node").edges("tied").where_edge(colour="red")


def test_endpoints_keep_their_edge(g):
    e = g.objects("node").edges("tied").endpoint("target", ("status",)).df
    assert sorted((r["id"], r["status"]) for r in e.collect()) == [("n2", "open"), ("n3", "open"), ("n3", "shut")]


def test_text_filter_knows_its_columns(g):
    assert ids(g.objects("node").where_text("weight >= 2 and id <> 'x or y'")) == ["n2", "n3"]
    with pytest.raises(ValueError):
        g.objects("node").where_text("secret = 1")


def test_pages(g):
    page, more = g.objects("node").page(0, 2)
    assert [r["id"] for r in page.collect()] == ["n1", "n2"] and more.count() == 1
    token = identity.encode_cursor("node", "n1", "knows", "out", 7)
    assert identity.decode_cursor(token, "node", "n1", "knows", "out") == 7
    assert identity.decode_cursor(token, "node", "n2", "knows", "out") == identity.decode_cursor("%%", "node", "n1", "knows", "out") == 0


def test_names_and_ids(spark):
    with pytest.raises(UnknownType):
        tiny().resolve("none")
    two = Registry([ObjectType("x", ("id",), "a"), ObjectType("x", ("id",), "b")])
    with pytest.raises(AmbiguousType):
        two.resolve("x")
    assert two.resolve("x", "b").domain == "b"
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "N"), ("N", None)], "x string, y string")
    assert len({r[0] for r in rows.select(identity.project_id("x", "y")).collect()}) == 4
    assert identity.snake_case("HTTPServerName") == "http_server_name"
    assert len(identity.short_identifier("ä" * 80).encode()) <= 63
    ok = [r[0] for r in spark.createDataFrame([("a b",), (" ",), ("é",), (None,)], "v string").select(identity.valid_identity(F.col("v"))).collect()]
    assert ok == [True, False, False, False]


def test_odd_vectors_score_zero(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, []), (5, None), (6, [2.0, 0.0])], "id int, v array<double>")
    got = {r[0]: r[1] for r in rows.select("id", similarity(F.col("v"), vector_literal([1.0, 0.0]))).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0}


def test_relate_reasons_and_repeats(spark):
    objects = spark.createDataFrame([("n", "1"), ("n", "2"), ("m", "1")], "type string, id string")
    links = spark.createDataFrame([("n", "to", "n", False), ("n", "self", "n", True)], "src_type string, link string, tgt_type string, self_loops boolean")
    schema = "src_type string, src_id string, link string, tgt_type string, tgt_id string, assoc_id string"
    c = spark.createDataFrame([("n", "1", "to", "n", "2", None)] * 2 + [("n", "1", "to", "n", "1", None), ("n", "1", "self", "n", "1", None), ("n", "9", "to", "n", "1", None), ("n", "1", "to", "n", "9", None), ("n", None, "to", "n", "1", None), ("n", "1", "to", "m", "1", None), ("n", "2", "to", "n", "1", "a")], schema)
    old = spark.createDataFrame([("n", "2", "to", "n", "1", "a")], schema)
    new, refused = R.relate(c, old, objects, links)
    assert sorted((r["src_id"], r["link"], r["tgt_id"]) for r in new.collect()) == [("1", "self", "1"), ("1", "to", "2")]
    assert sorted((str(r["src_id"]), r["tgt_type"], r["tgt_id"], r["reason"]) for r in refused.collect()) == [("1", "m", "1", "undeclared-link"), ("1", "n", "1", "self-loop"), ("1", "n", "9", "missing-target"), ("9", "n", "1", "missing-source"), ("None", "n", "1", "missing-source")]
    objs = spark.createDataFrame([("a", 1), ("b", 2)], "id string, w int")
    edges = spark.createDataFrame([("n", "2", "to", "n", "1", "a"), ("n", "1", "to", "n", "2", "a"), ("n", "1", "to", "n", "2", "b")], schema)
    left, kept = R.unrelate_attributed(edges, objs, edges.filter("src_id = '2' or assoc_id = 'b'"))
    assert left.count() == 1 and [r["id"] for r in kept.collect()] == ["a"]
    assert R.missing_endpoints(c, objects).count() == 3


def test_checks_find_faults():
    bad = Registry(
        [
            ObjectType("a", ("id",), "d", (Property("id"), Property("p", derived_from=("q",)), Property("q", derived_from=("p",))), (Link("x", "nowhere"), Link("y", "b", inverse="none")), parent="b", interfaces={"I": {}, "J": {}}),
            ObjectType("b", ("key",), "d", (), parent="a", roles=(Role("r", "a", "c"),), lifecycle=Lifecycle("s", "new", ("old",), (("old", "gone", "act"),))),
            ObjectType("b", ("key",), "d"),
        ],
        {"I": ("need",)},
        [CrossLink("c", "d", "a", "e", "z")],
    )
    codes = {i.code for i in bad.issues()}
    assert codes >= {"duplicate-type", "key-missing", "link-target-missing", "inverse-missing", "association-endpoints", "interface-missing", "interface-uncovered", "lifecycle-state", "lifecycle-initial", "derivation-cycle", "hierarchy-cycle", "cross-target-missing"}
    assert not [i for i in tiny().issues() if i.hard]
    t = ObjectType("t", ("id",), properties=(Property("id"), Property("c", computed=True)), actions=(Action("w", (Requirement("property", "zzz > 1"),), modifies=("c",)),), lifecycle=Lifecycle("s", "new", ("new", "old"), (("old", "new", "w"),)))
    assert {i.code for i in Registry([t]).patterns()} == {"Computed.Write", "Action.PreconditionPropertyMissing", "Lifecycle.UnreachableInitial"}


def test_version_merge_and_edits():
    a = Registry([ObjectType("x", ("id",), "d", (Property("id"), Property("n", "int"))), ObjectType("y", ("id",), "d")])
    b = Registry(list(reversed(a.types)))
    assert a.version() == b.version() != apply_deltas(a, [{"op": "remove_type", "domain": "d", "type": "y"}]).version()
    m = merge(a.types[0], ObjectType("x", ("id",), "d", (Property("n", "string"), Property("extra"))))
    assert [(p.name, p.type, p.origin) for p in m.properties] == [("id", "string", "declared"), ("n", "int", "declared"), ("extra", "string", "ingested")]
    edits = [
        {"op": "add_type", "domain": "d", "type": "z", "value": ObjectType("z", ("id",), "d")}, {"op": "add_property", "domain": "d", "type": "z", "value": Property("p")}, {"op": "rename_property", "domain": "d", "type": "z", "name": "p", "to": "q"},
        {"op": "add_link", "domain": "d", "type": "z", "value": Link("l", "x")}, {"op": "remove_link", "domain": "d", "type": "z", "name": "l"}, {"op": "update_type", "domain": "d", "type": "z", "value": {"parent": "x"}}, {"op": "remove_property", "domain": "d", "type": "z", "name": "q"},
    ]
    z = apply_deltas(a, edits).resolve("z")
    assert (z.parent, z.properties, z.links) == ("x", (), ())
    with pytest.raises(UnknownType):
        apply_deltas(a, [{"op": "add_link", "domain": "d", "type": "none", "value": None}])
    assert ("breaking", "removed n") in schema_changes(a.types[0], ObjectType("x", ("id",), "d", (Property("id"),)))
    assert comparison("(status == 'open')") == ("status", "==", "open") and comparison("foo(bar)") is None
