"""Questions about the model: listings, reach, constraints, smells."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import graph as G
from .base import Catalogue, table
from .domain import model

C = Catalogue()

LINKS = """links(src, dst) AS (VALUES ('trade.region', 'trade.nation'), ('trade.nation', 'trade.region'), ('trade.nation', 'trade.customer'), ('trade.nation', 'trade.supplier'), ('trade.customer', 'trade.nation'), ('trade.customer', 'trade.orders'),
  ('trade.supplier', 'trade.nation'), ('trade.supplier', 'trade.lineitem'), ('trade.part', 'trade.lineitem'), ('trade.orders', 'trade.customer'), ('trade.orders', 'trade.lineitem'), ('trade.lineitem', 'trade.part'), ('trade.lineitem', 'trade.supplier'), ('knowledge.documents', 'knowledge.labels'), ('dialogue.conversations', 'dialogue.conversations')),
crossing(src, dst) AS (VALUES ('trade.customer', 'knowledge.documents'), ('knowledge.documents', 'trade.customer'), ('trade.part', 'knowledge.documents'), ('knowledge.documents', 'trade.part'), ('dialogue.conversations', 'knowledge.documents'), ('knowledge.documents', 'dialogue.conversations'))"""


def _frames(spark):
    return model().frames(spark)


@C.model_check(f"WITH RECURSIVE {LINKS}, walk(node, depth) AS (SELECT 'trade.customer', 0 UNION SELECT dst, depth + 1 FROM walk JOIN links ON node = src WHERE depth < 2) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node")
def schema_bfs(spark, sf_dir):
    f = _frames(spark)
    edges = G.model_edges(f).filter("NOT hop")
    return G.reach(edges, spark.createDataFrame([("trade.customer",)], "node string"), 2)


@C.model_check(f"WITH RECURSIVE {LINKS}, walk(node, depth) AS (SELECT 'trade.supplier', 0 UNION SELECT e.dst, depth + 1 FROM walk JOIN (SELECT * FROM links UNION SELECT * FROM crossing) e ON node = src WHERE depth < 12) SELECT node, CAST(min(depth) AS INTEGER) AS depth, 'CrossDomain' AS scope FROM walk GROUP BY node HAVING min(depth) > 0")
def blast_radius(spark, sf_dir):
    radius, scope = G.blast_radius(_frames(spark), ["trade.supplier"])
    return radius.withColumn("scope", F.lit(scope))


@C.model_check("SELECT * FROM (VALUES ('standing', 'c_acctbal', true), ('offer', 'standing', true), ('offer', 'c_mktsegment', true), ('offer', 'c_acctbal', false)) t(property, source, direct)")
def derivation_closure(spark, sf_dir):
    return _frames(spark)["derivations"].filter("type = 'customer'").select("property", "source", "direct")


@C.model_check("SELECT * FROM (VALUES ('standing', 'direct'), ('offer', 'transitive')) t(property, how)")
def affected_properties(spark, sf_dir):
    return G.affected_properties(_frames(spark), "customer", "c_acctbal")


@C.model_check("SELECT * FROM (VALUES ('trade', 7), ('knowledge', 3), ('dialogue', 1)) t(domain, n_types)")
def explore_domains(spark, sf_dir):
    return G.explore(_frames(spark), "domains").select("domain", F.col("n_types").cast("int").alias("n_types"))


@C.model_check("SELECT * FROM (VALUES ('customer'), ('supplier')) t(type)")
def implementors(spark, sf_dir):
    return _frames(spark)["interfaces"].filter("interface = 'Party'").select("type")


@C.model_check("SELECT * FROM (VALUES ('lineitem', 'orders', 'part')) t(association, src, dst)")
def association_edges(spark, sf_dir):
    return G.association_edges(_frames(spark))


@C.model_check("SELECT * FROM (VALUES ('embeddings', 'embedding')) t(type, property)")
def vector_properties(spark, sf_dir):
    return G.explore(_frames(spark), "vectorProperties").select("type", "property")


@C.model_check("SELECT * FROM (VALUES ('mentions', 'matched'), ('cites', 'wrong-interface'), ('asks', 'no-point')) t(link, verdict)")
def extension_points(spark, sf_dir):
    return G.matched_points(_frames(spark)).select("link", "verdict")


@C.model_check("SELECT * FROM (VALUES ('fulfil', 'ok', 'ok'), ('embed', 'ok', 'ok'), ('lost', 'ok', 'unresolved')) t(workflow, consumed_state, produced_state)")
def workflow_chains(spark, sf_dir):
    return G.chain_types(_frames(spark)).select("workflow", "consumed_state", "produced_state")


@C.query("""SELECT c_custkey, 'close' AS action, c_acctbal >= 0 AS available, CASE WHEN c_acctbal >= 0 THEN '' ELSE 'c_acctbal >= 0' END AS failed_hard, CASE WHEN c_mktsegment <> 'BUILDING' THEN '' ELSE 'c_mktsegment != BUILDING' END AS failed_soft FROM customer
UNION ALL SELECT c_custkey, 'contact', c_nationkey % 2 = 0, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'nation_known' END, '' FROM customer UNION ALL SELECT c_custkey, 'score', true, '', '' FROM customer""")
def constraint_report(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("nation_known", F.col("c_nationkey") % 2 == 0)
    return G.constraint_report(model(), rows, "customer", "c_custkey")


@C.model_check("SELECT * FROM (VALUES ('ship'), ('audit')) t(action)")
def actions_in_state(spark, sf_dir):
    return G.actions_in_state(_frames(spark), "orders", "O")


@C.model_check("SELECT * FROM (VALUES ('Computed.Write', 'trade.customer.score', true), ('Link.MissingExtensionPoint', 'dialogue.conversations.asks', true)) t(code, subject, hard)")
def pattern_violations(spark, sf_dir):
    return spark.createDataFrame([(i.code, i.subject, i.hard) for i in model().patterns()], "code string, subject string, hard boolean")


@C.query("SELECT c_custkey, c_acctbal >= 0 AS ok FROM customer")
def bulk_dispatch(spark, sf_dir):
    def act(row):
        if row["c_acctbal"] < 0:
            raise ValueError("negative balance")

    return G.dispatch(table(spark, sf_dir, "customer"), "c_custkey", act, read_only=False).select("c_custkey", "ok")


@C.model_check("""SELECT * FROM (VALUES ('documents', 'entity', 5, 1, 0, 0, false, ''), ('labels', 'entity', 3, 0, 0, 0, false, ''), ('embeddings', 'entity', 3, 0, 0, 0, true, '')) t(type, kind, n_properties, n_links, n_actions, n_events, searchable, endpoints)
UNION ALL SELECT 'lineitem', 'association', 11, 2, 0, 0, false, 'order:orders,part:part'""")
def explore_object_types(spark, sf_dir):
    t = G.explore(_frames(spark), "objectTypes")
    return t.filter("domain = 'knowledge' OR kind = 'association'").drop("domain")


@C.model_check("SELECT * FROM (VALUES ('customer', 'close', false, ''), ('customer', 'contact', true, ''), ('customer', 'score', false, 'orders')) t(type, action, read_only, target)")
def explore_actions(spark, sf_dir):
    return G.explore(_frames(spark), "actions", "trade", "customer").drop("domain")


@C.model_check("SELECT * FROM (VALUES ('nation', 'region', 'region', 'N-1', 'nations'), ('nation', 'customers', 'customer', '1-N', 'nation'), ('nation', 'suppliers', 'supplier', '1-N', 'nation'), ('nation', 'parties', 'Party', '1-N', '')) t(type, link, target, cardinality, inverse)")
def explore_links(spark, sf_dir):
    return G.explore(_frames(spark), "links", "trade", "nation").drop("domain")


@C.model_check("SELECT 'lineitem' AS type, 'order:orders,part:part' AS endpoints, 'l_discount,l_extendedprice,l_linenumber,l_linestatus,l_orderkey,l_partkey,l_quantity,l_returnflag,l_shipdate,l_suppkey,l_tax' AS attributes")
def explore_associations(spark, sf_dir):
    return G.explore(_frames(spark), "associations", "trade").drop("domain")


@C.model_check("SELECT * FROM (VALUES ('placed'), ('shipped')) t(event)")
def explore_events(spark, sf_dir):
    return G.explore(_frames(spark), "events", "trade", "orders").select("event")


@C.model_check("SELECT 'Party' AS interface, 2::BIGINT AS n_types")
def explore_interfaces(spark, sf_dir):
    return G.explore(_frames(spark), "interfaces")


@C.model_check("SELECT * FROM (VALUES ('fulfil', 'orders', 'lineitem'), ('embed', 'documents', 'embeddings'), ('lost', 'orders', 'parcel')) t(workflow, consumed, produced)")
def explore_workflow_chains(spark, sf_dir):
    return G.explore(_frames(spark), "workflowChains")


@C.model_check("SELECT * FROM (VALUES ('nation', 'nation', 1), ('orders', 'orders', 1), ('region', 'region', 2), ('supplier', 'suppliers', 2), ('Party', 'parties', 2), ('lineitem', 'lines', 2)) t(type, link, depth)")
def explore_traversal(spark, sf_dir):
    return G.explore_from(_frames(spark), "trade", "customer", 2)


@C.query("SELECT c_custkey, c_acctbal >= 0 AS ok, CASE WHEN c_acctbal >= 0 THEN '' ELSE 'c_acctbal >= 0' END AS failed_hard, CASE WHEN c_mktsegment <> 'BUILDING' THEN '' ELSE 'c_mktsegment != BUILDING' END AS failed_soft FROM customer")
def reported_dispatch(spark, sf_dir):
    def act(row):
        if row["c_acctbal"] < 0:
            raise ValueError("negative balance")

    rows = table(spark, sf_dir, "customer")
    done = G.dispatch(rows.select("c_custkey", "c_acctbal"), "c_custkey", act, read_only=False).select("c_custkey", "ok")
    return G.reported(model(), rows, "customer", "close", "c_custkey", done)


def _faulty():
    """A model with one fault of each kind in its links, lifecycle and interfaces."""
    return R.Registry(
        [
            R.ObjectType("order", ("id",), "shop", (R.Property("id"),), (R.Link("lines", "line"), R.Link("buyer", "person", inverse="orders"), R.Link("parcel", "parcel")), interfaces={"Named": {}, "Priced": {}}, interface_actions={"Named": {"rename": "none"}}),
            R.ObjectType("person", ("id",), "crm", (R.Property("id"),), parent="human"),
            R.ObjectType("human", ("code",), "crm", (R.Property("id"),), parent="person"),
            R.ObjectType("parcel", ("id",), "post", (R.Property("id"),), lifecycle=R.Lifecycle("state", "new", ("sent",), (("sent", "lost", "lose"),))),
            R.ObjectType("parcel", ("id",), "mail", (R.Property("id"),), roles=(R.Role("a", "order", "id"),)),
        ],
        {"Named": ("name",)},
        [R.CrossLink("ships", "shop", "order", "post", "box")],
    )


@C.model_check("""SELECT * FROM (VALUES ('link-target-missing', 'shop.order.lines', true), ('inverse-missing', 'shop.order.buyer', false), ('link-target-ambiguous', 'shop.order.parcel', true), ('interface-uncovered', 'shop.order:Named.name', true), ('interface-missing', 'shop.order:Priced', true),
  ('interface-action-missing', 'shop.order:Named.rename', true), ('hierarchy-cycle', 'crm.person', true), ('hierarchy-cycle', 'crm.human', true), ('key-missing', 'crm.human.code', true), ('lifecycle-state', 'post.parcel.lost', true), ('lifecycle-initial', 'post.parcel', true),
  ('lifecycle-action', 'post.parcel.lose', false), ('association-endpoints', 'mail.parcel', true), ('cross-target-missing', 'shop.order.ships', true)) t(code, subject, hard)""")
def composition_checks(spark, sf_dir):
    return spark.createDataFrame([(i.code, i.subject, i.hard) for i in _faulty().issues()], "code string, subject string, hard boolean")


@C.model_check("SELECT * FROM (VALUES ('property-not-ingested', 'shop.item.price', true), ('property-not-declared', 'shop.item.colour', false), ('property-type', 'shop.item.size', true), ('type-not-ingested', 'shop.shelf', false)) t(code, subject, hard)")
def schema_drift(spark, sf_dir):
    mine = R.Registry([R.ObjectType("item", ("id",), "shop", (R.Property("id"), R.Property("price", "double"), R.Property("size", "int"))), R.ObjectType("shelf", ("id",), "shop", (R.Property("id"),))])
    found = R.Registry([R.ObjectType("item", ("id",), "shop", (R.Property("id"), R.Property("colour"), R.Property("size", "string")))])
    return spark.createDataFrame([(i.code, i.subject, i.hard) for i in mine.drift(found)], "code string, subject string, hard boolean")


@C.model_check("SELECT * FROM (VALUES ('item', 'id', 'declared'), ('item', 'title', 'declared'), ('bin', 'id', 'declared'), ('bin', 'depth', 'declared')) t(type, property, origin)")
def model_after_edits(spark, sf_dir):
    base = R.Registry([R.ObjectType("item", ("id",), "shop", (R.Property("id"), R.Property("name"))), R.ObjectType("old", ("id",), "shop", (R.Property("id"),))])
    edit = lambda op, of, **more: {"op": op, "domain": "shop", "type": of, **more}
    sources = {
        "first": [edit("rename_property", "item", name="name", to="title"), edit("add_type", "bin", value=R.ObjectType("bin", ("id",), "shop", (R.Property("id"),)))],
        "second": [edit("add_property", "bin", value=R.Property("depth", "int")), edit("remove_type", "old")],
    }
    return spark.createDataFrame([(t.name, p.name, p.origin) for t in R.drain(base, sources).types for p in t.properties], "type string, property string, origin string")
