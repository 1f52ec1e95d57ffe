"""Object sets: filters, traversals, interfaces, associations, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import project_id, row_id
from ..operators import observed, reach
from ..operators.objectset import FULL
from .base import Catalogue
from .domain import graph

C = Catalogue()
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
LINE_SQL = ", ".join("l." + c for c in LINE)


@C.query("SELECT * FROM nation")
def scan_root(spark, sf_dir):
    return graph(spark, sf_dir).objects("nation").df


@C.query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR (c_nationkey <= 2 AND c_acctbal <> 0)")
def where_and_or(spark, sf_dir):
    s = graph(spark, sf_dir).objects("customer")
    return s.where(((F.col("c_acctbal") > 5000) & (F.col("c_mktsegment") == "BUILDING")) | ((F.col("c_nationkey") <= 2) & (F.col("c_acctbal") != 0))).df.select("c_custkey", "c_name", "c_acctbal")


@C.query("SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_acctbal < 3000 AND c_mktsegment <> 'MACHINERY'")
def where_stacked(spark, sf_dir):
    s = graph(spark, sf_dir).objects("customer")
    return s.where(F.col("c_acctbal") > 1000).where(F.col("c_acctbal") < 3000).where(F.col("c_mktsegment") != "MACHINERY").df.select("c_custkey")


@C.query("SELECT doc_id, lang FROM documents WHERE contains(text, '%') OR contains(text, 'the_') OR contains(text, 'License')")
def contains_literal(spark, sf_dir):
    t = F.col("text")
    return graph(spark, sf_dir).objects("documents").where(t.contains("%") | t.contains("the_") | t.contains("License")).df.select("doc_id", "lang")


@C.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000")
def where_text(spark, sf_dir):
    return graph(spark, sf_dir).objects("orders").where_text("o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000").df.select("o_orderkey", "o_totalprice")


@C.query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def by_id(spark, sf_dir):
    return graph(spark, sf_dir).objects("nation").by_id("7").df.select("n_nationkey", "n_name")


@C.query("SELECT conv_id, turn, 'V' || length(CAST(conv_id AS VARCHAR)) || ':' || conv_id || chr(31) || 'V' || length(CAST(turn AS VARCHAR)) || ':' || turn AS id FROM conversations")
def composite_id(spark, sf_dir):
    return graph(spark, sf_dir).objects("conversations").df.select("conv_id", "turn", project_id("conv_id", "turn").alias("id"))


@C.query("SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def traverse_1hop(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.objects("nation").where(F.col("n_regionkey") == 1).traverse("customers").df.select("c_custkey", "c_name")


@C.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3)")
def traverse_2hop_filtered(spark, sf_dir):
    g = graph(spark, sf_dir)
    s = g.objects("nation").by_id("3").traverse("customers").where(F.col("c_acctbal") > 0).traverse("orders").where(F.col("o_totalprice") > 100000)
    return s.df.select("o_orderkey", "o_totalprice")


@C.query(f"SELECT {LINE_SQL} FROM lineitem l WHERE l_quantity > 40 AND l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)")
def traverse_3hop(spark, sf_dir):
    s = graph(spark, sf_dir).objects("nation").where(F.col("n_nationkey") == 3).traverse("customers").traverse("orders").traverse("lines")
    return s.where(F.col("l_quantity") > 40).df.select(*LINE)


@C.query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND l_quantity > 45)")
def traverse_4hop(spark, sf_dir):
    s = graph(spark, sf_dir).objects("nation").by_id("3").traverse("customers").traverse("orders").traverse("lines").where(F.col("l_quantity") > 45).traverse("part")
    return s.df.select("p_partkey", "p_name")


@C.query("SELECT p.p_partkey, count(*) AS paths FROM customer c JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part p ON p.p_partkey = l_partkey WHERE c.c_nationkey = 3 GROUP BY p.p_partkey")
def traverse_paths(spark, sf_dir):
    s = graph(spark, sf_dir).objects("customer").where(F.col("c_nationkey") == 3)
    for link in ("orders", "lines", "part"):
        s = s.traverse(link, keep_paths=True)
    return s.df.groupBy("p_partkey").agg(F.count("*").alias("paths"))


@C.query("""SELECT 'customer' AS _type, c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2""")
def polymorphic_parties(spark, sf_dir):
    return graph(spark, sf_dir).objects("nation").where(F.col("n_regionkey") == 2).traverse("parties").df


@C.query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 5")
def traverse_named_target(spark, sf_dir):
    return graph(spark, sf_dir).objects("nation").by_id("5").traverse("suppliers", target="supplier").df.select("s_suppkey", "s_name")


@C.query("SELECT 'supplier' AS _type, s_suppkey AS key, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier WHERE s_acctbal > 0")
def interface_narrow(spark, sf_dir):
    return graph(spark, sf_dir).objects("supplier").where(F.col("s_acctbal") > 0).of_interface("Party").df


@C.query("SELECT _type, count(*) AS n, round(sum(balance), 2) AS total FROM (SELECT 'customer' AS _type, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY _type")
def interface_view(spark, sf_dir):
    return graph(spark, sf_dir).interface("Party").groupBy("_type").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("total"))


@C.query(f"SELECT {LINE_SQL} FROM lineitem l WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 11)")
def assoc_edge_view(spark, sf_dir):
    return graph(spark, sf_dir).objects("orders").where(F.col("o_custkey") == 11).edges("lineitem").df.select(*LINE)


@C.query("SELECT p_partkey, p_brand, l_quantity, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 11")
def assoc_endpoint_hop(spark, sf_dir):
    s = graph(spark, sf_dir).objects("orders").where(F.col("o_custkey") == 11).edges("lineitem").endpoint("part", ("l_quantity", "l_returnflag"))
    return s.df.select("p_partkey", "p_brand", "l_quantity", "l_returnflag")


@C.query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' AND l_returnflag = 'R' AND l_linestatus = 'F')")
def edge_filter_walk(spark, sf_dir):
    s = graph(spark, sf_dir).objects("orders").where(F.col("o_orderpriority").startswith("1"))
    return s.walk("lineitem", 1, True, l_returnflag="R", l_linestatus="F")[-1].df.select("p_partkey")


@C.query("SELECT sha2_id, l_quantity FROM (SELECT 1 AS sha2_id, l_quantity FROM lineitem WHERE false)")
def empty_result(spark, sf_dir):
    return graph(spark, sf_dir).objects("lineitem").where(F.lit(False)).df.select(F.lit(1).alias("sha2_id"), "l_quantity")


@C.query("SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS distinct_rows FROM lineitem")
def surrogate_row_ids(spark, sf_dir):
    rows = graph(spark, sf_dir).objects("lineitem").df
    return rows.select(row_id(*rows.columns).alias("id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_rows"))


@C.query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def inverse_link(spark, sf_dir):
    g = graph(spark, sf_dir)
    c = g.objects("customer").where(F.col("c_acctbal") > 0)
    back = g.registry.inverse(g.registry.resolve("nation"), "customers")
    nations = c.inverse("nation", "customers").traverse("region", keep_paths=False).df
    pairs = c.df.join(g.table("nation"), F.col(back.source_key) == F.col(back.target_key)).join(nations, F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("c_custkey", "n_name", "r_name")


@C.query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers, 4 AS n_links FROM nation")
def include_links_count(spark, sf_dir):
    rows = graph(spark, sf_dir).objects("nation").include(FULL).with_facets()
    return rows.select("n_nationkey", F.col("_n_customers").alias("n_customers"), F.col("_n_suppliers").alias("n_suppliers"), F.size("_links").alias("n_links"))


@C.query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_parties, 1 AS n_region FROM nation")
def include_interface_links(spark, sf_dir):
    rows = graph(spark, sf_dir).objects("nation").include("linked_objects").with_facets()
    return rows.select("n_nationkey", F.col("_n_parties").alias("n_parties"), F.col("_n_region").cast("int").alias("n_region"))


@C.query("SELECT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 3 AS n_actions FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND n_name <> 'X'")
def narrowed_question(spark, sf_dir):
    rows = graph(spark, sf_dir).objects("nation").narrowed("n_regionkey = 1 AND n_name <> 'X'", "customers", "Party", ("actions",)).with_facets()
    return rows.select(F.col("_type").alias("type"), F.col("key").cast("string").alias("id"), "name", F.size("_actions").alias("n_actions"))


@C.query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def page_offset(spark, sf_dir):
    return graph(spark, sf_dir).objects("customer").page(50, 25)[0].select("c_custkey", "c_name")


@C.query("SELECT r_name, n_name, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def count_by_hierarchy(spark, sf_dir):
    g = graph(spark, sf_dir)
    rows = g.table("customer").join(g.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


EDGES = """candidates AS (
  SELECT 'nation' AS src_type, CAST(c_nationkey AS VARCHAR) AS src_id, 'knows' AS link, 'nation' AS tgt_type, CAST(c_custkey % 30 AS VARCHAR) AS tgt_id FROM customer
  UNION SELECT 'nation', CAST(c_custkey AS VARCHAR), 'likes', 'nation', '1' FROM customer WHERE c_mktsegment = 'BUILDING'
), judged AS (
  SELECT *, CASE WHEN link <> 'knows' THEN 'undeclared-link' WHEN src_id NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) THEN 'missing-source'
    WHEN tgt_id NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) THEN 'missing-target' WHEN src_id = tgt_id THEN 'self-loop' END AS reason FROM candidates
)"""


def _relate(spark, sf_dir):
    from ..operators.relate import relate

    g = graph(spark, sf_dir)
    c, n = g.table("customer"), g.table("nation")
    text = lambda x: x.cast("string")
    edge = lambda rows, s, link, t: rows.select(F.lit("nation").alias("src_type"), text(s).alias("src_id"), F.lit(link).alias("link"), F.lit("nation").alias("tgt_type"), text(t).alias("tgt_id"), F.lit(None).cast("string").alias("assoc_id"))
    candidates = edge(c, F.col("c_nationkey"), "knows", F.col("c_custkey") % 30).unionByName(edge(c.filter("c_mktsegment = 'BUILDING'"), F.col("c_custkey"), "likes", F.lit(1)))
    existing = edge(n, F.col("n_nationkey"), "knows", F.col("n_regionkey"))
    links = spark.createDataFrame([("nation", "knows", "nation", False)], "src_type string, link string, tgt_type string, self_loops boolean")
    return relate(candidates, existing, n.select(F.lit("nation").alias("type"), text(F.col("n_nationkey")).alias("id")), links), existing


@C.query(f"WITH {EDGES} SELECT src_id, link, tgt_id FROM judged WHERE reason IS NULL AND (src_id, tgt_id) NOT IN (SELECT (CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR)) FROM nation)")
def relate_accept(spark, sf_dir):
    return _relate(spark, sf_dir)[0][0].select("src_id", "link", "tgt_id")


@C.query(f"WITH {EDGES} SELECT src_id, link, tgt_id, reason FROM judged WHERE reason IS NOT NULL")
def relate_reject(spark, sf_dir):
    return _relate(spark, sf_dir)[0][1].select("src_id", "link", "tgt_id", "reason")


@C.query("SELECT CAST(n_nationkey AS VARCHAR) AS src_id, CAST(n_regionkey AS VARCHAR) AS tgt_id FROM nation WHERE n_regionkey >= 2")
def unrelate_plain(spark, sf_dir):
    from ..operators.relate import unrelate

    existing = _relate(spark, sf_dir)[1]
    return unrelate(existing, existing.filter(F.col("tgt_id").cast("int") < 2)).select("src_id", "tgt_id")


@C.query("SELECT CAST(c_custkey AS VARCHAR) AS src_id, CAST(c_nationkey AS VARCHAR) AS tgt_id FROM customer WHERE c_nationkey >= 20 OR c_custkey % 3 = 0")
def missing_endpoints(spark, sf_dir):
    from ..operators.relate import missing_endpoints

    g = graph(spark, sf_dir)
    c, n = g.table("customer"), g.table("nation")
    text = lambda x: F.col(x).cast("string")
    edges = c.select(F.lit("customer").alias("src_type"), text("c_custkey").alias("src_id"), F.lit("lives").alias("link"), F.lit("nation").alias("tgt_type"), text("c_nationkey").alias("tgt_id"), F.lit(None).cast("string").alias("assoc_id"))
    customers = c.filter("c_custkey % 3 <> 0").select(F.lit("customer").alias("type"), text("c_custkey").alias("id"))
    nations = n.filter("n_nationkey < 20").select(F.lit("nation").alias("type"), text("n_nationkey").alias("id"))
    return missing_endpoints(edges, customers.unionByName(nations)).select("src_id", "tgt_id")


@C.query("SELECT p_partkey, p_brand, l_quantity, l_discount FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def assoc_far_end(spark, sf_dir):
    edges = graph(spark, sf_dir).objects("orders").where(F.col("o_orderstatus") == "P").edges("lineitem")
    return edges.endpoint("part", with_edges=("l_quantity", "l_discount")).df.select("p_partkey", "p_brand", "l_quantity", "l_discount")


@C.query("SELECT 'position' AS question, count(*) AS n FROM (SELECT 1 FROM customer WHERE c_acctbal > 1000) UNION ALL SELECT 'hop', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)")
def object_counts(spark, sf_dir):
    rich = graph(spark, sf_dir).objects("customer").where(F.col("c_acctbal") > 1000)
    counted = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("question"), "n")
    return counted("position", rich.df).unionByName(counted("hop", rich.traverse("orders").df))


@C.query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 5 OFFSET 5")
def page_after_cursor(spark, sf_dir):
    from ..functions.identity import decode_cursor, encode_cursor

    token = encode_cursor("nation", "7", "customers", "out", 5)
    rows, _ = graph(spark, sf_dir).objects("nation").by_id("7").traverse("customers").page(decode_cursor(token, "nation", "7", "customers", "out"), 5)
    return rows.select("c_custkey", "c_name")


@C.query("SELECT o_orderpriority AS priority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderstatus = 'P' QUALIFY place <= 3")
def ordered_within(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = graph(spark, sf_dir).objects("orders").where_text("o_orderstatus = 'P'").df
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return rows.select(F.col("o_orderpriority").alias("priority"), "o_orderkey", place.alias("place")).filter("place <= 3")


@C.query("""WITH RECURSIVE e AS (
  SELECT 'customer' AS st, CAST(o_custkey AS VARCHAR) AS si, 'orders' AS tt, CAST(o_orderkey AS VARCHAR) AS ti FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION SELECT 'orders', CAST(l_orderkey AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR) FROM lineitem
), ways AS (SELECT * FROM e UNION SELECT tt, ti, st, si FROM e
), walk AS (
  SELECT DISTINCT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id, 0 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'
  UNION SELECT tt, ti, depth + 1 FROM walk JOIN ways ON type = st AND id = si WHERE depth < 12
) SELECT type, id, min(depth) AS depth FROM walk GROUP BY type, id""")
def reach_any_depth(spark, sf_dir):
    g = graph(spark, sf_dir)
    start = g.objects("nation").where(F.col("n_name") == "NATION_7").traverse("customers").with_id("id").select(F.lit("customer").alias("type"), "id")
    edges = [reach.both_ways(reach.link_edges(g, "customer", "orders")), reach.both_ways(reach.association_edges(g, "lineitem", "order", "part"))]
    return reach.reachable(start, edges)


@C.query("""WITH c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'nowhere'))), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT * FROM (SELECT '0 region' AS point, count(*) AS rows FROM region WHERE r_name <> 'nowhere' UNION ALL SELECT '1 nations', count(*) FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region) UNION ALL SELECT '2 customers', count(*) FROM c UNION ALL SELECT '3 orders', count(*) FROM o)""")
def traversal_metrics(spark, sf_dir):
    """Objects of each hop of a traversal, counted by the one job that runs it."""
    start = graph(spark, sf_dir).objects("region").where(F.col("r_name") != "nowhere")
    end, trace = observed.observed_walk(start, ["nations", "customers", "orders"])
    trace.run(end.df)
    return spark.createDataFrame([(name, v["rows"]) for name, v in trace.values().items()], "point string, rows long")
