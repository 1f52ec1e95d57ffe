"""The domain model over the test tables, and the event log's roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objectset import Graph
from ..registry import Action, CrossLink, Lifecycle, Link, ObjectType, Property, Registry, Requirement, Role
from ..sources.tables import parquet_tables


def _props(text: str) -> tuple[Property, ...]:
    return tuple(Property(*p.split(":")) for p in text.split())


def model() -> Registry:
    """Trade: regions, nations, parties, orders and their lines. Knowledge: documents and vectors."""
    party = ("key", "name", "nation", "balance")
    types = [
        ObjectType("region", ("r_regionkey",), "trade", _props("r_regionkey:int r_name"), (Link("nations", "nation", "r_regionkey", "n_regionkey", inverse="region"),)),
        ObjectType(
            "nation", ("n_nationkey",), "trade", _props("n_nationkey:int n_name n_regionkey:int"),
            (Link("region", "region", "n_regionkey", "r_regionkey", "N-1", "nations"), Link("customers", "customer", "n_nationkey", "c_nationkey", inverse="nation"), Link("suppliers", "supplier", "n_nationkey", "s_nationkey", inverse="nation"), Link("parties", "Party", "n_nationkey", "nation")),
        ),
        ObjectType(
            "customer", ("c_custkey",), "trade", (*_props("c_custkey:bigint c_name c_nationkey:int c_acctbal:double c_mktsegment"), Property("standing", "double", computed=True, derived_from=("c_acctbal",)), Property("offer", "double", computed=True, derived_from=("standing", "c_mktsegment"))),
            (Link("nation", "nation", "c_nationkey", "n_nationkey", "N-1", "customers"), Link("orders", "orders", "c_custkey", "o_custkey", inverse="customer")),
            actions=(Action("close", (Requirement("property", "c_acctbal >= 0"), Requirement("property", "c_mktsegment != BUILDING", hard=False)), modifies=("c_acctbal",)), Action("contact", (Requirement("link", "nation_known"),), read_only=True), Action("score", modifies=("standing",), target="orders")),
            interfaces={"Party": {"key": "c_custkey", "name": "c_name", "nation": "c_nationkey", "balance": "c_acctbal"}}, interface_actions={"Party": {"reach": "contact"}},
        ),
        ObjectType("supplier", ("s_suppkey",), "trade", _props("s_suppkey:bigint s_name s_nationkey:int s_acctbal:double"), (Link("nation", "nation", "s_nationkey", "n_nationkey", "N-1", "suppliers"), Link("lines", "lineitem", "s_suppkey", "l_suppkey")), interfaces={"Party": {"key": "s_suppkey", "name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"}}),
        ObjectType("part", ("p_partkey",), "trade", _props("p_partkey:bigint p_name p_brand p_type p_size:int p_retailprice:double"), (Link("lines", "lineitem", "p_partkey", "l_partkey"),)),
        ObjectType(
            "orders", ("o_orderkey",), "trade", _props("o_orderkey:bigint o_custkey:bigint o_orderstatus o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority"),
            (Link("customer", "customer", "o_custkey", "c_custkey", "N-1", "orders"), Link("lines", "lineitem", "o_orderkey", "l_orderkey")),
            actions=(Action("ship", from_states=("O",)), Action("audit", read_only=True)), events=("placed", "shipped"),
            lifecycle=Lifecycle("o_orderstatus", "O", ("O", "P", "F"), (("O", "P", "ship"), ("P", "F", "ship"))),
        ),
        ObjectType("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "trade", _props("l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag l_linestatus l_shipdate:timestamp_ntz"), (Link("part", "part", "l_partkey", "p_partkey", "N-1"), Link("supplier", "supplier", "l_suppkey", "s_suppkey", "N-1", "lines")), (Role("order", "orders", "l_orderkey"), Role("part", "part", "l_partkey"))),
        ObjectType("documents", ("doc_id",), "knowledge", _props("doc_id:bigint text lang source n_chars:bigint"), (Link("labels", "labels", "doc_id", "doc_id"),), accepts=(("mentions", "trade", "Party"),)),
        ObjectType("labels", ("doc_id",), "knowledge", _props("doc_id:bigint quality:int toxic:int")),
        ObjectType("embeddings", ("vec_id",), "knowledge", (*_props("vec_id:bigint label:int"), Property("embedding", "array<float>", kind="vector"))),
        ObjectType("conversations", ("conv_id", "turn"), "dialogue", _props("conv_id:bigint turn:bigint role text"), (), actions=(Action("review", target="conversations"),)),
    ]
    cross = [CrossLink("mentions", "trade", "customer", "knowledge", "documents", "mentions"), CrossLink("cites", "trade", "part", "knowledge", "documents", "mentions"), CrossLink("asks", "dialogue", "conversations", "knowledge", "documents", "asked")]
    return Registry(types, {"Party": party}, cross, [("fulfil", "orders", "lineitem"), ("embed", "documents", "embeddings"), ("lost", "orders", "parcel")])


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(model(), parquet_tables(spark, sf_dir))


def outcomes(events: DataFrame) -> DataFrame:
    """Events as outcomes of five agents: success above 50, credit as the value's share of 100."""
    credit = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    return events.select((F.col("user_id") % 5).alias("agent"), F.col("event_type").alias("category"), (F.col("value") >= 50).alias("success"), credit.alias("credit"), "event_id")


def progress(events: DataFrame) -> DataFrame:
    """Events as ledger entries: purchases and signups are progress, errors failures."""
    kind = F.col("event_type")
    return events.select("event_id", "ts", F.col("user_id").alias("task"), kind.alias("action"), kind.isin("purchase", "signup").alias("progress"), F.when(kind == "error", "Failure").when(kind == "purchase", "Success").alias("signal"), "value")


def assertions(events: DataFrame) -> DataFrame:
    """Events as a log: signups and purchases assert, errors retract the user's association."""
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "assert").when(F.col("event_type") == "error", "retract")
    return events.select(F.col("user_id").alias("assoc_id"), kind.alias("kind"), F.col("ts").alias("occurred_at"), "event_id").filter("kind is not null")
