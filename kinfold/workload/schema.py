"""The entity-relation model over the test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Entity, FilteredEntity, MergedEntity, Property, Relation
from ..plans.match import Match
from ..sources.catalog import Catalog
from ..sources.tables import read_parquet

P = Property


def num(*names: str) -> tuple[Property, ...]:
    return tuple(P(n, "number") for n in names)


def text(*names: str) -> tuple[Property, ...]:
    return tuple(P(n) for n in names)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    read: dict = {}

    def t(n: str):
        """A table, opened when it is first asked for."""
        if n not in read:
            read[n] = read_parquet(spark, sf_dir, n)
        return read[n]

    c = Catalog(spark)
    c.entity(Entity("Region", text("r_name") + num("r_regionkey")), lambda: t("region"), "r_regionkey")
    c.entity(Entity("Nation", text("n_name") + num("n_nationkey", "n_regionkey")), lambda: t("nation"), "n_nationkey")
    parent = F.when(F.col("c_custkey").cast("bigint") >= 2, F.expr("c_custkey div 2"))
    c.entity(Entity("Customer", text("c_name", "c_mktsegment") + num("c_custkey", "c_acctbal", "c_nationkey")), lambda: t("customer").withColumn("parent_id", parent), "c_custkey")
    c.entity(Entity("Supplier", text("s_name") + num("s_suppkey", "s_acctbal", "s_nationkey")), lambda: t("supplier"), "s_suppkey")
    c.entity(Entity("Part", text("p_name", "p_brand", "p_type") + num("p_partkey", "p_size", "p_retailprice")), lambda: t("part"), "p_partkey")
    orders = lambda: t("orders").withColumns({
        "status_n": F.nullif(F.col("o_orderstatus"), F.lit("P")),
        "price_n": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")),
        "tags": F.array("o_orderstatus", "o_orderpriority"),
    })
    c.entity(Entity("Order", text("o_orderstatus", "o_orderpriority", "status_n") + num("o_orderkey", "o_custkey", "o_totalprice", "price_n") + (P("o_orderdate", "timestamp"), P("tags", "string", collection=True))), orders, "o_orderkey")
    line = lambda: t("lineitem").withColumn("line_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    c.entity(Entity("Lineitem", text("l_returnflag", "l_linestatus") + num("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax") + (P("l_shipdate", "timestamp"),)), line, "line_id")
    c.entity(Entity("Event", text("event_type") + num("event_id", "user_id", "value") + (P("ts", "timestamp"), P("props", "json"))), lambda: t("events"), "event_id")
    c.entity(Entity("User", num("user_id")), lambda: t("events").select("user_id").distinct(), "user_id")
    c.entity(Entity("Document", text("lang", "source", "text") + num("doc_id", "n_chars")), lambda: t("documents"), "doc_id")
    c.entity(Entity("Label", num("doc_id", "quality", "toxic")), lambda: t("labels"), "doc_id")
    c.entity(Entity("Client", text("name", "segment") + num("balance", "nation_id")), lambda: t("customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation_id")))
    c.entity(Entity("Vendor", text("name") + num("balance", "nation_id")), lambda: t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation_id")))

    c.relation(Relation("NationRegion", "Nation", "region", "Region", "nations", "n:1"), fk=("source", "n_regionkey"))
    c.relation(Relation("CustomerNation", "Customer", "nation", "Nation", "customers", "n:1"), fk=("source", "c_nationkey"))
    c.relation(Relation("SupplierNation", "Supplier", "nation", "Nation", "suppliers", "n:1"), fk=("source", "s_nationkey"))
    c.relation(Relation("OrderCustomer", "Order", "customer", "Customer", "orders", "n:1"), fk=("source", "o_custkey"))
    c.relation(Relation("OrderLines", "Order", "lineitems", "Lineitem", "order", "1:n", reliance=True), fk=("target", "l_orderkey"))
    c.relation(Relation("LinePart", "Lineitem", "part", "Part", "lineitems", "n:1"), fk=("source", "l_partkey"))
    c.relation(Relation("LineSupplier", "Lineitem", "supplier", "Supplier", "lineitems", "n:1"), fk=("source", "l_suppkey"))
    c.relation(Relation("CustomerParent", "Customer", "parent", "Customer", "children", "n:1"), fk=("source", "parent_id"))
    c.relation(Relation("EventUser", "Event", "user", "User", "events", "n:1"), fk=("source", "user_id"))
    c.relation(Relation("DocumentLabel", "Document", "label", "Label", "document", "1:1"), fk=("target", "doc_id"))
    supplied = lambda: t("lineitem").groupBy(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).agg(F.sum("l_quantity").alias("quantity"))
    c.relation(Relation("PartSuppliers", "Part", "suppliers", "Supplier", "parts", "n:n", num("quantity")), links=supplied)

    def peers():
        s = t("supplier").select("s_suppkey", "s_nationkey")
        pairs = s.alias("a").join(s.alias("b"), F.expr("a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey"))
        return pairs.select(F.col("a.s_suppkey").alias("source"), F.col("b.s_suppkey").alias("target"), (F.col("b.s_suppkey") - F.col("a.s_suppkey")).alias("gap"))

    c.relation(Relation("Peers", "Supplier", "peers", "Supplier", "peers", "n:n", num("gap")), links=peers)
    c.relation(Relation("Returned", "Order", "returned", "Lineitem", "", "1:n", base="OrderLines", match=Match.atom("target.l_returnflag", "=", "R")))
    c.relation(Relation("BigSuppliers", "Part", "bigSuppliers", "Supplier", "", "n:n", num("quantity"), base="PartSuppliers", match=Match.atom("quantity", ">", 60)))
    fav = lambda: t("orders").groupBy(F.col("o_custkey").alias("source")).agg(F.min("o_orderkey").alias("target"))
    last = lambda: t("orders").groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_orderkey").alias("target"))
    c.relation(Relation("FirstOrder", "Customer", "firstOrder", "Order", "firstOf", "n:n"), links=fav)
    c.relation(Relation("LastOrder", "Customer", "lastOrder", "Order", "lastOf", "n:n"), links=last)
    c.merged_relation(Relation("EdgeOrders", "Customer", "edgeOrders", "Order", "edgeOf", "n:n"), ["FirstOrder", "LastOrder"])

    c.view(FilteredEntity("RichCustomer", "Customer", Match.atom("c_acctbal", ">", 5000)))
    c.view(FilteredEntity("RichAsian", "RichCustomer", Match.atom("nation.region.r_name", "=", "ASIA")))
    c.view(FilteredEntity("RichClient", "Client", Match.atom("balance", ">", 8000)))
    c.view(MergedEntity("Contact", ("Client", "Vendor"), ("name", "balance")))
    c.view(MergedEntity("GoodContact", ("RichClient", "Vendor"), ("name",)))
    c.view(FilteredEntity("Debtor", "Contact", Match.atom("balance", "<", 0)))
    c.view(MergedEntity("AnyContact", ("Contact",), ("name",)))
    return c
