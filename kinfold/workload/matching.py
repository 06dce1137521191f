"""Scans, predicates, projections, paging and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.match import Match
from ..plans.query import find, find_one, find_path, find_relation, nested, policy_view, traverse
from ..sources.catalog import Catalog

M = Match.atom
Query = Callable[[Catalog], DataFrame]
Q: dict[str, tuple[Query, str]] = {}

O_SQL = "(SELECT *, nullif(o_orderstatus, 'P') AS status_n, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price_n FROM orders)"


def ids(entity: str, match) -> Query:
    return lambda c: find(c, entity, match, attrs=["id"]).select("id")


def on_orders(name: str, match, where: str) -> None:
    Q[name] = (ids("Order", match), f"SELECT o_orderkey AS id FROM {O_SQL} o WHERE {where}")


Q["scan_project"] = (lambda c: find(c, "Order", attrs=["o_orderstatus", "o_totalprice"]), "SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders")
Q["scan_all_attrs"] = (lambda c: find(c, "Nation"), "SELECT n_nationkey AS id, n_name, n_nationkey, n_regionkey FROM nation")
Q["scan_one"] = (lambda c: find_one(c, "Order", M("o_orderstatus", "=", "F"), {"order_by": {"o_totalprice": "desc"}}, ["o_totalprice"]), "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, id LIMIT 1")
Q["scan_relation"] = (lambda c: find_relation(c, "PartSuppliers", M("quantity", ">", 50), ["quantity", nested("source", ["p_brand"]), nested("target", ["s_name"])]).select("id", "quantity", "source.p_brand", "target.s_name"),
    "SELECT concat_ws('-', l_partkey, l_suppkey) AS id, sum(l_quantity) AS quantity, any_value(p_brand) AS p_brand, any_value(s_name) AS s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey, l_suppkey HAVING sum(l_quantity) > 50")
on_orders("match_cmp_ops", M("o_totalprice", ">=", 1000).and_(M("o_totalprice", "<", 200000)).and_(M("o_orderstatus", "!=", "F")), "o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'F'")
on_orders("match_between", M("o_totalprice", "between", [50000, 120000]), "o_totalprice BETWEEN 50000 AND 120000")
Q["match_like"] = (ids("Part", M("p_type", "like", "%A%")), "SELECT p_partkey AS id FROM part WHERE p_type LIKE '%A%'")
on_orders("match_timestamp", M("o_orderdate", ">=", "1995-06-01T00:00:00Z").and_(M("o_orderdate", "<", 852076800000)), "o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
on_orders("match_in_lists", M("o_orderstatus", "in", ["F", "O"]).and_(M("o_orderpriority", "not in", ["1-URGENT"])), "o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT')")
on_orders("match_in_empty", M("status_n", "in", []).or_(M("status_n", "not in", []).and_(M("o_orderstatus", "=", "P"))), "o_orderstatus = 'P'")
on_orders("match_notin_null", M("status_n", "not in", [None, "F"]).or_(M("price_n", "in", [None])), "(status_n IS NOT NULL AND status_n NOT IN ('F')) OR price_n IS NULL")
on_orders("match_null_ops", M("status_n", "=", None).or_(M("price_n", "is null", None).and_(M("status_n", "not", None))), "status_n IS NULL OR (price_n IS NULL AND status_n IS NOT NULL)")
on_orders("match_and_or_not_3vl", M("status_n", "=", "F").or_(M("price_n", ">", 100000)).not_(), "NOT (status_n = 'F' OR price_n > 100000)")
on_orders("match_from_object", Match.of({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}), "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
on_orders("match_from_array", Match.of([("o_orderstatus", "=", "P"), ("o_totalprice", ">", 300000)]), "o_orderstatus = 'P' OR o_totalprice > 300000")
Q["match_ref_value"] = (ids("Order", M("o_totalprice", "<", "customer.c_acctbal", reference=True)), "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice < c_acctbal")
Q["match_ref_between"] = (ids("Order", M("customer.c_acctbal", "between", ["o_custkey", "o_totalprice"], reference=True)), "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal BETWEEN o_custkey AND o_totalprice")
Q["match_json_eq"] = (ids("Event", M("props", "=", {"k": 7}).or_(M("props", "in", ['{"k":3}', {"k": 5}]))), "SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) IN (7, 3, 5)")
Q["match_contains"] = (ids("Order", M("tags", "contains", "2-HIGH")), "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '2-HIGH'")
Q["match_path_x1"] = (ids("Order", M("customer.nation.region.r_name", "=", "ASIA")), "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
on_orders("match_path_xn", M("lineitems.l_returnflag", "=", "R"), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
on_orders("match_path_xn_not", M("lineitems.l_returnflag", "=", "R").not_(), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag <> 'R')")
on_orders("match_path_xn_same_row", M("lineitems.l_returnflag", "=", "R").and_(M("lineitems.l_quantity", ">", 45)), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
on_orders("match_path_xn_null", M("lineitems.l_returnflag", "=", None), "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
on_orders("match_path_xn_or", M("lineitems.l_quantity", ">", 49).or_(M("o_totalprice", "<", 20000)), "o_totalprice < 20000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity > 49)")
Q["match_link_attr"] = (ids("Part", M("suppliers.&.quantity", ">", 80).and_(M("suppliers.s_acctbal", ">", 0))), "SELECT DISTINCT l_partkey AS id FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 80) JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0")
Q["match_symmetric"] = (ids("Supplier", M("peers.s_acctbal", ">", 9000)), "SELECT s_suppkey AS id FROM supplier a WHERE EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey AND b.s_acctbal > 9000)")
Q["match_rebase"] = (ids("Order", M("nation.region.r_name", "=", "EUROPE").rebase("customer")), "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'")
Q["match_self_join"] = (ids("Customer", M("parent.parent.c_mktsegment", "=", "BUILDING")), "SELECT c.c_custkey AS id FROM customer c JOIN customer p ON p.c_custkey = c.c_custkey // 2 AND c.c_custkey >= 2 JOIN customer g ON g.c_custkey = p.c_custkey // 2 AND p.c_custkey >= 2 WHERE g.c_mktsegment = 'BUILDING'")
on_orders("exist_1n", M("lineitems", "exist", M("l_returnflag", "=", "R").and_(M("l_discount", ">", 0.05))), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_discount > 0.05)")
Q["exist_nn"] = (ids("Part", M("suppliers", "exist", M("nation.region.r_name", "=", "EUROPE"))), "SELECT DISTINCT l_partkey AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'")
Q["exist_multi_hop"] = (ids("Nation", M("customers.orders", "exist", M("o_totalprice", ">", 400000))), "SELECT DISTINCT c_nationkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000")
Q["exist_x1_prefix"] = (ids("Order", M("customer.nation", "exist", M("n_name", "like", "%A%"))), "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name LIKE '%A%'")
Q["exist_nested"] = (ids("Customer", M("orders", "exist", M("o_orderstatus", "=", "F").and_(M("lineitems", "exist", M("l_quantity", ">", 48))))), "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48))")
on_orders("exist_under_or", M("lineitems", "exist", M("l_returnflag", "=", "R")).or_(M("o_totalprice", "<", 50000)), "o_totalprice < 50000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
on_orders("not_exist_1n", M("lineitems", "exist", M("l_returnflag", "=", "R")).not_(), "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
Q["not_exist_multi_hop"] = (ids("Customer", M("orders.lineitems", "exist", M("l_quantity", ">", 45)).not_()), "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 45)")
on_orders("exist_filtered_relation", M("returned", "exist", M("l_quantity", ">", 30)), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity > 30)")
Q["path_filtered_relation"] = (ids("Part", M("bigSuppliers.s_acctbal", ">", 0)), "SELECT DISTINCT l_partkey AS id FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 60) JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0")
Q["exist_root_reference"] = (ids("Order", M("lineitems", "exist", M("l_extendedprice", ">", "o_totalprice", reference=True))), "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice)")
Q["exist_nested_root_reference"] = (ids("Customer", M("orders", "exist", M("lineitems", "exist", M("l_extendedprice", "<", "c_acctbal", reference=True)))), "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_extendedprice < c_acctbal)")

Q["nested_x1"] = (lambda c: find(c, "Order", M("o_totalprice", ">", 200000), attrs=["o_totalprice", nested("customer", ["c_name", nested("nation", ["n_name"])])]).select("id", "customer.c_name", "customer.nation.n_name"), "SELECT o_orderkey AS id, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 200000")
Q["nested_xn"] = (lambda c: find(c, "Order", attrs=[nested("lineitems", ["l_quantity", "l_linenumber"])]).select("id", F.size("lineitems").cast("bigint").alias("n"), F.aggregate("lineitems", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("q")), "SELECT o_orderkey AS id, count(l_orderkey) AS n, coalesce(sum(l_quantity), 0)::DOUBLE AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["nested_xn_filtered"] = (lambda c: find(c, "Customer", attrs=[nested("orders", ["o_orderstatus"], match=M("o_orderstatus", "=", "F"))]).select("id", F.size("orders").cast("bigint").alias("n")), "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
Q["nested_x1_predicate"] = (lambda c: find(c, "Order", attrs=[nested("customer", ["c_name"], match=M("c_acctbal", ">", 0))]).select("id", "customer.c_name"), "SELECT o_orderkey AS id, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
Q["nested_topn_per_parent"] = (lambda c: find(c, "Customer", attrs=[nested("orders", ["o_totalprice"], modifier={"order_by": {"o_totalprice": "desc"}, "limit": 2, "offset": 1})]).select("id", F.posexplode("orders").alias("pos", "o")).select("id", F.col("pos").cast("bigint").alias("pos"), F.col("o.id").alias("order_id")), "SELECT o_custkey AS id, n - 2 AS pos, o_orderkey AS order_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n IN (2, 3)")
Q["nested_link"] = (lambda c: find(c, "Part", M("p_size", "<", 5), attrs=[nested("suppliers", ["s_name", nested("&", ["quantity"])])]).select("id", F.explode("suppliers").alias("s")).select("id", "s.s_name", "s.&.quantity"), "SELECT p_partkey AS id, s_name, sum(l_quantity) AS quantity FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 5 GROUP BY p_partkey, l_suppkey, s_name")
Q["nested_symmetric_link"] = (lambda c: find(c, "Supplier", attrs=[nested("peers", ["s_name", nested("&", ["gap"])])]).select("id", F.explode("peers").alias("p")).select("id", F.col("p.id").alias("peer"), F.col("p.&.gap").alias("gap")), "SELECT a.s_suppkey AS id, b.s_suppkey AS peer, abs(b.s_suppkey - a.s_suppkey) AS gap FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey")
Q["nested_filtered_relation"] = (lambda c: find(c, "Order", attrs=[nested("returned", ["l_quantity"], alias="back")]).select("id", F.size("back").cast("bigint").alias("n")), "SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
Q["nested_deep"] = (lambda c: find(c, "Region", attrs=["r_name", nested("nations", ["n_name", nested("suppliers", ["s_name"])])]).select("r_name", F.explode("nations").alias("n")).select("r_name", "n.n_name", F.size("n.suppliers").cast("bigint").alias("suppliers")), "SELECT r_name, n_name, count(s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_nationkey, n_name")
Q["recursive_tree"] = (lambda c: traverse(c, "Customer", "children", M("c_custkey", "=", 1), 40).select("id", F.col("depth").cast("bigint").alias("depth")), "WITH RECURSIVE t(id, depth) AS (SELECT c_custkey, 0::BIGINT FROM customer WHERE c_custkey = 1 UNION ALL SELECT c_custkey, depth + 1 FROM t JOIN customer ON c_custkey // 2 = id AND c_custkey >= 2) SELECT * FROM t")
Q["recursive_exit"] = (lambda c: traverse(c, "Customer", "children", M("c_custkey", "in", [2, 3]), 40, lambda x: x["depth"] >= 3).select("root", "id"), "WITH RECURSIVE t(root, id, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey IN (2, 3) UNION ALL SELECT root, c_custkey, depth + 1 FROM t JOIN customer ON c_custkey // 2 = id AND c_custkey >= 2 WHERE depth < 3) SELECT root, id FROM t")
Q["find_path"] = (lambda c: find_path(c, "Customer", "parent", 100, 3).select(F.array_join("path", ">").alias("path"), F.col("length").cast("bigint").alias("length")), "WITH RECURSIVE t(id, path, n) AS (SELECT 100::BIGINT, '100', 0::BIGINT UNION ALL SELECT id // 2, path || '>' || (id // 2), n + 1 FROM t WHERE id >= 2 AND id <> 3) SELECT path, n AS length FROM t WHERE id = 3")
Q["data_policy_view"] = (lambda c: policy_view(c, "Customer", {"match": lambda u: M("c_nationkey", "=", u["nation"]), "modifier": {"order_by": {"c_acctbal": "desc"}, "limit": 5}, "attrs": ["c_name"]}, M("c_acctbal", ">", 0), user={"nation": 7}), "SELECT c_custkey AS id, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 5")
Q["order_limit_offset"] = (lambda c: find(c, "Order", None, {"order_by": {"o_orderstatus": "asc", "o_totalprice": "desc"}, "limit": 20, "offset": 5}, ["o_totalprice"]), "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderstatus NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
Q["order_by_x1_path"] = (lambda c: find(c, "Order", M("o_orderstatus", "=", "P"), {"order_by": {"customer.nation.n_name": "asc", "price_n": "desc"}, "limit": 15}, ["id"]), f"SELECT o_orderkey AS id FROM {O_SQL} JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P' ORDER BY n_name NULLS LAST, price_n DESC NULLS LAST, o_orderkey LIMIT 15")
Q["page_over_fanout"] = (lambda c: find(c, "Order", M("lineitems.l_quantity", ">", 20), {"order_by": {"o_orderkey": "asc"}, "limit": 10, "offset": 10}, ["id"]), "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20) ORDER BY o_orderkey LIMIT 10 OFFSET 10")
Q["limit_zero"] = (lambda c: find(c, "Order", None, {"limit": 0}, ["id"]), "SELECT o_orderkey AS id FROM orders LIMIT 0")
Q["filtered_entity"] = (lambda c: find(c, "RichCustomer", M("c_mktsegment", "=", "BUILDING"), attrs=["c_name"]), "SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
Q["filtered_nested"] = (lambda c: find(c, "RichAsian", attrs=["c_name"]), "SELECT c_custkey AS id, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 5000 AND r_name = 'ASIA'")
Q["filtered_cross_entity"] = (lambda c: find(c, "RichAsian", M("orders", "exist", M("o_totalprice", ">", 300000)), attrs=["id"]), "SELECT c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 5000 AND r_name = 'ASIA' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_CONTACT = "(SELECT 'C' || c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'Client' AS __type FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, s_acctbal, NULL, 'Vendor' FROM supplier)"
Q["merged_entity"] = (lambda c: find(c, "Contact", M("balance", ">", 0), attrs=["name", "segment", "__type"]), f"SELECT id, name, segment, __type FROM {_CONTACT} WHERE balance > 0")
Q["merged_filtered_inputs"] = (lambda c: find(c, "GoodContact", attrs=["name", "__type"]), f"SELECT id, name, CASE __type WHEN 'Client' THEN 'RichClient' ELSE __type END AS __type FROM {_CONTACT} WHERE __type = 'Vendor' OR balance > 8000")
Q["merged_nested"] = (lambda c: find(c, "AnyContact", M("__type", "=", "Vendor"), attrs=["name"]), f"SELECT id, name FROM {_CONTACT} WHERE __type = 'Vendor'")
Q["merged_view"] = (lambda c: find(c, "Debtor", attrs=["name"]), f"SELECT id, name FROM {_CONTACT} WHERE balance < 0")
Q["merged_relation"] = (lambda c: find_relation(c, "EdgeOrders", M("target.o_totalprice", ">", 100000)).select("id", "__type"), "SELECT concat_ws('-', e.o_custkey, k) AS id, t AS __type FROM (SELECT o_custkey, min(o_orderkey) AS k, 'FirstOrder' AS t FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, max(o_orderkey), 'LastOrder' FROM orders GROUP BY 1) e JOIN orders ON o_orderkey = k WHERE o_totalprice > 100000")
Q["one_to_one"] = (lambda c: find(c, "Document", M("label.toxic", "=", 1), attrs=[nested("label", ["quality"])]).select("id", F.col("label.quality").cast("bigint").alias("quality")), "SELECT d.doc_id AS id, quality::BIGINT AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1")


def flagship(c: Catalog) -> DataFrame:
    """Orders of Asian customers with a returned line, the dearest first, with the customer's name."""
    match = M("customer.nation.region.r_name", "=", "ASIA").and_(M("lineitems", "exist", M("l_returnflag", "=", "R")))
    out = find(c, "Order", match, {"order_by": {"o_totalprice": "desc"}, "limit": 20}, ["o_totalprice", nested("customer", ["c_name"])])
    return out.select("id", "o_totalprice", "customer.c_name")


Q["flagship"] = (flagship, "SELECT o_orderkey AS id, o_totalprice, c_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
