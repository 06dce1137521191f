"""Aggregations, sequences, retention, transforms, machines, change logs, constraints and writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expression import Expression
from ..functions.values import finite, from_millis, json_column, millis, same_id
from ..model import Entity, Property
from ..operators import changes, derive, governance, machines, sequences
from ..operators import aggregations as A
from ..plans.match import Match
from ..plans.query import find, recursive
from ..plans.views import Graph, View
from ..sources.catalog import Catalog
from ..sources.tables import KeyValues

M = Match.atom
Query = Callable[[Catalog], DataFrame]
Q: dict[str, tuple[Query, str]] = {}


def rounded(df: DataFrame, *cols: str, digits: int = 2) -> DataFrame:
    """Sums of doubles depend on their order in the last bits."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


Q["count_global"] = (lambda c: A.aggregate_all(c, A.Count(), "Order", M("o_orderstatus", "=", "F"), "n"), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
Q["count_property"] = (lambda c: A.aggregate(c, A.Count(), "Order", "lineitems", name="n"), "SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["count_callback"] = (lambda c: A.aggregate(c, A.Count(("l_quantity", "part.p_size"), lambda i: i["l_quantity"] > i["part.p_size"]), "Order", "lineitems", name="n"), "SELECT o_orderkey AS id, count(p_partkey) AS n FROM orders LEFT JOIN (lineitem JOIN part ON p_partkey = l_partkey AND l_quantity > p_size) ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["count_x1"] = (lambda c: A.aggregate(c, A.Count(("c_acctbal",), lambda i: i["c_acctbal"] > 0), "Order", "customer", name="n"), "SELECT o_orderkey AS id, (c_acctbal > 0)::BIGINT AS n FROM orders JOIN customer ON c_custkey = o_custkey")
Q["sum_global"] = (lambda c: rounded(A.aggregate_all(c, A.Summation(("o_totalprice",)), "Order", name="s"), "s"), "SELECT round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE, 2) AS s FROM orders")
Q["sum_property"] = (lambda c: rounded(A.aggregate(c, A.Summation(("l_extendedprice",)), "Order", "lineitems", name="s"), "s"), "SELECT o_orderkey AS id, round(coalesce(sum(l_extendedprice::DECIMAL(18, 2)), 0)::DOUBLE, 2) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["sum_nested_path"] = (lambda c: rounded(A.aggregate(c, A.Summation(("part.p_retailprice",)), "Order", "lineitems", name="s"), "s"), "SELECT o_orderkey AS id, round(coalesce(sum(p_retailprice), 0), 2) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")


def _dirty(c: Catalog) -> Catalog:
    bad = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, float("nan")).when(F.col("event_id") % 5 == 2, float("inf")).otherwise(F.col("value"))
    return c.with_frame("Event", c.scan("Event").withColumn("value", bad))


_DIRTY = "(SELECT *, CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0 ELSE value END AS v FROM events)"
Q["sum_dirty"] = (lambda c: rounded(A.aggregate(_dirty(c), A.Summation(("value",)), "User", "events", name="s"), "s"), f"SELECT user_id AS id, round(sum(v), 2) AS s FROM {_DIRTY} GROUP BY user_id")
Q["avg_global"] = (lambda c: rounded(A.aggregate_all(c, A.Average(("o_totalprice",)), "Order", name="a"), "a", digits=4), "SELECT round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*), 4) AS a FROM orders")
Q["avg_property"] = (lambda c: rounded(A.aggregate(c, A.Average(("l_quantity",)), "Order", "lineitems", name="a"), "a", digits=4), "SELECT o_orderkey AS id, round(coalesce(avg(l_quantity), 0), 4) AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["avg_null_denominator"] = (lambda c: rounded(A.aggregate(_dirty(c), A.Average(("value",)), "User", "events", name="a"), "a", digits=4), f"SELECT user_id AS id, round(sum(v) / count(*), 4) AS a FROM {_DIRTY} GROUP BY user_id")
Q["weighted_sum_property"] = (lambda c: rounded(A.aggregate(c, A.WeightedSummation(("l_extendedprice", "l_discount"), lambda i: (1 - i["l_discount"], i["l_extendedprice"])), "Order", "lineitems", name="s"), "s", digits=4), "SELECT o_orderkey AS id, round(coalesce(sum(l_extendedprice::DECIMAL(18, 2) * (1 - l_discount::DECIMAL(18, 2))), 0)::DOUBLE, 4) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["weighted_sum_global"] = (lambda c: rounded(A.aggregate_all(c, A.WeightedSummation(("o_totalprice", "customer.c_acctbal"), lambda i: (F.when(i["customer.c_acctbal"] > 0, 1.0), i["o_totalprice"])), "Order", name="s"), "s"), "SELECT round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE, 2) AS s FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0")
Q["weighted_sum_link"] = (lambda c: rounded(A.aggregate(c, A.WeightedSummation(("&.quantity", "s_acctbal"), lambda i: (i["&.quantity"], i["s_acctbal"])), "Part", "suppliers", name="s"), "s"), "SELECT p_partkey AS id, round(coalesce(sum(l_quantity::DECIMAL(18, 2) * s_acctbal::DECIMAL(18, 2)), 0)::DOUBLE, 2) AS s FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey")
Q["every_property"] = (lambda c: A.aggregate(c, A.Every(("l_quantity",), lambda i: i["l_quantity"] > 10), "Order", "lineitems", name="ok"), "SELECT o_orderkey AS id, coalesce(bool_and(l_quantity > 10), true) AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["every_not_empty"] = (lambda c: A.aggregate(c, A.Every(("l_quantity",), lambda i: i["l_quantity"] > 10, not_empty=True), "Order", "lineitems", name="ok"), "SELECT o_orderkey AS id, coalesce(bool_and(l_quantity > 10), false) AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["every_global"] = (lambda c: A.aggregate_all(c, A.Every(("o_totalprice",), lambda i: i["o_totalprice"] > 0), "Order", name="ok"), "SELECT bool_and(o_totalprice > 0) AS ok FROM orders")
Q["any_property"] = (lambda c: A.aggregate(c, A.Any_(("l_returnflag",), lambda i: i["l_returnflag"] == "R"), "Order", "lineitems", name="ok"), "SELECT o_orderkey AS id, coalesce(bool_or(l_returnflag = 'R'), false) AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
Q["any_global"] = (lambda c: A.aggregate_all(c, A.Any_(("o_totalprice",), lambda i: i["o_totalprice"] > 1e9), "Order", name="ok"), "SELECT bool_or(o_totalprice > 1e9) AS ok FROM orders")
Q["agg_filtered_relation"] = (lambda c: A.aggregate(c, A.Count(), "Order", "returned", name="n"), "SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
Q["agg_filtered_entity"] = (lambda c: rounded(A.aggregate_all(c, A.Summation(("c_acctbal",)), "RichAsian", name="s"), "s"), "SELECT round(coalesce(sum(c_acctbal::DECIMAL(18, 2)), 0)::DOUBLE, 2) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 5000 AND r_name = 'ASIA'")
Q["agg_merged_entity"] = (lambda c: A.aggregate_all(c, A.Count(("balance",), lambda i: i["balance"] < 0), "Contact", name="n"), "SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) + (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS n")
Q["agg_symmetric"] = (lambda c: rounded(A.aggregate(c, A.Summation(("s_acctbal",)), "Supplier", "peers", name="s"), "s"), "SELECT a.s_suppkey AS id, round(coalesce(sum(b.s_acctbal::DECIMAL(18, 2)), 0)::DOUBLE, 2) AS s FROM supplier a LEFT JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey GROUP BY a.s_suppkey")
Q["agg_with_match"] = (lambda c: A.aggregate(c, A.Count(), "Customer", "orders", M("lineitems", "exist", M("l_returnflag", "=", "R")), name="n"), "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY c_custkey")
Q["agg_with_dict_dep"] = (lambda c: A.aggregate(c, A.Count(("o_totalprice",), lambda i: i["o_totalprice"] > i.dep["limit"]), "Customer", "orders", name="n", deps=A.scalars(limit=c.scan("Order").agg(F.round(F.avg("o_totalprice"), 2)))), "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > (SELECT round(avg(o_totalprice), 2) FROM orders) GROUP BY c_custkey")

Q["scoped_sequence"] = (lambda c: sequences.scoped_sequence(c.scan("Order"), ["o_custkey"], ["o_orderkey"]).select("id", "number"), "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders")
Q["scoped_sequence_match_step"] = (lambda c: sequences.scoped_sequence(c.scan("Order"), ["o_custkey"], ["o_orderkey"], initial=100, step=10, where=F.col("status_n") == "F").select("id", "number"), "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 100 + 10 * row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) END AS number FROM orders")
Q["retention_cap"] = (lambda c: sequences.retain_cap(c.scan("Event"), ["user_id"], ["ts"], 5).select("id"), "SELECT event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r <= 5")


def _now():
    return F.to_timestamp(F.lit("2024-01-30 00:00:00"))


Q["retention_ttl"] = (lambda c: sequences.retain_ttl(c.scan("Event"), "ts", _now(), "7 days").select("id"), "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-23'")
Q["retention_cap_ttl"] = (lambda c: sequences.retain(c.scan("Event"), {"ttl": {"ts": "ts", "max_age": "10 days"}, "cap": {"partition": ["user_id", "event_type"], "keys": ["ts"], "n": 2}}, _now()).select("id"), "SELECT event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-20') WHERE r <= 2")
Q["latest_by_key"] = (lambda c: sequences.latest_by_key(c.scan("Event"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1")
Q["seed_max"] = (lambda c: sequences.sequence_seed(c.scan("Order"), ["o_custkey"], "o_orderkey"), "SELECT o_custkey, max(o_orderkey) AS seed FROM orders GROUP BY o_custkey")

Q["transform_1_1"] = (lambda c: derive.transform(c.scan("Event").filter("event_type = 'purchase'"), "event_id", lambda x: F.struct(x("user_id").alias("buyer"), (x("value") * 2).alias("points"))), "SELECT event_id AS source_id, 0 AS transform_index, user_id AS buyer, value * 2 AS points FROM events WHERE event_type = 'purchase'")
Q["transform_1_n"] = (lambda c: derive.transform(c.scan("Order"), "o_orderkey", lambda x: [F.struct(x("o_orderstatus").alias("tag")), F.when(x("o_totalprice") > 100000, F.struct(F.lit("big").alias("tag"))), F.struct(x("o_orderpriority").alias("tag"))]), "SELECT o_orderkey AS source_id, i AS transform_index, CASE i WHEN 0 THEN o_orderstatus WHEN 1 THEN 'big' ELSE o_orderpriority END AS tag FROM orders, (VALUES (0), (1), (2)) v(i) WHERE i <> 1 OR o_totalprice > 100000")
Q["transform_events"] = (lambda c: derive.transform_events(c.scan("Event"), F.col("event_type") == "error", [F.col("event_id"), F.col("user_id"), F.get_json_object("props", "$.k").cast("int").alias("k")]), "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'error'")
Q["transform_patch"] = (lambda c: derive.transform_patch(*[derive.transform(c.scan("Order"), "o_orderkey", lambda x, t=t: [F.when(x("o_totalprice") > t, F.struct(F.floor(x("o_totalprice") / t).alias("units")))]) for t in (100000, 150000)]), "SELECT o_orderkey AS source_id, 0 AS transform_index, CASE WHEN o_totalprice <= 150000 THEN 'delete' ELSE 'update' END AS op, floor(o_totalprice / CASE WHEN o_totalprice <= 150000 THEN 100000 ELSE 150000 END)::BIGINT AS units FROM orders WHERE o_totalprice > 100000 AND (o_totalprice <= 150000 OR floor(o_totalprice / 100000) <> floor(o_totalprice / 150000))")

T = machines.Transfer
MACHINE = machines.StateMachine("new", (T("signup", "new", "member"), T("purchase", "member", "buyer"), T("error", "buyer", "lost"), T("error", "member", "lost"), T("signup", "lost", "member")))
_MACHINE_SQL = """WITH RECURSIVE e AS (SELECT {key} AS k, event_type, value, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events WHERE {where}),
    f(k, n, s, m, v) AS (SELECT DISTINCT k, 0::BIGINT, 'new', 0, 0::DOUBLE FROM e UNION ALL SELECT f.k, e.n, t.s2, f.m + (t.s2 <> f.s)::INT, CASE WHEN t.s2 <> f.s THEN f.v + e.value ELSE f.v END FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1,
        LATERAL (SELECT CASE WHEN f.s = 'new' AND event_type = 'signup' THEN 'member' WHEN f.s = 'member' AND event_type = 'purchase' THEN 'buyer' WHEN f.s IN ('buyer', 'member') AND event_type = 'error' THEN 'lost' WHEN f.s = 'lost' AND event_type = 'signup' THEN 'member' ELSE f.s END AS s2) t),
    z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM f) """
Q["state_machine_property"] = (lambda c: machines.final_states(c.scan("Event").select("user_id", "ts", "event_id", "event_type"), MACHINE, ["user_id"], ["ts", "event_id"], "event_type", F.to_date("ts")), _MACHINE_SQL.format(key="user_id", where="true") + "SELECT k AS user_id, s AS state FROM z WHERE r = 1")
Q["state_machine_global"] = (lambda c: machines.final_states(c.scan("Event").filter("value > 95").select(F.lit("all").alias("scope"), "ts", "event_id", "event_type"), MACHINE, ["scope"], ["ts", "event_id"], "event_type", F.to_date("ts")), _MACHINE_SQL.format(key="'all'", where="value > 95") + "SELECT k AS scope, s AS state FROM z WHERE r = 1")
Q["state_machine_value"] = (lambda c: rounded(machines.fold_values(c.scan("Event").select("user_id", "ts", "event_id", "event_type", "value"), MACHINE, ["user_id"], ["ts", "event_id"], "event_type", F.lit(0.0), lambda v, s, e: v + e("value")).select("user_id", "state", "value", "moves"), "value"), _MACHINE_SQL.format(key="user_id", where="true") + "SELECT k AS user_id, s AS state, m AS moves, round(v, 2) AS value FROM z WHERE r = 1")
Q["state_machine_sum"] = (lambda c: rounded(machines.sum_values(c.scan("Event").select("user_id", "ts", "event_id", "event_type", "value"), MACHINE, ["user_id"], ["ts", "event_id"], "event_type", F.lit(0.0), lambda s, e: e("value"), F.to_date("ts")), "value"), _MACHINE_SQL.format(key="user_id", where="true") + "SELECT k AS user_id, s AS state, m AS moves, round(v, 2) AS value FROM z WHERE r = 1")
Q["scoped_sequence_global"] = (lambda c: sequences.scoped_sequence(c.scan("Event"), [], ["ts", "event_id"]).select("event_id", "number"), "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS number FROM events")
Q["state_machine_targets"] = (lambda c: machines.targets(c.scan("Event").filter("event_type = 'click'"), F.array("user_id", F.col("user_id") + 1)).groupBy("target").agg(F.count("*").alias("n")), "SELECT target, count(*) AS n FROM (SELECT user_id AS target FROM events WHERE event_type = 'click' UNION ALL SELECT user_id + 1 FROM events WHERE event_type = 'click') GROUP BY target")


def _activity(kind: str) -> Query:
    a = machines.Activity(["signup", machines.Group(kind, [["purchase"], ["error"]])])
    return lambda c: machines.run_activities(c.scan("Event"), a, "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"))


_ACT = """WITH s AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
    h AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS t0, count(*) AS n FROM s GROUP BY user_id),
    b AS (SELECT h.user_id, n, t0, min(ts) FILTER (event_type = 'purchase' AND ts > t0) AS p, min(ts) FILTER (event_type = 'error' AND ts > t0) AS e FROM h JOIN s USING (user_id) GROUP BY ALL)
    SELECT user_id, CASE WHEN t0 IS NULL THEN 'none' WHEN {done} THEN 'done' ELSE '1' END AS step, {ok}::BIGINT AS accepted, (n - {ok})::BIGINT AS refused FROM b"""
for _k in ("any", "race"):
    Q[f"activity_{_k}"] = (_activity(_k), _ACT.format(done="p IS NOT NULL OR e IS NOT NULL", ok="((t0 IS NOT NULL)::INT + (p IS NOT NULL OR e IS NOT NULL)::INT)"))
Q["activity_every"] = (_activity("every"), _ACT.format(done="p IS NOT NULL AND e IS NOT NULL", ok="((t0 IS NOT NULL)::INT + (p IS NOT NULL)::INT + (e IS NOT NULL)::INT)"))

E_ = Expression.variable
Q["realtime_expression"] = (lambda c: rounded(derive.real_time(c.scan("Event"), _now(), lambda now: E_("value").multiply(2).add(E_("age").divide(3600)).column({"value": F.col("value"), "age": F.unix_timestamp(now) - F.unix_timestamp("ts")})).select("id", "value"), "value", digits=4), "SELECT event_id AS id, round(value * 2 + (epoch(TIMESTAMP '2024-01-30') - floor(epoch(ts))) / 3600, 4) AS value FROM events")
Q["realtime_inequality"] = (lambda c: derive.real_time(c.scan("Event"), _now(), lambda now: E_("age").gt(86400).column({"age": F.unix_timestamp(now) - F.unix_timestamp("ts")}), name="old").select("id", "old"), "SELECT event_id AS id, epoch(TIMESTAMP '2024-01-30') - floor(epoch(ts)) > 86400 AS old FROM events")
Q["realtime_equation"] = (lambda c: derive.real_time(c.scan("Order"), _now(), lambda now: E_("a").eq(E_("b")).column({"a": F.col("o_totalprice") % 2, "b": F.lit(0.0)}), name="even").select("id", "even"), "SELECT o_orderkey AS id, abs(o_totalprice % 2) < 1e-10 AS even FROM orders")
Q["realtime_next"] = (lambda c: derive.real_time(c.scan("Event"), _now(), lambda now: F.unix_timestamp(now) - F.unix_timestamp("ts") > 86400, lambda now: derive.crossing(-F.unix_timestamp("ts").cast("double"), F.lit(1.0), F.lit(86400.0)), "old").select("id", "old", F.col("old_next").cast("bigint").alias("next")), "SELECT event_id AS id, epoch(TIMESTAMP '2024-01-30') - floor(epoch(ts)) > 86400 AS old, (floor(epoch(ts)) + 86400)::BIGINT AS next FROM events")


def _custom(c: Catalog) -> DataFrame:
    """Orders by status, kept from a change log: a patch of the statuses that changed, with the number of batches as state."""
    old, new = _snapshots(c)
    count = lambda df: df.groupBy(F.coalesce("o_orderstatus", F.lit("none")).alias("id")).agg(F.count("*").alias("n"))
    batches = lambda df, k: df.sparkSession.createDataFrame([(k,)], "batches int")

    def patch(deps, last, log, state):
        side = lambda k, sign: log["orders"].filter(F.col(k).isNotNull()).select(F.coalesce(f"{k}.o_orderstatus", F.lit("none")).alias("id"), F.lit(sign).alias("d"))
        moved = side("new", 1).unionAll(side("old", -1)).groupBy("id").agg(F.sum("d").alias("d"))
        out = moved.join(last, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("d")).alias("n"), F.col("n").isNull().alias("fresh"))
        return out.select("id", F.when(F.col("n") == 0, "delete").when(F.col("fresh"), "insert").otherwise("update").alias("op"), "n"), state.select((F.col("batches") + 1).alias("batches"))

    job = derive.Custom(lambda deps, state: count(deps["orders"]), incremental_patch=patch, create_state=lambda: batches(old, 0))
    last, state = job.run({"orders": old})
    value, state = job.run({"orders": new}, last, {"orders": changes.diff(old, new)}, state)
    return value.crossJoin(F.broadcast(state))  # a row


Q["custom_computation"] = (_custom, "SELECT coalesce(o_orderstatus, 'none') AS id, count(*) AS n, 1 AS batches FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0) GROUP BY 1")
Q["async_tasks"] = (lambda c: derive.settle_tasks(c.scan("Event").select("id", "user_id", F.when(F.col("event_type") == "error", "pending").otherwise("success").alias("status")), ["user_id"]).groupBy("status").agg(F.count("*").alias("n")), "SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'pending' WHEN event_id = max(event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id) THEN 'applied' ELSE 'skipped' END AS status FROM events) GROUP BY status")


def _snapshots(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of orders: the second lacks every eleventh, has every seventh's status changed (every fourteenth's to null) and one in thirteen
    anew."""
    o = c.scan("Order").select("id", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.filter("id % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("id") % 14 == 0, None).when(F.col("id") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("id") % 7 == 0, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice")))
    return o.filter("id % 13 <> 0"), new


_OLD = "(SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 <> 0)"
_NEW = "(SELECT o_orderkey AS id, o_custkey, CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)"
Q["changelog_diff"] = (lambda c: changes.diff(*_snapshots(c)).select("id", "op", F.coalesce(F.array_join("keys", ","), F.lit("")).alias("keys")), f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS op, CASE WHEN o.id IS NULL OR n.id IS NULL THEN '' ELSE 'o_orderstatus,o_totalprice' END AS keys FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.id % 7 = 0")
Q["event_pattern"] = (lambda c: changes.diff(*_snapshots(c)).filter(changes.pattern({"type": "update", "keys": ["o_orderstatus"], "record": {"o_orderstatus": "X"}, "old": {"o_orderstatus": "F"}}, "new", "old")).select("id"), f"SELECT n.id FROM {_OLD} o JOIN {_NEW} n ON o.id = n.id WHERE n.o_orderstatus = 'X' AND o.o_orderstatus = 'F'")
Q["view_membership_events"] = (lambda c: changes.membership(*[s.filter("o_totalprice > 100000 and o_orderstatus <> 'X'") for s in _snapshots(c)]), f"WITH a AS (SELECT id FROM {_OLD} WHERE o_totalprice > 100000 AND o_orderstatus <> 'X'), b AS (SELECT id FROM {_NEW} WHERE o_totalprice > 100000 AND o_orderstatus <> 'X') SELECT id, 'create' AS event FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'delete' FROM a WHERE id NOT IN (SELECT id FROM b)")
Q["apply_patch"] = (lambda c: changes.apply_patch(_snapshots(c)[0], changes.diff(*_snapshots(c)).select("id", F.when(F.col("op") == "create", "insert").otherwise(F.col("op")).alias("op"), "keys", "new.*")).select("id", "o_orderstatus", "o_custkey"), f"SELECT id, o_orderstatus, o_custkey FROM {_NEW}")
Q["dirty_hosts"] = (lambda c: changes.dirty_hosts(changes.diff(*_snapshots(c)).select("id"), c.scan("Order").select("id", F.col("o_custkey").alias("host"))), "SELECT DISTINCT o_custkey AS host FROM orders WHERE (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AND NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0)")


def _delta(agg: A.Aggregation, name: str, digits: int | None = None) -> Query:
    """The aggregation of each customer's orders on the second snapshot, from that of the first and the changed rows only."""
    def run(c: Catalog) -> DataFrame:
        old, new = _snapshots(c)
        log = changes.diff(old, new)
        items = lambda d: d.select(F.col("o_custkey").alias("host"), *[v.alias(k) for k, v in agg.states(A.Item({x: F.col(x) for x in ("o_orderstatus", "o_totalprice")}, {})).items()])
        state = A.sums(items(old), "host")
        part = lambda side: items(log.filter(f"{side} is not null").select(f"{side}.*"))
        out = A.from_state(agg, c.scan("Customer"), A.delta(state, part("old"), part("new")), name)
        return out if digits is None else rounded(out, name, digits=digits)

    return run


_JOINED = f"customer LEFT JOIN {_NEW} n ON o_custkey = c_custkey GROUP BY c_custkey"
Q["delta_count"] = (_delta(A.Count(("o_orderstatus",), lambda i: i["o_orderstatus"] != "F"), "n"), f"SELECT c_custkey AS id, count(*) FILTER (o_orderstatus <> 'F') AS n FROM {_JOINED}")
Q["delta_sum"] = (_delta(A.Summation(("o_totalprice",)), "s", 2), f"SELECT c_custkey AS id, round(coalesce(sum(o_totalprice), 0), 2) AS s FROM {_JOINED}")
Q["delta_avg"] = (_delta(A.Average(("o_totalprice",)), "a", 7), f"SELECT c_custkey AS id, round(coalesce(avg(o_totalprice), 0), 7) AS a FROM {_JOINED}")
Q["delta_every"] = (_delta(A.Every(("o_totalprice",), lambda i: i["o_totalprice"] > 50000), "ok"), f"SELECT c_custkey AS id, coalesce(bool_and(o_totalprice > 50000), true) AS ok FROM {_JOINED}")
Q["delta_any"] = (_delta(A.Any_(("o_orderstatus",), lambda i: i["o_orderstatus"] == "X"), "ok"), f"SELECT c_custkey AS id, coalesce(bool_or(o_orderstatus = 'X'), false) AS ok FROM {_JOINED}")
Q["delta_weighted"] = (_delta(A.WeightedSummation(("o_totalprice", "o_orderstatus"), lambda i: (F.when(i["o_orderstatus"] == "X", 2).otherwise(1), i["o_totalprice"])), "s", 2), f"SELECT c_custkey AS id, round(coalesce(sum(o_totalprice * CASE WHEN o_orderstatus = 'X' THEN 2 ELSE 1 END), 0), 2) AS s FROM {_JOINED}")

Q["identity_insert_ignore"] = (lambda c: governance.insert_ignore(c.scan("Event").filter("event_type = 'signup'"), c.scan("Event"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id"), "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) e WHERE r = 1 AND event_type <> 'signup'")
Q["idempotent_dedup"] = (lambda c: governance.idempotent(c.scan("Event"), ["user_id", "event_type", "props"], ["ts", "event_id"]).select("event_id"), "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
Q["dispatch_batch"] = (lambda c: governance.dispatch(c.scan("Event").filter("ts >= '2024-01-10'"), c.scan("Event").filter("ts < '2024-01-10'"), ["user_id", "props"], ["ts", "event_id"], F.col("event_type") != "error", lambda df: df.withColumn("points", F.col("value") * F.col("rate")), open_=lambda df: df.withColumn("rate", F.when(F.col("event_type") == "purchase", 2.0).otherwise(1.0)), after=lambda out: out["created"].select("event_id", F.round("points", 4).alias("points")))["answer"], "SELECT event_id, round(value * CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END, 4) AS points FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-10') e WHERE r = 1 AND event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events k WHERE k.ts < TIMESTAMP '2024-01-10' AND k.user_id = e.user_id AND k.props = e.props)")
Q["guard_conditions"] = (lambda c: governance.guard(c.scan("Event"), "buyer && !(small || old)", {"buyer": lambda: F.col("event_type") == "purchase", "small": lambda: F.col("value") < 20, "old": lambda: F.col("ts") < _now() - F.expr("INTERVAL 20 DAYS")})[0].select("event_id"), "SELECT event_id FROM events WHERE event_type = 'purchase' AND NOT (value < 20 OR ts < TIMESTAMP '2024-01-10')")
Q["unique_violations"] = (lambda c: governance.unique_violations(c.scan("Lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
Q["filtered_unique_violations"] = (lambda c: governance.unique_violations(c.scan("Order"), ["o_custkey", "status_n"], [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_orderstatus", "notEquals", "F")]), "SELECT o_custkey, o_orderstatus AS status_n, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' GROUP BY ALL HAVING count(*) > 1")
Q["non_null_violations"] = (lambda c: governance.non_null_violations(c.scan("Order"), ["status_n", "price_n", "o_custkey"]), "SELECT o_orderkey AS id, 'status_n' AS \"column\" FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'price_n' FROM orders WHERE o_orderkey % 4 = 0")
Q["cascade_delete"] = (lambda c: governance.cascade_delete(c, "Order", M("o_totalprice", ">", 400000))["Lineitem"].select("id"), "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 400000")
Q["delete_by_match"] = (lambda c: governance.delete(c.scan("Order"), find(c, "Order", M("lineitems", "exist", M("l_returnflag", "=", "R")), attrs=["id"])).select("id"), "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
Q["hard_delete"] = (lambda c: governance.hard_delete(c.scan("Customer").withColumn("_isDeleted_", F.when(F.col("c_acctbal") < 0, True))).select("id"), "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0")
Q["update_by_match"] = (lambda c: governance.update_by_match(c, "Customer", M("nation.region.r_name", "=", "ASIA"), {"c_acctbal": F.col("c_acctbal") + 1}).select("id", F.round("c_acctbal", 2).alias("c_acctbal")), "SELECT c_custkey AS id, round(c_acctbal + (r_name = 'ASIA')::INT, 2) AS c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
Q["relation_replace"] = (lambda c: governance.replace_links(c.links(c.relations["PartSuppliers"]), c.scan("Part").filter("p_size > 25").select(F.col("p_partkey").alias("source"), F.lit(1).cast("bigint").alias("target"), F.lit(0.0).alias("quantity"))).select("source", "target", "quantity"), "SELECT l_partkey AS source, l_suppkey AS target, sum(l_quantity) AS quantity FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY ALL UNION ALL SELECT p_partkey, 1, 0 FROM part WHERE p_size > 25")
Q["add_links_one"] = (lambda c: governance.add_links(c.scan("Customer").filter("c_acctbal < 5000").select(F.col("c_nationkey").alias("source"), F.col("id").alias("target")), c.scan("Customer").filter("c_acctbal > 0").select((F.col("c_nationkey") + 100).alias("source"), F.col("id").alias("target"), F.col("id").alias("seq")), "1:n").select("source", "target"), "SELECT CASE WHEN c_acctbal > 0 THEN c_nationkey + 100 ELSE c_nationkey END AS source, c_custkey AS target FROM customer")
Q["allocate_ids"] = (lambda c: governance.allocate_ids(c.scan("Order").select("id"), c.scan("Customer").select("c_custkey"), ["c_custkey"]).select("id", "c_custkey"), "SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS id, c_custkey FROM customer")
Q["insert_rows"] = (lambda c: governance.insert(c.scan("Vendor").select("id", "name"), c.scan("Client").filter("balance > 9000").select("id", "name")), "SELECT 'S' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'C' || c_custkey, c_name FROM customer WHERE c_acctbal > 9000")
Q["payload_ref_check"] = (lambda c: governance.payload_errors(c.scan("Event").select("event_id", (F.col("user_id") * 40).alias("customer"), F.when(F.col("value") > 1, F.col("value")).alias("value")), [{"name": "customer", "ref": "customer"}, {"name": "value", "required": True}], "event_id", {"customer": c.scan("Customer")}), "SELECT event_id, 'customer' AS field, 'ref' AS error FROM events WHERE user_id * 40 NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT event_id, 'value', 'required' FROM events WHERE value IS NULL OR value <= 1")
Q["default_backfill"] = (lambda c: governance.backfill(c.scan("Order").select("id", "o_orderstatus"), Property("stage", default="NEW")), "SELECT o_orderkey AS id, o_orderstatus, 'NEW' AS stage FROM orders")
Q["union_defaults"] = (lambda c: governance.with_input_defaults({"Buyer": Entity("Buyer", (Property("tier", default="gold"),)), "Seller": Entity("Seller", (Property("tier", default="trade"), Property("fee", "number", default=2.5)))}, c.scan("Customer").select("id", F.lit("Buyer").alias("__type")).unionAll(c.scan("Supplier").select("id", F.lit("Seller")))), "SELECT c_custkey AS id, 'Buyer' AS __type, 'gold' AS tier, NULL::DOUBLE AS fee FROM customer UNION ALL SELECT s_suppkey, 'Seller', 'trade', 2.5 FROM supplier")
Q["null_out"] = (lambda c: governance.null_out(c, "Order", M("o_orderstatus", "=", "F"), ["o_custkey"]).select("id", "o_custkey"), "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey FROM orders")
Q["deletion_events"] = (lambda c: governance.deletion_events(governance.cascade_delete(c, "Order", M("o_totalprice", ">", 400000)), set(c.relations)).filter("record in ('Order', 'Lineitem')").select("record", "id", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("step")).alias("place")), "SELECT 'Order' AS record, o_orderkey::VARCHAR AS id, 2 AS place FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT DISTINCT 'Lineitem', (l_orderkey * 8 + l_linenumber)::VARCHAR, 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 400000")
Q["guard_scope"] = (lambda c: governance.guard_scope(c.scan("Order").select("id", "o_custkey", F.lit(1).alias("number")), c.scan("Order").select("id", "o_custkey", F.lit(2).alias("number")), ["o_custkey"], "number"), "SELECT o_orderkey AS id, o_custkey, 2 AS number FROM orders")
Q["finite_values"] = (lambda c: _dirty(c).scan("Event").select("id", finite(F.col("value")).alias("v")), f"SELECT event_id AS id, v FROM {_DIRTY}")


def _computed(c: Catalog) -> DataFrame:
    e = Entity("Line", (Property("total", "number", computed=lambda r: r["l_extendedprice"] * (1 - r["l_discount"])), Property("note", default="none"), Property("flag", default="new")))
    # every payload lacks `note`; only those of odd lines have `flag`, which is null in some
    lines = c.scan("Lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("flag"))
    written = F.when(F.col("l_linenumber") % 2 == 1, F.array(F.lit("flag"))).otherwise(F.array().cast("array<string>"))
    return rounded(governance.with_defaults(e, lines, written).select("l_orderkey", "l_linenumber", "total", "note", "flag"), "total", digits=4)


Q["computed_and_default"] = (_computed, "SELECT l_orderkey, l_linenumber, round((l_extendedprice::DECIMAL(18, 2) * (1 - l_discount::DECIMAL(18, 2)))::DOUBLE, 4) AS total, 'none' AS note, CASE WHEN l_linenumber % 2 = 0 THEN 'new' WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag FROM lineitem")
Q["member_change"] = (lambda c: changes.diff(*_snapshots(c)).select("id", changes.member_change(F.col("old.o_orderstatus") == "F", F.col("new.o_orderstatus") == "F").alias("move")).filter("move <> 'none'"), f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN coalesce(o.o_orderstatus = 'F', false) THEN 'left' ELSE 'entered' END AS move FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id WHERE coalesce(o.o_orderstatus = 'F', false) <> coalesce(n.o_orderstatus = 'F', false)")
Q["merged_event_view"] = (lambda c: (log := changes.diff(*_snapshots(c))).select("id", changes.merged_view(log).alias("r")).select("id", "r.o_orderstatus", "r.o_custkey"), f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, CASE WHEN n.id IS NULL THEN o.o_custkey ELSE n.o_custkey END AS o_custkey FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.id % 7 = 0")
Q["attribute_trigger"] = (lambda c: changes.diff(*_snapshots(c)).filter((F.col("op") == "update") & changes.touches(F.col("keys"), ["o_orderstatus"])).select("id"), f"SELECT n.id FROM {_OLD} o JOIN {_NEW} n ON o.id = n.id WHERE o.id % 7 = 0")
Q["create_graph"] = (lambda c: governance.create_graph({"Customer": c.scan("Customer").select("id", "c_name"), "Order": c.scan("Order").select("id", "o_custkey")}, {"Customer": c.scan("Supplier").select((F.col("id") + 1000000).alias("id"), F.col("s_name").alias("c_name")), "Order": c.scan("Supplier").select((F.col("id") + 9000000).alias("id"), (F.col("id") + 1000000).alias("o_custkey"))}, {"Order": [("o_custkey", "Customer")]})["Order"].select("id", "o_custkey"), "SELECT o_orderkey AS id, o_custkey FROM orders UNION ALL SELECT s_suppkey + 9000000, s_suppkey + 1000000 FROM supplier")
Q["millis_round_trip"] = (lambda c: c.scan("Event").select("id", millis(F.col("ts").cast("timestamp")).alias("ms"), (from_millis(millis(F.col("ts").cast("timestamp"))) <= F.col("ts").cast("timestamp")).alias("ok")), "SELECT event_id AS id, epoch_us(ts) // 1000 AS ms, true AS ok FROM events")
Q["json_canonical"] = (lambda c: c.scan("Event").select("id", json_column(F.concat(F.lit('{"z": 1, "a": '), "props", F.lit("}"))).alias("j")), "SELECT event_id AS id, '{\"a\":{\"k\":' || json_extract(props, '$.k') || '},\"z\":1}' AS j FROM events")
Q["ids_as_text"] = (lambda c: c.scan("Client").join(c.scan("Customer"), same_id(F.substring(c.scan("Client")["id"], 2, 20), F.col("c_custkey"))).select("c_custkey"), "SELECT c_custkey FROM customer")
Q["dictionary_values"] = (lambda c: KeyValues.empty(c.spark).set("dictionary", "limit", 5).set("dictionary", "limit", 7).set("system", "limit", [1, {"b": 2, "a": 1}]).df, """SELECT * FROM (VALUES ('dictionary', 'limit', '{"raw":7}'), ('system', 'limit', '{"raw":[1,{"a":1,"b":2}]}')) t(concept, key, value)""")
Q["nested_recursive"] = (lambda c: find(c, "Customer", M("c_custkey", "=", 1), attrs=["c_name", recursive(c, "Customer", "children", ["c_name"], 3)]).select(F.explode("children").alias("a")).select(F.explode("a.children").alias("b")).select(F.explode("b.children").alias("d")).select("d.id", "d.c_name"), "SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey // 8 = 1")
Q["view_graph_refresh"] = (lambda c: Graph().add(View("totals", {"orders": ("o_totalprice",)}, lambda d: d["orders"].groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t")))).add(View("rich", {"totals": ()}, lambda d: d["totals"].filter("t > 1000000").select("o_custkey"))).refresh({"orders": c.scan("Order")})["rich"], "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice::DECIMAL(18, 2)) > 1000000")
