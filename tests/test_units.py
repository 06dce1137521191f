"""Declarations, boolean expressions, symbolic expressions, the view graph, machines, and errors."""

import pytest
from pyspark.sql import functions as F

from kinfold import BoolExp, Catalog, Entity, FilteredEntity, Match, MergedEntity, ModelError, Property, Relation, find
from kinfold.functions.expression import Expression
from kinfold.functions.values import canonical_json, to_timestamp_literal
from kinfold.model import TypeSpec, define_type, from_dict, to_dict
from kinfold.operators import aggregations as A
from kinfold.operators import changes, derive, governance, machines, sequences
from kinfold.plans.query import Modifier, merge_attrs, nested
from kinfold.plans.views import Graph, View, dependencies, manifest, manifest_diff, rebuild_plan
from kinfold.sources.tables import KeyValues

M = Match.atom


@pytest.fixture(scope="module")
def cat(spark):
    c = Catalog(spark)
    c.entity(Entity("A", (Property("x", "number"), Property("j", "json"), Property("tags", collection=True))), spark.createDataFrame([(1, 1.0, '{"a":1,"b":[2]}', ["p"]), (2, None, None, None), (3, float("nan"), '{"b":[2], "a":1}', ["q", "p"]), (None, 9.0, None, None)], "id int, x double, j string, tags array<string>"))
    c.entity(Entity("B", (Property("y", "number"),)), spark.createDataFrame([(10, 5.0, 1), (11, None, 1), (12, float("inf"), 3)], "id int, y double, a_id int"))
    c.relation(Relation("AB", "A", "bs", "B", "a", "1:n", reliance=True), fk=("target", "a_id"))
    return c


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_bool_expressions():
    e = BoolExp.parse("a && !(b || c)")
    assert [e.evaluate(lambda n, on=on: n in on)[0] for on in ("a", "ab", "", "ac")] == [True, False, False, False]
    assert e.evaluate(lambda n: n in "ab")[1] == ["b"]
    assert BoolExp.from_dict(e.to_dict()) == e
    assert BoolExp.all(None, "a", None) == BoolExp.atom("a") and BoolExp.any() is None
    assert list(e.map(str.upper).atoms()) == ["A", "B", "C"] and e.find(lambda n: n > "a") == "b"
    assert BoolExp("and", BoolExp.atom("a")).evaluate(lambda n: True) == (True, [])


def test_records_without_id_are_not_scanned(cat):
    assert ids(find(cat, "A", attrs=["id"])) == [1, 2, 3]


def test_json_and_collections(cat):
    assert ids(find(cat, "A", M("j", "=", {"b": [2], "a": 1}), attrs=["id"])) == [1, 3]
    assert ids(find(cat, "A", M("j", "=", {"b": [2], "a": 1}).not_(), attrs=["id"])) == [2]
    assert ids(find(cat, "A", M("tags", "contains", "q").not_(), attrs=["id"])) == [1, 2]
    assert canonical_json('{"b":1,"a":{"d":1,"c":2}}') == '{"a":{"c":2,"d":1},"b":1}'


@pytest.mark.parametrize("bad", [("x", ">", None), ("x", "in", 3), ("x", "between", [1, None]), ("x", "contains", 1), ("x", "is null", 1), ("x", "~", 1), ("zz.y", "=", 1)])
def test_bad_atoms(cat, bad):
    with pytest.raises(ModelError):
        find(cat, "A", M(*bad))


def test_bad_declarations(cat, spark):
    with pytest.raises(ModelError):
        Property("x", "decimal")
    with pytest.raises(ModelError):
        Relation("R", "A", "p", "A", "p", "1:n")
    with pytest.raises(ModelError):
        Relation("R", "A", "p", "B", "q", "n:n", reliance=True)
    with pytest.raises(ModelError):
        Entity("E", (Property("x"), Property("x")))
    with pytest.raises(ModelError):
        cat.view(FilteredEntity("V", "Nope", M("x", "=", 1)))
    with pytest.raises(ModelError):
        cat.view(MergedEntity("U", ("A", "B"), ("x",)))
    with pytest.raises(ModelError):
        Modifier(limit=-1)
    with pytest.raises(ModelError):
        Modifier.of({"order_by": {"x": "up"}})
    with pytest.raises(ModelError):
        find(cat, "A", modifier={"order_by": {"bs.y": "asc"}})
    with pytest.raises(ModelError):
        merge_attrs([nested("bs", match=M("y", "=", 1)), nested("bs", match=M("y", "=", 2))])
    with pytest.raises(ModelError):
        merge_attrs([("bs", 1, 2)])
    with pytest.raises(ModelError):
        governance.check_payload(cat, "A", spark.range(1).withColumn("nope", F.lit(1)))


def test_extended_type(spark):
    define_type(TypeSpec("money", "double", operators={"near": lambda c, v: F.abs(c - v) < 1}))
    c = Catalog(spark).entity(Entity("P", (Property("m", "money"),)), spark.createDataFrame([(1, 9.5), (2, 20.0)], "id int, m double"))
    assert ids(find(c, "P", M("m", "near", 10), attrs=["id"])) == [1]
    with pytest.raises(ModelError):
        find(c, "P", M("m", ">", 3))


def test_declarations_round_trip(cat):
    for d in [*cat.entities.values(), *cat.relations.values(), FilteredEntity("V", "A", M("x", ">", 1).or_(M("bs", "exist", M("y", "=", 5))))]:
        assert from_dict(to_dict(d)) == d


def test_aggregations_of_dirty_and_missing_values(cat):
    get = lambda agg: {r["id"]: r["value"] for r in A.aggregate(cat, agg, "A", "bs").collect()}
    assert get(A.Count()) == {1: 2, 2: 0, 3: 1}
    assert get(A.Summation(("y",))) == {1: 5.0, 2: 0.0, 3: 0.0}
    assert get(A.Average(("y",))) == {1: 2.5, 2: 0.0, 3: 0.0}
    assert get(A.WeightedSummation(("y",), lambda i: (F.lit(2), i["y"]))) == {1: 10.0, 2: 0.0, 3: 0.0}
    assert get(A.Every(("y",), lambda i: i["y"] > 1)) == {1: False, 2: True, 3: True}
    assert get(A.Every(("y",), lambda i: i["y"] > 1, True)) == {1: False, 2: False, 3: True}
    assert get(A.Any_(("y",), lambda i: i["y"] > 1)) == {1: True, 2: False, 3: True}
    with pytest.raises(ModelError):
        A.Summation(("y", "id"))
    with pytest.raises(ModelError):
        A.Every()
    with pytest.raises(ModelError):
        A.aggregate(cat, A.Every(("x",), lambda i: i["x"] > 1), "B", "a")
    with pytest.raises(ModelError):
        get(A.Count(("y",), lambda i: i["other"] > 1))


def test_delta_follows_any_change(spark):
    import random

    r = random.Random(5)
    agg = A.Average(("v",))
    rows = {i: (r.randint(0, 3), float(r.randint(0, 9))) for i in range(30)}
    frame = lambda d: spark.createDataFrame([(i, h, v) for i, (h, v) in d.items()], "id int, host int, v double")
    items = lambda df: df.select("host", *[c.alias(k) for k, c in agg.states(A.Item({"v": F.col("v")}, {})).items()])
    hosts, state = spark.range(5).select(F.col("id").cast("int").alias("id")), A.sums(items(frame(rows)), "host")
    for _ in range(3):
        new = dict(rows)
        for i in r.sample(sorted(new), 5):
            new[i] = (r.randint(0, 3), float(r.randint(0, 9)))
        for i in r.sample(sorted(new), 3):
            del new[i]
        new[max(new) + 1] = (4, 1.0)
        log = changes.diff(frame(rows), frame(new))
        side = lambda s: items(log.filter(f"{s} is not null").select(f"{s}.*"))
        state = spark.createDataFrame(A.delta(state, side("old"), side("new")).collect(), "host int, s double, n bigint")
        full = A.from_state(agg, hosts, A.sums(items(frame(new)), "host"))
        assert sorted(A.from_state(agg, hosts, state).collect()) == sorted(full.collect())
        assert A.check_states(state).isEmpty()
        rows = new


def test_symbolic_expressions():
    x = Expression.variable("x")
    assert x.multiply(3).add(1).eq(10).solve() == 3
    assert x.power(2).eq(49).solve() == 7 and x.power(3).eq(8).solve() == pytest.approx(2) and x.sqrt().eq(5).solve() == pytest.approx(25)
    assert x.add(1).eq(x.add(2).subtract(x).add(x)).solve() is None
    assert x.gt(2).evaluate({"x": 3}) and x.lt(2).evaluate({"x": 1}) and x.eq(2).evaluate({"x": 2 + 1e-12})
    with pytest.raises(ZeroDivisionError):
        x.divide(0).evaluate({"x": 1})
    with pytest.raises(KeyError):
        x.evaluate({})
    with pytest.raises(ValueError):
        x.eq(Expression.variable("y")).solve()
    assert to_timestamp_literal(0).year == 1970 and to_timestamp_literal("2024-01-02T00:00:00Z").day == 2


def test_view_graph(spark, cat):
    one = lambda d: next(iter(d.values()))
    calls = []
    inc = lambda deps, last, ch: calls.append("inc") or last
    g = Graph().add(View("v1", {"t": ("x",)}, one, inc)).add(View("v2", {"v1": (), "u": ()}, one)).add(View("v0", {"t": ("z",)}, one, phase=0))
    assert g.order() == ["v0", "v1", "v2"]
    assert g.affected({"t": {"x"}}) == ["v1", "v2"] and g.affected({"t": {"q"}}) == [] and g.affected({"u": set()}) == ["v2"]
    df = spark.range(2)
    out = g.refresh({"t": df, "u": df})
    assert out["v2"].count() == 2
    g.refresh({"t": df, "u": df}, {"v0": df, "v1": df, "v2": df}, {"t": df})
    assert calls == ["inc"] and g.plan("v1", df, {}) == "skip" and g.plan("v0", None, {}) == "full"
    assert Graph().add(View("w", {"t": ()}, one, inc, windowed=("t",))).plan("w", df, {"t": df}) == "full"
    with pytest.raises(ModelError):
        Graph().add(View("a", {"b": ()}, one)).add(View("b", {"a": ()}, one))
    cat.view(FilteredEntity("Busy", "A", M("bs.y", ">", 1)))
    assert dependencies(cat, "Busy") == {"AB": set(), "B": {"y"}}
    old = manifest(cat, g)
    g.views["v1"] = View("v1", {"t": ("x",)}, one, inc, version="2")
    assert manifest_diff(old, manifest(cat, g)) == [("changed", "v1")] and rebuild_plan(old, manifest(cat, g), g) == ["v1", "v2"]


def test_machines(spark):
    with pytest.raises(ModelError):
        machines.StateMachine("a", (machines.Transfer("e", "a", "b"), machines.Transfer("e", "a", "c")))
    m = machines.StateMachine("a", (machines.Transfer("e", "a", "b"), machines.Transfer("e", "b", "c"), machines.Transfer(lambda e: e("v") > 5, "c", "a")))
    ev = spark.createDataFrame([(1, i, "e", v) for i, v in enumerate([1, 1, 2, 9, 1])] + [(2, 0, "x", 1)], "k int, n int, ev string, v int")
    for chunk in (F.lit(0), F.col("n"), F.floor(F.col("n") / 2)):
        assert sorted(map(tuple, machines.final_states(ev, m, ["k"], ["n"], "ev", chunk).collect())) == [(1, "b"), (2, "a")]
    got = machines.fold_values(ev, m, ["k"], ["n"], "ev", F.lit(0), lambda v, s, e: v + e("v")).filter("k = 1").head()
    assert (got["state"], got["value"], got["moves"]) == ("b", 12, 4)
    G = machines.Group
    a = machines.Activity(["s", G("any", [["a", "b"], ["c"]]), "t"])
    assert a.run(["x"]) == ("none", 0, 1) and a.run(["s", "a", "c", "b", "t"]) == ("done", 4, 1)
    assert machines.Activity(["s", G("every", [["a"], ["b"]])]).run(["s", "b", "b", "a", "a"]) == ("done", 3, 2)
    assert machines.Activity(["s", G("race", [["a", "b"], ["c", "d"]])]).run(["s", "a", "c", "d"]) == ("done", 4, 0)
    with pytest.raises(ModelError):
        machines.Activity([G("any", [["a"]])])


def test_sequences_and_tasks(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 50), (3, "a", None), (4, "b", None)], "id int, s string, m int")
    assert [r["number"] for r in sequences.scoped_sequence(df, ["s"], ["id"], manual="m", initial=10).orderBy("id").collect()] == [11, 50, 12, 11]
    assert sequences.reserve(10, 3, 2) == {"start": 12, "count": 3, "end": 16, "step": 2}
    assert sequences.retain(df, {"forever": True}, F.current_timestamp()).count() == 4
    t = spark.createDataFrame([(1, "k", "success"), (2, "k", "success"), (3, "k", "pending")], "id int, k string, status string")
    s = derive.settle_tasks(t, ["k"])
    assert [r["status"] for r in s.orderBy("id").collect()] == ["skipped", "applied", "pending"] and derive.clean_tasks(s).count() == 1


def test_governance(cat, spark):
    gone = governance.cascade_delete(cat, "A", M("id", "=", 1))
    assert ids(gone["B"]) == [10, 11] and ids(gone["A"]) == [1] and gone["AB"].count() == 2
    links = spark.createDataFrame([(1, 2)], "source int, target int")
    with pytest.raises(governance.ConstraintError):
        governance.add_links(links, spark.createDataFrame([(1, 2, 1)], "source int, target int, seq bigint"))
    with pytest.raises(governance.ConstraintError):
        governance.insert_ignore(links, spark.createDataFrame([(None, 1)], "source int, target int"), ["source"], ["target"])
    with pytest.raises(governance.ConstraintError):
        governance.enforce(spark.createDataFrame([(1,), (1,)], "a int"), unique=[["a"]])
    with pytest.raises(governance.ConstraintError):
        governance.create_graph({"A": cat.scan("A").select("id"), "B": cat.scan("B")}, {"B": spark.createDataFrame([(99, 1.0, 77)], "id int, y double, a_id int")}, {"B": [("a_id", "A")]})
    e = Entity("E", (Property("a", "number", default=7), Property("b", "number", computed=lambda r: r["a"] * 2)))
    assert governance.with_defaults(e, spark.createDataFrame([(1, None), (2, 3.0)], "id int, a double")).select("b").collect() == [(None,), (6.0,)]  # an explicit null is no missing value
    with pytest.raises(ModelError):
        governance.with_defaults(Entity("E", (Property("b", "number", computed=lambda r: r["rel.x"]),)), spark.range(1))
    bad = governance.payload_errors(spark.createDataFrame([(1, "x"), (2, "3")], "id int, n string"), [{"name": "n", "type": "number"}])
    assert [tuple(r) for r in bad.collect()] == [(1, "n", "type")]


def test_key_values(spark):
    kv = KeyValues.empty(spark).set("dictionary", "a", [1, 2]).set("dictionary", "a", {"z": 1}).set("system", "a", 3)
    assert kv.get("dictionary", "a") == {"z": 1} and kv.get("system", "a") == 3 and kv.get("system", "b", 0) == 0


def test_plans_push_down(spark):
    from kinfold.workload import catalog

    c = catalog(spark, "/root/testdata/sf0.001")
    plan = find(c, "Order", M("o_orderstatus", "=", "F"), attrs=["o_totalprice"])._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "PushedFilters: [" in plan and "EqualTo(o_orderstatus,F)" in plan
    plan = find(c, "Order", M("lineitems", "exist", M("l_returnflag", "=", "R")), attrs=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftOuter" not in plan
