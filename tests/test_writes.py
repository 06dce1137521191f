"""Nulls in change logs, defaults, dispatch steps, customs, ordered deletions, paths, sequences, activities, sinks."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold import Catalog, Entity, ModelError, Property, Relation
from kinfold.operators import changes, derive, governance, machines, sequences
from kinfold.plans.query import find_path, traverse
from kinfold.plans.views import apply_result, approve, destructive, last_value, manifest
from kinfold.sources.tables import EventSource, QueryLog, ddl


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_updates_to_null(spark):
    old, new = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, a string, b int"), spark.createDataFrame([(1, None, 5), (3, "z", None)], "id int, a string, b int")
    log = changes.diff(old, new)
    assert rows(log.select("id", changes.merged_view(log).alias("r")).select("id", "r.*")) == [(1, None, 5), (2, "y", 6), (3, "z", None)]
    patch = log.select("id", F.when(F.col("op") == "create", "insert").otherwise(F.col("op")).alias("op"), "keys", "new.*")
    assert rows(changes.apply_patch(old, patch)) == rows(new)
    # without keys an update writes all it has; with keys only those
    one = spark.createDataFrame([(1, "update", None)], "id int, op string, a string")
    assert rows(changes.apply_patch(old, one)) == [(1, None, 5), (2, "y", 6)]
    some = spark.createDataFrame([(1, "update", ["b"], "lost", 9)], "id int, op string, keys array<string>, a string, b int")
    assert rows(changes.apply_patch(old, some)) == [(1, "x", 9), (2, "y", 6)]


def test_defaults_are_for_what_is_missing(spark):
    e = Entity("E", (Property("a", default="d"), Property("n", "number", default=1)))
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, a string")
    assert rows(governance.with_defaults(e, df)) == [(1, "x", 1.0), (2, None, 1.0)]
    written = F.when(F.col("id") == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    assert rows(governance.with_defaults(e, df, written)) == [(1, "x", 1.0), (2, "d", 1.0)]
    with pytest.raises(ModelError):
        governance.backfill(df, e.properties[0])


def graph(spark, links, name="N"):
    ids = sorted({x for link in links for x in link})
    c = Catalog(spark)
    c.entity(Entity(name, (Property("x", "number"),)), spark.createDataFrame([(i, float(i)) for i in ids], "id int, x double"))
    c.relation(Relation("Link", name, "next", name, "prev", "n:n"), links=spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(links)], "id int, source int, target int"))
    return c


def test_paths(spark):
    long = graph(spark, [(i, i + 1) for i in range(40)])
    (got,) = find_path(long, "N", "next", 0, 40).collect()
    assert got["length"] == 40 and got["path"] == list(range(41))
    assert find_path(long, "N", "next", 40, 0).isEmpty()
    with pytest.raises(ModelError):
        find_path(long, "N", "next", 0, 40, max_depth=5)
    with pytest.raises(ModelError):
        traverse(long, "N", "next", max_depth=5)
    assert traverse(long, "N", "next", max_depth=40).count() == 41 * 42 // 2
    # a dense graph has more simple paths than can be listed
    r = random.Random(1)
    dense = graph(spark, sorted({(a, b) for a in range(40) for b in range(40) if a != b and r.random() < 0.5 and b != 39} | {(38, 39)}))
    (got,) = find_path(dense, "N", "next", 0, 39).collect()
    assert got["path"][-2:] == [38, 39] and got["length"] <= 4


def test_custom(spark):
    nums = spark.createDataFrame([(1, 5), (2, 7)], "id int, n int")
    total = lambda deps, state: deps["nums"].agg(F.sum("n").alias("total"))
    job = derive.Custom(total, lambda deps, last, log, state: last.crossJoin(log["nums"].agg(F.sum("d").alias("d"))).select((F.col("total") + F.col("d")).alias("total")), initial=lambda: spark.createDataFrame([(0,)], "total bigint"))
    assert rows(job.run({})[0]) == [(0,)]
    value, state = job.run({"nums": nums})
    assert rows(value) == [(12,)] and state is None
    assert rows(job.run({"nums": nums}, value, {"nums": spark.createDataFrame([(3,)], "d int")})[0]) == [(15,)]
    seen = derive.Custom(lambda deps, state: (deps["nums"], state.select((F.col("runs") + 1).alias("runs"))), create_state=lambda: spark.createDataFrame([(0,)], "runs int"))
    _, state = seen.run({"nums": nums})
    assert rows(seen.run({"nums": nums}, state=state)[1]) == [(2,)]
    patched = derive.Custom(lambda deps, state: deps["nums"], incremental_patch=lambda deps, last, log, state: log["nums"])
    assert rows(patched.run({"nums": nums}, nums, {"nums": spark.createDataFrame([(1, "update", None), (2, "delete", None), (9, "insert", 4)], "id int, op string, n int")})[0]) == [(1, None), (9, 4)]
    for bad in ({"kind": "other"}, {"kind": "property", "reads": ("records",)}):
        with pytest.raises(ModelError):
            derive.Custom(total, **bad)


def test_dispatch_steps(spark):
    log = spark.createDataFrame([(1, "a", 1, 1)], "id int, k string, v int, w int")
    events = spark.createDataFrame([(2, "a", 5), (3, "b", 6), (4, "b", 7), (5, "c", -1)], "id int, k string, v int")
    ran = []

    def fails(result):
        raise RuntimeError("down")

    source = EventSource("s", "E", admit=lambda df: F.col("v") > 0, key=("k",), open_=lambda df: df.withColumn("rate", F.lit(2)), resolve=lambda df: df.withColumn("w", F.col("v") * F.col("rate")).drop("rate"), after=lambda out: out["created"].select("w"), post_commit=(fails, lambda out: ran.append(out["created"].count())))
    with pytest.raises(governance.EffectError) as e:
        source.dispatch(events, log, ["id"], commit=lambda out: ran.append("commit"))
    assert ran == ["commit", 1] and e.value.failed == [fails]
    out = governance.dispatch(events, log, ["k"], ["id"], F.col("v") > 0, open_=source.open_, resolve=source.resolve, after=source.after)
    assert rows(out["created"]) == [(3, "b", 6, 12)] and rows(out["refused"]) == [(5, "c", -1)] and rows(out["replayed"].select("id")) == [(2,)] and rows(out["answer"]) == [(12,)] and out["log"].count() == 2
    assert rows(source.take(events).select("id", "w")) == [(2, 10), (3, 12), (4, 14)]


def test_deletions_come_in_order(spark):
    c = Catalog(spark)
    c.entity(Entity("A", ()), spark.createDataFrame([(1,), (2,)], "id int"))
    c.entity(Entity("B", ()), spark.createDataFrame([(10, 1), (11, 1)], "id int, a_id int"))
    c.entity(Entity("C", ()), spark.createDataFrame([(100, 10)], "id int, b_id int"))
    c.relation(Relation("AB", "A", "bs", "B", "a", "1:n", reliance=True), fk=("target", "a_id"))
    c.relation(Relation("BC", "B", "cs", "C", "b", "1:n", reliance=True), fk=("target", "b_id"))
    got = [tuple(x) for x in governance.deletion_events(governance.cascade_delete(c, "A", {"id": 1}), set(c.relations)).orderBy("step", "record", "id").select("record", "id").collect()]
    where = {x: k for k, x in enumerate(got)}
    records = [x for x in got if x[0] in ("A", "B", "C")]
    assert records == [("C", "100"), ("B", "10"), ("B", "11"), ("A", "1")]
    assert max(k for (n, _), k in where.items() if n == "AB") < where["B", "10"] and max(k for (n, _), k in where.items() if n == "BC") < where["C", "100"]


def test_scopes(spark):
    r = random.Random(2)
    data = [(i, r.choice(["a", "a", "a", "b", None]), r.randrange(50), r.choice([7, None])) for i in range(500)]
    df = spark.createDataFrame(data, "id int, s string, o int, m int")
    for scope, where, manual in ((["s"], None, None), ([], None, None), (["s"], F.col("o") > 20, None), (["s"], None, "m")):
        got = {x["id"]: x["number"] for x in sequences.scoped_sequence(df, scope, ["o", "id"], "number", 10, 5, where, manual).collect()}
        seen = {}
        for i, s, o, m in sorted(data, key=lambda x: (x[2], x[0])):
            if manual and m is not None:
                assert got[i] == m
            elif where is not None and o <= 20:
                assert got[i] is None
            else:
                k = seen[s if scope else 0] = seen.get(s if scope else 0, 0) + 1
                assert got[i] == 10 + 5 * k
    numbered = sequences.scoped_sequence(df, ["s"], ["o", "id"])
    assert governance.guard_scope(numbered, numbered, ["s"], "number").count() == 500
    with pytest.raises(governance.ConstraintError):
        governance.guard_scope(numbered, numbered.withColumn("s", F.lit("z")), ["s"], "number")


def test_activities_are_automata(spark):
    r = random.Random(3)
    for kind in ("any", "every", "race"):
        a = machines.Activity(["a", machines.Group(kind, [["b", "c"], ["d"], ["b", "e"]]), "f", machines.Group("every", [["g"], ["a", "g"]])])
        logs = [[r.choice("abcdefgx") for _ in range(r.randrange(1, 40))] for _ in range(40)]
        df = spark.createDataFrame([(k, t, n) for k, log in enumerate(logs) for t, n in enumerate(log)], "k int, t int, e string")
        for chunk in (None, F.floor(F.col("t") / 7)):
            got = {x["k"]: (x["step"], x["accepted"], x["refused"]) for x in machines.run_activities(df, a, "k", ["t"], "e", chunk).collect()}
            for k, log in enumerate(logs):
                known = [n for n in log if n != "x"]
                assert got.get(k) == (a.run(known) if known else None)


def test_triggers_that_clash(spark):
    m = machines.StateMachine("s", (machines.Transfer(lambda e: e("n") > 1, "s", "a"), machines.Transfer(lambda e: e("n") > 2, "s", "b")))
    run = lambda *n: machines.final_states(spark.createDataFrame([(1, t, "x", v) for t, v in enumerate(n)], "k int, t int, e string, n int"), m, ["k"], ["t"], "e", F.lit(0)).collect()
    assert run(1, 2)[0]["state"] == "a"
    with pytest.raises(Exception, match="two states"):
        run(3)
    assert rows(machines.with_initial(spark.createDataFrame([(1,)], "id int"), m)) == [(1, "s")]


def test_results_and_first_values(spark):
    hosts, new = spark.createDataFrame([(1, 5), (2, 6)], "id int, value int"), spark.createDataFrame([(1, None)], "id int, value int")
    assert rows(apply_result("property", hosts, new)) == [(1, None), (2, 6)] and rows(apply_result("delete", hosts, new)) == [(2, 6)]
    assert rows(apply_result("property", hosts.select("id"), new)) == [(1, None), (2, None)] and rows(apply_result("entity", hosts, new)) == rows(new)
    assert last_value("none", hosts) is None and last_value("full", hosts).columns == ["id", "value"] and last_value("normal", hosts.withColumn("x", F.lit(1))).columns == ["id", "value"]
    m = machines.StateMachine("s", ())
    assert rows(machines.initial_values(spark.createDataFrame([(1, 9)], "id int, n int"), {"state": m, "n": 0, "count": 0, "same": F.col("id")})) == [(1, 9, "s", 0, 1)]


def test_visible_rows_and_query_log(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, who string")
    seen = governance.visible(events, spark.createDataFrame([("a",), ("a",), (None,)], "name string"), {"who": "name"}, "known")
    ok, no = governance.guard(seen, "known", {"known": lambda: F.col("known")})
    assert rows(ok.select("id")) == [(1,)] and rows(no.select("id")) == [(2,), (3,)]
    log = QueryLog(str(tmp_path / "log"))
    assert log.run("ids", events.select("id")).count() == 3 and log.run("all", events).count() == 3
    assert sorted(x["name"] for x in spark.read.parquet(log.path).collect()) == ["all", "ids"]


def test_schema_and_approvals(spark):
    old = graph(spark, [(1, 2)])
    new = Catalog(spark)
    new.entity(Entity("N", (Property("x", "string"),)), spark.createDataFrame([(1, "a")], "id int, x string"))
    assert ddl(old)["N"] == "CREATE TABLE `N` (`id` int NOT NULL, `x` double) USING parquet" and "`source` int NOT NULL" in ddl(old)["Link"]
    a, b = manifest(old), manifest(new)
    assert destructive(a, b) == ["Link", "N.x"] and destructive(a, a) == []
    approve(a, b, {"Link", "N.x"})
    for wrong in (set(), {"Link", "N.x", "other"}):
        with pytest.raises(ModelError):
            approve(a, b, wrong)
