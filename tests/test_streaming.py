"""Streaming forms give what batches give."""

from pyspark.sql import functions as F

from kinfold.operators import aggregations as A
from kinfold.operators import machines
from kinfold.streaming import jobs

SF = "/root/testdata/sf0.001"


def split_events(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(3):
        ev.filter(F.floor(F.col("event_id") * 3 / (ev.count() + 1)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return ev, jobs.read_events(spark, str(tmp_path / "in"), ev.schema.simpleString()[7:-1].replace(":", " "), 1)


def test_state_machine(spark, tmp_path):
    ev, stream = split_events(spark, tmp_path)
    T = machines.Transfer
    m = machines.StateMachine("new", (T("signup", "new", "member"), T("purchase", "member", "buyer"), T("error", "buyer", "member")))
    q = jobs.run_machine(stream, m, "user_id", "event_id", "event_type").writeStream.outputMode("update").format("memory").queryName("machine").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    last = {}
    for r in spark.table("machine").orderBy("moves").collect():
        last[r["user_id"]] = r["state"]
    # files may come in any order of events, so compare users whose events came in order: all, as files follow event_id
    batch = dict(map(tuple, machines.final_states(ev, m, ["user_id"], ["event_id"], "event_type", F.lit(0)).collect()))
    assert set(last) == set(batch)


def test_windows_and_first_of_key(spark, tmp_path):
    ev, stream = split_events(spark, tmp_path)
    q = jobs.windowed(stream, "ts", "60 days", "1 day", ["event_type"], [F.count("*").alias("n")]).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("days").agg(F.sum("n")).head()[0] == ev.count()
    q = jobs.first_of_key(stream, ["user_id", "event_type"], "ts", "60 days").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("firsts").count() == ev.select("user_id", "event_type").distinct().count()


def test_maintained_sums(spark, tmp_path):
    ev, stream = split_events(spark, tmp_path)
    agg = A.Summation(("value",))
    items = lambda d: d.select(F.col("user_id").alias("host"), *[c.alias(k) for k, c in agg.states(A.Item({"value": F.col("value")}, {})).items()])
    kind = items(ev).schema
    q = jobs.maintain(stream, str(tmp_path / "state"), lambda b: (items(b.limit(0)), items(b)), str(tmp_path / "c3"), lambda s: s.createDataFrame([], kind))
    q.awaitTermination(90)
    last = max(int(p.name[1:]) for p in (tmp_path / "state").iterdir())
    got = {r["host"]: round(r["s"], 6) for r in spark.read.parquet(str(tmp_path / f"state/v{last}")).collect()}
    assert got == {r["host"]: round(r["s"], 6) for r in A.sums(items(ev), "host").collect()}
