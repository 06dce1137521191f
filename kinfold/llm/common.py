"""Pieces the operators share: staging in the shared folder, word columns, components, links inside buckets."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Ids are broadcast up to so many rows (about 16 MB); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: A bucket goes on to all its pairs once there are no more than so many for each member.
FEW_PAIRS = 8
#: Where spark.checkpoint.dir is unset and one machine does all (tests).
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Unset, it is an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(found or LOCAL_SHARED).rstrip('/')}/kinfold"


class Staging:
    """Tables written to the shared folder, so that a lost executor costs no more than the step that reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n, self.here = 0, []

    def cut(self, df: DataFrame, name: str, plain: bool = False) -> DataFrame:
        """Write df and read it back: its lineage ends there. plain: columns of hashes, of which no dictionary is worth trying."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        self.here.append(out)
        return out

    def bucketed(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """One row for each value of a column, as a table bucketed by it: joins on it do not shuffle its rows again."""
        self.n += 1
        n, path = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"{self.root}/{self.n:03d}-{name}"
        known = f"kinfold_{name}_{uuid.uuid4().hex}"
        df.repartition(n, by).dropDuplicates([by]).write.bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(known)
        out = self.spark.table(known)
        out.staged_at, out.known_as = path, known
        self.here.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for f in frames:
            if hasattr(f, "known_as"):
                self.spark.sql(f"DROP TABLE IF EXISTS {f.known_as}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f.staged_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.here = [x for x in self.here if x.staged_at != f.staged_at]

    def keep_only(self, *frames: DataFrame) -> None:
        """Remove all tables but these, once the rest is no longer read."""
        kept = {f.staged_at for f in frames}
        self.drop(*[x for x in self.here if x.staged_at not in kept])


def few_ids(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if they are staged and few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skewless(stage: Staging, pairs: DataFrame, facts: DataFrame, key: str, most: int) -> DataFrame:
    """pairs joined with facts, of which each key has one row. The pairs of a key with over `most` are dealt over several copies of its row,
    so that no task gets all of them."""
    hot = stage.cut(pairs.groupBy(key).count().filter(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("_n")), "hot")
    n = hot.count()
    plain = pairs.join(facts, key)
    if not n:
        return plain
    hot = F.broadcast(hot) if n <= BROADCAST_IDS else hot
    other = next(c for c in pairs.columns if c != key)
    dealt = pairs.join(hot, key).withColumn("_s", F.pmod(F.xxhash64(other), F.col("_n")).cast("int")).drop("_n")
    copies = facts.join(hot, key).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return pairs.join(hot, key, "left_anti").join(facts, key).select(*plain.columns).unionByName(dealt.join(copies, [key, "_s"]).select(*plain.columns))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. The built-in lower() serves where a text is all ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def words(c: Column, separators: str) -> Column:
    """The non-empty pieces of a lower-cased text between separators; null for null."""
    return F.array_remove(F.split(ascii_lower(c), separators), "")


def word_grams(hashed: Column, n: int) -> Column:
    """64-bit hashes of each n consecutive entries of an array of hashed words; empty if there are fewer."""
    gram = lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(n)])
    return F.when(F.size(hashed) >= n, F.transform(F.sequence(F.lit(0), F.size(hashed) - n), gram)).otherwise(F.array().cast("array<bigint>"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def thinned(rows: DataFrame, h: str, want: int, total: int) -> DataFrame:
    """About four times `want` of `total` rows, picked by a hash column, where there are more: the first `want` in the order of the
    hash are taken from these, so that no task gathers that many from each part of the table."""
    share = min(1.0, 4 * want / max(1, total))
    return rows.filter(F.pmod(F.col(h), F.lit(1 << 31)) < int(share * (1 << 31)) + 1)


def components(stage: Staging, edges: DataFrame, kind: str = "bigint") -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows two hooks, and contracts the edges, so the edges left
    shrink by a factor each time. Minimums combine before the shuffle; hubs reach joins only, which split skewed keys.
    """
    spark = stage.spark
    left = stage.cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = None
    while not left.isEmpty():
        hook = both(left).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hook = hook.select("node", F.least("node", "to").alias("to"))
        hook = stage.cut(hook, "hook")
        jump = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hook2 = hook.join(jump, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        hook2 = stage.cut(hook2, "hook2")
        if label is None:
            label2 = stage.cut(hook2.select("node", F.col("to").alias("comp")), "labels")
        else:
            m = hook2.select(F.col("node").alias("comp"), "to")
            label2 = stage.cut(label.join(m, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
            stage.drop(label)
        label = label2
        ma, mb = hook2.select(F.col("node").alias("a"), F.col("to").alias("ca")), hook2.select(F.col("node").alias("b"), F.col("to").alias("cb"))
        nxt = left.join(ma, "a").join(mb, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        nxt = stage.cut(nxt, "edges")
        stage.drop(left, hook, hook2)
        left = nxt
    stage.drop(left)
    if label is None:
        return spark.createDataFrame([], f"node {kind}, comp {kind}")
    return label


def bucket_links(stage: Staging, lists: DataFrame, verify: Callable[[DataFrame], DataFrame], within: Column | None = None, crowd: Callable[[DataFrame], DataFrame] | None = None, stars: int = 3, most: int = 64, kind: str = "bigint") -> DataFrame:
    """(node, comp) of the graph whose links are the pairs that share a bucket and pass verify.

    lists: distinct (bucket, node, worth), and whatever `within`, a condition on columns x_... and y_... of a pair, compares; pairs
    are made inside a join that has it. verify: keeps the rows of (a, b) that are links.

    All pairs of a bucket are not made. A star round tests each member against one centre of its bucket, one of least
    worth; what links is one component from then on, and a bucket inside one component is done with. After the first round buckets
    with at most FEW_PAIRS pairs a member wait for the pairs, so that only larger ones are read again. After up to `stars` rounds,
    members of *different* components that share a bucket are tested, so that no link between components is missed: pair by
    pair, in blocks of `most` members against blocks of as many, or, where `crowd` is given, buckets of over `most` members go there. It gets
    (bucket, node, comp, size) and returns links.
    """
    edges, tested, label = [], [], None
    lists = lists if hasattr(lists, "staged_at") else stage.cut(lists, "lists")

    def add(found: DataFrame) -> None:
        nonlocal label
        edges.append(found)
        if label is None:
            label = components(stage, found)
            return
        new = found.join(label.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        more = components(stage, new.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        base = label.unionAll(ends.join(label, "node", "left_anti").select("node", F.col("node").alias("comp")))
        label = stage.cut(base.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")

    cur, last, waiting = lists.withColumn("comp", F.col("node")), False, []
    own = [c for c in cur.columns if c != "bucket"]
    named = lambda d, k, of="": [F.col(f"{of}{c}").alias(f"{k}_{c}") for c in own]
    relabelled = lambda d: d.drop("comp").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if label is not None else d
    for r in range(stars + 1):
        if r:  # the members of buckets that are not inside one component yet
            sizes = cur.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
            sizes = few_ids(stage.cut(sizes.select("bucket", "size"), "sizes"))
            cur = stage.cut(cur.join(sizes, "bucket"), "open")
            members, left = cur.agg(F.count("*"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)) / 2).first()
            if not members and not waiting:
                break
            last = r == stars or left <= FEW_PAIRS * members
            if not last:
                small = F.col("size") <= 2 * FEW_PAIRS + 1
                waiting, cur = [*waiting, cur.filter(small)], cur.filter(~small)
            elif waiting:
                cur = stage.cut(reduce(DataFrame.unionByName, [relabelled(d) for d in waiting], cur), "open")
        if not last:
            best = F.min(F.struct(F.floor(F.col("worth") / (1 + 2 * r)).alias("w"), F.xxhash64("node", F.lit(r)).alias("h"), *own)).alias("c")
            centres = cur.groupBy("bucket").agg(best, F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
            y = few_ids(stage.cut(centres.select(F.col("bucket").alias("other"), *named(centres, "y", "c.")), "centres"))
            x, on = cur.select("bucket", *named(cur, "x")), F.col("x_comp") != F.col("y_comp")
        else:
            few = cur if crowd is None else cur.filter(F.col("size") <= most)
            # block against block: each block of a bucket meets each
            blocks = F.ceil(F.col("size") / most).cast("int")
            mine, all_ = F.pmod(F.xxhash64("node", F.lit(13)), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
            dealt = lambda d, key, k: d.select(F.xxhash64("bucket", "_i", "_j").alias(key), *named(d, k))
            x, y = dealt(few.withColumn("_i", mine).withColumn("_j", all_), "bucket", "x"), dealt(few.withColumn("_j", mine).withColumn("_i", all_), "other", "y")
            on = F.col("x_comp") < F.col("y_comp")
        on = (F.col("bucket") == F.col("other")) & on
        pairs = x.join(y, on if within is None else on & within).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
        pairs = pairs.distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionAll, tested), ["a", "b"], "left_anti")
        pairs = stage.cut(pairs, "pairs")
        if not pairs.isEmpty():
            tested.append(pairs)
            add(stage.cut(verify(pairs), "links"))
        if last:
            if crowd is not None:
                many = cur.filter(F.col("size") > most)
                if not many.isEmpty():
                    add(stage.cut(crowd(many), "links"))
            break
        cur = relabelled(cur.drop("size"))
    return label if label is not None else stage.spark.createDataFrame([], f"node {kind}, comp {kind}")
