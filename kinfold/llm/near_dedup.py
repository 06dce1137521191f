"""MinHash near-duplicates from bottom-k sketches of one hash function."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, bucket_links, components, few_ids, skewless, word_grams, words

#: Nodes in a block of a large list; a pair of blocks is one group of a task.
BLOCK = 256
#: A hot centre's sketch and set are copied so that a join by it has no more than so many pairs for each copy.
SALTED = 512
#: Words end at white space.
SPACES = r"[\x20\x09-\x0D]+"


@lru_cache
def least_shared(k: int, similarity: float, risk: float = 1e-9) -> int:
    """The count that the number of shared values among k drawn from a union falls below with a chance under risk, at this similarity."""
    total = 0.0
    for i in range(k + 1):
        total += comb(k, i) * similarity**i * (1 - similarity) ** (k - i)
        if total > risk:
            return i
    return k


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, hashes): the distinct hashed shingles of each text, in the order of the hash."""
    d = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col), SPACES).alias("w"))
    d = d.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    few = F.when(F.size("w") > 0, F.array(F.xxhash64(F.size("w"), F.concat_ws(" ", F.col("w").cast("array<string>"))))).otherwise(F.array().cast("array<bigint>"))
    s = F.when(F.size("w") >= width, word_grams(F.col("w"), width)).otherwise(few)
    return d.select("doc_id", F.sort_array(F.array_distinct(s)).alias("hashes"))


def _block_links(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between components among the two sides of a block pair."""
    left, right = (p[p.side == k].reset_index(drop=True) for k in (0, 1))
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    every = [np.concatenate(list(x.hashes)) for x in (left, right)]
    known = np.intersect1d(every[0], every[1])
    na, nb = left.n.to_numpy(), right.n.to_numpy()
    rows = [np.repeat(np.arange(len(x)), x.n.to_numpy()) for x in (left, right)]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(known), 8192):  # bounds the matrices
        part, m = known[at : at + 8192], []
        for e, r, x in zip(every, rows, (left, right)):
            i = np.minimum(np.searchsorted(part, e), len(part) - 1)
            hit = part[i] == e
            one = np.zeros((len(x), len(part)), np.float32)
            one[r[hit], i[hit]] = 1
            m.append(one)
        both += m[0] @ m[1].T
    union = na[:, None] + nb[None, :] - both
    ok = (both * 100 >= union * percent) & (left.comp.to_numpy()[:, None] != right.comp.to_numpy()[None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    a, b = left.node.to_numpy(), right.node.to_numpy()
    ca, cb = left.comp.to_numpy(), right.comp.to_numpy()
    out = []
    for i, j in zip(*np.nonzero(ok)):
        x, y = find(ca[i]), find(cb[j])
        if x != y:
            root[x] = y
            out.append((a[i], b[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 32) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of `width`-word shingles.

    * Equal sets fall together first (they are one class).
    * A sketch holds the k smallest hashes of a set. Sketches of linked sets share at least m of k values, but for a chance
      of under 1e-9; hence they share one of the k - m + 1 values of each that are rarest in the corpus. Those values
      make the inverted lists: passages that many documents share drop out unless they make up most of a document.
    * Within lists, `bucket_links` tests candidates: sizes, then the estimate from the sketch of the union, then the full
      sets. What is left open in large lists goes block against block, on full sets.

    Null, empty or blank texts have no shingles and no links; nor have rows with a null id, which are kept, with a null component.
    Rows of one id are one document: all links of its texts count, also for a row of it without words.
    """
    sim = percent / 100
    stage = Staging(docs.sparkSession)
    sets = shingle_sets(docs, id_col, text_col, width)
    hashes = [F.size("hashes").alias("n"), F.xxhash64("hashes").alias("h1"), F.xxhash64(F.lit(7), "hashes").alias("h2")]
    same = ["h1", "h2", "n"]
    sig = stage.cut(sets.select("doc_id", F.slice("hashes", 1, k).alias("sketch"), *hashes), "sketches")
    real = sig.filter("n > 0 and doc_id is not null")
    # any_value: rows of one class have one sketch. A class has a number of its own: one id may have texts in several
    reps = real.groupBy(*same).agg(F.min("doc_id").alias("first_doc"), F.any_value("sketch").alias("sketch"))
    reps = stage.cut(reps.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = reps.select("node", "n", F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    per_doc = entries.join(shared, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("c"))
    need = F.element_at(F.array(*[F.lit(i - least_shared(i, sim) + 1) for i in range(1, k + 1)]), F.least("n", F.lit(k)))
    own = F.least("n", F.lit(k)) - F.size("c")
    lists = per_doc.select("node", F.explode(F.slice("c", F.lit(1), F.greatest(need - own, F.lit(0)))).alias("x"), own.alias("worth")).select(F.col("x.v").alias("bucket"), "node", "worth")

    sketches = reps.select("node", "n", "sketch")

    # the full sets of the representatives that share a list with another one, once
    lists = stage.cut(lists, "prefixes")
    wanted = lists.join(lists.groupBy("bucket").count().filter("count > 1"), "bucket", "left_semi").select("node").distinct()
    wanted = stage.cut(reps.select("node", "first_doc", *same).join(wanted, "node"), "wanted")
    ids = stage.cut(wanted.select(F.col("first_doc").alias("doc_id")).distinct(), "ids")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(few_ids(ids), "doc_id", "left_semi")
    full = shingle_sets(texts, "doc_id", "text", width).select("doc_id", "hashes", *hashes)
    # of several texts of an id the one that is wanted; as equalities the hashes would be join keys, and filters on them would be pushed below the shingles
    full = full.join(few_ids(wanted.select("node", F.col("first_doc").alias("doc_id"), F.col("h1").alias("w1"), F.col("h2").alias("w2"))), "doc_id")
    full = full.filter((F.col("h1").bitwiseXOR(F.col("w1")) == 0) & (F.col("h2").bitwiseXOR(F.col("w2")) == 0))
    full = stage.bucketed(full.select("node", "n", "hashes"), "sets", "node")

    def verify(pairs: DataFrame) -> DataFrame:
        p = skewless(stage, pairs, sketches.withColumnsRenamed({"node": "a", "n": "na", "sketch": "sa"}), "a", SALTED)
        p = skewless(stage, p, sketches.withColumnsRenamed({"node": "b", "n": "nb", "sketch": "sb"}), "b", SALTED)
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        p = p.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).withColumn("u", union)
        least = F.element_at(F.array(*[F.lit(least_shared(i, sim)) for i in range(1, k + 1)]), F.size("u"))
        p = p.filter(F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")) >= least).select("a", "b", "na", "nb")
        p = stage.cut(p, "candidates")
        if p.isEmpty():
            return p.select("a", "b")
        p = skewless(stage, p, full.select(F.col("node").alias("a"), F.col("hashes").alias("fa")), "a", SALTED)
        p = skewless(stage, p, full.select(F.col("node").alias("b"), F.col("hashes").alias("fb")), "b", SALTED)
        both = F.size(F.array_intersect("fa", "fb"))
        return stage.cut(p.withColumn("i", both).filter(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b"), "verified")

    def crowd(members: DataFrame) -> DataFrame:
        """The links between components in large lists, block against block.

        A node joins the cluster of its largest list. Two clusters meet if some list has members of both. Clusters are dealt
        into blocks of about BLOCK nodes; each pair of blocks of clusters that meet is one group of a bounded size, whose
        intersections are one product of 0/1 matrices. It returns a spanning forest of the links it finds.
        """
        of = members.groupBy("node").agg(F.max(F.struct("size", "bucket")).alias("m"), F.any_value("comp").alias("comp")).select("node", F.col("m.bucket").alias("cluster"), "comp")
        of = stage.cut(of, "clusters")
        blocks = of.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        present = members.join(of.select("node", "cluster"), "node").select("bucket", "cluster").distinct()
        meet = present.join(present.withColumnRenamed("cluster", "other"), "bucket").filter("cluster <= other").select("cluster", "other").distinct()
        meet = meet.join(blocks, "cluster").join(blocks.select(F.col("cluster").alias("other"), F.col("blocks").alias("other_blocks")), "other")
        nodes = of.join(full, "node").join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")).drop("blocks")
        nodes = stage.cut(nodes, "members")
        # every block of `cluster` against every block of `other`; within a cluster, each pair of blocks once
        first = nodes.join(meet.select("cluster", "other", "other_blocks"), "cluster")
        to = F.when(F.col("cluster") == F.col("other"), F.sequence("block", F.col("other_blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("other_blocks") - 1))
        first = first.select("node", "comp", "n", "hashes", F.lit(0).alias("side"), F.col("cluster").alias("c1"), F.col("block").alias("b1"), F.col("other").alias("c2"), F.explode(to).alias("b2"))
        second = nodes.withColumnRenamed("cluster", "other").join(meet.select("cluster", "other", F.col("blocks").alias("first_blocks")), "other")
        fro = F.when(F.col("cluster") == F.col("other"), F.sequence(F.lit(0), "block")).otherwise(F.sequence(F.lit(0), F.col("first_blocks") - 1))
        second = second.select("node", "comp", "n", "hashes", F.lit(1).alias("side"), F.col("cluster").alias("c1"), F.explode(fro).alias("b1"), F.col("other").alias("c2"), F.col("block").alias("b2")).select(first.columns)
        return first.unionAll(second).groupBy("c1", "b1", "c2", "b2").applyInPandas(lambda p: _block_links(p, percent), "a bigint, b bigint").distinct()

    label = bucket_links(stage, lists, verify, crowd=crowd)
    stage.drop(full)
    rows = stage.cut(sig.select("doc_id", *same).join(reps.select("node", "first_doc", *same), same, "left"), "rows")
    # an id with several texts links their classes
    several = rows.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    several = stage.cut(several.filter("doc_id is not null and (lo < hi or least <> most)").select("doc_id", "lo"), "several")
    repeats = not several.isEmpty()
    if repeats:
        links = rows.filter("node is not null").join(several, "doc_id").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
        label = components(stage, label.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(links))
    of = label.join(reps.select("node", "first_doc"), "node")
    of = of.join(of.groupBy("comp").agg(F.min("first_doc").alias("component_id")), "comp").select("node", "component_id")
    out = rows.join(of, "node", "left").select("doc_id", "n", F.coalesce("component_id", "first_doc").alias("found"))
    if repeats:  # a text without words goes with the others of its id
        mine = stage.cut(out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("found").alias("by_id")), "by-id")
        out = out.join(mine, "doc_id", "left").withColumn("found", F.coalesce("found", "by_id"))
    out = stage.cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")), "found")
    stage.keep_only(out)
    return out
