"""Approximate nearest neighbours: balanced posting lists with replicated boundary vectors, and a centroid graph in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staging, thinned

#: Lists that a query visits at least.
LEAST_LISTS = 16
#: Vectors in a block of a list and queries in a block; a pair of blocks is one group of a task.
BLOCK = 2048


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, size: int, seed: int = 6) -> np.ndarray:
    """Centroids of balanced clusters of about `size` vectors: clusters are halved at the median along the line between two
    means until they are small enough; a few rounds of k-means follow, in which large clusters are penalised."""
    r, parts, done = np.random.default_rng(seed), [np.arange(len(x))], []
    while parts:
        p = parts.pop()
        if len(p) <= size:
            done.append(p)
            continue
        y = x[p]
        c = y[r.choice(len(p), 2, replace=False)]
        for _ in range(4):
            near = _distances(y, c).argmin(1)
            if near.min() == near.max():
                break
            c = np.stack([y[near == k].mean(0) for k in (0, 1)])
        order = np.argsort(y @ (c[1] - c[0]), kind="stable")
        parts += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
    c = np.stack([x[p].mean(0) for p in done])
    extra = np.zeros(len(c))
    for _ in range(6):
        near, least = np.zeros(len(x), int), 0.0
        for at in range(0, len(x), 2048):  # bounds the driver's memory
            d = _distances(x[at : at + 2048], c)
            least += float(d.min(1).sum())
            near[at : at + 2048] = (d + extra).argmin(1)
        n = np.bincount(near, minlength=len(c))
        extra += 0.05 * least / len(x) * (n / max(1, n.mean()) - 1)
        full = n > 0
        c[full] = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)[full] / n[full, None]
    return c


class CentroidGraph:
    """A graph of neighbouring centroids, searched from fixed entry points by best-first beams, many queries at once."""

    def __init__(self, c: np.ndarray, degree: int = 24, entries: int = 16, seed: int = 8):
        self.c, n = c.astype(np.float32), len(c)
        k = min(degree, n - 1)
        near = np.stack([np.argsort(_distances(self.c[i : i + 1], self.c)[0], kind="stable")[1 : k + 1] for i in range(n)]) if k else np.zeros((n, 0), int)
        far = np.random.default_rng(seed).integers(0, n, (n, 4))  # long edges keep it connected
        self.edges = np.concatenate([near, far], 1)
        self.entries = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(int))

    def search(self, q: np.ndarray, want: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the nearest centroids found for each query, nearest first."""
        q, n, m = q.astype(np.float32), len(self.c), len(q)
        beam, rows = min(max(beam, want), n), np.arange(m)[:, None]
        seen = np.zeros((m, n), bool)
        ids = np.broadcast_to(self.entries, (m, len(self.entries)))
        seen[rows, ids] = True
        d = ((q[:, None] - self.c[ids]) ** 2).sum(2)
        ids, open_ = ids.copy(), np.ones(ids.shape, bool)
        while True:
            order = np.argsort(d, 1, kind="stable")[:, :beam]
            ids, d, open_ = ids[rows, order], d[rows, order], open_[rows, order]
            if not (open_ & np.isfinite(d)).any():
                return ids[:, :want], d[:, :want]
            first = np.argsort(~open_, 1, kind="stable")[:, :4]  # the nearest four not yet expanded
            live = open_[rows, first]
            open_[rows, first] = False
            new = self.edges[ids[rows, first]].reshape(m, -1)
            fresh = np.repeat(live, self.edges.shape[1], 1) & ~seen[rows, new]
            dist = np.where(fresh, ((q[:, None] - self.c[new]) ** 2).sum(2), np.inf)
            seen[rows, new] |= fresh
            # one of several copies of a new centroid counts
            by = np.argsort(new, 1, kind="stable")
            same = np.zeros(new.shape, bool)
            ordered = new[rows, by]
            same[rows, by[:, 1:]] = ordered[:, 1:] == ordered[:, :-1]
            dist[same & fresh & _later(new, fresh)] = np.inf
            ids, d = np.concatenate([ids, new], 1), np.concatenate([d, dist], 1)
            open_ = np.concatenate([open_, np.isfinite(dist)], 1)


def _later(new: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Whether a fresh entry repeats an earlier fresh one of its row."""
    out = np.zeros(new.shape, bool)
    for i in range(len(new)):
        at = np.flatnonzero(fresh[i])
        _, first = np.unique(new[i, at], return_index=True)
        late = np.ones(len(at), bool)
        late[first] = False
        out[i, at[late]] = True
    return out


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, one not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", list_size: int = 64, copies: int = 6, boundary: float = 1.2, most_lists: int = 96, query_ratio: float = 1.75, sample: int = 20_000, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows found by Euclidean
    distance, ties to smaller ids.

    Centroids are fitted on at most `sample` distinct vectors picked by hash; every vector is indexed. A vector goes to its nearest
    list and to others whose centroid is within `boundary` times that distance and not nearer to a list it has already, up to `copies`. A
    query visits the LEAST_LISTS nearest lists and those whose centroid is within `query_ratio` times the distance of the second nearest
    one (a query may be a centroid itself), up to most_lists, and further ones, nearest first, until k + 1 distinct ids are in them or
    none is left; with `exact` it visits them all. Lists are searched whole, in blocks of a bounded size. Distances are computed in double precision on the vectors as given.

    Equal vectors are indexed once, with their k + 1 smallest ids: no other of their ids can be among k nearest. Rows with a null id
    or an unusable vector (null, empty, zero, with null or non-finite components, or of another length than most) take no part. With fewer than k candidates a query gets all that is found.
    Rows that repeat an id count once for each different vector. No usable rows give an empty table.
    """
    spark, stage = vectors.sparkSession, Staging(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    ok = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    dims = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()  # one row
    if not dims:
        return spark.createDataFrame([], schema)
    ok = ok.filter(F.size("v") == dims[0]["d"])
    # the smallest ids of each distinct vector; the limit is applied before the shuffle too
    low = ok.select("id", "v", F.row_number().over(Window.partitionBy("v").orderBy("id")).alias("r")).filter(F.col("r") <= k + 1)
    low = stage.cut(low.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "distinct")
    n = low.count()
    fit = thinned(low.select("v", F.xxhash64("v").alias("h")), "h", sample, n).orderBy("h").limit(sample).toPandas()
    x = np.stack(fit.v.to_numpy())
    del fit
    graph = CentroidGraph(balanced_centroids(x, max(1, round(list_size * len(x) / n)) if n > sample else list_size))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for at in range(0, len(p), 512):
                q = p.iloc[at : at + 512]
                ids, d = graph.search(np.stack(q.v.to_numpy()), 4 * copies, 64)
                d, rows = np.sqrt(d), {"v": [], "ids": [], "list": [], "first": []}
                for i, (v, own) in enumerate(zip(q.v, q.ids)):
                    got: list[int] = []
                    for c, dist in zip(ids[i], d[i]):
                        if len(got) >= copies or dist > boundary * d[i][0] + 1e-12:
                            break
                        if all(((graph.c[c] - graph.c[g]) ** 2).sum() > 0.3 * dist * dist for g in got):
                            got.append(int(c))
                    rows["v"] += [v] * len(got)
                    rows["ids"] += [own] * len(got)
                    rows["list"] += got
                    rows["first"] += [len(own)] + [0] * (len(got) - 1)
                yield pd.DataFrame(rows)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for at in range(0, len(p), 512):
                q = p.iloc[at : at + 512]
                if exact:
                    yield pd.DataFrame({"v": np.repeat(q.v.to_numpy(), len(graph.c)), "list": np.tile(np.arange(len(graph.c), dtype="int32"), len(q))})
                    continue
                ids, d = graph.search(np.stack(q.v.to_numpy()), most_lists, 2 * most_lists)
                near = np.isfinite(d) & ((d <= query_ratio**2 * d[:, min(1, d.shape[1] - 1)][:, None] + 1e-12) | (np.arange(d.shape[1]) < LEAST_LISTS))
                i, j = np.nonzero(near)
                yield pd.DataFrame({"v": q.v.to_numpy()[i], "list": ids[i, j]})
                for r in np.flatnonzero((held[ids] * near).sum(1) <= k):  # too few candidates
                    order = np.argsort(((graph.c - np.asarray(q.v.iloc[r], np.float32)) ** 2).sum(1), kind="stable")
                    order = order[~np.isin(order, ids[r, near[r]])]
                    more = order[: int(np.searchsorted(np.cumsum(held[order]), k + 1 - held[ids[r, near[r]]].sum())) + 1]
                    if len(more):
                        yield pd.DataFrame({"v": [q.v.iloc[r]] * len(more), "list": more.astype(ids.dtype)})

    lists = stage.cut(low.mapInPandas(assign, f"v array<double>, ids array<{kind}>, list int, first int"), "lists")
    # the ids whose nearest list it is: no id counts twice
    held = np.zeros(len(graph.c), np.int64)
    for r in lists.groupBy("list").agg(F.sum("first").alias("n")).collect():  # a row for each list
        held[r["list"]] = r["n"]
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = ok.filter(F.col("id") % every == 0)
    distinct = stage.cut(asked.select("v").distinct(), "queries")
    visits = stage.cut(distinct.mapInPandas(visit, "v array<double>, list int"), "visits")
    asks = visits.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks"))
    shape = F.broadcast(sizes.join(asks, "list"))  # a row for each list; there are at most `sample` lists
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = lists.join(shape, "list").select("list", deal("v", "blocks").alias("b"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"), "v", "ids")
    right = visits.join(shape, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), deal("v", "q_blocks").alias("q"), "v")

    def search(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"v": [], "id": [], "score": []}
        if len(p) and len(q):
            base, ids = np.stack(p.v.to_numpy()), list(p.ids)
            for v in q.v:
                d = np.sqrt(((base - v) ** 2).sum(1))
                top = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                cand = sorted((d[i], e) for i in top for e in ids[i])[: k + 1]
                out["v"] += [v] * len(cand)
                out["id"] += [e for _, e in cand]
                out["score"] += [s for s, _ in cand]
        return pd.DataFrame(out)

    found = left.groupBy("list", "b", "q").cogroup(right.groupBy("list", "b", "q")).applyInPandas(search, f"v array<double>, id {kind}, score double")
    best = found.select("v", "id", "score", F.dense_rank().over(Window.partitionBy("v").orderBy("score", "id")).alias("r")).filter(F.col("r") <= k + 1).distinct()
    best = stage.cut(best.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near")), "near")
    # each query drops its own row; its copies stay
    mine = asked.distinct().withColumnRenamed("id", "query_id").join(best, "v")
    mine = mine.select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    mine = mine.select("query_id", F.posexplode("near").alias("rank", "x"))
    return mine.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
