"""Mixing sources to target weights: Pfair windows for source blocks, dealt by earliest deadline first."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staging, few_ids

#: Blocks in a piece of the plan.
DEALS = 200_000
#: Rows in a chunk and chunks in a span of the running sums.
CHUNK_ROWS, SPAN_CHUNKS = 256, 4096
#: Sources that the driver plans for.
MOST_SOURCES = 50_000


def pfair(parts: dict[str, int], periods: int = 1) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of so many periods of sum(parts) slots.

    Block j of a source with weight w has the window [floor(j / w), ceil((j + 1) / w)). Each slot goes to the released block of
    the earliest deadline (ties: longer blocks of deadlines first by weight, then name). The weights sum to one, so every block
    meets its deadline: at any time a source has had less than one block more or less than its weight times the time.
    """
    period, ready, t = sum(parts.values()), [], 0
    window = lambda s, j: (j * period // parts[s], -((j + 1) * -period // parts[s]))
    coming: dict[int, list[tuple[str, int]]] = {0: [(s, 0) for s in sorted(parts)]}
    while t < period * periods:
        for s, j in coming.pop(t, ()):
            heappush(ready, (window(s, j)[1], -parts[s], s, j))
        d, _, s, j = heappop(ready)
        yield s, j, window(s, j)[0], d, t
        if j + 1 < parts[s] * periods:
            r = window(s, j + 1)[0]
            if r <= t:  # released already
                heappush(ready, (window(s, j + 1)[1], -parts[s], s, j + 1))
            else:
                coming.setdefault(r, []).append((s, j + 1))
        t += 1


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def plan(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block, in the order of the slots.

    All blocks are dealt. A phase ends when a source runs out; the rest share the slots in the same proportions from then on, with
    windows that start there. There are at most as many phases as sources. The weights are exact, so within a phase no error adds up. What is held is a few numbers for each source."""
    left, done, slot = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0
    while left:
        parts = whole({s: weights[s] for s in left})
        first, start = dict(done), slot
        for s, j, release, deadline, t in pfair(parts, max(left.values()) + 1):
            yield s, first[s] + j, start + release, start + deadline, start + t
            done[s], left[s], slot = done[s] + 1, left[s] - 1, slot + 1
            if not left[s]:
                del left[s]
                break


def deal(stage: Staging, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """(_t, block, release, deadline, slot): the plan as a table, written in pieces, so that the driver holds one piece."""
    order, out = plan(blocks, weights), None
    while piece := list(islice(order, DEALS)):
        columns = zip(("_t", "block", "release", "deadline", "slot"), zip(*piece))
        part = stage.cut(stage.spark.createDataFrame(pa.table({k: list(v) for k, v in columns})), "deals")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else stage.spark.createDataFrame([], "_t string, block bigint, release bigint, deadline bigint, slot bigint")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block_words: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with source_block, release, deadline, slot and mix_pos: the order in which to read them is (slot, mix_pos).

    Each source's documents stand in the order of a hash and are cut into blocks of block_words words (a document belongs to the
    block in which it starts). Blocks are dealt to slots by `plan`; weights default to the words of a source to the power alpha.
    Every row comes out once. A null source is a source of its own; null texts have no words. Sources without a target weight get the smallest one.
    A weight that is not a positive number is an error. The hash is of id and text; its ties are broken by them. Repeated rows stay. An empty table gives an empty one.

    Running sums go over chunks of a bounded number of rows, then spans of chunks, so that a source of any size has no window in one task.
    """
    spark, stage = docs.sparkSession, Staging(docs.sparkSession)
    names = ["source_block", "release", "deadline", "slot", "mix_pos"]
    # the row travels as one value, so that no column name clashes
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    src = F.coalesce(F.col("_source").cast("string"), F.lit("\0null"))
    words = F.coalesce(F.regexp_count("_text", F.lit(r"\S+")), F.lit(0)).cast("bigint")
    base = base.withColumns({"_s": src, "_w": words, "_h": F.xxhash64("_id", F.lit(3), "_text")})
    sizes = base.groupBy("_s").agg(F.count("*").alias("rows"), F.sum("_w").alias("words"))
    sizes = sizes.limit(MOST_SOURCES + 1).collect()  # a row for each source
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; join small ones first")
    blocks = {r["_s"]: (r["words"] - 1) // block_words + 1 if r["words"] else 1 for r in sizes}
    target = weights or {r["_s"]: max(1, r["words"]) ** alpha for r in sizes}
    if bad := [s for s, w in target.items() if not 0 < w < float("inf")]:
        raise ValueError(f"weights that are not positive numbers: {bad[:5]}")
    # chunks: ranges of the hash, so that their order is the order of the hash
    chunk_of = spark.createDataFrame([(r["_s"], max(1, -(-r["rows"] // CHUNK_ROWS)), blocks[r["_s"]] - 1) for r in sizes], "_s string, _n bigint, _last bigint")
    place = (F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(2**63))), 33).cast("bigint") * F.col("_n") / F.lit(2**31)).cast("bigint")
    base = base.join(F.broadcast(chunk_of), "_s").withColumn("_c", place).drop("_n")
    chunks = stage.cut(base.groupBy("_s", "_c").agg(F.sum("_w").alias("w")).withColumn("span", F.floor(F.col("_c") / SPAN_CHUNKS)), "chunks")
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spans = chunks.groupBy("_s", "span").agg(F.sum("w").alias("w")).withColumn("s0", F.coalesce(F.sum("w").over(before(["_s"], ["span"])), F.lit(0))).drop("w")
    chunks = chunks.withColumn("c0", F.coalesce(F.sum("w").over(before(["_s", "span"], ["_c"])), F.lit(0))).join(spans, ["_s", "span"]).select("_s", "_c", (F.col("c0") + F.col("s0")).alias("_0"))
    within = F.coalesce(F.sum("_w").over(before(["_s", "_c"], ["_h", "_id", "_text"])), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_s", "_c").orderBy("_h", "_id", "_text"))
    base = base.withColumns({"_in": within, "_r": rank}).join(chunks, ["_s", "_c"])
    base = base.withColumn("_b", F.floor((F.col("_in") + F.col("_0")) / block_words))
    low = min(target.values(), default=1)
    deals = few_ids(deal(stage, blocks, {s: target.get(s, low) for s in blocks}))
    # a last document without words can start where the last block ends
    out = base.withColumn("_b", F.least("_b", "_last")).join(deals, (F.col("_s") == F.col("_t")) & (F.col("_b") == F.col("block")))
    at = lambda k: deals[k].cast("bigint").alias(k)
    pos = (F.col("_c") * (1 << 31) + F.col("_r")).cast("bigint").alias("mix_pos")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in names], F.col("_b").cast("bigint").alias("source_block"), at("release"), at("deadline"), at("slot"), pos)
