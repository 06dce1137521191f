"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, word_grams, words

#: Words are runs of digits, letters and whatever is not ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same as whole pieces of an original text: a word and what follows it, up to the next word.
PIECES = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: The hash set is broadcast up to so many windows (about 32 bytes each); a larger one is joined by shuffle.
BROADCAST_WINDOWS = 1_000_000


def _hashed(w: str) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x)).alias("hw")


def _windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(len, h, gram, items): the windows of all items, with the ids of the items that hold each."""
    b = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col), BREAKS).alias("w"))
    b = b.select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("len"))
    b = b.select("item_id", "w", "len", F.explode(F.when(F.col("len") > 0, F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))).alias("at"))
    b = b.select("item_id", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    b = b.groupBy("len", "gram").agg(F.collect_set("item_id").alias("items"))
    hw = F.transform("gram", lambda x: F.xxhash64(x))
    h = F.coalesce(*[F.when(F.col("len") == n, F.xxhash64(*[F.get(hw, F.lit(k)) for k in range(n)])) for n in range(1, width + 1)])
    return b.select("len", h.alias("h"), "gram", "items")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 8) -> tuple[DataFrame, DataFrame]:
    """(keyed, found): docs with columns _k1, _k2 that identify equal rows, and for each key that was hit: at (0-based
    positions of hit words), items (ids as sorted strings).

    A window is `width` consecutive words of an item, or all of an item with fewer. A hash hit counts once its words are equal.
    """
    stage = Staging(docs.sparkSession)
    win = stage.cut(_windows(benchmark, item_col, item_text, width), "windows")
    # at most `width` rows
    lens = sorted(r[0] for r in win.select("len").distinct().collect())
    few = win.count() <= BROADCAST_WINDOWS
    small = F.broadcast if few else (lambda x: x)
    keyed = docs.withColumns({"_k1": F.xxhash64(F.col(id_col), F.col(text_col)), "_k2": F.xxhash64(F.lit(5), F.col(text_col), F.col(id_col))})
    if not lens:
        return keyed, docs.sparkSession.createDataFrame([], "_k1 bigint, _k2 bigint, at array<int>, items array<string>")
    d = keyed.select("_k1", "_k2", words(F.col(text_col), BREAKS).alias("w"))
    d = d.select("_k1", "_k2", "w", _hashed("w"))
    scans = []
    for n in lens:
        one = d.select("_k1", "_k2", "w", F.posexplode(word_grams(F.col("hw"), n)).alias("pos", "h"))
        seen = small(win.filter(F.col("len") == n).select("h").distinct())
        one = one.join(seen, "h")
        scans.append(one.select("_k1", "_k2", "pos", F.lit(n).alias("len"), "h", F.slice("w", F.col("pos") + 1, n).alias("gram")))
    hit = scans[0]
    for s in scans[1:]:
        hit = hit.unionAll(s)
    hit = stage.cut(hit, "hits")
    sure = hit.join(small(win), ["len", "h", "gram"])
    span = F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)
    # a key's rows are at most its text's windows; equal ones fall together before the shuffle
    found = sure.groupBy("_k1", "_k2").agg(F.collect_set(span).alias("spans"), F.collect_set("items").alias("sets"))
    found = found.select("_k1", "_k2", F.array_sort(F.array_distinct(F.flatten("spans"))).alias("at"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    return keyed, found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 8, min_items: int = 2) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items).

    Null and wordless texts have no words and no hits; an empty benchmark hits nothing; items without words have no windows. Rows
    that repeat get equal results; rows of one id with different texts are judged each by its text. A null id is kept.
    """
    keyed, found = hits(docs, benchmark, id_col, text_col, item_col, item_text, width)
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    base = keyed.select("_k1", "_k2", F.col(id_col).alias("doc_id"), n_words.alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    out = base.join(found, ["_k1", "_k2"], "left")
    out = out.select("doc_id", "n_words", F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.size("at")).cast("bigint").alias("n_hit"), size(items).alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_items") >= min_items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 8, remove: str = "span", drop_share: float = 0.5) -> DataFrame:
    """docs without benchmark passages, in the columns of docs.

    remove="span" takes hit words out, with what stands between them and the next word, and drops a document of which at least
    drop_share of the words are hit; remove="document" drops every document that was hit. Others stay as they are.
    """
    # the row travels as one value, so that no column name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed, found = hits(rows, benchmark, "id", "text", item_col, item_text, width)
    same = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if remove == "document":
        return keyed.join(found.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").select(*same)
    out = keyed.join(found.select("_k1", "_k2", F.col("at").alias("_at")), ["_k1", "_k2"], "left")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({PIECES})"), F.lit(1))
    share = F.size("_at") / F.greatest(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(1))
    out = out.filter(F.col("_at").isNull() | (share < drop_share))
    left = F.filter(pieces, lambda x, i: ~F.array_contains("_at", i))
    lead = F.regexp_extract(F.col("text"), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    clean = F.when(F.col("_at").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(left, "")))
    return out.select(*[clean.alias(c) if c == text_col else x for c, x in zip(docs.columns, same)])
