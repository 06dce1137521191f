"""Chat formatting: cumulative snapshots collapse to the conversations that no longer one extends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging


def _folded(step) -> Column:
    """The rolling hashes h_1 .. h_n of a conversation's turns: each is sha2 of the one before and the turn."""
    start = F.array().cast("array<string>")
    return F.aggregate("turns", start, lambda acc, t: F.concat(acc, F.array(step(acc, t))))


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key, turns): the turns of each conversation in order; repeated rows count once. A row without an id belongs to no other:
    each is a conversation of one turn (equal ones are one), so that such rows, however many, don't gather in one place. key tells
    conversations apart."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.when(F.col(conv_col).isNotNull(), F.col(turn_col)).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.concat(F.lit("n"), F.sha2(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text"), 256)))
    return t.groupBy("conv_id", key.alias("key")).agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def render(turns: Column | str, end: str = "<|end|>") -> Column:
    """<|role|> newline text <|end|> for each turn; a role that is null or empty is `unknown`."""
    role = lambda t: F.when(t["role"] == "", F.lit("unknown")).otherwise(t["role"])
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), role(t), F.lit("|>\n"), t["text"], F.lit(end))), "\n")


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, kept, rep_id (of equal conversations the smallest id), rendered (null unless kept).

    A conversation is dropped if its turns (role and text, in order) begin a longer conversation, or equal those of one with
    a smaller id. Turns are hashed as they roll: sha2(hash before + role + text). The hash of a whole conversation is looked
    up among the distinct hashes of proper prefixes with an anti-join; both sides are distinct, so no key repeats however
    often a first turn or a conversation was logged.

    Null role or text counts as empty. A row with a null conversation id is a conversation by itself, equal ones are one. Ties in `turn` are ordered by
    role and text; rows that repeat entirely count once. An empty table gives an empty one.
    """
    stage = Staging(turns.sparkSession)
    conv = conversations(turns, conv_col, turn_col, role_col, text_col)
    last = lambda acc: F.coalesce(F.element_at(acc, -1), F.lit(""))
    turn = lambda t: F.concat_ws("\x1f", F.length(t["role"]).cast("string"), t["role"], t["text"])
    hashes = _folded(lambda acc, t: F.sha2(F.concat(F.when(F.size(acc) > 0, last(acc)).otherwise(F.lit("")), turn(t)), 256))
    conv = stage.cut(conv.select("conv_id", "key", "turns", F.size("turns").alias("n_turns"), hashes.alias("hashes")), "conversations")
    whole = conv.select("conv_id", "key", "n_turns", F.element_at("hashes", -1).alias("h"))
    reps = stage.cut(whole.groupBy("n_turns", "h").agg(F.min("conv_id").alias("rep_id"), F.min(F.when(F.col("conv_id").isNull(), F.col("key"))).alias("rep_key")), "classes")
    prefix = conv.select(F.explode(F.slice("hashes", F.lit(1), F.col("n_turns") - 1)).alias("h")).distinct()
    top = reps.join(prefix, "h", "left_anti").select("h", F.lit(True).alias("top"))
    known = stage.cut(reps.join(top, "h", "left"), "known")  # joined to the conversations as a table, so that Spark can split a hash that many have
    # of equal conversations the smallest id stays, or, if none has one, one of them
    mine = F.col("conv_id").eqNullSafe(F.col("rep_id")) & (F.col("rep_id").isNotNull() | (F.col("key") == F.col("rep_key")))
    facts = whole.join(known, ["h", "n_turns"]).select("key", "rep_id", (F.coalesce("top", F.lit(False)) & mine).alias("kept"))
    out = conv.join(facts, "key")
    return out.select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "kept", "rep_id", F.when(F.col("kept"), render("turns")).alias("rendered"))
