"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import TYPE_CHECKING
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thinned

if TYPE_CHECKING:  # workers that need no pandas do not load it
    import pandas as pd

BUCKETS = 1 << 16
#: Texts that Python holds at a time besides the Arrow batch they come in, and words whose weights it keeps.
PIECE, KNOWN_WORDS = 256, 170_000


LABELLERS = ("symbols", "marked_words", "shouting", "bars", "repeats", "variety", "sentences", "plain_words")


def labellers(text: str, ws: list[str]) -> tuple[int, ...]:
    """Votes of overlapping heuristics on a whole text and its words: 1 good, -1 bad, 0 abstains. Most can only say bad."""
    n = len(ws)
    bad = lambda share, most: -1 if share > most else 0
    ends = text.count(". ") + text.count(".\n") + text.count("? ") + text.count("?\n") + text.endswith((".", "?"))
    plain = sum(1 for w in ws if w.islower() or w.istitle()) / max(1, n)
    return (
        bad(sum(map(text.count, "#$%&*@^~=<>{}\\")) / max(1, len(text)), 0.015),
        bad(sum(map(text.count, ("*** ", "### ", "%%% ", "&&& ", "$$$ ", "!! "))) / max(1, n), 0.1),
        bad(sum(map(str.isupper, ws)) / max(1, n), 0.25),
        bad(ws.count("|") / max(1, n), 0.06),
        bad(sum(map(eq, ws, ws[1:])) / max(1, n), 0.12),
        bad(1 - len(set(ws)) / max(1, n), 0.9),
        0 if n < 12 else -1 if ends < 0.012 * n else 1 if ends >= 0.03 * n else 0,
        -1 if plain < 0.6 and n >= 4 else 1 if plain > 0.9 else 0,
    )


def fit_labellers(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """(prior of good, table[labeller, class, vote + 1]) by expectation-maximisation over patterns of votes and their counts.

    Labellers are independent given the class; it starts from a vote in which bad counts three times, as
    most labellers see one kind of fault only; that also says which class is which."""
    q = 1 / (1 + np.exp(-1.0 - np.where(votes < 0, 3.0 * votes, votes).sum(1)))
    for _ in range(rounds):
        prior = float((counts * q).sum() / counts.sum())
        prior = min(max(prior, 1e-4), 1 - 1e-4)
        table = np.zeros((votes.shape[1], 2, 3))
        for v in (-1, 0, 1):
            hit = votes == v
            table[:, 1, v + 1] = (counts[:, None] * q[:, None] * hit).sum(0)
            table[:, 0, v + 1] = (counts[:, None] * (1 - q)[:, None] * hit).sum(0)
        table = (table + 0.5) / (table + 0.5).sum(2, keepdims=True)
        new = posterior(votes, prior, table)
        if np.abs(new - q).max() < 1e-7:
            break
        q = new
    return prior, table


def posterior(votes: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    i = np.arange(votes.shape[1])
    odds = np.log(prior / (1 - prior)) + (np.log(table[i, 1, votes + 1]) - np.log(table[i, 0, votes + 1])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def shape(w: str) -> str:
    """A word's kinds of characters, runs squeezed to two."""
    out = []
    for c in w:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


def word_features(w: str) -> list[int]:
    """Hashed buckets of a word: itself, its shape and its last character."""
    low = w.lower()
    return [crc32(f"{kind}{x}".encode("utf-8", "replace")) % BUCKETS for kind, x in (("w", low), ("s", shape(w)), ("e", w[-1]))]


REPEAT, BIAS = crc32(b"repeat") % BUCKETS, crc32(b"bias") % BUCKETS


def features(text: str) -> dict[int, float]:
    ws = text.split()
    out: dict[int, float] = {BIAS: 1.0}
    if ws:
        for w in ws:
            for k in word_features(w):
                out[k] = out.get(k, 0) + 1 / len(ws)
        out[REPEAT] = out.get(REPEAT, 0) + sum(map(eq, ws, ws[1:])) / len(ws)
    return out


def fit_linear(texts: list[str], target: np.ndarray, epochs: int = 12, rate: float = 0.5, seed: int = 4) -> np.ndarray:
    """Weights of a logistic model on hashed features, fitted to soft labels with adaptive steps."""
    rows = [features(t) for t in texts]
    rows = [(np.fromiter(r, np.int64, len(r)), np.fromiter(r.values(), float, len(r))) for r in rows]
    w, g2, r = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            k, x = rows[i]
            d = (1 / (1 + np.exp(-np.clip(w[k] @ x, -30, 30))) - target[i]) * x
            g2[k] += d * d
            w[k] -= rate * d / np.sqrt(g2[k])
    return w.astype(np.float32)


class _Weights(dict):
    """The summed weight of each word, computed once; bounded."""

    def __init__(self, w: np.ndarray):
        self.w = w

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        x = self[word] = float(self.w[word_features(word)].sum())
        return x


class Scorer:
    """The fitted labellers and linear scorer; scores whole texts."""

    def __init__(self, prior: float, table: np.ndarray | None, weights: np.ndarray | None):
        self.prior, self.table, self.weights = prior, table, weights

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of the labellers, score of the linear scorer) of each text; 0 and 0 for blank ones."""
        weak, out = np.zeros(len(texts)), np.zeros(len(texts))
        if self.weights is None:
            return weak, out
        known = self.__dict__.setdefault("known", _Weights(self.weights))
        repeat, bias = float(self.weights[REPEAT]), float(self.weights[BIAS])
        for i, t in enumerate(texts):
            if t and (ws := t.split()):
                weak[i] = posterior(np.array([labellers(t, ws)]), self.prior, self.table)[0]
                s = (sum(map(known.__getitem__, ws)) + sum(map(eq, ws, ws[1:])) * repeat) / len(ws) + bias
                out[i] = 1 / (1 + np.exp(-min(max(s, -30.0), 30.0)))
        return weak, out


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    for i in range(0, len(texts), PIECE):
        yield texts.slice(i, PIECE).to_pylist()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000) -> Scorer:
    """Accuracies of the labellers from the votes on all documents, counted by pattern; the linear scorer from the posteriors of at
    most `sample` documents, picked by the hash of their id and text. No given label is used."""
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, int] = {}
            for part in _pieces(b.column(0)):
                for t in part:
                    if ws := t.split():
                        v = labellers(t, ws)
                        seen[v] = seen.get(v, 0) + 1
            columns = [pa.array([v[k] for v in seen], pa.int32()) for k in range(len(LABELLERS))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seen.values(), pa.int64())], [*LABELLERS, "n"])

    kinds = ", ".join(f"{k} int" for k in LABELLERS)
    # at most 3 ** labellers rows, counted in each batch first
    patterns = d.select("text").mapInArrow(vote, f"{kinds}, n bigint").groupBy(*LABELLERS).agg(F.sum("n").alias("n")).toPandas().sort_values([*LABELLERS])
    if not len(patterns):
        return Scorer(0.5, None, None)
    prior, table = fit_labellers(patterns[[*LABELLERS]].to_numpy(), patterns["n"].to_numpy(float))
    h = F.xxhash64("doc_id", "text")
    some = d.filter(F.trim("text") != "").select("doc_id", h.alias("h"))
    picked = thinned(some, "h", sample, int(patterns["n"].sum())).orderBy("h", "doc_id").limit(sample)
    train = d.withColumn("h", h).join(F.broadcast(picked), "h", "left_semi").dropDuplicates(["h"]).toPandas().sort_values("h")
    train = train[train.text.map(lambda t: bool(t.split())).astype(bool)]
    votes = np.array([labellers(t, t.split()) for t in train.text]).reshape(-1, len(LABELLERS))
    return Scorer(prior, table, fit_linear(list(train.text), posterior(votes, prior, table)) if len(train) else None)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = 3000) -> DataFrame:
    """doc_id, weak (posterior of the labellers), score (the linear scorer's), accepted (score >= threshold) for every row of docs.

    Null texts count as empty. Empty and blank texts have score 0 and are rejected. Repeated rows get equal results; an empty table
    gives an empty one.
    """
    model = fit(docs, id_col, text_col, sample)

    import pandas as pd

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            weak, s = model(list(p.text))
            yield pd.DataFrame({"doc_id": p.doc_id, "weak": weak, "score": s})

    out = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(score, "doc_id string, weak double, score double")
    return out.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "weak", "score", (F.col("score") >= threshold).alias("accepted"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = 3000) -> DataFrame:
    """The rows of docs that quality() accepts, with all their columns."""
    model = fit(docs, id_col, text_col, sample)

    @F.arrow_udf("boolean")
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(np.concatenate([np.zeros(0, bool), *[model(part)[1] >= threshold for part in _pieces(b)]]))

    # only texts go to Python, and only a flag of each comes back
    return docs.filter(passes(text_col))
