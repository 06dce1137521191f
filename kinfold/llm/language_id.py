"""Language identification with a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

WIDTHS, FILTERS, DIM, WINDOW = (2, 3, 4), 12, 8, 256


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length byte windows of whole texts, one after the other, the last padded with 0; and the text of each."""
    parts, owner = [], []
    for k, t in enumerate(texts):
        b = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        n = max(1, -(-len(b) // WINDOW))
        full = np.zeros(n * WINDOW, np.uint8)
        full[: len(b)] = b
        parts.append(full)
        owner.append(np.full(n, k))
    return np.concatenate(parts).reshape(-1, WINDOW), np.concatenate(owner)


class ByteCNN:
    """Byte embedding, filters of several widths, ReLU, max over time, softmax."""

    def __init__(self, classes: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, DIM)), "wo": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)), "bo": np.zeros(classes)}
        for w in WIDTHS:
            self.p |= {f"w{w}": r.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)), f"b{w}": np.zeros(FILTERS)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        emb, pooled, at, cols = p["e"][x], [], [], []
        for w in WIDTHS:
            c = np.concatenate([emb[:, k : WINDOW - w + 1 + k] for k in range(w)], 2)
            z = c @ p[f"w{w}"]
            i = z.argmax(1)
            pooled.append(np.take_along_axis(z, i[:, None], 1)[:, 0] + p[f"b{w}"])
            at.append(i)
            cols.append(c)
        h = np.maximum(np.concatenate(pooled, 1), 0)
        s = h @ p["wo"] + p["bo"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[np.arange(n), y] -= 1
        s /= n
        g = {"wo": h.T @ s, "bo": s.sum(0), "e": np.zeros_like(p["e"])}
        dh = (s @ p["wo"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            picked = cols[j][rows, at[j]]  # n, filters, w * DIM
            g[f"w{w}"] = np.einsum("nfd,nf->df", picked, d)
            g[f"b{w}"] = d.sum(0)
            back = np.einsum("df,nf->nfd", p[f"w{w}"], d).reshape(n, FILTERS, w, DIM)
            for k in range(w):
                np.add.at(g["e"], x[rows, at[j] + k], back[:, :, k])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.004, seed: int = 2) -> None:
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(self.p["bo"].size)]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = np.array([by[k][r.integers(len(by[k]))] for k in r.integers(len(by), size=batch)])  # languages come up evenly
            g = self.grads(x[pick], y[pick])
            for k, a in g.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> list[tuple[int, list[tuple[int, int, np.ndarray]]]]:
        """The same convolution as sums of table rows: a table for two neighbouring bytes, one for a last byte alone."""
        out, e = [], self.p["e"]
        for w in WIDTHS:
            one = [e @ self.p[f"w{w}"][k * DIM : (k + 1) * DIM] for k in range(w)]
            parts = [(k, 2, (one[k][:, None] + one[k + 1][None]).reshape(65536, FILTERS)) for k in range(0, w - 1, 2)]
            out.append((w, parts + ([(w - 1, 1, one[w - 1])] if w % 2 else [])))
        return out

    def predict(self, x: np.ndarray, tables, block: int = 128) -> np.ndarray:
        probs = []
        for at in range(0, len(x), block):
            b = x[at : at + block]
            pair = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            pooled = []
            for w, parts in tables:
                n, z = WINDOW - w + 1, None
                for k, size, t in parts:
                    got = t.take((pair if size == 2 else b)[:, k : k + n].ravel(), axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(z.reshape(len(b), n, FILTERS).max(1) + self.p[f"b{w}"])
            s = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["wo"] + self.p["bo"]
            s = np.exp(s - s.max(1, keepdims=True))
            probs.append(s / s.sum(1, keepdims=True))
        return np.concatenate(probs)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400) -> tuple[ByteCNN | None, list[str]]:
    """A network fitted on at most per_language labelled rows of each language outside the held-out ones, picked by the hash of
    their id, with all their windows. Rows with null or empty texts teach nothing."""
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"))
    counts = rows.groupBy("lang").count()  # a row for each language
    share = F.least(F.lit(1.0), 4 * per_language / F.col("count"))
    # about four times as many by the hash, so that no task gathers that many from each part of the table
    rows = rows.join(F.broadcast(counts), "lang").filter(F.pmod("h", F.lit(1 << 31)) <= share * (1 << 31))
    by = Window.partitionBy("lang").orderBy("h", "id")
    rows = rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= per_language).select("id", "lang").distinct()
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id").groupBy("id", "lang").agg(F.min("text").alias("text")).toPandas()  # one text for each
    sample = sample[sample.text.notna()].sort_values(["id", "text"])
    if sample.empty:
        return None, []
    langs, y = np.unique(sample.lang.astype(str), return_inverse=True)
    xs, ys, r = [], [], np.random.default_rng(3)
    for t, k in zip(sample.text, y):
        x, _ = windows([t])
        pick = x[r.permutation(len(x))]
        cut = pick[:1].copy()
        cut[:, int(r.integers(8, 128)) :] = 0  # short texts occur too
        xs += [pick, cut]
        ys.append(np.full(len(pick) + 1, k))
    net = ByteCNN(len(langs))
    net.fit(np.concatenate(xs), np.concatenate(ys))
    return net, list(langs)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    The score is the mean probability of the language over all windows of the whole text. A text that is null or has no letter
    is `und` with score 0; so is every text if there is no labelled row to learn from. Rows that repeat get equal results.
    """
    net, langs = train(docs, id_col, text_col, lang_col, **fit)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = net.tables() if net else None
        for p in batches:
            lang, sure = np.full(len(p), "und", object), np.zeros(len(p))
            ok = [k for k, t in enumerate(p.text) if t is not None and any(map(str.isalpha, t))] if net else []
            at = 0
            while at < len(ok):  # about 4 MB of text at a time, or one text
                end, size = at, 0
                while end < len(ok) and (end == at or size < 4_000_000):
                    size += len(p.text[ok[end]])
                    end += 1
                x, owner = windows([p.text[k] for k in ok[at:end]])
                probs = net.predict(x, tables)
                mean = np.stack([np.bincount(owner, probs[:, c], end - at) for c in range(len(langs))], 1)
                mean /= np.bincount(owner, minlength=end - at)[:, None]
                best = mean.argmax(1)
                lang[ok[at:end]] = [langs[b] for b in best]
                sure[ok[at:end]] = mean[np.arange(end - at), best]
                at = end
            yield pd.DataFrame({"doc_id": p.doc_id, "held_out": p.held_out, "lang_pred": lang, "score": np.clip(sure, 0, 1)})

    # the id travels as text: pandas would turn whole numbers with nulls into floats
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = d.mapInPandas(score, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
