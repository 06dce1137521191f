"""Toxicity with a bidirectional gated recurrent network, attention pooling, and character and word inputs, in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, thinned

STEPS, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, CHARS = 32, 16, 8, 8, 12, 4096
EDGES = ".,;:!?\"'()[]{}<>|*#$%&/\\-_=+~`«»“”‘’…¡¿"
#: Unknown words and padding.
OOV, PAD = 0, 1


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character pairs and triples of words with their ends marked: pairs and triples that start at each character (0: none
    there), and where each word starts."""
    c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    start = np.cumsum(size) - size
    b, d = np.roll(c, -1), np.roll(c, -2)
    mix = lambda x: np.uint64(1) + ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(CHARS - 1)
    two, three = (mix(c * np.uint64(1 << 21) + b).astype(np.int32), mix((c * np.uint64(1 << 21) + b) * np.uint64(1 << 21) + d).astype(np.int32))
    last = start + size - 1
    two[last] = three[last] = three[last - 1] = 0
    return two, three, start


def spans(n: int) -> list[int]:
    """Starts of the overlapping windows over n words; every word is in one at least."""
    return list(range(0, max(1, n - STEPS + STRIDE), STRIDE))


class BiGRU:
    """Parameters, training and scoring. A word's input is its embedding next to the sum of its characters' grams over the root of their number."""

    def __init__(self, vocab: dict[str, int], seed: int = 5):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocab = vocab
        self.p = {"we": r.normal(0, 0.3, (len(vocab) + 2, WORD_DIM)), "ce": r.normal(0, 0.3, (CHARS, CHAR_DIM)), "wa": r.normal(0, 0.4, (2 * h, h)), "va": r.normal(0, 0.4, h), "wo": r.normal(0, 0.4, 2 * h), "bo": np.array([-1.0])}
        for k in "fb":
            self.p |= {f"x{k}": r.normal(0, d**-0.5, (d, 3 * h)), f"u{k}": r.normal(0, h**-0.5, (h, 3 * h)), f"b{k}": np.zeros(3 * h)}
        self.p["ce"][0] = 0  # no gram
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m, self.v, self.t = {}, {}, 0
        self.scale, self.shift = 1.0, 0.0  # of a document's highest logit, to a probability

    def run(self, x: np.ndarray, k: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of one direction from inputs (T, B, 3H)."""
        h, u, n = np.zeros((x.shape[1], HIDDEN), np.float32), self.p[f"u{k}"], HIDDEN
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(x.shape[0]) if k == "f" else range(x.shape[0] - 1, -1, -1):
            hu = h @ u
            zr = _sig(x[t][:, : 2 * n] + hu[:, : 2 * n])
            c = np.tanh(x[t][:, 2 * n :] + zr[:, n:] * hu[:, 2 * n :])
            prev, h = h, h + zr[:, :n] * (c - h)
            out[t] = h
            if keep is not None:
                keep.append((t, prev, zr, c, hu[:, 2 * n :]))
        return out

    def head(self, hs: np.ndarray, real: np.ndarray):
        """Attention over the steps that hold words, then the logit."""
        a = np.tanh(hs @ self.p["wa"])
        s = np.where(real, a @ self.p["va"], -1e9)
        s = np.exp(s - s.max(0))
        s /= s.sum(0)
        pooled = (s[:, :, None] * hs).sum(0)
        return a, s, pooled, pooled @ self.p["wo"] + self.p["bo"][0]

    def step(self, words: np.ndarray, forms: np.ndarray, grams: tuple[np.ndarray, np.ndarray], real: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One Adam step on windows: word ids (T, B), forms (T, B), which are words (T, B), labels (B). grams are those of all forms one
        after the other, and where each form's begin."""
        p, n = self.p, HIDDEN
        each, at = np.unique(forms, return_inverse=True)
        at, begin, size = at.reshape(forms.shape), grams[1][each], grams[1][each + 1] - grams[1][each]
        owner = np.repeat(np.arange(len(each)), size)
        gram = grams[0][np.arange(len(owner)) + (begin - np.cumsum(size) + size)[owner]]
        root = 1 / np.sqrt(np.maximum(size, 1))
        summed = np.stack([np.bincount(owner, p["ce"][gram, i], len(each)) for i in range(CHAR_DIM)], 1) * root[:, None]
        e = np.concatenate([p["we"][words], summed[at]], 2).astype(p["we"].dtype)
        kept, hs = {}, []
        for k in "fb":
            kept[k] = []
            hs.append(self.run(e @ p[f"x{k}"] + p[f"b{k}"], k, kept[k]))
        hs = np.concatenate(hs, 2)
        a, s, pooled, logit = self.head(hs, real)
        d = (_sig(logit) - y) / len(y)
        g = {"bo": np.array([d.sum()]), "wo": pooled.T @ d}
        dp = d[:, None] * p["wo"]
        ds = (hs * dp).sum(2)
        ds = s * (ds - (s * ds).sum(0))
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        g["va"], g["wa"] = np.einsum("tb,tbh->h", ds, a), np.einsum("tbi,tbh->ih", hs, da)
        dh = s[:, :, None] * dp + da @ p["wa"].T
        de = np.zeros_like(e)
        for j, k in enumerate("fb"):
            u, dx, carry = p[f"u{k}"], np.zeros((*e.shape[:2], 3 * n), np.float32), np.zeros((e.shape[1], n), np.float32)
            gu = np.zeros_like(u)
            for t, prev, zr, c, huc in reversed(kept[k]):
                z, r = zr[:, :n], zr[:, n:]
                o = dh[t][:, j * n : (j + 1) * n] + carry
                dc = o * z * (1 - c * c)
                dz, dr = o * (c - prev) * z * (1 - z), dc * huc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                dx[t] = np.concatenate([dz, dr, dc], 1)
                gu += prev.T @ du
                carry = o * (1 - z) + du @ u.T
            g[f"u{k}"], g[f"b{k}"], g[f"x{k}"] = gu, dx.sum((0, 1)), np.einsum("tbi,tbj->ij", e, dx)
            de += dx @ p[f"x{k}"].T
        g["we"], g["ce"] = np.zeros_like(p["we"]), np.zeros_like(p["ce"])
        for i in range(WORD_DIM):
            g["we"][:, i] = np.bincount(words.ravel(), de[:, :, i].ravel(), len(p["we"]))
        for i in range(CHAR_DIM):
            back = np.bincount(at.ravel(), de[:, :, WORD_DIM + i].ravel(), len(each)) * root
            g["ce"][:, i] = np.bincount(gram, back[owner], CHARS)
        g["ce"][0] = 0
        self.t += 1
        for k, x in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * x * x
            p[k] -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores all windows of texts. What a word adds to the gates is computed once for each distinct word, in a table of bounded size."""

    MOST = 200_000

    def __init__(self, net: BiGRU):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.used = 1  # row 0 pads
        e = np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
        e[0, :WORD_DIM] = self.net.p["we"][PAD]
        self.table[0] = self.gates(e)[0]

    def gates(self, e: np.ndarray) -> np.ndarray:
        p = self.net.p
        return np.concatenate([e @ p["xf"] + p["bf"], e @ p["xb"] + p["bb"]], 1)

    def add(self, new: list[str]) -> None:
        p = self.net.p
        core = [w.strip(EDGES) or w for w in new]
        two, three, start = grams(core)
        n = np.array([2 * len(w) + 1 for w in core], np.float32)
        chars = np.add.reduceat(p["ce"][two] + p["ce"][three], start) / np.sqrt(n)[:, None]
        e = np.concatenate([p["we"][[self.net.vocab.get(w, OOV) for w in core]], chars], 1)
        if self.used + len(new) > len(self.table):
            more = np.zeros((max(len(self.table), len(new)), 6 * HIDDEN), np.float32)
            self.table = np.concatenate([self.table, more])
        self.table[self.used : self.used + len(new)] = self.gates(e)
        self.row.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)

    def windows(self, ids: np.ndarray, block: int = 2048) -> np.ndarray:
        """Logits of windows of table rows (N, T); row 0 pads."""
        out = np.empty(len(ids))
        for at in range(0, len(ids), block):
            i = np.ascontiguousarray(ids[at : at + block].T)
            x = self.table[i]
            hs = np.concatenate([self.net.run(x[:, :, : 3 * HIDDEN], "f"), self.net.run(x[:, :, 3 * HIDDEN :], "b")], 2)
            out[at : at + block] = self.net.head(hs, i > 0)[3]
        return out

    def logits(self, texts: list[str]) -> list[np.ndarray]:
        """The logits of all windows of each text."""
        if len(self.row) > self.MOST:
            self.clear()
        split = [t.lower().split() for t in texts]
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.row]
        if new:
            self.add(new)
        ids = []
        for ws in split:
            starts = np.array(spans(len(ws)))
            flat = np.zeros(starts[-1] + STEPS, np.int32)
            flat[: len(ws)] = np.fromiter(map(self.row.__getitem__, ws), np.int32, len(ws))
            ids.append(flat[starts[:, None] + np.arange(STEPS)])
        return np.split(self.windows(np.concatenate(ids)), np.cumsum([len(x) for x in ids])[:-1])


def calibrate(net: BiGRU, texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> None:
    """Fit the probability of a toxic document to its highest logit, on documents that the network hasn't learned from."""
    x = np.array([s.max() for at in range(0, len(texts), 256) for s in Scorer(net).logits(texts[at : at + 256])])
    w = np.where(toxic == 1, weight[1], weight[0])
    w, b, f = w / w.mean(), np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1)
    loss = lambda b: (w * (np.logaddexp(0, f @ b) - toxic * (f @ b))).sum() + ((b - [1, 0]) ** 2).sum()
    for _ in range(30):  # Newton with halved steps, and a pull to the start
        q = _sig(f @ b)
        d = np.linalg.solve((f * (w * q * (1 - q))[:, None]).T @ f + 2 * np.eye(2), f.T @ (w * (q - toxic)) + 2 * (b - [1, 0]))
        size = next((k for k in 0.5 ** np.arange(12) if loss(b - k * d) < loss(b)), 0)
        b = b - size * d
    net.scale, net.shift = max(0.05, float(b[0])), float(b[1])


def fit(texts: list[str], toxic: np.ndarray, steps: int = 700, batch: int = 96, vocab_size: int = 20_000, seed: int = 9) -> BiGRU:
    """Labels are of documents, the network scores windows: at first every window of a toxic document counts as toxic, after
    that its highest windows; half of the clean windows are then those it scores highest. Words lose their identity or
    a character now and then, so that characters carry weight too."""
    r = np.random.default_rng(seed)
    split = [[w.strip(EDGES) or w for w in t.lower().split()] for t in texts]
    seen = Counter(w for ws in split for w in set(ws))
    net = BiGRU({w: i + 2 for i, (w, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:vocab_size]) if n > 1})
    wins = np.array([(d, s) for d, ws in enumerate(split) if ws for s in spans(len(ws))], np.int64).reshape(-1, 2)
    is_pos = np.asarray(toxic)[wins[:, 0]] == 1
    pos, neg, hard = wins[is_pos], wins[~is_pos], wins[:0]
    if not len(pos) or not len(neg):
        net.p["bo"][:] = 5.0 if len(pos) else -5.0
        net.p["wo"][:] = 0
        return net
    known = list(seen)
    at = {w: i + 1 for i, w in enumerate(known)}
    spoil = [w if len(w) < 4 else w[: (c := 1 + crc32(w.encode("utf-8", "replace")) % (len(w) - 2))] + "*@01!x.-"[len(w) % 8] + w[c + 1 :] for w in known]
    two, three, start = grams(known + spoil)
    # form 0 pads and has no grams; the words, then the words with a character changed
    each = [g for a, z in zip(start, np.append(start[1:], len(two))) for g in (two[a : z - 1], three[a : z - 2])]
    table = (np.concatenate(each), np.concatenate([[0], np.cumsum([0, *(len(a) + len(b) for a, b in zip(each[::2], each[1::2]))])]))
    vid = np.array([PAD] + [net.vocab.get(w, OOV) for w in known] + [OOV] * len(known))
    docs = [np.array([at[w] for w in ws] + [0] * STEPS, np.int64) for ws in split]
    half = batch // 2
    for t in range(steps):
        if t in (steps // 4, steps // 2, steps * 3 // 4):
            scorer, keep, hard = Scorer(net), [], []
            some = [k for k in range(len(texts)) if split[k]]
            for c in range(0, len(some), 256):
                part = some[c : c + 256]
                for k, s in zip(part, scorer.logits([texts[k] for k in part])):
                    if toxic[k]:
                        keep += [(k, i * STRIDE) for i in np.flatnonzero(s >= min(s.max(), max(0.0, s.max() - 2)))]
                    else:
                        hard += [(k, i * STRIDE) for i in np.flatnonzero(s > -3)]
            pos, hard = np.array(keep, np.int64), np.array(hard, np.int64).reshape(-1, 2)
        easy = batch - half if not len(hard) else (batch - half) // 2
        pick = np.concatenate([pos[r.integers(len(pos), size=half)], neg[r.integers(len(neg), size=easy)], hard[r.integers(max(1, len(hard)), size=batch - half - easy)]])
        w = np.stack([docs[d][s : s + STEPS] for d, s in pick], 1)
        real = w > 0
        real[0] = True
        drop = r.random(w.shape)
        w = np.where((drop > 0.96) & (w > 0), w + len(known), w)
        ids = np.where((drop < 0.1) & (w > 0), OOV, vid[w])
        net.step(ids, w, table, real, np.repeat([1.0, 0.0], [half, batch - half]), 0.01 if t < steps * 0.6 else 0.003)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500) -> BiGRU | None:
    """A network fitted on at most per_class labelled documents of each class outside the held-out ones, picked by the hash of
    their id (of several texts of one id the first). A fifth of them are for the calibration, to the shares of the classes among all
    labels. Words that fewer than two of them have, or that are not among the vocab_size most frequent, are known by their characters."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = known.withColumn("h", F.xxhash64("id"))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    first = lambda k: thinned(known.filter(F.col("y") == k), "h", per_class, share.get(k, 0)).orderBy("h", "id").limit(per_class)
    known = first(1).unionAll(first(0)).drop("h")
    # one text for each id, so that no more comes back than was picked
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toPandas()
    sample = sample[sample.text.map(lambda t: t is not None and bool(t.strip())).astype(bool)].sort_values(["id", "text"])
    if not len(sample):
        return None
    texts, y = list(sample.text), sample.y.to_numpy()
    check = np.array([crc32(t.encode("utf-8", "replace")) % 5 == 0 for t in texts])  # equal texts stay together
    net = fit([t for t, c in zip(texts, check) if not c], y[~check])
    if len(set(y[check])) == 2:
        weight = np.array([share.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
        calibrate(net, [t for t, c in zip(texts, check) if c], y[check], weight)
    return net


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows for every row of docs.

    The score is the highest probability among all overlapping windows (32 words, every 16) of the whole text. Texts that are
    null, empty or blank score 0, as does everything if there are no labels to learn from. Repeated rows get equal results.
    """
    net = train(docs, labels, id_col, text_col, label_col, **how)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(net) if net else None
        for p in batches:
            best, count = np.zeros(len(p)), np.zeros(len(p), np.int64)
            ok = [k for k, t in enumerate(p.text) if t is not None and t.strip()] if net else []
            at = 0
            while at < len(ok):  # about 1 MB of text at a time, or one text
                end, size = at, 0
                while end < len(ok) and (end == at or size < 1_000_000):
                    size += len(p.text[ok[end]])
                    end += 1
                found = scorer.logits([p.text[k] for k in ok[at:end]])
                best[ok[at:end]], count[ok[at:end]] = [s.max() for s in found], [len(s) for s in found]
                at = end
            prob = np.where(count > 0, _sig(best * net.scale + net.shift), 0.0) if net else best
            yield pd.DataFrame({"doc_id": p.doc_id, "held_out": p.held_out, "score": prob, "predicted": (prob >= threshold).astype("int32"), "n_windows": count})

    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = d.mapInPandas(score, "doc_id string, held_out boolean, score double, predicted int, n_windows bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
