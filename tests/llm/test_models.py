"""The trained models' scores against plain forward passes over whole texts, and the search over more vectors than it is fitted on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import ann, language_id, quality, toxicity
from tests.llm.test_rows import words

SF = "/root/testdata/sf0.001"


def sig(x):
    return 1 / (1 + np.exp(-x))


def plain_logit(net, ws):
    """One window, step by step: inputs, two recurrent passes, attention over the words that are there."""
    p, h = net.p, toxicity.HIDDEN
    inputs = []
    for w in ws + [None] * (toxicity.STEPS - len(ws)):
        if w is None:
            inputs.append(np.concatenate([p["we"][toxicity.PAD], np.zeros(toxicity.CHAR_DIM)]))
            continue
        core = w.strip(toxicity.EDGES) or w
        two, three, _ = toxicity.grams([core])
        each = [g for g in (*two, *three) if g]
        inputs.append(np.concatenate([p["we"][net.vocab.get(core, toxicity.OOV)], p["ce"][each].sum(0) / len(each) ** 0.5]))
    states = []
    for k in "fb":
        s, out = np.zeros(h), []
        for e in inputs if k == "f" else inputs[::-1]:
            x, u = e @ p[f"x{k}"] + p[f"b{k}"], s @ p[f"u{k}"]
            z, r = sig(x[:h] + u[:h]), sig(x[h : 2 * h] + u[h : 2 * h])
            s = (1 - z) * s + z * np.tanh(x[2 * h :] + r * u[2 * h :])
            out.append(s)
        states.append(out if k == "f" else out[::-1])
    hs = np.concatenate([np.array(states[0]), np.array(states[1])], 1)[: len(ws)]
    a = np.exp(np.tanh(hs @ p["wa"]) @ p["va"])
    return (a / a.sum()) @ hs @ p["wo"] + p["bo"][0]


def test_toxicity_is_the_highest_of_all_windows(spark):
    r = random.Random(5)
    rows = [(i, " ".join(words(r, r.choice([1, 5, 31, 33, 120]), 200) + (["idiot!", "moron"] if i % 2 else [])), i % 2) for i in range(200)]
    rows.append((500, "x" * 3000 + " " + "(y)" + " -- ok", 0))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id bigint, toxic int")
    net = toxicity.train(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels).collect()}
    for i, t, _ in rows[::9] + rows[-1:]:
        ws = t.lower().split()
        wins = [ws[s : s + 32] for s in range(0, max(1, len(ws) - 16), 16)]
        assert set(range(len(ws))) == {k for s in range(0, max(1, len(ws) - 16), 16) for k in range(s, min(len(ws), s + 32))}
        best = max(plain_logit(net, w) for w in wins)
        assert got[i]["n_windows"] == len(wins) and got[i]["score"] == pytest.approx(sig(best * net.scale + net.shift), abs=1e-4)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_language_is_the_mean_of_all_windows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    net, langs = language_id.train(d)
    got = {x["doc_id"]: x for x in language_id.identify(d).collect()}
    for x in d.orderBy(F.length("text").desc()).limit(5).collect() + d.limit(10).collect():
        b = x["text"].encode()
        probs = []
        for at in range(0, max(1, len(b)), 256):
            row = np.zeros(256, int)
            row[: len(b[at : at + 256])] = list(b[at : at + 256])
            e = net.p["e"][row]
            pooled = []
            for w in language_id.WIDTHS:
                z = np.stack([e[k : k + w].ravel() @ net.p[f"w{w}"] for k in range(256 - w + 1)])
                pooled += list(np.maximum(z.max(0) + net.p[f"b{w}"], 0))
            s = np.array(pooled) @ net.p["wo"] + net.p["bo"]
            probs.append(np.exp(s - s.max()) / np.exp(s - s.max()).sum())
        mean = np.mean(probs, 0)
        if got[x["doc_id"]]["lang_pred"] != "und":
            assert got[x["doc_id"]]["lang_pred"] == langs[int(mean.argmax())] and got[x["doc_id"]]["score"] == pytest.approx(mean.max(), abs=1e-4)


def test_quality_is_em_and_a_linear_model(spark):
    """Posteriors by loops over documents instead of patterns; scores by the features as they are defined."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {x["doc_id"]: x["text"] or "" for x in d.collect()}
    model = quality.fit(d)
    votes = [quality.labellers(t, t.split()) for t in texts.values() if t.split()]
    q = [1 / (1 + np.exp(-1.0 - sum(3.0 * v if v < 0 else v for v in row))) for row in votes]
    for _ in range(100):
        prior = min(max(sum(q) / len(q), 1e-4), 1 - 1e-4)
        share = {}
        for k in range(len(quality.LABELLERS)):
            for good in (0, 1):
                n = [0.5 + sum((x if good else 1 - x) for x, row in zip(q, votes) if row[k] == v) for v in (-1, 0, 1)]
                share.update({(k, good, v): m / sum(n) for v, m in zip((-1, 0, 1), n)})
        new = []
        for row in votes:
            odds = np.log(prior / (1 - prior)) + sum(np.log(share[k, 1, v] / share[k, 0, v]) for k, v in enumerate(row))
            new.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        change, q = max(abs(a - b) for a, b in zip(q, new)), new
        if change < 1e-7:
            break
    want = dict(zip([i for i, t in texts.items() if t.split()], q))
    for x in quality.quality(d).collect():
        t = texts[x["doc_id"]]
        assert x["weak"] == pytest.approx(want.get(x["doc_id"], 0.0), abs=1e-3)
        score = 1 / (1 + np.exp(-np.clip(sum(float(model.weights[k]) * v for k, v in quality.features(t).items()), -30, 30))) if t.split() else 0.0
        assert x["score"] == pytest.approx(score, abs=1e-4) and x["accepted"] == (x["score"] >= 0.3)


def test_neighbours_beyond_the_sample(spark):
    """Clusters, some of a vector repeated, and more vectors than are fitted: recall against brute force; exact where it is asked for."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 16)) * 4
    x = np.concatenate([centres[r.integers(40, size=3800)] + r.normal(size=(3800, 16)) * 0.6, r.normal(size=(200, 16)) * 30])
    x[1200:1260] = x[1200]
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id bigint, embedding array<double>")
    for how, least in ((dict(sample=500, list_size=32), 0.9), (dict(sample=300, exact=True), 1.0)):
        got = {}
        for q in ann.nearest(df, **how).collect():
            got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"]))
        assert sorted(got) == list(range(0, 4000, 100))
        hit = 0
        for q, mine in got.items():
            assert [m[0] for m in sorted(mine)] == list(range(1, 11))
            dist = np.sqrt(((x - x[q]) ** 2).sum(1))
            best = [i for _, i in sorted((dist[i], i) for i in range(4000) if i != q)[:10]]
            hit += len(set(best) & {m[1] for m in mine})
            assert how.get("exact") is None or [m[1] for m in sorted(mine)] == best
        assert hit >= least * 10 * len(got)


def test_quality_filter_reads_texts_in_pieces(spark, monkeypatch):
    """Python holds few texts at a time, however many an Arrow batch has; null texts count too."""
    most = 1000

    def model(texts):
        assert len(texts) <= most
        return None, np.array([float(t is not None and t.endswith("1")) for t in texts])

    monkeypatch.setattr(quality, "fit", lambda *a: model)
    d = spark.range(5000).repartition(1).selectExpr("id doc_id", "if(id % 7 = 0, null, concat('x', id)) text", "id n_chars")
    got = {x["doc_id"]: x for x in quality.accepted(d).collect()}
    assert set(got) == {i for i in range(5000) if i % 7 and i % 10 == 1} and all(x["text"] == f"x{i}" and x["n_chars"] == i for i, x in got.items())
