"""Pairs, windows, lines and conversations against brute force, and the edge cases of every operator."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import ann, chat, common, decontamination, language_id, mixing, near_dedup, quality, toxicity
from kinfold.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLE_SQL[name])


def words(r, n, vocab=400):
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def near_docs(seed, families=6, size=9):
    """Families of texts with growing numbers of edits, some around the threshold, and copies."""
    r, out = random.Random(seed), []
    for _ in range(families):
        base = words(r, r.choice([40, 90, 200]), 5000)
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(0, 3)):
                t[r.randrange(len(t))] = f"x{r.randrange(9999)}"
            out.append(" ".join(t))
    out += out[:4] + ["", "  ", None, "one two", "one two", "One TWO", "a b c d e"]
    return list(enumerate(out))


def brute_components(docs, percent, width=5):
    sets = {}
    for i, t in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    comp = {i: i for i, _ in docs}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and a and b and 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_near_duplicates(spark, seed, percent):
    docs = near_docs(seed)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, percent)


def test_near_duplicates_in_crowds(spark, monkeypatch):
    """Large lists go block against block: the same components as by all pairs."""
    r = random.Random(7)
    base = words(r, 60, 9999)
    docs = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(len(t))] = f"x{r.randrange(99999)}"
        docs.append((i, " ".join(t)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    orig = common.bucket_links
    monkeypatch.setattr(near_dedup, "bucket_links", lambda *a, **k: orig(*a, **{**k, "most": 4, "stars": 1}))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), percent=85).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(docs, 85)


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (9, "z " * 30000), (8, "z " * 30000)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).withColumn("n", F.lit("x")))
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got.collect()) == [(0, 2, 0), (3, 2, 3), (5, 2, 3), (5, 2, 3), (8, 1, 8), (9, 1, 8)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).isEmpty()


def test_near_duplicates_of_repeated_ids(spark):
    """Texts of one id link what is near to any of them, though their sets have one size; ids may be strings."""
    r = random.Random(3)
    a, b = words(r, 60, 9000), words(r, 60, 9000)
    edit = lambda t: " ".join([*t[:30], "x", *t[31:]])
    docs = [("1", " ".join(a)), ("1", " ".join(b)), ("7", edit(a)), ("8", edit(b)), ("9", edit(words(r, 60, 9000))), ("1", ""), ("5", None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id string, text string"), percent=80).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [("1", "1"), ("1", "1"), ("1", "1"), ("5", "5"), ("7", "1"), ("8", "1"), ("9", "9")]


def test_small_buckets_wait_for_the_pairs(spark, monkeypatch):
    """Star rounds after the first read the members of large buckets only; no link of a small bucket is lost by that."""
    large = [(1, n, 0) for n in range(60)]
    small = [(b, 100 + 3 * b + k, 0) for b in range(2, 40) for k in range(4)]  # neighbours share a node
    real = {(a, a + 1) for _, a, _ in small if a % 5} | {(0, 1), (58, 59)}
    sizes, orig = [], common.Staging.cut

    def cut(stage, df, name, plain=False):
        out = orig(stage, df, name, plain)
        if name == "sizes":
            sizes.append(out.agg(F.sum("size")).first()[0])
        return out

    monkeypatch.setattr(common.Staging, "cut", cut)
    links = spark.createDataFrame(sorted(real), "a bigint, b bigint")
    label = common.bucket_links(common.Staging(spark), spark.createDataFrame(large + small, "bucket bigint, node bigint, worth int"), lambda p: p.join(links, ["a", "b"], "left_semi"))
    of = {n: n for _, n, _ in large + small}
    together = {(a, b) for a, b in real if any({(k, a, 0), (k, b, 0)} <= {*large, *small} for k in range(1, 40))}
    for a, b in sorted(together):
        old, new = max(of[a], of[b]), min(of[a], of[b])
        of = {k: new if v == old else v for k, v in of.items()}
    got = dict(label.select("node", "comp").collect())
    assert {n: got.get(n, n) for n in of} == of and len(together) > 50
    assert sizes[0] > 200 and sizes[1:] == [60, 60]


def test_joins_by_a_hot_key(spark):
    pairs = spark.createDataFrame([(i, 0) for i in range(100)] + [(i, 1) for i in range(5)], "a bigint, b bigint")
    facts = spark.createDataFrame([(i, f"f{i}") for i in range(100)], "b bigint, f string")
    got = common.skewless(common.Staging(spark), pairs, facts, "b", 8)
    assert sorted((x["a"], x["b"], x["f"]) for x in got.collect()) == sorted([(i, 0, "f0") for i in range(100)] + [(i, 1, "f1") for i in range(5)])


def test_least_shared_is_a_tail():
    assert near_dedup.least_shared(32, 0.85) < 0.85 * 32 and near_dedup.least_shared(1, 0.85) == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    stage = common.Staging(spark)
    got = dict(map(tuple, common.components(stage, spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {k: v for k, v in got.items()} == {k: v for k, v in comp.items() if any(a != b and k in (a, b) for a, b in edges)}


def brute_hits(docs, items, width=8):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for k, (i, t) in enumerate(docs):
        w, at, seen = cut(t), set(), set()
        for j, b in items:
            v = cut(b)
            n = min(width, len(v))
            for p in range(len(v) - n + 1) if n else ():
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == v[p : p + n]:
                        at |= set(range(q, q + n))
                        seen.add(str(j))
        out[k] = (i, len(w), len(at), len(seen))
    return sorted(out.values(), key=str)


def test_decontamination(spark):
    r = random.Random(4)
    items = [(j, " ".join(words(r, n, 50))) for j, n in enumerate([30, 12, 8, 5, 1, 3])] + [(6, ""), (7, None), (8, "ÉTÉ été Ünter x9")]
    docs = []
    for i in range(30):
        t = words(r, 60, 50)
        for _ in range(r.randrange(3)):
            v = (items[r.randrange(6)][1]).split()
            p = r.randrange(50)
            t[p:p] = v
        docs.append((i, ", ".join(t).upper() if i % 3 == 0 else "\n".join(t)))
    docs += [(90, None), (91, ""), (92, "..."), (93, "ÉTÉ été Ünter x9"), (94, "été été Ünter x9"), (5, docs[5][1]), (None, items[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(d.withColumn("h", F.lit(1)).withColumn("_k1", F.lit(2)), b)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()), key=str) == brute_hits(docs, items)
    assert decontamination.contamination(d, b.limit(0)).filter("n_hit > 0 or contaminated").isEmpty()
    assert decontamination.contamination(d.limit(0), b).isEmpty()


def test_decontamination_removes_spans(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    clean = "  Some, clean text -- with marks!\nAnd lines. " * 3
    d = spark.createDataFrame([(1, f"{clean}{item.upper()}, {clean}", "x", 7), (2, clean, "y", 8), (3, item, "z", 9), (4, None, "z", 9)], "doc_id bigint, text string, row string, _at int")
    out = {r["doc_id"]: r for r in decontamination.decontaminate(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert set(out) == {1, 2, 4} and out[2]["text"] == clean and out[4]["text"] is None
    assert out[1]["text"] == clean + clean.lstrip() and (out[1]["row"], out[1]["_at"]) == ("x", 7)
    assert decontamination.decontaminate(d, spark.createDataFrame([(1, item)], "item_id bigint, text string"), remove="document").count() == 2


def test_chat(spark):
    t = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "more"), (4, 0, "user", "hi\x1fbot"), (5, 0, None, None), (5, 0, None, None), (None, 0, "user", "lone"), (None, 1, "user", "lone"), (6, None, "user", "hi")]
    got = {r["conv_id"]: r for r in chat.maximal_conversations(spark.createDataFrame(t, "conv_id bigint, turn bigint, role string, text string").withColumn("h", F.lit(0))).collect()}
    odd = [(None, 0, "user", "x"), (None, 0, "bot", "x"), (None, 1, "user", "x"), (7, 0, "bot", "x"), (7, 1, "user", "y"), (8, 0, "user", "x")]
    lone = chat.maximal_conversations(spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((x["conv_id"] or 0, x["n_turns"], x["kept"], x["rep_id"] or 0) for x in lone) == [(0, 1, False, 0), (0, 1, False, 8), (7, 2, True, 7), (8, 1, True, 8)]
    assert {k: v["kept"] for k, v in got.items()} == {1: False, 2: True, 3: False, 4: True, 5: True, None: True, 6: False}
    assert got[3]["rep_id"] == 2 and got[2]["rendered"].startswith("<|user|>\nhi<|end|>\n<|bot|>\nyo<|end|>") and got[5]["rendered"] == "<|unknown|>\n<|end|>" and got[5]["n_turns"] == 1 and got[1]["rendered"] is None
    assert chat.maximal_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).isEmpty()


def test_pfair():
    r = random.Random(2)
    for _ in range(20):
        parts = {f"s{i}": r.randrange(1, 60) for i in range(r.randrange(1, 25))}
        period, got = sum(parts.values()), dict.fromkeys(parts, 0)
        for s, _, release, deadline, t in mixing.pfair(parts):
            assert release <= t < deadline
            got[s] += 1
            assert max(abs(got[x] - (t + 1) * parts[x] / period) for x in parts) < 1
        assert got == parts


def test_plan_keeps_to_the_weights():
    """Over many thousand slots every source stays within a block of its exact weight."""
    r = random.Random(4)
    for weights in ({f"s{i}": (0.5 if i else 9.5) ** 0.5 for i in range(20)}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": r.random() ** 3 + 1e-3 for i in range(12)}):
        total, got = sum(weights.values()), dict.fromkeys(weights, 0)
        blocks = {s: int(9000 * w / total) + 5 for s, w in weights.items()}
        for s, block, release, deadline, t in mixing.plan(blocks, weights):
            assert block == got[s] and release <= t < deadline
            got[s] += 1
            if t < 8000:
                assert max(abs(got[x] - (t + 1) * weights[x] / total) for x in weights) < 1 + 1e-9
        assert got == blocks
    # skewed weights, as given, for 10 ** 5 slots; many sources
    for weights in ({"a": 0.9999, "b": 0.0001}, {"a": 0.70045, "b": 0.29955}):
        got, total = dict.fromkeys(weights, 0), sum(weights.values())
        for s, _, _, _, t in mixing.plan({"a": 10**5, "b": 10**5}, weights):
            got[s] += 1
            assert abs(got["b"] - (t + 1) * weights["b"] / total) < 1 + 1e-9
            if t == 99_000:
                break
    assert len(list(mixing.plan({f"s{i}": 3 for i in range(5000)}, {f"s{i}": (i + 1) ** 0.5 for i in range(5000)}))) == 15_000


def test_mixing_refuses_weights(spark):
    d = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id bigint, text string, source string")
    for w in ({"a": 1.0, "b": 0.0}, {"a": -1.0}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            mixing.mix(d, w)


def test_mixing(spark):
    r = random.Random(9)
    docs = [(i, " ".join(words(r, r.randrange(0, 30))), r.choice(["a", "a", "a", "b", None]), i) for i in range(700)] + [(1, None, "c", 1), (2, "", "c", 2), (2, "", "c", 2), (None, "x y", "b", 0)]
    out = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string, slot bigint").withColumn("_s", F.lit("own")), block_words=100)
    got = out.collect()
    assert len(got) == len(docs) and {x["_s"] for x in got} == {"own"}
    slots = {}
    for x in got:
        assert slots.setdefault(x["slot"], (x["source"], x["source_block"])) == (x["source"], x["source_block"])
        assert x["release"] <= x["slot"] < x["deadline"]
    for s in {x["source"] for x in got}:
        mine = sorted((x for x in got if x["source"] == s), key=lambda x: (x["slot"], x["mix_pos"]))
        before = 0
        for x in mine:
            assert x["source_block"] in (before // 100, before // 100 - 1)  # a wordless one at the end stays in the last block
            before += len((x["text"] or "").split())
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).isEmpty()
    assert mixing.mix(spark.createDataFrame(docs[:5], "doc_id bigint, text string, source string, slot bigint"), weights={"a": 3, "b": 1}).count() == 5


def test_neighbours(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(900, 12)).round(1)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)]
    rows += [(1000, None), (1100, [0.0] * 12), (1200, [float("nan")] * 12), (1300, [1.0] * 11 + [None]), (1400, [1.0] * 5), (None, [1.0] * 12), (700, rows[700][1])]
    got = {}
    for q in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("list", F.lit(1))).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert set(got) == set(range(0, 900, 100))
    hit = 0
    for q in got:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = sorted((d[i], i) for i in range(900) if i != q)[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        assert all(abs(m[2] - d[m[1]]) < 1e-12 for m in mine)
        hit += len({m[1] for m in mine} & {b[1] for b in best})
    assert hit >= 0.9 * 10 * len(got)
    assert [m[1] for m in sorted(got[100])] == list(range(101, 111))
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [tuple(f) for f in few] == [(0, 1, 1, 1.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).isEmpty()


def test_neighbours_of_outliers(spark):
    """A query that is a centroid of its own, far from all others, gets its neighbours."""
    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(size=(600, 8))
    x[0] *= 500
    x[100] = 40
    docs = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for q in ann.nearest(docs, list_size=1).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"]))
    for q in range(0, 600, 100):
        assert [m[0] for m in sorted(got[q])] == list(range(1, 11))
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = {i for _, i in sorted((d[i], i) for i in range(600) if i != q)[:10]}
        assert len(best & {m[1] for m in got[q]}) >= 8


def accuracy(spark, run, truth, pick, right):
    rows = run.join(truth, "doc_id").collect()
    mine = [r for r in rows if pick(r)]
    return sum(right(r) for r in mine) / max(1, len(mine)), len(mine)


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    acc, n = accuracy(spark, language_id.identify(d), d.select("doc_id", "lang"), lambda r: r["held_out"], lambda r: r["lang_pred"] == r["lang"])
    assert n > 150 and acc > 0.97
    odd = spark.createDataFrame([(1, "the and of to in", "en"), (3, "der die und das", "de"), (None, "der die", None), (5, None, "de"), (6, "", "de"), (7, "12 34 !", "en"), (8, "the " * 40000, None)], "doc_id bigint, text string, lang string").withColumn("held_out", F.lit(9))
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in language_id.identify(odd).collect()))
    assert [g[0] for g in got] == [0, 1, 3, 5, 6, 7, 8] and [g[1] for g in got[3:6]] == ["und"] * 3
    assert language_id.identify(odd.limit(0)).isEmpty()
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_byte_network_tables_are_the_convolution():
    import numpy as np

    net = language_id.ByteCNN(3)
    x = np.random.default_rng(0).integers(0, 256, (2, language_id.WINDOW)).astype(np.uint8)
    p, emb = net.p, net.p["e"][x]
    pooled = [np.concatenate([emb[:, k : language_id.WINDOW - w + 1 + k] for k in range(w)], 2) @ p[f"w{w}"] for w in language_id.WIDTHS]
    h = np.maximum(np.concatenate([z.max(1) + p[f"b{w}"] for z, w in zip(pooled, language_id.WIDTHS)], 1), 0)
    s = np.exp(h @ p["wo"] + p["bo"])
    assert np.allclose(net.predict(x, net.tables()), s / s.sum(1, keepdims=True), atol=1e-5)


def test_toxicity(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = random.Random(5)
    bad = ["idiot", "worthless", "moron"]
    rows = [(i, " ".join(words(r, 60, 300)[:50] + ([r.choice(bad)] * 2 if i % 2 else []) + words(r, 40, 300)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(1, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    mine = [(g["predicted"], g["doc_id"] % 2) for g in got if g["held_out"]]
    assert len(mine) > 60 and sum(a == b for a, b in mine) / len(mine) > 0.8
    edge = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "word"), (4, "idiot " * 30000), (4, "idiot " * 30000)], "doc_id bigint, text string")
    out = toxicity.toxicity(edge, lab.limit(0)).collect()
    assert len(out) == 6 and all(o["score"] == 0 and o["predicted"] == 0 for o in out)
    assert toxicity.toxicity(d.limit(0), labels).isEmpty()


def test_network_gradients():
    import numpy as np

    net = toxicity.BiGRU({"a": 2, "b": 3})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(2)
    ids, forms = r.integers(0, 4, (5, 3)), r.integers(0, 6, (5, 3))
    lists = [[]] + [list(r.integers(1, 9, n)) for n in (1, 3, 4, 2, 30)]
    grams = (np.concatenate(lists).astype(int), np.cumsum([0, *map(len, lists)]))
    real, y = np.ones((5, 3), bool), np.array([1.0, 0.0, 1.0])

    def loss():
        sums = np.stack([net.p["ce"][x].sum(0) / max(1, len(x)) ** 0.5 if x else np.zeros(toxicity.CHAR_DIM) for x in lists])
        e = np.concatenate([net.p["we"][ids], sums[forms]], 2)
        hs = np.concatenate([net.run(e @ net.p[f"x{k}"] + net.p[f"b{k}"], k) for k in "fb"], 2)
        z = net.head(hs, real)[3]
        return np.mean(np.logaddexp(0, z) - y * z)

    base = {k: v.copy() for k, v in net.p.items()}
    net.step(ids, forms, grams, real, y, 0.0)
    for k in ("uf", "xb", "wa", "va", "wo", "we", "bb", "ce"):
        i = tuple(r.integers(0, n) for n in base[k].shape)
        if k in ("we", "ce"):
            i = (ids[0, 0] if k == "we" else grams[0][0], 1)
        eps = 1e-3
        net.p = {q: v.copy() for q, v in base.items()}
        net.p[k][i] += eps
        up = loss()
        net.p[k][i] -= 2 * eps
        assert (up - loss()) / (2 * eps) == pytest.approx(net.m[k][i] / 0.1, rel=0.05, abs=2e-4)


def test_quality(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(d).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["accepted"] for r in good) / len(good) > 0.97 and sum(not r["accepted"] for r in bad) / len(bad) > 0.8
    edge = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (None, "A plain sentence stands here. It is fine."), (4, "x " * 50000), (4, "x " * 50000)], "doc_id bigint, text string").withColumn("weak", F.lit(1))
    out = quality.quality(edge).collect()
    assert len(out) == 6 and [o["accepted"] for o in out if o["doc_id"] in (1, 2, 3)] == [False] * 3
    assert quality.accepted(edge).columns == edge.columns and quality.quality(edge.limit(0)).isEmpty() and quality.accepted(edge.limit(0)).isEmpty()


def test_labeller_accuracies():
    """EM finds how often labellers err from their votes alone."""
    import numpy as np

    r = np.random.default_rng(3)
    y = r.random(4000) < 0.8
    votes = np.stack([np.where(r.random(4000) < e, -1, 1) * np.where(y, 1, -1) for e in (0.05, 0.1, 0.2, 0.3)], 1)
    u, n = np.unique(votes, axis=0, return_counts=True)
    prior, table = quality.fit_labellers(u, n.astype(float))
    assert abs(prior - 0.8) < 0.05
    assert np.allclose(table[:, 1, 0], [0.05, 0.1, 0.2, 0.3], atol=0.05)
