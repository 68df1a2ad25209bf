import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lociloom.llm import gam, neighbours


def auc(s, y):
    s, y = np.asarray(s), np.asarray(y)
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


def test_tables_learn_single_features_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 3))
    y = (rng.random(6000) < 1 / (1 + np.exp(-(2 * np.sin(2 * x[:, 0]) + 3 * np.sign(x[:, 1] * x[:, 2]))))).astype(float)
    m = gam.fit_matrix(x[:4000], y[:4000])
    assert (1, 2) in [(i, j) for i, j, _ in m.pairs]
    assert auc(m.score(x[4000:]), y[4000:]) > 0.88
    q = m.score(x[4000:])
    assert abs(q.mean() - y[4000:].mean()) < 0.04
    b = m.bins(x[4000:4010])  # the score is the sum of lookups, nothing else
    total = [m.intercept + sum(t[b[r, j]] for j, t in enumerate(m.tables)) + sum(t[b[r, i], b[r, j]] for i, j, t in m.pairs) for r in range(10)]
    assert np.allclose(1 / (1 + np.exp(-np.array(total))), q[:10])


def test_quality_on_held_out(spark, tables):
    from lociloom.llm.queries import op3_quality

    got = op3_quality(spark, "/root/testdata/sf0.01").where("held_out").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    assert auc(got.score, got.quality) > 0.97 and (got.predicted == got.quality).mean() > 0.95
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def plain_boosting(x, y, rounds=150, rate=0.15, n_pairs=6):
    """The same boosting with a tree's splits found by trying all, and sums taken row by row: a function of a feature row."""
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, gam.BINS + 1)[1:-1])) for c in x.T]
    of = lambda row: [int((e <= v).sum()) for e, v in zip(bins, row)]
    b = np.array([of(r) for r in x])
    p = (y.sum() + 1) / (len(y) + 2)
    start = np.log(p / (1 - p))
    f = np.full(len(y), start)
    value = lambda g, h: g.sum() / (h.sum() + 1)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)

    def tree(j, k0, k1, g, h, depth):
        """{bin: value} for the bins from k0 up to k1."""
        here = (b[:, j] >= k0) & (b[:, j] < k1)
        best = None
        for k in range(k0 + 1, k1) if depth else ():
            low, high = here & (b[:, j] < k), here & (b[:, j] >= k)
            if h[low].sum() >= 1 and h[high].sum() >= 1:
                got = gain(g[low], h[low]) + gain(g[high], h[high])
                if best is None or got > best[0] + 1e-12:
                    best = got, k
        if best is None or best[0] <= gain(g[here], h[here]):
            return {k: value(g[here], h[here]) for k in range(k0, k1)}
        return tree(j, k0, best[1], g, h, depth - 1) | tree(j, best[1], k1, g, h, depth - 1)

    def now():
        q = 1 / (1 + np.exp(-f))
        return y - q, q * (1 - q)

    tables = [np.zeros(len(e) + 1) for e in bins]
    for _ in range(rounds):
        for j, t in enumerate(tables):
            got = tree(j, 0, len(t), *now(), 2)
            step = rate * np.array([got[k] for k in range(len(t))])
            t += step
            f += step[b[:, j]]

    def quadrants(i, j):
        g, h = now()
        best = None
        for a in range(1, len(tables[i])):
            for c in range(1, len(tables[j])):
                parts = [(b[:, i] < a) == u for u in (True, False)], [(b[:, j] < c) == u for u in (True, False)]
                cells = [m & n for m in parts[0] for n in parts[1]]
                got = sum(gain(g[m], h[m]) for m in cells)
                if best is None or got > best[0] + 1e-12:
                    best = got, a, c, [value(g[m], h[m]) for m in cells]
        return best

    both = [(i, j) for i in range(len(tables)) for j in range(i + 1, len(tables)) if len(tables[i]) > 1 and len(tables[j]) > 1]
    both = sorted(both, key=lambda ij: -quadrants(*ij)[0])[:n_pairs]
    pairs = {ij: [] for ij in both}
    for _ in range(rounds // 3):
        for i, j in both:
            _, a, c, v = quadrants(i, j)
            pairs[i, j].append((a, c, v))
            f += rate * np.array([v[2 * (r[i] >= a) + (r[j] >= c)] for r in b])

    def score(row):
        r = of(row)
        total = start + sum(t[k] for t, k in zip(tables, r)) + rate * sum(v[2 * (r[i] >= a) + (r[j] >= c)] for (i, j), steps in pairs.items() for a, c, v in steps)
        return 1 / (1 + np.exp(-total))

    return score


def test_boosting_against_plain(monkeypatch):
    monkeypatch.setattr(gam, "BINS", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4)).round(1)
    y = (rng.random(150) < 1 / (1 + np.exp(-2 * x[:, 0] - 3 * np.sign(x[:, 1] * x[:, 2])))).astype(float)
    model, plain = gam.fit_matrix(x, y, rounds=12, n_pairs=2), plain_boosting(x, y, rounds=12, n_pairs=2)
    assert np.allclose(model.score(x), [plain(r) for r in x], atol=1e-9)


def test_quality_query_against_plain(spark, data, tables, monkeypatch):
    """The query's rows, labels and remainders, with few rounds, against plain boosting on the same features."""
    from lociloom.llm.queries import op3_quality

    whole = gam.fit_matrix
    monkeypatch.setattr(gam, "BINS", 6)
    monkeypatch.setattr(gam, "fit_matrix", lambda x, y: whole(x, y, rounds=3, n_pairs=1))
    text = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    label = {r["doc_id"]: r["quality"] for r in tables["labels"].collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    ids = sorted(i for i in label if i in text)
    plain = plain_boosting(np.array([gam.features(text[i] or "") for i in ids]), np.array([label[i] for i in ids], float), rounds=3, n_pairs=1)
    got = {r["doc_id"]: r for r in op3_quality(spark, data).collect()}
    assert got.keys() == text.keys()
    for i, t in text.items():
        assert abs(got[i]["score"] - plain(gam.features(t or ""))) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_null_ids_are_not_held_out(spark, odd):
    from lociloom.llm.queries import held_out

    assert {r["held_out"] for r in odd.where("doc_id IS NULL").select(held_out(5, 0)).collect()} == {False}


def test_quality_edges(spark, tables, odd):
    model = gam.fit(tables["documents"], tables["labels"])
    got = gam.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0].asDict().keys() == {"doc_id", "text", "ids", "kept", "score", "predicted"}
    assert {r["score"] for r in gam.score(odd, gam.fit(odd, tables["labels"].limit(0))).collect()} == {0.5}
    assert gam.score(odd.limit(0), model).count() == 0
    bad = spark.createDataFrame([(1, None), (None, 1), (2, 5), (4, 1), (4, 0), (6, 1)], "doc_id long, quality int")
    assert gam.score(odd, gam.fit(odd, bad)).count() == 10


def vectors(rng, n, terms):
    rows = []
    for _ in range(n):
        t = np.array(sorted(rng.sample(range(terms), rng.randint(1, 6))))
        w = np.array([rng.choice([1.0, 2.0, 3.0]) for _ in t])
        rows.append((t, w / np.sqrt((w**2).sum())))
    return rows


@pytest.mark.parametrize("tables", [1, 11, 3000])
def test_nearest_are_exact_and_blocks_are_skipped(monkeypatch, tables):
    rng = random.Random(4)
    terms = 40
    monkeypatch.setattr(neighbours, "COMMON", tables)
    monkeypatch.setattr(neighbours, "ALIKE", 0)
    rows = vectors(rng, 3000, terms)
    index = neighbours.BlockMaxIndex(rows, terms)
    assert (len(index.table) == 0) == (tables == 1) and (len(index.place) == 0) == (tables == 3000)
    weight_of = [dict(zip(t.tolist(), w.tolist())) for t, w in rows]

    def check(t, w):
        q = dict(zip(t.tolist(), w.tolist()))
        cos = np.zeros(3000)
        for i, own in enumerate(weight_of):
            for x, y in own.items():  # one by one, in the order of terms
                cos[i] += y * q.get(x, 0.0)
        who, c, blocks = index.nearest(t, w, 25)
        least = max(np.sort(cos)[-25] - neighbours.TIE, 1e-15)
        want = sorted(np.flatnonzero(cos >= least).tolist(), key=lambda i: (-round(cos[i], 12), i))
        assert who.tolist() == want and np.allclose(c, cos[want], atol=1e-14)
        return blocks

    read = sum(check(t, w) for t, w in vectors(rng, 200, terms))
    assert read < 200 * index.blocks * 0.8
    monkeypatch.setattr(neighbours, "ALIKE", 1e9)  # all blocks at once
    assert all(check(t, w) == index.blocks for t, w in vectors(rng, 50, terms))


@pytest.mark.parametrize("operator, label", [(neighbours, "toxic"), (gam, "quality")])
def test_order_and_repeats_decide_nothing(spark, operator, label):
    """Ids with several texts, equal texts under several ids: scores are the same whatever order the rows come in and whatever ids they have."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("a b c d e bad words here".split(), k=rng.randint(0, 6))) for _ in range(60)]
    rows = [(k % 40, t) for k, t in enumerate(texts)]
    labels = spark.createDataFrame([(k, int("bad" in texts[k])) for k in range(40)], f"doc_id long, {label} int")
    got = []
    for _ in range(3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(rng.randint(1, 4))
        scored = operator.score(docs, operator.fit(docs, labels))
        got.append(sorted((r["text"], r["score"]) for r in scored.collect()))
        rng.shuffle(rows)
    assert got[0] == got[1] == got[2]


def test_votes_and_calibration():
    rng = random.Random(9)
    bags, labels = [], []
    for _ in range(600):
        bad = rng.random() < 0.3
        bags.append(neighbours.counted(" ".join([rng.choice("ab" if bad else "cd")] * rng.randint(1, 2)) if rng.random() < 0.8 else ""))
        labels.append(int(bad))
    terms = np.unique(np.concatenate([w for w, _ in bags]))
    m = neighbours.build(list(range(600)), labels, bags, terms, np.full(4, 1), 10, (420, 180))
    high, low, none = m.score("a b a"), m.score("c d"), m.score("nothing known")
    assert high[0] > 0.9 and low[0] < 0.1 and 0.15 < none[0] < 0.45 and none[1] == []
    assert len(high[1]) == 3 and all(e["label"] == 1 and 0 < e["similarity"] <= 1 for e in high[1])


def plain_toxicity(docs, labels):
    """The whole query with dense vectors and no index: scores by id. docs: (id, text); labels: (id, 0 or 1)."""
    bag = lambda x: Counter(re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", (x or "").lower()).split(" ")) - Counter({"": 10**9})
    chosen = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    examples = sorted((i, y, bag(x)) for i, x in docs if (y := chosen.get(i)) is not None)
    vocabulary = sorted({w for _, _, b in examples for w in b})
    y = np.array([e[1] for e in examples])
    has = np.array([[w in b for w in vocabulary] for _, _, b in examples])
    every = [bag(x) for _, x in docs]
    idf = np.array([np.log((1 + len(docs)) / (1 + sum(w in b for b in every))) + 1 for w in vocabulary])
    phi = np.nan_to_num(np.abs([np.corrcoef(has[:, k], y)[0, 1] if has[:, k].any() and not has[:, k].all() else 0 for k in range(len(vocabulary))]))

    def vector(b):
        v = np.array([(1 + np.log(b[w])) if w in b else 0.0 for w in vocabulary]) * idf * phi
        return v / np.sqrt((v**2).sum()) if v.any() else v

    v = np.array([vector(b) for _, _, b in examples])
    total = np.bincount([y for _, y in chosen.items()], minlength=2)
    scale, prior = total / np.maximum(np.bincount(y, minlength=2), 1), (total[1] + 0.5) / (total.sum() + 1)

    def vote(q, leave=None):
        c = v @ q
        other = np.arange(len(c)) != (-1 if leave is None else leave)
        least = np.sort(c[other])[-min(neighbours.K, other.sum())]
        near = np.flatnonzero(other & (c > 1e-9) & (c >= least - 1e-9))
        w = c[near] * scale[y[near]]
        return ((w * y[near]).sum() + prior) / (w.sum() + 1)

    own = [i for i in range(len(y)) if v[i].any()]
    x = np.array([np.log((p := vote(v[i], i)) / (1 - p)) for i in own])
    w, t = scale[y[own]], y[own]

    def loss(ab):
        z = ab[0] * x + ab[1]
        return (w * (np.logaddexp(0, z) - t * z)).sum() + 0.5 * (ab[0] - 1) ** 2 + 0.5 * ab[1] ** 2

    ab, step = np.array([1.0, 0.0]), 1.0
    while step > 1e-10:  # a pattern search, unlike the operator's Newton steps
        for d in ((step, 0), (-step, 0), (0, step), (0, -step), (step, step), (-step, -step), (step, -step), (-step, step)):
            if loss(ab + d) < loss(ab):
                ab = ab + d
                break
        else:
            step /= 2
    none = y[[i for i in range(len(y)) if not v[i].any()]]
    bare = (scale[1] * none.sum() + 0.5 * prior) / (scale[none].sum() + 0.5)
    out = {}
    for i, x in docs:
        q = vector(bag(x))
        p = np.clip(vote(q), 1e-6, 1 - 1e-6) if q.any() else None
        out[i] = 1 / (1 + np.exp(-(ab[0] * np.log(p / (1 - p)) + ab[1]))) if p is not None and (v @ q > 0).any() else bare
    return out


def test_toxicity_query_against_plain(spark, data, tables):
    from lociloom.llm.queries import op1_toxicity

    docs = [(r["doc_id"], r["text"]) for r in tables["documents"].collect()]
    want = plain_toxicity(docs, [(r["doc_id"], r["toxic"]) for r in tables["labels"].collect()])
    got = {r["doc_id"]: r for r in op1_toxicity(spark, data).collect()}
    assert got.keys() == want.keys() and all(abs(got[i]["score"] - want[i]) < 1e-5 for i in want)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_toxicity_on_held_out(spark):
    from lociloom.llm.queries import op1_toxicity

    got = op1_toxicity(spark, "/root/testdata/sf0.1").where("held_out").toPandas().merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    assert auc(got.score, got.toxic) > 0.98 and (got.predicted == got.toxic).mean() > 0.985
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_toxicity_edges(spark, tables, odd):
    model = neighbours.fit(tables["documents"], tables["labels"])
    got = neighbours.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert neighbours.score(odd.limit(0), model).count() == 0
    assert [r["score"] for r in neighbours.score(odd, neighbours.fit(odd, tables["labels"].limit(0))).collect()] == pytest.approx([0.5] * 10)
    bad = spark.createDataFrame([(1, None), (None, 1), (2, 5), (4, 1), (4, 0), (6, 1)], "doc_id long, toxic int")
    assert neighbours.score(odd, neighbours.fit(odd, bad)).count() == 10
