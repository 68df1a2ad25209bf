"""The pipeline against a brute-force version of its stages, one after the other."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece

from lociloom.llm import gam
from lociloom.llm import order_minhash as om


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def plain_distance(a, b):
    """Insertions and deletions between two arrays, by the whole table, a row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row = np.maximum.accumulate(np.maximum(row, np.concatenate([[0], row[:-1] + (b == x)])))
    return len(a) + len(b) - 2 * int(row[-1])


def plain_near(rows):
    """Keeps the first document of each component of near copies; all pairs that share a shingle are aligned in full."""
    s = [om.shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    first = {}
    for i, (_, t) in enumerate(rows):
        group[i] = first.setdefault(" ".join(norm(t).split()), i)
    by: dict = {}
    for i, x in enumerate(s):
        for h in set(x.tolist()):
            by.setdefault(h, []).append(i)
    for i, j in {(i, j) for v in by.values() for i in v for j in v if i < j}:
        if abs(len(s[i]) - len(s[j])) * 9 <= len(s[i]) + len(s[j]) and len(np.intersect1d(s[i], s[j])) > 0.5 * min(len(set(s[i].tolist())), len(set(s[j].tolist()))):
            if 9 * plain_distance(s[i], s[j]) <= len(s[i]) + len(s[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [r for i, r in enumerate(rows) if top(i) == i]


def plain_words(t):
    return re.sub(r"[\W_]+", " ", t).strip().split(" ")


def test_pipeline(spark, data, tables):
    model = gam.fit(tables["documents"], tables["labels"])
    rows = sorted((r["doc_id"], r["text"]) for r in tables["documents"].collect())
    score = model.score(gam.matrix([t for _, t in rows]))
    rows = [r for r, s in zip(rows, score) if s >= 0.7]
    seen, once = set(), []
    for d, t in rows:
        if norm(t) not in seen:
            once.append((d, t))
            seen.add(norm(t))
    near = plain_near(once)
    items = [plain_words(r["text"]) for r in tables["benchmark"].collect()]
    text_of = {d: " " + " ".join(plain_words(t)) + " " for d, t in near}
    half = [[" " + " ".join(w[k : k + -(-len(w) // 2)]) + " " for k in range(len(w) // 2 + 1)] for w in items]
    clean = [(d, t) for d, t in near if not any(p in text_of[d] for ps in half for p in ps)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: np.array(sp.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for d, t in clean}
    got = {r["doc_id"]: (bytes(r["ids"]), r["n_tokens"], r["same_text"]) for r in corpus_pipeline.run(spark, data).collect()}
    assert {d: x[0] for d, x in got.items()} == want
    assert all(len(x[0]) == 4 * x[1] and x[2] for x in got.values())
    assert len(tables["documents"].columns) == 5 and 0 < len(got) < len(rows) <= 200


def test_stages_keep_columns_and_odd_rows(spark, data, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, data)
        assert out.columns == odd.columns, name
        assert out.exceptAll(odd).isEmpty(), name
        assert out.count() <= 10 and stage(spark, odd.limit(0), data).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).count() == 10
