import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lociloom.llm import order_minhash as om
from lociloom.llm import stream_dedup as sd
from lociloom.llm import super_kmers as sk
from lociloom.llm.common import in_bitmap


def plain_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    first = {k: min(v, key=lambda d: (d is None, d or 0)) for k, v in groups.items()}
    return sorted((repr(d), repr(first[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)


def test_exact_edges_and_collisions(spark, odd):
    want = plain_exact([(r["doc_id"], r["text"]) for r in odd.collect()])
    for digest in (sd.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")):
        got = sd.exact_dedup(odd, digest=digest).collect()
        assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert sd.exact_dedup(odd.limit(0)).count() == 0


def test_exact_state_goes_on(spark, tmp_path):
    docs = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    state = str(tmp_path / "state")
    sd.exact_dedup(docs((5, "a b"), (6, "c")), state=state)
    sd.exact_dedup(docs((7, "a  b"), (8, "d"), (9, "a b")), state=state, files_per_batch=1)
    got = {r["first"]["doc_id"]: r["n"] for r in sd.read_state(spark, f"{state}/state", str(tmp_path / "index")).collect()}
    assert got == {5: 3, 6: 1, 8: 1}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none") == "none" or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_exact_state_over_calls_compares_bytes(spark, tmp_path):
    """Earlier texts are read again from where they lie; equal digests of unlike texts are told apart, whenever these came."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "a  b", "c", "d", "", None, "e f"])) for i in range(60)]
    rng.shuffle(rows)
    for digest, label in ((sd.sha256, "sha"), (lambda c: F.length(c).cast("string"), "length"), (lambda c: F.lit("same"), "same")):
        seen, state = [], str(tmp_path / label)
        for k in range(0, 60, 20):
            part = rows[k : k + 20]
            docs = spark.createDataFrame(part, "doc_id long, text string")
            if k == 20:  # of files that the caller keeps; the others go below the state folder
                docs.write.parquet(f"{state}-given")
                docs = spark.read.parquet(f"{state}-given")
            seen += part
            want = [x for x in plain_exact(seen) if x[0] in {repr(d) for d, _ in part}]
            for _ in range(2):  # the second time as after a failure
                got = sd.exact_dedup(docs, state=state, digest=digest, batch=f"b{k}").collect()
                assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
                assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_rows_of_files(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    assert sd.of_files(d) and sd.of_files(d.where("doc_id > 0").drop("x")) and not sd.of_files(spark.range(3)) and not sd.of_files(d.union(d)) and not sd.of_files(d.join(d.select("doc_id"), "doc_id"))
    assert sd.exact_dedup(d.union(d)).where("kept").count() == 1


def test_columns_of_any_name(spark, tmp_path):
    """Columns that are called like Spark's metadata, this library's helpers or outputs in another case."""
    rows = [(1, "the same text of some words here", 1, "x", 7, 8, 9.0, 5), (2, "the same text of some words here", 2, "y", 7, 8, 9.0, 5), (3, "other", 3, "z", 7, 8, 9.0, 5)]
    path = str(tmp_path / "odd")
    spark.createDataFrame(rows, "doc_id long, text string, _metadata long, _FILE string, _gone_file long, _gone_row long, N_Words double, _at0 long").write.parquet(path)
    d = spark.read.parquet(path)
    assert sd.of_files(d)
    for out in (sd.drop_copies(d), om.drop_near(d)):
        assert out.columns == d.columns and sorted(r["_metadata"] for r in out.collect()) == [1, 3]
    out = sk.without_repeats(d)
    assert {r["doc_id"]: (r["_metadata"], r["n_words"]) for r in out.collect()} == {1: (1, 7), 2: (2, 7), 3: (3, 1)}
    assert out.columns == [c for c in d.columns if c not in ("text", "N_Words")] + ["text", "n_words", "n_removed"]


def test_drop_copies(spark, odd):
    left = sd.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == len({x[3] for x in plain_exact([(r["doc_id"], r["text"]) for r in odd.collect()])})


def test_bitmap_lets_all_wanted_through(spark):
    rows, wanted = spark.range(20_000), spark.range(0, 20_000, 100)
    got = {r["id"] for r in in_bitmap(rows, F.col("id"), wanted, F.col("id")).collect()}
    assert set(range(0, 20_000, 100)) <= got and len(got) < 300


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(d[j - 1] if x == y else 1 + min(d[j], new[-1]))
        d = new
    return d[-1]


def test_banded_alignment_against_plain():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randint(0, 5) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.3:
            b = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        want, most = plain_distance(a, b), rng.randint(0, 25)
        assert om.aligned_within(np.array(a, np.uint64), np.array(b, np.uint64), most) == (want if want <= most else None)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k, kind = rng.randrange(len(out)), rng.random()
        out[k : k + 1] = [f"e{rng.randrange(10**6)}"] if kind < 0.6 else [] if kind < 0.8 else [out[k], f"e{rng.randrange(10**6)}"]
    return out


def plain_groups(texts):
    s = [om.shingles(t) for t in texts]
    group = list(range(len(s)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            same = texts[i].split() == texts[j].split()
            if same or len(s[i]) and len(s[j]) and 9 * plain_distance(s[i].tolist(), s[j].tolist()) <= len(s[i]) + len(s[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(s))]


def test_near_groups_against_plain(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 70))]
        texts += [" ".join(base), "  ".join(base), *(" ".join(edited(rng, base, rng.randint(1, 4))) for _ in range(4))]
    texts += ["", " ", "one two", "one two", "one two three"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    want = plain_groups([texts[i] for i in order])
    got = om.near_dedup(spark.createDataFrame([(k, texts[i]) for k, i in enumerate(order)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == dict(enumerate(want))
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in got)


def test_large_family_of_variants(spark, monkeypatch):
    """Many variants of one text, most of them too far from each other and some from the first; also with buckets dealt anew."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = [" ".join(edited(rng, base, 2)), *(" ".join(edited(rng, base, rng.randint(1, 3))) for _ in range(60)), " ".join(base)]
    want = dict(enumerate(plain_groups(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in om.near_dedup(docs).collect()} == want
    monkeypatch.setattr(om, "OUTSIDE", 2)
    assert {r["doc_id"]: r["group_id"] for r in om.near_dedup(docs).collect()} == want


def pairs_and_groups(spark, sketch, pairs=8, head=False):
    """Links found and wanted of documents 2i and 2i + 1 that are near copies, unlike all others, with sketches made up by an expression of id and j.

    With head, each pair has a third document with its sketches (a negative id, so the first of all their buckets) that is unlike both.
    """
    rng = random.Random(13)
    texts = []
    for _ in range(pairs):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(base), " ".join([*base[:58], "x", "y"])]
    rows = list(enumerate(texts)) + [(2 * i - 2 * pairs, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(pairs if head else 0)]
    docs = om.filed(spark.createDataFrame(rows, "doc_id long, text string"))
    base = om.shared_dir(spark, "near")
    cls = om.classes(docs, base)[1].withColumn("id", F.when(F.col("first.doc_id") < 0, F.col("first.doc_id") + 2 * pairs).otherwise(F.col("first.doc_id"))).withColumn("sketch", F.expr(f"transform(sequence(0, {om.SKETCHES - 1}), j -> {sketch})")).drop("id")
    id_of = {r["v"]: r["first"]["doc_id"] for r in cls.collect()}
    assert len(id_of) == len(rows)
    return {frozenset((id_of[r["a"]], id_of[r["b"]])) for r in om.links(docs, cls, base).collect()}, {frozenset((2 * i, 2 * i + 1)) for i in range(pairs)}


def test_buckets_of_any_size_are_searched(spark, monkeypatch):
    monkeypatch.setattr(om, "OUTSIDE", 2)
    got, want = pairs_and_groups(spark, "if(j < 4, 7L, xxhash64(id, j))")
    assert got == want


def test_first_common_bucket_may_be_hot(spark, monkeypatch):
    monkeypatch.setattr(om, "OUTSIDE", 2)
    got, want = pairs_and_groups(spark, "if(j = 0, 7L, if(j in (5, 9, 14), xxhash64(id div 2, j), xxhash64(id, j)))", head=True)
    assert got == want


def test_one_common_sketch_is_enough(spark):
    got, want = pairs_and_groups(spark, "if(j = 0, xxhash64(id div 2), xxhash64(id, j))", head=True)
    assert got == want


def test_parities_never_say_more_than_the_distance():
    rng = random.Random(3)
    for n in (9, 40, 700):
        a = [f"w{rng.randrange(50)}" for _ in range(n)]
        x, y = (om.shingles(" ".join(w)) for w in (a, edited(rng, a, 3)))
        assert np.bitwise_count(om.parities(x) ^ om.parities(y)).sum() <= plain_distance(x.tolist(), y.tolist())


def test_order_matters():
    a = [f"w{i}" for i in range(60)]
    turned = a[30:] + a[:30]
    assert om.linked(om.shingles(" ".join(a)), om.shingles(" ".join(a[:59])))
    assert not om.linked(om.shingles(" ".join(a)), om.shingles(" ".join(turned)))
    x, y = om.sketch(om.shingles(" ".join(a))), om.sketch(om.shingles(" ".join(turned)))
    assert (x == om.sketch(om.shingles(" ".join(a)))).all() and (x == y).mean() < 0.8


def test_near_edges(spark, odd):
    got = om.near_dedup(odd).collect()
    assert len(got) == 10 and sum(r["kept"] for r in got) == len({(r["group_id"], r["group_size"]) for r in got})
    assert om.drop_near(odd).columns == odd.columns and om.near_dedup(odd.limit(0)).count() == 0


def plain_passages(rows):
    docs = [(float("inf") if d is None else d, (t or "").encode().split()) for d, t in rows]
    owner = {}
    for d, w in docs:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            owner[k] = min(owner.get(k, d), d)
    out = []
    for (d, w), (name, _) in zip(docs, rows):
        gone = set()
        for i in range(len(w) - 49):
            if owner[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((repr(name), len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out)


def passages(rng):
    shared = [[f"s{k}_{i}" for i in range(rng.randint(45, 90))] for k in range(4)]
    rows = []
    for d in range(60):
        w = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 80))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            a = rng.randint(0, 5)
            k = rng.randint(0, len(w))
            w[k:k] = s[a:]
        rows.append((d, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(100, "x " * 300), (101, "x " * 120), (102, rows[5][1]), (None, rows[7][1]), (None, rows[7][1]), (7, rows[8][1]), (103, None), (104, "")]
    return rows


def test_passages_against_plain(spark):
    rows = passages(random.Random(21))
    want = plain_passages(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    show = lambda df: sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())
    assert show(sk.without_repeats(docs, digest=True)) == want
    assert sum(x[2] for x in want) > 500


def test_hot_minimisers_give_the_same(spark, monkeypatch):
    rows = passages(random.Random(22))
    docs = sk.filed(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = lambda hot: sorted((r["_file"], r["_row"], sk._mask(5000, r["spans"]).tobytes()) for r in sk.removed(docs, hot).collect())
    plain = spans(1 << 20)
    assert plain == spans(0) == spans(3000) and len(plain) > 10
    monkeypatch.setattr(sk, "AT_ONCE", 7)
    assert spans(0) == plain
    monkeypatch.setattr(sk, "window_hashes", lambda words: np.full(len(words) - sk.WINDOW + 1, 7, np.uint64))  # all windows meet
    assert spans(1 << 20) == plain


def test_a_bucket_of_one_word_alone():
    """A million equal windows take little time and memory."""
    import time
    import tracemalloc

    group = [(b"a", 1, 1, "w " * 400_000 + "w"), (b"b", 2, 2, "w " * 300_000 + "v")]
    tracemalloc.start()
    began = time.time()
    got = dict(sk.owners_in_bucket(group))
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"a" not in got and got[b"b"] == [{"start": 0, "end": 299_951, "owner": 1}] and took < 30 and peak < 150 << 20


def test_super_kmers_cover_all_windows():
    rng = random.Random(1)
    w = [b"w%d" % rng.randrange(300) for _ in range(400)]
    mini, first, end = sk.super_kmers(w)
    assert first[0] == 0 and end[-1] == 351 and (first[1:] == end[:-1]).all() and (mini[1:] != mini[:-1]).all()
    again = sk.super_kmers(w[37:120])
    assert again[0][0] in mini and len(sk.super_kmers(w[:49])[0]) == 0


def test_passage_edges(spark, odd):
    out = sk.without_repeats(odd)
    assert out.columns == ["doc_id", "score", "ids", "kept", "text", "n_words", "n_removed"] and out.count() == 10
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[4]["n_removed"] == 0 and rows[5]["n_removed"] == rows[5]["n_words"] == 60_000 and rows[5]["text"] == ""
    assert sk.without_repeats(odd.limit(0)).count() == 0


def test_names_that_clash(spark, odd):
    names = ["_file", "_row", "spans", "digest", "v", "n", "first", "label", "_at0", "bucket", "hashes", "seq", "item_id", "_page"]
    df = odd
    for n in names:
        df = df.withColumn(n, F.lit(n))
    for f in (sd.drop_copies, om.drop_near):
        left = f(df)
        assert left.columns == df.columns and left.count() == f(odd).count()
        assert {tuple(r) for r in left.select(*[f"`{n}`" for n in names]).distinct().collect()} == {tuple(names)}
    assert sk.without_repeats(df).count() == sd.exact_dedup(df).count() == om.near_dedup(df).count() == 10
