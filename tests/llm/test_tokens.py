import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lociloom.llm import chat_tree as ct
from lociloom.llm import kneser_ney as kn
from lociloom.llm import prefix_table as pt
from lociloom.llm import wavelet as wv

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCRAPS = [
    "a", "b", " ", "  ", "the", "ing", "\n", "é", "中", "\U0001f600", "▁", ".", ",", "(", "1", "22", "def", "\t", "<s>", "</s>", "ﬁ", "tion", "\x00", "<0x0A>", "​", "é", "==", "----", "    ", "<|endoftext|>", "<|EndOfText|>",
    "it's", "'S", "J̌", "İ", "İ", "Σ", "\x85", "\xa0", "\x1c", "가", "가", "²", "naïve", "Straße", "!!", "$$$", ".**", "garçon,", "ŉ", "ǆ", "ſ",
]


def scraps(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(SCRAPS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_pieces_equal_the_library(tables):
    table, sp = pt.PrefixTable(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = scraps(1, 4000, 40) + [r["text"] for r in tables["documents"].collect()] + ["", "x" * 3000, " " * 2000, "ab" * 2000]
    assert [np.frombuffer(table.packed(t), "<u4").tolist() for t in texts] == sp.encode(texts, add_bos=True, add_eos=True)
    assert table.decode([table.packed(t) for t in texts]) == [sp.decode(sp.encode(t, add_bos=True, add_eos=True)) for t in texts]


def test_pairs_and_prefixes():
    table = pt.PrefixTable(PIECES)
    rng = random.Random(3)
    ids = list(table.halves)
    assert table.fits == table.fits_by_spines
    for a, b in [(rng.choice(ids), rng.choice(ids)) for _ in range(4000)]:
        assert table.fits_by_spines(a, b) == table.fits_by_merging(a, b)
    for s in ("▁international", "▁thethe", "▁tion中x"):  # each prefix has one last token, whatever follows
        assert all(table.part(s[:k]) == [x for p in table.merged(s[:k])[0] for x in ([p] if p >= 0 else [table.bytes_at[f"<0x{y:02X}>"] for y in chr(-1 - p).encode()])] for k in range(1, len(s) + 1))


def test_piece_query_against_the_library(spark, data, tables):
    from lociloom.llm.queries import op4_sentencepiece

    sp, sha = sentencepiece.SentencePieceProcessor(model_file=PIECES), lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for r in tables["documents"].collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"]] = len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op4_sentencepiece(spark, data).collect()} == want


def test_what_a_worker_keeps():
    from lociloom.llm.common import Memory, _held, held

    calls = []
    memory = Memory(lambda k: calls.append(k) or -k, 4)
    assert [memory[k] for k in (1, 2, 3, 1, 1, 4, 1, 5, 1, 6)] == [-1, -2, -3, -1, -1, -4, -1, -5, -1, -6]
    assert calls == [1, 2, 3, 4, 5, 6] and len(memory) + len(memory.old) <= 4  # 1 is asked for again and again, and stays
    one = held(("a",), list)
    assert held(("a",), list) is one and held(("b",), dict) == {} and list(_held) == [("b",)]


def test_memory_that_is_too_small():
    table = pt.PrefixTable(PIECES, memory=3)
    whole = pt.PrefixTable(PIECES)
    assert all(table.packed(t) == whole.packed(t) for t in scraps(2, 200, 30))


def test_encode_edges(spark, odd):
    out = pt.encode(odd, PIECES)
    assert set(out.columns) == {"doc_id", "text", "score", "kept", "ids", "decoded"} and out.count() == 10
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r["decoded"] == sp.decode(sp.encode(r["text"] or "", add_bos=True, add_eos=True)) for r in out.collect())
    assert pt.encode(odd.limit(0), PIECES).count() == 0


def test_words_equal_the_library(tables):
    memory = wv.WordMemory(WORDS, 1)
    texts = scraps(5, 6000, 30) + [r["text"] for r in tables["documents"].collect()]
    want = [e.ids + [1] for e in memory.encoder.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(memory.packed(t), "<u4").tolist() for t in texts] == want
    small = wv.WordMemory(WORDS, 1, memory=3)
    assert all(small.packed(t) == memory.packed(t) for t in texts[:300])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    memory = wv.WordMemory(public_tokenizers.path(name), 1)
    texts = scraps(8, 300, 20) + ["Two  Words\n and More"]
    assert memory.by_word == (name == "word_bpe_49k.json")
    assert [np.frombuffer(memory.packed(t), "<u4").tolist() for t in texts] == [e.ids + [1] for e in memory.encoder.encode_batch(texts, add_special_tokens=False)]


def test_shard_query_against_the_library(spark, data, tables):
    from tokenizers import Tokenizer

    from lociloom.llm.queries import op10_token_shards

    t, at, want = Tokenizer.from_file(WORDS), 0, []
    for r in sorted(tables["documents"].collect(), key=lambda r: r["doc_id"]):
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in op10_token_shards(spark, data).collect()) == want


def test_one_token_unpacks_a_block_of_each_plane():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 400_000) % 40_000).astype(np.uint32)
    s = wv.Shard(wv.Shard.pack([1], [ids]))
    planes = s.matrix.planes
    assert len(planes) > 12 and all(len(p.at) - 1 == 13 for p in planes)
    assert s.token(271_828) == ids[271_828] and all(p.unpacked == 1 for p in planes)
    assert s.count(int(ids[5]), 0, 400_000) == int((ids == ids[5]).sum()) and all(p.unpacked <= 3 for p in planes)


def test_a_block_that_packs_to_its_own_length():
    """Some short last blocks are as long when compressed as they are: readers take what has that length for the plain bits."""
    rng = np.random.default_rng(3)
    press = wv.zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
    same = 0
    for n in range(200, 2000, 3):
        bits = rng.random(n) < 0.06
        raw = np.packbits(bits, bitorder="little").tobytes()
        same += len(press(raw)) == len(raw)
        assert (wv.Plane.pack(bits).bits() == bits).all()
    assert same


@pytest.mark.parametrize("n,kinds", [(1, 1), (7, 1), (513, 2), (5000, 37), (4096, 300), (32_768, 5), (70_001, 900)])
def test_shard_answers_from_its_file(tmp_path, n, kinds):
    rng = np.random.default_rng(n)
    ids = (np.minimum(rng.zipf(1.4, n), kinds) * 137 % 49_000).astype(np.uint32)
    cut = sorted(rng.integers(0, n + 1, 4).tolist())
    docs = [ids[a:b] for a, b in zip([0, *cut], [*cut, n])]
    (tmp_path / "s.wm").write_bytes(wv.Shard.pack([1, 2, None, 4, 5], docs))
    s = wv.Shard((tmp_path / "s.wm").read_bytes())
    assert (s.tokens() == ids).all() and len(s) == n and [len(d) for d in docs] == s.lengths.tolist() and s.none.tolist() == [0, 0, 1, 0, 0]
    pick = random.Random(n)
    assert all(s.token(i) == ids[i] for i in pick.choices(range(n), k=60))
    for t in [*map(int, ids[:5]), 48_999, 3]:
        lo, hi = sorted((pick.randint(0, n), pick.randint(0, n)))
        assert s.count(t, lo, hi) == int((ids[lo:hi] == t).sum()) and list(s.occurrences(t, lo, hi)) == (lo + np.flatnonzero(ids[lo:hi] == t)).tolist()
    assert (s.document(1) == docs[1]).all()
    with pytest.raises(ValueError):
        wv.Shard((tmp_path / "s.wm").read_bytes()[:-1])


def test_shards_in_order(spark, odd, tables):
    docs = tables["documents"].select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id IS NULL OR text IS NULL"))
    manifest = wv.write(docs, WORDS, shard_tokens=20_000)
    got = sorted(map(tuple, wv.read(manifest).collect()), key=lambda r: r[1])
    assert manifest.count() > 3 and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda d: (d is not None, d or 0))
    memory = wv.WordMemory(WORDS, 1)
    want = sorted((repr(r["doc_id"]), zlib.crc32(memory.packed(r["text"] or ""))) for r in docs.collect())
    assert sorted((repr(r[0]), r[3]) for r in got) == want
    assert wv.read(wv.write(odd.limit(0), WORDS)).count() == 0 and wv.read(wv.write(odd, WORDS)).count() == 10


def plain_kneser_ney(train):
    """A function of a text: its scores and counts straight from the formulas, with dictionaries."""
    from collections import Counter, defaultdict
    from functools import cache

    toks = lambda t: t.encode().lower().split() + [None]
    uni, bi = Counter(), Counter()
    for t in train:
        w = toks(t)
        uni.update(w)
        bi.update(zip(["begin", *w[:-1]], w))
    follow, before = defaultdict(Counter), Counter()
    for (h, w), c in bi.items():
        follow[h][w] = c
        before[w] += 1
    d = kn.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    d1 = kn.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0.0
    v, ways, total = len(uni), len(bi), sum(uni.values())
    spread = sum(cut(c, d1) for c in before.values())

    @cache
    def left(h):
        return (sum(follow[h].values()), sum(cut(x, d) for x in follow[h].values())) if h in follow else (0, 0)

    def p1(w):
        return (before[w] - cut(before[w], d1)) / ways + spread / ways / (v + 1) if ways else 1 / (v + 1)

    def p(h, w):
        n, rest = left(h)
        if not n:
            return p1(w)
        c = follow[h][w] if w in follow[h] else 0
        return (c - cut(c, d)) / n + rest / n * p1(w)

    def score(text):
        w = toks(text)
        base = sum(np.log10((uni[x] + 1) / (total + v + 1)) for x in w)
        return sum(np.log10(p(h, x)) for h, x in zip(["begin", *w[:-1]], w)), base, sum(uni[x] > 0 for x in w), p, uni

    return score


def test_kneser_ney_against_plain(spark):
    rng = random.Random(4)
    draw = lambda: " ".join(rng.choice(["the", "The", "a", "of", "x1", "x2", "x3", "é", "rare%d" % rng.randrange(60)]) for _ in range(rng.randint(0, 25)))
    train = [draw() for _ in range(80)] + ["the the the"] * 5
    tests = [draw() for _ in range(20)] + ["", "never seen words", "the unseen a"]
    model = kn.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(5))
    got = model.score(tests)
    plain = plain_kneser_ney(train)
    for i, t in enumerate(tests):
        score, base, known, p, uni = plain(t)
        assert got["score"][i] == pytest.approx(score) and got["base_score"][i] == pytest.approx(base) and got["n_known"][i] == known and got["n_tokens"][i] == len(t.split()) + 1
    words = [*uni, b"unknown"]
    assert all(sum(p(h, w) for w in words) == pytest.approx(1) for h in ["begin", b"the", b"of", b"unknown"])
    assert set(got["train_tokens"].tolist()) == {sum(uni.values())}


def test_kneser_ney_edges(spark, odd):
    model = kn.train(odd)
    out = kn.score(odd, model).collect()
    assert len(out) == 10 and all(np.isfinite(r["score"]) and r["score"] <= 0 and r["n_tokens"] >= 1 for r in out)
    assert kn.score(odd.limit(0), model).count() == 0
    none = kn.score(odd, kn.train(odd.limit(0))).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in none} == {(0, 0, 0.0, 0.0)}


def test_language_model_query_against_plain(spark, data, tables, monkeypatch):
    from lociloom.llm.queries import op6_language_model

    rows = [(r["doc_id"], r["text"] or "") for r in tables["documents"].collect()]
    plain = plain_kneser_ney([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    for size in (kn.RANGE_BYTES, 1 << 13):  # also by many ranges of keys
        monkeypatch.setattr(kn, "RANGE_BYTES", size)
        got = {r["doc_id"]: r for r in op6_language_model(spark, data).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            score, base, known, _, uni = plain(t)
            r = got[i]
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t.encode().split()) + 1, known, sum(uni.values()))
            assert r["score"] == pytest.approx(score) and r["base_score"] == pytest.approx(base)


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    from lociloom.llm.queries import op6_language_model

    got = op6_language_model(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_escaping_comes_back():
    rng = random.Random(7)
    bits = ["\\", "<", "|", ">", "<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "a", "\n", "<|turn|>", "<|text|>", "<|end|>", "[", "]"]
    for _ in range(3000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        e = ct.escape(s)
        assert ct.unescape(e) == s and "<|" not in e and "</s>" not in e and "[INST]" not in e and "<s>" not in e
    for _ in range(300):
        turns = [("".join(rng.choice(bits) for _ in range(2)), "".join(rng.choice(bits) for _ in range(5))) for _ in range(rng.randint(0, 4))]
        assert ct.parse("".join(ct.TURN + ct.escape(r) + ct.TEXT + ct.escape(t) + ct.END for r, t in turns)) == turns


def chats(rng):
    rows = []
    for c in range(60):
        first = rng.choice(["hello", "hello", "hi there"])
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else rng.choice(["a", "b", "c"])))
    return rows


def test_trees_share_turns_and_attend_to_ancestors(spark):
    rows = chats(random.Random(2))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    shards = [r.asDict(recursive=True) for r in ct.format_trees(df.coalesce(1)).collect()]
    conv = {}
    for c, _, role, text in sorted(rows):
        conv.setdefault(c, []).append((role, text))
    seen = {}
    for s in shards:
        for c, whole, loss in ct.conversations(s):
            assert ct.parse(whole) == conv[c] and loss == [t for r, t in conv[c] if r == "assistant"]
            seen[c] = True
        nodes = s["nodes"]
        paths = []
        for k, x in enumerate(nodes):
            above = [] if x["parent"] < 0 else paths[x["parent"]] + [x["parent"]]
            paths.append(above)
            own = {i for a in x["attends"] for i in range(a["start"], a["end"])}
            assert own == {i for p in above for i in range(nodes[p]["start"], nodes[p]["end"])} and x["position"] == len(own)
        texts = [tuple(s["text"][nodes[p]["start"] : nodes[p]["end"]] for p in [*paths[k], k]) for k in range(len(nodes))]
        assert len(texts) == len(set(texts))  # no shared turn is emitted twice
        assert [x["start"] for x in nodes] == [0, *(x["end"] for x in nodes)][:-1]
    assert sorted(seen) == sorted(conv)


def test_tree_tokens(spark):
    df = spark.createDataFrame(chats(random.Random(3)), "conv_id long, turn long, role string, text string")
    for s in (r.asDict(recursive=True) for r in ct.format_trees(df, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), shard_units=200).collect()):
        assert len(s["ids"]) == s["nodes"][-1]["end"] and all(x["start"] <= x["loss_start"] <= x["loss_end"] <= x["end"] for x in s["nodes"])


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "y"), (None, 1, "user", "y"), (2, 0, "user", "z"), (2, 0, "user", "z"), (3, None, "assistant", "\\<|end|>"), (4, 0, "user", "w" * 300_000), (5, 0, "user", "w" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    every = ct.read_back(ct.format_trees(df.withColumn("Turns", df.turn).withColumn("alone", df.turn))).collect()
    got = {r["conv_id"]: r for r in every}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 1, 4: 1, 5: 1}
    assert sum(r["conv_id"] is None for r in every) == 2  # each a conversation of its own
    assert got[3]["loss_chars"] == 8 and got[3]["loss_sha256"] == hashlib.sha256(b"\\<|end|>").hexdigest()
    assert ct.read_back(ct.format_trees(df.limit(0))).count() == 0
