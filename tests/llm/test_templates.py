import random
import re

from compare import same

from lociloom.llm import templates as tp
from lociloom.llm.queries import ORACLE


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(spark, d, i):
    return {(r["doc_id"], r["item_id"]): r.asDict() for r in tp.matches(d, i).collect()}


QUESTION = "a train with Alice leaves the old station and travels for 3 hours at 60 km per hour while Alice reads the very long book"


def test_verbatim_and_new_parameters(spark):
    other = QUESTION.replace("Alice", "Bob").replace("3", "7").replace("60 km", "45 miles")
    clash = QUESTION.replace("Alice", "Bob", 1)
    got = found(spark, docs(spark, f"foo bar, {QUESTION}. baz", f"foo {other}!", clash, "nothing of this is anywhere in the items at all, really nothing of it"), items(spark, QUESTION))
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0]["changed_slots"] == 0 and got[0, 0]["matched_words"] == got[0, 0]["item_words"] == 25
    assert got[1, 0]["changed_slots"] == 4 and got[1, 0]["n_windows"] > 5


def test_values_with_another_number_of_words(spark):
    """3.5 for 3, 1,200 for 60, glued units, names of several words: still the same template."""
    other = QUESTION.replace("Alice", "Mary Ann Smith").replace("3 hours", "3.5 hours").replace("60 km", "1,200km")
    back = found(spark, docs(spark, QUESTION), items(spark, other))
    got = found(spark, docs(spark, f"so: {other}, they say"), items(spark, QUESTION))
    assert got[0, 0]["matched_words"] == 25 and got[0, 0]["changed_slots"] == 3  # km stays km
    assert back[0, 0]["matched_words"] == back[0, 0]["item_words"] == 29


def test_half_of_the_item_is_enough(spark):
    w = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    put_in = " ".join([*w[:10], "one", *w[10:20], "two", *w[20:30], "three", *w[30:]])
    left_out = " ".join([*w[:12], *w[13:25], *w[27:]])
    got = found(spark, docs(spark, " ".join(w[:21]), " ".join(w[:19]), " ".join(w[:15] + ["x"] + w[16:]), " ".join(reversed(w)), put_in, left_out), items(spark, " ".join(w)))
    assert {k[0]: r["matched_words"] for k, r in got.items()} == {0: 21, 2: 39, 4: 40, 5: 37}


def test_slots_of_segments_must_fit_together(spark):
    q = "the farmer Tom has 12 large brown cows in the old barn behind the house and Tom sells 5 of them to a man from the town who pays for all of them at once"
    words = q.split(" ")
    apart = " ".join([*words[:16], "then", *words[16:]])
    unlike = apart.replace("Tom", "Bob", 1)  # the two halves tell of different people
    got = found(spark, docs(spark, apart, apart.replace("Tom", "Bob"), unlike), items(spark, q))
    assert got[0, 0]["matched_words"] == got[1, 0]["matched_words"] == len(words) and got[1, 0]["changed_slots"] == 1
    assert (2, 0) not in got or got[2, 0]["matched_words"] < len(words)


def test_items_of_slots_and_short_items(spark):
    slots = "Compute 3 x 4 y 12 z 5 w 7 Boston Paris 9 Rome 4 Oslo"
    title = "What Is The Capital City Of The Old Kingdom Of France"
    short = "what is the capital of France"
    some = items(spark, slots, title, short, "two words", "one", "3 + 4 = 7", "Is It True")
    got = found(spark, docs(spark, f"q: {slots}.", f"Question 5 {title} Answer", f"tell me {short.upper()}?", "two words and one", "we know 3 + 4 = 7 of course", "3 + 5 = 8", slots.replace("12", "13"), "Yes It Is True"), some)
    assert {k for k in got} >= {(0, 0), (1, 1), (2, 2), (4, 5)}
    assert got[0, 0]["matched_words"] == got[0, 0]["item_words"] and got[1, 1]["matched_words"] == 11 and got[2, 2]["matched_words"] == 6
    assert not {k for k in got if k[1] in (3, 4)} and (5, 5) not in got and (7, 6) not in got


def plain_tokens(text):
    t = re.sub(r"[\x01\x02\x20\x09-\x0D]+", " ", text)
    t = re.sub(r"(?<![^\W_])([^\W\d_a-zé][^\W_]*) (?=[^\W\d_a-zé])", "\\1\x01", t)
    t = re.sub(r"(?<=\d)[.,](?=\d)", "\x02", t)
    t = re.sub(r"(?:[^\w\x01\x02]|_)+", " ", t)
    t = re.sub(rf"(?<=\d)(?=(?i:{tp.UNITS})(?![\w\x01\x02]))", " ", t)
    return t.strip().split(" ")


def plain_template(text):
    out = []
    for tok in plain_tokens(text):
        t = re.sub(r"\d+(?:\x02\d+)*", "#", tok)
        unit = re.fullmatch(f"(?:{tp.UNITS})", t, re.I) and out and out[-1].endswith("#")
        out.append("%" if unit else "@" if t[:1].isupper() else t.lower())
    return out


BITS = ["Alice", "km", "3", "12.5", "KG", "word", "x5", "5x", "a-b", "Été", "%", "10%", "s", "S", "iPhone", "ABC", ".", "h2o", "7 h", "1,200", "5kg", "New York", "1.2.3", "3.", "It's", "Bob,", "\x01", "_"]


def test_template_against_plain(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(BITS) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    got = tp.sequences(docs(spark, *texts)).select("doc_id", "seq.*").collect()
    assert all(len(r["raw"]) == len(r["canon"]) for r in got)
    assert {r["doc_id"]: list(r["canon"]) for r in got} == {i: plain_template(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: list(r["raw"]) for r in got} == {i: plain_tokens(t) for i, t in enumerate(texts)}


def test_odd_items_against_sql(spark):
    """Items that are short, full of slots, or cut up with words put in and left out, in documents of the same bits."""
    import duckdb

    rng = random.Random(7)
    bits = [*BITS, *"one two three four five six seven eight the of and to in".split()]
    made = [" ".join(rng.choice(bits) for _ in range(rng.choice([2, 4, 6, 9, 15, 25, 40]))) for _ in range(60)]

    def changed(text):
        w = text.split(" ")
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [w[k], "put"], [rng.choice(bits)], [w[k].upper()]])
        return " ".join(w)

    texts = [" ".join([changed(rng.choice(made)), *(rng.choice(bits) for _ in range(rng.randint(0, 9))), changed(rng.choice(made))]) for _ in range(150)] + [None, ""]
    d, i = docs(spark, *texts, *texts[:3]), items(spark, *made, None, made[0])
    d, i = d.union(d.limit(5)), i.union(i.limit(3))
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("benchmark", i.toPandas())
    out = tp.matches(d, i)
    assert same(out, con.sql(ORACLE["op5_decontamination"]).df()) and out.count() > 100


def test_many_windows_go_without_broadcast(spark, monkeypatch):
    d, i = docs(spark, QUESTION, "else"), items(spark, QUESTION)
    want = found(spark, d, i)
    monkeypatch.setattr(tp, "BROADCAST_BYTES", 1)
    assert found(spark, d, i) == want and len(want) == 1


def test_edges(spark, odd):
    said = odd.where("doc_id = 1").first()["text"]
    long = odd.where("doc_id = 4").first()["text"]
    some = items(spark, QUESTION, said, "too short", "", None, " ".join(long.split()[100:140]))  # the last has numbered words alone
    assert {k[0] for k in found(spark, odd, some)} == {1, 4, 5}
    left = tp.drop_contaminated(odd, some)
    assert left.columns == odd.columns and left.count() == 6
    assert found(spark, odd.limit(0), some) == {} and found(spark, odd, some.limit(0)) == {}
    assert found(spark, spark.createDataFrame([(None, QUESTION)], "doc_id long, text string"), some).keys() == {(None, 0)}


def test_slices_and_words_make_the_same_parts(spark, monkeypatch):
    rng = random.Random(21)
    item = "Each of the Miller children has 3 baskets that hold 1,200 apples from Old Town and they give away half of all"
    texts = [" ".join([*(f"w{rng.randrange(90)}" for _ in range(n)), item.replace("Miller", "Baker").replace("3", "17"), *(f"W{k}" for k in range(n // 2))]) for n in (0, 100, 125, 128, 300, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "w1 w2 w3 w4 w5"), (3, texts[5][:400])], "item_id long, text string")
    got = []
    for short in (0, 10**9):
        monkeypatch.setattr(tp, "SHORT", short)
        got.append(sorted(map(tuple, tp.matches(docs, items).collect())))
    assert got[0] == got[1] and {r[0] for r in got[0] if r[1] == 1} == set(range(6))
