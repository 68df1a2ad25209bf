"""Benchmark decontamination by templates, in DataFrame functions alone.

Texts become sequences of words: letters and digits, with a number's decimal and group marks inside (3.5, 1,200) and a
unit that stands close to its number apart (5kg). Typed placeholders take the place of numbers, of names (words with a capital first
letter; several with a space between are one name) and of units after a number; other words are lower-cased. So a text is a row
of tokens, of which names may hold several words. What is looked for of an item, and how a place of it is matched in a document:

* each window of WINDOW tokens of which half are plain at least: the same window of tokens, whatever fills its slots;
* each window of WINDOW words more than half of which stand in slots: the same words, but for their case;
* an item of fewer than WINDOW tokens (but LEAST words): all its words, but for their case. Shorter items match nothing.

Windows are joined by hash and then compared. A matched token's diagonal is its word's place in the document less that in the
item. On a diagonal, the words that fill the slots must fit: one filling of the item has the same filling in the document
wherever it occurs; other diagonals are left out. The diagonal that matches most words is a match's middle; those nearer to it than the
item is long (as words were put in or left out, or a name has more words) add theirs if they fill no slot otherwise than it does, and if
all of them together fit; else the middle stands alone. Fillings that differ from the item's are re-parameterised questions.
A document is contaminated by an item if a match covers at least COVER of the item's words.

Null texts count as empty. Null ids are kept like others. Repeated document rows give the same matches once for each id, repeated
items once for each id and text. An empty table on either side gives an empty result. Very long texts are taken whole. Other
columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import filled, in_bitmap, shared_dir, stored

WINDOW, COVER, LEAST = 8, 0.5, 3
#: Words that are units after a number (fixed values).
UNITS = "mm|cm|km|m|mg|kg|g|t|ml|cl|l|lb|lbs|oz|ft|in|mi|mph|kmh|s|sec|min|h|hr|hrs|ms|hz|khz|mhz|ghz|w|kw|v|a|k|c|f|j|kj|cal|kcal|usd|eur|gbp|percent|dollars|euros|cents|metres|meters|miles|hours|minutes|seconds|days|weeks|years|grams|litres|liters"
#: A benchmark whose windows take so many bytes at most (a hash, a place and an id each) is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 16 << 20
#: Windows begin at so many places of one part of a document: what is kept with a place of it does not grow with the text.
PART = 128
#: Of texts of so many words at most the parts are slices, each of which reads the whole array at once; of longer ones they are made word by word.
SHORT = 16_384
#: Between the words of one name, and in place of a number's marks.
NAME, MARK = "\x01", "\x02"


def tokens(text: str = "text") -> Column:
    """The text with single spaces between its tokens."""
    # each pattern begins with what is rare
    out = F.regexp_replace(F.replace(F.replace(filled(text), F.lit(NAME), F.lit(" ")), F.lit(MARK), F.lit(" ")), r"(\p{Lu}(?<![\p{L}\p{N}]\p{Lu})[\p{L}\p{N}]*)[\x20\x09-\x0D]+(?=\p{Lu})", f"$1{NAME}")
    out = F.regexp_replace(out, r"[.,](?<=\p{N}[.,])(?=\p{N})", MARK)
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\x01\x02]+", " ")
    return F.trim(F.regexp_replace(out, rf"(\p{{N}})((?i:{UNITS}))(?![\p{{L}}\p{{N}}\x01\x02])", "$1 $2"))


def template(clean: Column) -> Column:
    """The same number of tokens: # for a number, % for a unit, @ for a name, the rest in lower case."""
    out = F.regexp_replace(clean, r"\p{N}+(?:\x02\p{N}+)*", "#")
    out = F.regexp_replace(out, rf"# (?:(?i){UNITS})(?![\p{{L}}#\x01])", "# %")
    out = F.regexp_replace(out, r"\p{Lu}(?<![\p{L}#%\x01]\p{Lu})[\p{L}#\x01]*", "@")
    return F.lower(out)


def low_words(raw: Column) -> Column:
    """The words of tokens, in lower case."""
    return _low(F.array_join(raw, " "))


def _low(clean: Column) -> Column:
    return F.split(F.lower(F.replace(clean, F.lit(NAME), F.lit(" "))), " ")


def is_slot(token: Column) -> Column:
    """True if a token of a template is or has a placeholder."""
    return token.rlike("[#%@]")


def n_words(token: Column) -> Column:
    return F.length(token) - F.length(F.replace(token, F.lit(NAME), F.lit(""))) + 1


def sequences(rows: DataFrame) -> DataFrame:
    """rows with text replaced by seq: raw and canon, the tokens and their templates."""
    both = lambda clean: F.struct(F.split(clean, " ").alias("raw"), F.split(template(clean), " ").alias("canon"))
    return rows.withColumn("seq", let(tokens(), both)).drop("text")


def some_of(words: Column, at: Column, n: Column) -> Column:
    """n words (one at least) from a place on, one by one: a slice inside an array function would read the whole array."""
    return F.transform(F.sequence(at, at + n - 1), lambda i: F.get(words, i))


def parts(rows: DataFrame, far: int) -> DataFrame:
    """Per part of a text, in place of the text, part: kind (0 of tokens, 1 of words; none of these if far is 0), first (the words before it), raw (tokens, if of tokens), words
    (templates of tokens, or words in lower case) and hashes of these. PART windows begin in a part; words go on as far as the longest window does, hashes as far as any that is hashed."""

    def cut(words: Column, over: int) -> Column:
        each = lambda b: some_of(words, b, F.least(F.lit(PART + over), F.size(words) - b))
        begins = F.sequence(F.lit(0), F.size(words) - 1, F.lit(PART))
        short = F.transform(begins, lambda b: F.slice(words, b + 1, PART + over))  # reads all words for each part, but as one block
        return F.when(F.size(words) <= PART, F.array(words)).when(F.size(words) <= SHORT, short).otherwise(F.transform(begins, each))

    def firsts(raw: Column) -> Column:
        return F.aggregate(F.slice(raw, 1, F.size(raw) - 1), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + start_of(x, F.lit(PART)))))

    def part(kind: int, first: Column, raw: Column, words: Column) -> Column:
        hashes = F.transform(F.slice(words, 1, PART + WINDOW - 1), lambda w: F.xxhash64(F.lit(kind), w))
        return F.struct(F.lit(kind).alias("kind"), first.alias("first"), raw.alias("raw"), words.alias("words"), hashes.alias("hashes"))

    def of_tokens(clean: Column) -> Column:
        made = lambda raw, canon, first: F.transform(raw, lambda x, i: part(0, F.get(first, i), x, F.get(canon, i)))
        cuts = lambda text, body: let(F.split(text, " "), lambda words: let(cut(words, WINDOW - 1), body))
        return cuts(clean, lambda raw: cuts(template(clean), lambda canon: let(firsts(raw), lambda first: made(raw, canon, first))))

    def of_words(clean: Column) -> Column:
        return let(_low(clean), lambda low: F.transform(cut(low, max(far, WINDOW) - 1), lambda x, i: part(1, i * PART, F.lit(None).cast("array<string>"), x)))

    every = let(tokens(), lambda clean: F.concat(of_tokens(clean), of_words(clean)) if far else of_tokens(clean))
    return rows.withColumn("part", F.explode_outer(every)).drop("text")  # an inner one would have the optimizer filter by the size first, and so compute all twice


def window_hash(kind: Column, off: Column, piece: Column) -> Column:
    return F.xxhash64(kind, off, piece)


def item_windows(items: DataFrame) -> DataFrame:
    """Per window of an item: kind (0 of tokens, 1 of words), at (the window's place), n (how many words or tokens are compared), item (a hash of its id and text),
    word and off (the hash of its longest plain token or its longest word, and that one's place in it), m (how many are hashed, WINDOW at most) and hash (of these)."""
    seq = sequences(items.select("item_id", "text", F.xxhash64("item_id", "text").alias("item"))).dropDuplicates(["item"]).withColumn("low", low_words(F.col("seq.raw")))
    in_slots = F.flatten(F.zip_with("seq.canon", "seq.raw", lambda c, r: F.transform(F.sequence(F.lit(1), n_words(r)), lambda k: is_slot(c))))
    long = F.size("seq.canon") >= WINDOW
    slots = F.size(F.filter(F.slice("flags", F.col("at") + 1, WINDOW), lambda y: y))

    def placed(kind: int, words: Column, flags: Column, heavy: bool) -> DataFrame:
        out = seq.where(long).select("item", words.alias("words"), flags.alias("flags"), F.explode(F.sequence(F.lit(0), F.size(words) - WINDOW)).alias("at"))
        out = out.where((slots * 2 > WINDOW) == heavy).withColumns({"piece": F.slice("words", F.col("at") + 1, WINDOW), "flags": F.slice("flags", F.col("at") + 1, WINDOW)})
        return out.select("item", F.lit(kind).alias("kind"), "at", F.lit(WINDOW).alias("n"), "piece", F.when(F.lit(kind == 0), F.col("flags")).alias("flags"))

    by_token = placed(0, F.col("seq.canon"), F.transform("seq.canon", is_slot), False)
    by_word = placed(1, F.col("low"), in_slots, True)
    whole = seq.where(~long & (F.size("low") >= LEAST)).select("item", F.lit(1).alias("kind"), F.lit(0).alias("at"), F.size("low").alias("n"), F.slice("low", 1, WINDOW).alias("piece"), F.lit(None).cast("array<boolean>").alias("flags"))
    every = by_token.unionByName(by_word).unionByName(whole)
    length = lambda w, i: F.when(F.coalesce(F.get("flags", i), F.lit(False)), 0).otherwise(F.length(w))
    chosen = every.withColumn("chosen", F.array_max(F.transform("piece", lambda w, i: F.struct(length(w, i).alias("length"), F.xxhash64(F.col("kind"), w).alias("word"), i.alias("i")))))
    chosen = chosen.select("item", "kind", "at", "n", F.size("piece").alias("m"), "piece", F.col("chosen.word").alias("word"), F.col("chosen.i").alias("off"))
    return chosen.withColumn("hash", window_hash(F.col("kind"), F.col("off"), F.col("piece"))).drop("piece")


def start_of(raw: Column, at: Column) -> Column:
    """The number of words before a token."""
    head = F.array_join(F.slice(raw, 1, at), " ")
    return at + F.length(head) - F.length(F.replace(head, F.lit(NAME), F.lit("")))


def _matched() -> Column:
    """For a hit (first, words and canon of the document's window; s, the item's sequence; kind, at and n) the matched tokens as (start, len, diagonal, slot, own, other); null if the window is another."""
    s, at, n, words = F.col("s"), F.col("at"), F.col("n"), F.col("words")
    piece = lambda a: F.slice(a, at + 1, n)
    before = lambda raw, k: F.aggregate(F.slice(raw, 1, k), F.lit(0), lambda a, r: a + n_words(r))

    def token(raw: Column, canon: Column, first: Column, k: Column) -> Column:
        start, there, slot = first + before(raw, k), F.col("first") + before(words, k), F.get(canon, k)
        return F.struct(start.alias("start"), n_words(F.get(raw, k)).alias("len"), (there - start).alias("diagonal"), F.when(is_slot(slot), slot).alias("slot"), F.get(raw, k).alias("own"), F.get(words, k).alias("other"))

    def word(w: Column, k: Column) -> Column:
        return F.struct((at + k).alias("start"), F.lit(1).alias("len"), (F.col("first") - at).alias("diagonal"), F.lit(None).cast("string").alias("slot"), w.alias("own"), w.alias("other"))

    each = lambda raw, canon, first: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: token(raw, canon, first, k))
    of_tokens = let(piece(s["raw"]), lambda raw: let(piece(s["canon"]), lambda canon: let(start_of(s["raw"], at), lambda first: F.when(F.col("canon") == canon, each(raw, canon, first)))))
    of_words = let(piece(low_words(s["raw"])), lambda own: F.when(F.slice(words, 1, n) == own, F.transform(own, word)))
    return F.when(F.col("kind") == 0, of_tokens).otherwise(of_words)


def _at_words(found: DataFrame) -> DataFrame:
    """found (doc_id, part, k: a word's place in it, and kind, m and off of windows it may be in) with the window's place (to) and hash; none if it does not begin in the part or ends beyond the text.

    An array function makes the hash: what follows the loop over the words in the same compiled method would make that too long for the JVM to optimise."""
    to, m = F.col("k") - F.col("off"), F.col("m")

    def hashed(p: Column) -> Column:
        fits = (to >= 0) & (to < PART) & (to + m <= F.size(p["words"]))
        return F.struct(to.alias("to"), F.when(fits, window_hash(F.col("kind"), F.col("off"), some_of(p["words"], to, m))).alias("hash"))

    return found.select("doc_id", "part", "kind", F.explode_outer(F.transform(F.array("part"), hashed)).alias("x")).select("doc_id", "part", "kind", "x.to", "x.hash")


def _windowed(found: DataFrame, far: int) -> DataFrame:
    """found with the window in place of part: first (the words before it), words (as many as the longest window has) and canon."""
    to = F.col("to")

    def window(p: Column) -> Column:
        of_tokens = F.struct((p["first"] + start_of(p["raw"], to)).alias("first"), some_of(p["raw"], to, F.lit(WINDOW)).alias("words"), some_of(p["words"], to, F.lit(WINDOW)).alias("canon"))
        of_words = F.struct((p["first"] + to).alias("first"), some_of(p["words"], to, F.least(F.lit(far), F.size(p["words"]) - to)).alias("words"), F.lit(None).cast("array<string>").alias("canon"))
        return F.when(F.col("kind") == 0, of_tokens).otherwise(of_words)

    return found.withColumn("x", F.explode_outer(F.transform(F.array("part"), window))).drop("part", "to").select("*", "x.*").drop("x")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that contaminates it: doc_id, item_id, n_windows, matched_words, item_words, changed_slots.

    A document's window is hashed only where it has the chosen word of a window that is looked for, at that word's place."""
    bench = stored(item_windows(items), f"{shared_dir(docs.sparkSession, 'templates')}/windows")
    shapes = bench.groupBy("kind", "m", "off").agg(F.max("n").alias("far"), F.count(F.lit(1)).alias("rows"))  # WINDOW * WINDOW rows at most of each kind
    counted = shapes.select("kind", "far", "rows").collect()
    far = max((r["far"] for r in counted if r["kind"] == 1), default=0)
    placed = parts(docs.select("doc_id", "text"), far).select("doc_id", "part", F.posexplode_outer("part.hashes").alias("k", "word"))
    looked, shapes = bench.drop("word", "off", "m"), shapes.select("kind", "m", "off")
    if sum(r["rows"] for r in counted) * 64 <= BROADCAST_BYTES:  # 64 bytes a row
        chosen = bench.select("word", "kind", "m", "off").distinct()
        hit = _windowed(_at_words(placed.join(F.broadcast(chosen), "word")).join(F.broadcast(looked), ["hash", "kind"]), far)
    else:  # each word that may be a chosen one stands in every shape of window; windows that the benchmark may have, and of these no more than the words, are dealt by their hashes
        some = in_bitmap(placed, F.col("word"), bench, F.col("word")).withColumn("kind", F.col("part.kind"))
        hit = _windowed(in_bitmap(_at_words(some.join(F.broadcast(shapes), "kind")), F.col("hash"), bench, F.col("hash")), far).join(looked, ["hash", "kind"])
    own = sequences(items.select("item_id", "text", F.xxhash64("item_id", "text").alias("item"))).dropDuplicates(["item"]).withColumnRenamed("seq", "s")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0  # one row
    hit = hit.join(F.broadcast(own) if size * 4 <= BROADCAST_BYTES else own, "item").withColumn("item_words", F.size(low_words(F.col("s.raw"))))  # tokens and templates, and their lengths
    # asked with k, as the optimizer would move a plain filter into the join and compute it for every window of every document
    token = hit.select("doc_id", "item_id", "item", "item_words", F.posexplode(_matched()).alias("k", "w")).select("doc_id", "item_id", "item", "item_words", "k", "w.*")
    key = ["doc_id", "item_id", "item", "item_words"]
    token = token.groupBy(*key, "diagonal", "start", "len").agg(F.max(F.when(F.col("k") == 0, 1).otherwise(0)).alias("starts"), F.max(F.struct("slot", "own", "other")).alias("f"))
    filling = token.groupBy(*key, "diagonal", F.when(F.col("f.slot").isNotNull(), F.concat("f.slot", "f.own")).alias("filling")).agg(
        F.sum("len").alias("words"), F.sum("starts").alias("windows"), F.min("f.other").alias("low"), F.max("f.other").alias("high"), F.min("f.own").alias("own"), F.collect_list(F.struct("start", "len")).alias("places")
    )
    filled_in = F.col("filling").isNotNull()
    of = lambda *c: Window.partitionBy(*key, *c)
    # diagonals that fit in themselves, and the middle one
    clash = F.max((filled_in & (F.col("low") != F.col("high"))).cast("int")).over(of("diagonal"))
    fit = filling.withColumn("clash", clash).where("clash = 0")
    all_words, all_windows = F.sum("words").over(of("diagonal")), F.sum("windows").over(of("diagonal"))
    fit = fit.withColumns({"all_words": all_words, "all_windows": all_windows})
    middle = F.max(F.struct("all_words", "all_windows", (-F.col("diagonal")).alias("d"))).over(of())
    near = fit.withColumn("middle", -middle["d"]).where(F.abs(F.col("diagonal") - F.col("middle")) <= F.col("item_words"))
    # those that fill its slots as it does, and whether all of them do among themselves
    as_middle = F.max(F.when(F.col("diagonal") == F.col("middle"), F.col("low"))).over(of("filling"))
    apart = near.withColumn("apart", (filled_in & as_middle.isNotNull() & (F.col("low") != as_middle)).cast("int"))
    near = apart.withColumn("apart", F.max("apart").over(of("diagonal"))).where("apart = 0")
    unlike = (filled_in & (F.min("low").over(of("filling")) != F.max("low").over(of("filling")))).cast("int")
    near = near.withColumn("unlike", unlike).withColumn("unlike", F.max("unlike").over(of())).where("unlike = 0 OR diagonal = middle")
    one = near.groupBy(*key, "filling").agg(F.sum("windows").alias("windows"), F.min("low").alias("low"), F.min("own").alias("own"), F.flatten(F.collect_list("places")).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda p: F.sequence(p["start"], p["start"] + p["len"] - 1)))))  # places of the item
    whole = one.groupBy(*key).agg(
        F.sum("windows").cast("long").alias("n_windows"), covered.cast("long").alias("matched_words"), F.count_if(filled_in & (F.col("low") != F.col("own"))).alias("changed_slots")
    )
    return whole.where(F.col("matched_words") >= COVER * F.col("item_words")).select("doc_id", "item_id", "n_windows", "matched_words", F.col("item_words").cast("long").alias("item_words"), "changed_slots")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated documents; those with a null id stay, as no match can be told to be theirs."""
    gone = matches(docs, items).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "anti")
