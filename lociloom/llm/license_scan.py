"""License scan: an exact set-similarity join of the texts' blocks of words with licence templates.

A template is found in a block if the block has at least THRESHOLD of the template's different words. Blocks of a template of up to L words (L a power of two)
are 2 L words long and begin at every L-th word, so that each passage of up to L words lies within one whole; a text's last block may be shorter. The join
is exact, and its three filters lose nothing:

* Words are ordered by the number of texts that have them, rarest first (counted over all texts; words of no template take no part, as no
  overlap counts them). A template that needs n of its m words can only be met by a block with one of its first m - n + 1
  (prefix filter): blocks are made around such words alone.
* A block with fewer words of any template than n can't meet it (length filter).
* If the first word that both have stands at i of the template and j of the block's words, what follows in either must be
  enough: 1 + min(m - i, size - j) >= n (positional filter, places from 1).

What passes is counted. A pair is taken at its first common word, so that none comes twice.

Besides, phrases are looked for word by word. The labels are those of phrases and templates. The score is 1 where a phrase stands, else the greatest share of
a template's words in a block that meets it, else 0.

DataFrame functions alone: no Python sees a row. The templates (MAX_WORDS words of all in total, an argument that is checked) are the only thing
passed to all tasks. A text's words never leave their row: only blocks with a prefix word do, as words of templates (one light row each, however
many texts repeat a passage), so that no text or word gathers rows in one task. Scratch tables below spark.checkpoint.dir cut the lineage.

Null texts are empty, and texts without words get no labels and score 0. Every row gives a row, repeated and null ids alike. An empty table gives an empty
result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, shared_dir, stored

#: Share of a template's different words that a block must have.
THRESHOLD = 0.9
#: So many words all templates may have together.
MAX_WORDS = 100_000
#: What parts words, as a pattern (Java's and DuckDB's alike).
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The words by which works are put under a licence, as the licences' own texts or common usage have them, and labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
]

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words: A-Z in lower case, parted by all other ASCII characters than letters and digits."""
    return F.array_remove(F.split(F.translate(text, _CAPITALS, _SMALL), APART), "")


def own_words(text: str) -> list[str]:
    """The same in Python, for the templates."""
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_CAPITALS, _SMALL)))


@dataclass(frozen=True)
class Template:
    """A template's place in the list, label, different words (rarest first), the number of them that a block must have, and L."""

    place: int
    label: str
    tokens: tuple[str, ...]
    need: int
    half: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def ordered(templates: list[tuple[str, str]], order: list[str], threshold: float) -> list[Template]:
    """The templates with their words in that order; those without words are left out."""
    made, rank = [], {w: k for k, w in enumerate(order)}
    for place, (label, text) in enumerate(templates):
        found = own_words(text)
        tokens = tuple(sorted(set(found), key=rank.__getitem__))
        if tokens:
            made.append(Template(place, label, tokens, ceil(threshold * len(tokens) - 1e-9), 1 << max(3, (len(found) - 1).bit_length())))
    return made


def rarest_first(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of rows (words) in which each word stands, then by itself; one number a word comes to the driver."""
    known = F.array(*map(F.lit, vocabulary))
    met = rows.select(F.explode(F.array_intersect(known, "words")).alias("word"))
    often = {r["word"]: r["n"] for r in met.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (often.get(w, 0), w))


def phrase_places(found: Column, phrases: dict[str, str]) -> Column:
    """array<struct<at, label>>: where the phrases' words stand consecutively, from 0. One pass over the words finds the phrases' last ones."""
    lists = {tuple(own_words(p)): label for p, label in phrases.items()}
    ends = F.filter(F.transform(found, lambda w, i: F.when(w.isin(*{p[-1] for p in lists}), i)), lambda i: i.isNotNull())

    def one(i: Column) -> Column:
        hits = []
        for p, label in lists.items():
            same = i >= len(p) - 1
            for k, w in enumerate(reversed(p)):
                same = same & F.coalesce(F.get(found, i - k) == w, F.lit(False))
            hits.append(F.when(same, F.struct((i - len(p) + 1).cast("long").alias("at"), F.lit(label).alias("label"))))
        return F.array_compact(F.array(*hits))

    return F.flatten(F.transform(ends, one))


def _blocks(found: Column, templates: list[Template], order: list[str]) -> Column:
    """array<struct<half, start, tokens>>: the blocks around prefix words, with their words of templates of that size, in the order of all words."""
    every = []
    for half in sorted({t.half for t in templates}):
        some = [t for t in templates if t.half == half]
        prefix, own = {w for t in some for w in t.prefix}, {w for t in some for w in t.tokens}
        at = F.filter(F.transform(found, lambda w, i: F.when(w.isin(*prefix), i)), lambda i: i.isNotNull())  # noqa: B023
        number = F.array_distinct(F.flatten(F.transform(at, lambda i: F.filter(F.array((i / half).cast("int") - 1, (i / half).cast("int")), lambda b: b >= 0))))  # noqa: B023
        known = F.array(*[F.lit(w) for w in order if w in own])
        every.append(F.transform(number, lambda b: F.struct(F.lit(half).alias("half"), (b * half).alias("start"), F.array_intersect(known, F.slice(found, b * half + 1, 2 * half)).alias("tokens"))))  # noqa: B023
    return F.concat(*every)


def matches(blocks: DataFrame, templates: list[Template]) -> DataFrame:
    """id, start, half, label, template (its place), n (words in common) and share of the blocks (id, half, start, tokens) that meet a template."""
    spark = blocks.sparkSession
    index = [(w, t.half, i, len(t.tokens), t.need, t.place, t.label, list(t.tokens)) for t in templates for i, w in enumerate(t.prefix, 1)]
    prefixes = F.broadcast(spark.createDataFrame(index, "token string, half int, i int, m int, need int, template int, label string, wanted array<string>"))
    size = F.size("tokens")
    least = min(t.need for t in templates)
    some = blocks.where(size >= least).select("id", "half", "start", "tokens", size.alias("size"))
    probe = some.select("*", F.posexplode(F.slice("tokens", 1, F.col("size") - least + 1)).alias("_j", "token")).withColumn("j", F.col("_j") + 1)
    met = probe.join(prefixes, ["token", "half"]).where((F.col("size") >= F.col("need")) & (1 + F.least(F.col("m") - F.col("i"), F.col("size") - F.col("j")) >= F.col("need")))
    both = met.withColumn("both", F.array_intersect("tokens", "wanted")).where((F.size("both") >= F.col("need")) & (F.get("both", F.lit(0)) == F.col("token")))
    return both.select("id", "start", "half", "label", "template", F.size("both").alias("n"), (F.size("both") / F.col("m")).alias("share"))


def _checked(templates: list[tuple[str, str]]) -> list[str]:
    every = [w for _, text in templates for w in own_words(text)]
    if len(every) > MAX_WORDS:
        raise ValueError(f"the templates have {len(every)} words, more than {MAX_WORDS}")
    return sorted(set(every))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """A row for each document: doc_id, id, n_words, places (of phrases, with labels); and the matches() of its blocks, by id."""
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession, "licenses")
    vocabulary = _checked(templates)
    rows = docs.select("doc_id", words(filled()).alias("words"))
    order = rarest_first(rows, vocabulary) if vocabulary else []
    made = ordered(templates, order, threshold)
    blocks = _blocks(F.col("words"), made, order) if made else F.array().cast("array<struct<half:int,start:int,tokens:array<string>>>")
    places = phrase_places(F.col("words"), phrases) if phrases else F.array().cast("array<struct<at:bigint,label:string>>")
    light = rows.select("doc_id", F.monotonically_increasing_id().alias("id"), F.size("words").cast("long").alias("n_words"), places.alias("places"), blocks.alias("blocks"))
    light = stored(light, f"{base}/rows")  # the ids stand in the table: what is computed again does not number anew
    found = matches(light.select("id", F.explode("blocks").alias("b")).select("id", "b.half", "b.start", "b.tokens"), made) if made else None
    if found is None:
        found = spark.createDataFrame([], "id long, start int, half int, label string, template int, n int, share double")
    return light.drop("blocks"), found


def licenses(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base (places of phrases), first_word and last_word (the least and greatest place), base_labels
    (of phrases), labels (of templates too), both distinct, sorted and joined by commas, and score."""
    rows, found = scan(docs, **options)
    best = found.groupBy("id").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    at, base = F.transform("places", lambda p: p["at"]), F.array_distinct(F.transform("places", lambda p: p["label"]))
    out = rows.select("doc_id", "id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), base.alias("base")).join(best, "id", "left")
    every = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"))
