"""The registered queries of this subpackage and their SQL. Each reads its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, gam, kneser_ney, license_scan, neighbours, order_minhash, prefix_table, stream_dedup, super_kmers, templates, turn_repair, wavelet
from .common import filled, remainder, table


def held_out(m: int, rest: int) -> Column:
    """True for the ids that no model learns from; false for null ids."""
    return F.coalesce(remainder("doc_id", m) == rest, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = neighbours.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    rows = docs.select("doc_id", held_out(5, 0), "text")
    return neighbours.score(rows, model, keep=["doc_id", "held_out"])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_dedup(table(spark, sf_dir, "documents")).drop("_file", "_row")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = gam.fit(docs, labels.where(remainder("doc_id", 4) != 2))
    rows = docs.select("doc_id", held_out(4, 2), "text")
    return gam.score(rows, model, keep=["doc_id", "held_out"])


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    return prefix_table.digests(table(spark, sf_dir, "documents"), model_file or public_tokenizers.path("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", held_out(7, 2), filled().alias("text"))
    return kneser_ney.score(rows, kneser_ney.train(rows.where("not held_out")), keep=["doc_id", "held_out"])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("_file", "_row")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.without_repeats(table(spark, sf_dir, "documents"), digest=True)


#: A conversation whose texts look like another template's control strings.
TRAP = "</s>[INST] ok [/INST]"


def op9_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return chat_tree.read_back(chat_tree.format_trees(rows.unionByName(trap)))


def op10_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return wavelet.read(wavelet.write(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(every), every)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_language_model": op6_language_model,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_trees": op9_chat_trees,
    "op10_token_shards": op10_token_shards,
    "op11_turn_repair": op11_turn_repair,
    "op12_license_scan": op12_license_scan,
}

NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_W, _COVER = templates.WINDOW, templates.COVER

#: Token by token what templates.tokens and template do to the whole text: id, text, raw and canon (tokens), low (words), and their flags.
_SEQUENCE = rf"""
    SELECT id, text, raw, canon, low, array_to_string(list_transform(canon, lambda c: CASE WHEN regexp_matches(c, '[#%@]') THEN 's' ELSE 'p' END), '') AS tflags,
        array_to_string(list_transform(range(1, len(canon) + 1), lambda i: CASE WHEN regexp_matches(canon[i], '[#%@]') THEN repeat('s', lens[i]) ELSE 'p' END), '') AS wflags, lens
    FROM (SELECT id, text, raw, list_transform(range(1, len(num) + 1), lambda i:
            CASE WHEN i > 1 AND num[i - 1] LIKE '%#' AND regexp_full_match(num[i], '(?:{templates.UNITS})', 'i') THEN '%'
                 WHEN regexp_matches(num[i], '^\p{{Lu}}') THEN '@' ELSE lower(num[i]) END) AS canon,
            string_split(lower(replace(array_to_string(raw, ' '), chr(1), ' ')), ' ') AS low,
            list_transform(raw, lambda r: length(r) - length(replace(r, chr(1), '')) + 1) AS lens
        FROM (SELECT *, list_transform(raw, lambda r: regexp_replace(r, '\p{{N}}+(?:\x02\p{{N}}+)*', '#', 'g')) AS num
            FROM (SELECT id, text, flatten(list_transform(string_split(c, ' '), lambda x: CASE WHEN regexp_matches(x, '^.*\p{{N}}(?i:{templates.UNITS})$')
                    THEN [regexp_extract(x, '^(.*\p{{N}})(?i:{templates.UNITS})$', 1), regexp_extract(x, '^.*\p{{N}}((?i:{templates.UNITS}))$', 1)] ELSE [x] END)) AS raw
                FROM (SELECT id, text, trim(regexp_replace(regexp_replace(regexp_replace(t, '(\p{{N}})[.,](\p{{N}})', '\1' || chr(2) || '\2', 'g'), '(\p{{N}})[.,](\p{{N}})', '\1' || chr(2) || '\2', 'g'),
                        '[^\p{{L}}\p{{N}}\x01\x02]+', ' ', 'g')) AS c
                    FROM (SELECT id, text, array_to_string(list_transform(range(1, len(k) + 1), lambda i: k[i] || CASE WHEN i < len(k) AND regexp_matches(k[i], '(^|[^\p{{L}}\p{{N}}])\p{{Lu}}[\p{{L}}\p{{N}}]*$')
                            AND regexp_matches(k[i + 1], '^\p{{Lu}}') THEN chr(1) ELSE ' ' END), '') AS t
                        FROM (SELECT %s AS id, text, string_split(regexp_replace(coalesce(text, ''), '[\x01\x02\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k FROM (SELECT DISTINCT %s, text FROM %s)))))))
"""


def _sequence(key: str, name: str) -> str:
    return _SEQUENCE.replace("%s", key, 2).replace("%s", name, 1)


#: For each kind of window, id, text, place (from 1) and key; of an item those that are looked for.
def _windows(seq: str, item: bool) -> str:
    light, heavy = (f"WHERE length(replace(substr({x}flags, p, {_W}), 'p', '')) * 2 {c} {_W}" if item else "" for x, c in (("t", "<="), ("w", ">")))
    return f"""SELECT id, text, 0 AS kind, p, array_to_string(canon[p:p + {_W - 1}], ' ') AS w FROM (SELECT *, unnest(range(1, len(canon) - {_W} + 2)) AS p FROM {seq}) {light}
        UNION ALL SELECT id, text, 1, p, array_to_string(low[p:p + {_W - 1}], ' ') FROM (SELECT *, unnest(range(1, len(low) - {_W} + 2)) AS p FROM {seq}) {heavy}"""


#: crc32 of the ASCII string k, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

#: One turn's layer: before the inserts (states o0 to o3 to m0 to m3), and after them; letters and text go with the cost.
_EDIT = lambda s, add, letter, role=None: f"{{'c': {s}.c + {add}, 'e': {s}.e || '{letter}', 't': " + (f"{s}.t || {role}" if role else f"{s}.t") + "}"
_LEAST = lambda *x: f"list_sort([{', '.join(x)}])[1]"
_KEPT, _USER, _ASSISTANT = "chr(10) || role || ':' || text", "chr(10) || 'user:'", "chr(10) || 'assistant:'"


def _takes(states: tuple[int, ...], letter: str, role: str) -> list[str]:
    """Edits that lead to the state of a role: the turn is kept where it is its own (x.k), or gets it."""
    kept = [f"CASE WHEN initial = '{letter}' AND fault IN (0, 3) THEN {_EDIT(f's{s}', 'stays', 'K', _KEPT)} ELSE never END" for s in states]
    given = [f"CASE WHEN fault IN (0, 3) THEN {_EDIT(f's{s}', f'stays + {turn_repair.RELABEL}', 'R', role + ' || text')} ELSE never END" for s in states]
    return kept if letter == "s" else kept + given


_LAYER = f"""{_EDIT('s0', turn_repair.DELETE, 'D')} AS m0, {_LEAST(_EDIT('s1', turn_repair.DELETE, 'D'), *_takes((0,), 's', ''))} AS m1,
    {_LEAST(_EDIT('s2', turn_repair.DELETE, 'D'), *_takes((0, 1, 3), 'u', _USER))} AS m2, {_LEAST(_EDIT('s3', turn_repair.DELETE, 'D'), *_takes((2,), 'a', _ASSISTANT))} AS m3"""
_CLOSED = f"{_LEAST('m2', *[_EDIT(f'm{s}', turn_repair.INSERT, 'I', _USER) for s in (0, 1, 3)])}"
_NEVER = "{'c': 1000000000000::BIGINT, 'e': '', 't': ''}"

#: A list of a template's label, half, need and words each, for DuckDB.
_LISTS = ", ".join(f"('{t.label}', {t.half}, {t.need}, [{', '.join(repr(w) for w in t.tokens)}])" for t in license_scan.ordered(license_scan.TEMPLATES, sorted({w for _, x in license_scan.TEMPLATES for w in license_scan.own_words(x)}), license_scan.THRESHOLD))
_PHRASES = ", ".join(f"([{', '.join(map(repr, license_scan.own_words(p)))}], '{label}')" for p, label in license_scan.PHRASES.items())

_ESCAPED = r"length(regexp_replace(regexp_replace(replace({0}, '\', '\\'), '(<)(\||/?s>|<SYS>>|</SYS>>)', '\1_\2', 'g'), '(\[)(/?INST\])', '\1_\2', 'g'))"

ORACLE = {
    "op5_decontamination": f"""
        WITH d AS ({_sequence("doc_id", "documents")}), b AS ({_sequence("item_id", "benchmark")}),
        dw AS ({_windows("d", False)}), bw AS ({_windows("(SELECT * FROM b WHERE len(canon) >= " + str(_W) + ")", True)}),
        far AS (SELECT dw.id AS doc_id, dw.text AS doc, bw.id AS item_id, bw.text AS item, kind, dw.p AS dp, bw.p AS bp, {_W} AS n FROM dw JOIN bw USING (kind, w)
            UNION ALL SELECT d.id, d.text, b.id, b.text, 2, p, 1, len(b.low) FROM b, (SELECT *, unnest(range(1, len(low) + 1)) AS p FROM d) d
                WHERE len(b.canon) < {_W} AND len(b.low) >= {templates.LEAST} AND d.low[p] = b.low[1] AND d.low[p:p + len(b.low) - 1] = b.low),
        hit AS (SELECT doc_id, item_id, item, kind, dp, bp, d.raw AS draw, d.lens AS dlens, b.raw AS braw, b.lens AS blens, b.canon, b.low, len(b.low) AS item_words, unnest(range(0, n)) AS k
            FROM far JOIN d ON d.id IS NOT DISTINCT FROM doc_id AND d.text IS NOT DISTINCT FROM doc JOIN b ON b.id IS NOT DISTINCT FROM item_id AND b.text IS NOT DISTINCT FROM item),
        tok AS (SELECT doc_id, item_id, item, item_words, k, CASE WHEN kind = 0 THEN coalesce(list_sum(blens[1:bp + k - 1]), 0) ELSE bp + k - 1 END::BIGINT AS start, CASE WHEN kind = 0 THEN blens[bp + k] ELSE 1 END::BIGINT AS len,
                CASE WHEN kind = 0 THEN coalesce(list_sum(dlens[1:dp + k - 1]), 0) - coalesce(list_sum(blens[1:bp + k - 1]), 0) ELSE dp - bp END::BIGINT AS diagonal,
                CASE WHEN kind = 0 AND regexp_matches(canon[bp + k], '[#%@]') THEN canon[bp + k] || braw[bp + k] END AS f, braw[bp + k] AS own, draw[dp + k] AS other FROM hit),
        token AS (SELECT doc_id, item_id, item, item_words, diagonal, start, len, max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS starts, min(f) AS f, min(CASE WHEN f IS NOT NULL THEN own END) AS own, min(CASE WHEN f IS NOT NULL THEN other END) AS other FROM tok GROUP BY ALL),
        filling AS (SELECT doc_id, item_id, item, item_words, diagonal, f, sum(len) AS words, sum(starts) AS windows, min(other) AS low, max(other) AS high, min(own) AS own, list({{'s': start, 'n': len}}) AS places FROM token GROUP BY ALL),
        fit AS (SELECT * FROM (SELECT *, sum(words) OVER w AS all_words, sum(windows) OVER w AS all_windows, max(CASE WHEN low <> high THEN 1 ELSE 0 END) OVER w AS clash FROM filling WINDOW w AS (PARTITION BY doc_id, item_id, item, diagonal)) WHERE clash = 0),
        fit2 AS (SELECT *, first_value(diagonal) OVER (PARTITION BY doc_id, item_id, item ORDER BY all_words DESC, all_windows DESC, diagonal) AS middle FROM fit),
        near AS (SELECT *, max(CASE WHEN diagonal = middle THEN low END) OVER (PARTITION BY doc_id, item_id, item, f) AS as_middle FROM fit2 WHERE abs(diagonal - middle) <= item_words),
        near2 AS (SELECT * FROM (SELECT *, max(CASE WHEN f IS NOT NULL AND low <> as_middle THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id, item, diagonal) AS apart FROM near) WHERE apart = 0),
        near3 AS (SELECT *, CASE WHEN f IS NOT NULL AND min(low) OVER w <> max(low) OVER w THEN 1 ELSE 0 END AS u FROM near2 WINDOW w AS (PARTITION BY doc_id, item_id, item, f)),
        near4 AS (SELECT * FROM (SELECT *, max(u) OVER (PARTITION BY doc_id, item_id, item) AS unlike FROM near3) WHERE unlike = 0 OR diagonal = middle),
        one AS (SELECT doc_id, item_id, item, item_words, f, sum(windows) AS windows, min(low) AS low, min(own) AS own, flatten(list(places)) AS places FROM near4 GROUP BY ALL),
        whole AS (SELECT doc_id, item_id, item_words, sum(windows)::BIGINT AS n_windows, len(list_distinct(flatten(list_transform(flatten(list(places)), lambda p: range(p.s, p.s + p.n)))))::BIGINT AS matched_words,
                count(CASE WHEN f IS NOT NULL AND low <> own THEN 1 END) AS changed_slots, item FROM one GROUP BY doc_id, item_id, item, item_words)
        SELECT doc_id, item_id, n_windows, matched_words, item_words::BIGINT AS item_words, changed_slots FROM whole WHERE matched_words >= {_COVER} * item_words
    """,
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w)),
        own AS (SELECT k, min(doc_id) AS o FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1),
        gone AS (SELECT DISTINCT doc_id, p + d AS i, TRUE AS g FROM win JOIN own USING (k), range(0, 50) r(d) WHERE o < doc_id),
        word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
        kept AS (SELECT doc_id, count(g) AS n, string_agg(x, ' ' ORDER BY i) FILTER (g IS NULL) AS t FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op9_chat_trees": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '{TRAP}'), (-7, 1, 'assistant', '{TRAP}')),
        e AS (SELECT *, {_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {len(chat_tree.TURN + chat_tree.TEXT + chat_tree.END)} AS n FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_turn_repair": f"""
        WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        part AS (SELECT *, {_CRC} % 20 AS part FROM keyed),
        damaged AS (SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role, CASE WHEN part = 1 THEN '' WHEN part = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(0, CASE WHEN part = 3 THEN 2 ELSE 1 END)) AS copy FROM part WHERE part <> 0),
        turns AS (SELECT *, row_number() OVER w AS r, role[1:1] AS initial, lag(role[1:1]) OVER w AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
        judged AS (SELECT *, CASE WHEN solid = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM turns),
        walk AS (SELECT conv_id, 0::BIGINT AS r, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS s0, {_NEVER} AS s1, {{'c': {turn_repair.INSERT}::BIGINT, 'e': 'I', 't': {_USER}}} AS s2, {{'c': {2 * turn_repair.INSERT}::BIGINT, 'e': 'II', 't': {_USER} || {_ASSISTANT}}} AS s3 FROM (SELECT DISTINCT conv_id FROM judged)
            UNION ALL SELECT conv_id, r, m0, m1, n2, {_LEAST('m3', _EDIT('n2', turn_repair.INSERT, 'I', _ASSISTANT))} FROM (SELECT *, {_CLOSED} AS n2
                FROM (SELECT conv_id, r, {_LAYER} FROM (SELECT w.conv_id, j.r, role, text, initial, fault, s0, s1, s2, s3, CASE WHEN fault = 3 THEN {turn_repair.CUT} ELSE 0 END AS stays, {_NEVER} AS never
                    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.r = w.r + 1)))),
        best AS (SELECT conv_id, {_LEAST('s0', 's3')} AS b FROM (SELECT *, max(r) OVER (PARTITION BY conv_id) AS m FROM walk) WHERE r = m),
        sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (r > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(b.c, 0) AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(b.t[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op12_license_scan": f"""
        WITH w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        t(label, half, need, tokens) AS (VALUES {_LISTS}),
        halves AS (SELECT DISTINCT half FROM t),
        block AS (SELECT id, half, unnest(list_transform(range(0, (len(ws) + half - 1) // half), lambda b: ws[b * half + 1:(b + 2) * half])) AS own FROM w, halves),
        met AS (SELECT id, label, len(list_intersect(tokens, own)) / len(tokens) AS share FROM block JOIN t USING (half) WHERE len(list_intersect(tokens, own)) >= need),
        found AS (SELECT id, list(DISTINCT label) AS more, max(share) AS share FROM met GROUP BY id),
        p(phrase, label) AS (VALUES {_PHRASES}),
        place AS (SELECT id, label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = phrase[1] AND ws[i:i + len(phrase) - 1] = phrase)) - 1 AS spot FROM w, p),
        base AS (SELECT id, count(*) AS n, min(spot) AS lo, max(spot) AS hi, list(DISTINCT label) AS labels FROM place GROUP BY id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
        FROM w LEFT JOIN found USING (id) LEFT JOIN base USING (id)
    """,
    "op7_exact_dedup": f"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {NORMAL} AS t FROM documents)
        WINDOW w AS (PARTITION BY t)
    """,
}
