"""The jobs as registered queries, and their SQL. Each runs its job twice into one new folder and gives the output of both."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import sv_atlas, text_sequences
from jobs.common import config
from lociloom.plans.queries import COVERAGE_PARTS, PHASE_SQL
from lociloom.sources.derived import with_sql
from lociloom.storage import scratch


def _settings(kind: type, name: str):
    return config(kind, Path(__file__).with_name(f"{name}.json"))


def job1_sv_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The atlas of all tables."""
    out, settings = f"{scratch(spark, 'job1')}/atlas", _settings(sv_atlas.Config, "sv_atlas")
    sv_atlas.run(spark, settings, sf_dir, out)
    return sv_atlas.run(spark, settings, sf_dir, out)


def job2_text_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions, with what the catalogue says of their sequences. The table may be a file or a folder, and a pattern stands for both."""
    base, settings = scratch(spark, "job2"), _settings(text_sequences.Config, "text_sequences")
    for _ in range(2):
        rows, every = text_sequences.run(spark, settings, f"{sf_dir}/documents*.parquet", f"{base}/out", f"{base}/checkpoint")
    return rows.join(every.drop("bases"), "sequence")


QUERIES = {"job1_sv_atlas": job1_sv_atlas, "job2_text_sequences": job2_text_sequences}

_GATE = "CASE WHEN 2 * depth < n THEN 'high_coverage' WHEN depth > 5 * n THEN 'low_coverage' WHEN {0} < 3 THEN 'low_support' WHEN depth > 100 THEN 'max_contig_depth' ELSE 'pass' END"

ORACLE = {
    "job1_sv_atlas": with_sql(
        PHASE_SQL + "," + COVERAGE_PARTS + f""",
 one AS (SELECT split.*, len(h1) AS a, len(h2) AS b, len(untagged) AS u, len(h1) + len(h2) + len(untagged) AS n, greatest(5, coalesce(coverage, 0))::DOUBLE AS depth FROM split LEFT JOIN cov USING (contig)),
 gates AS (SELECT *, {_GATE.format('a')} AS ga, {_GATE.format('b')} AS gb, {_GATE.format('u')} AS gu FROM one)
 SELECT contig, node, k::INT AS k, start, ref, floor(ref / 100000)::BIGINT AS bin, n::INT AS reads, a::INT AS h1, b::INT AS h2, u::INT AS untagged, depth, ga AS h1_gate, gb AS h2_gate, gu AS untagged_gate,
   CASE WHEN ga = 'pass' AND gb = 'pass' THEN '1|1' WHEN ga = 'pass' THEN '1|0' WHEN gb = 'pass' THEN '0|1' WHEN gu = 'pass' THEN '0/1' ELSE './.' END AS zygosity FROM gates"""
    ),
    "job2_text_sequences": r"""
        WITH w AS (SELECT doc_id, source, lang AS language, list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda w: regexp_full_match(w, '[ACGTNacgtn]{4,}')) AS ws FROM documents),
        m AS (SELECT doc_id, source, language, i - 1 AS nth, ws[i] AS found, upper(ws[i]) AS s FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
        r AS (SELECT *, translate(reverse(s), 'ACGT', 'TGCA') AS rc FROM m),
        k AS (SELECT doc_id, source, language, nth::INT AS nth, found, least(s, rc) AS sequence, length(found)::INT AS bases, rc < s AS reversed, CASE WHEN regexp_full_match(language, '[a-z]{2,3}') THEN language ELSE 'other' END AS lang FROM r),
        c AS (SELECT sequence, count(*) AS mentions, count(*) FILTER (NOT reversed) AS forward, count(DISTINCT language) AS languages FROM k GROUP BY sequence)
        SELECT * FROM k JOIN c USING (sequence)
    """,
}
