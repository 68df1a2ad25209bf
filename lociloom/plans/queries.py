"""The registered queries over the derived tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import alignments as al
from ..operators import clusters as cl
from ..operators import haplotypes as hp
from ..operators import loci as lo
from ..operators import remap as rm
from ..params import Params
from ..sources.derived import SEQUENCE, derived, gaf_in_order, sequences, with_sql
from ..adapters.external import attempts, median_read, read_sequences
from ..sources.files import fasta_index, fetch_fasta, first_nodes, lines, numbered, parse_gaf, read_fasta, read_gaf, read_gfa, read_phase
from ..sources.sinks import fasta_records, write_blocks, write_fasta
from ..storage import by_shuffle, scratch, written
from ..streaming.loci import collect_signals, loci_so_far

P = Params()
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with SQL over the derived tables if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_sql(sql)
        return f

    return put


def _nodes(spark, d):
    return derived(spark, d, "gfa_node")


def _gaf(spark, d):
    return derived(spark, d, "gaf")


def joined(c: str):
    return F.array_join(F.sort_array(c), ",")


def _put(lines: DataFrame, spark: SparkSession, packed: bool = False) -> str:
    """The folder of text files that hold the lines; packed, of .gz files, one for each task."""
    path = scratch(spark, "text")
    lines.write.option("compression", "gzip" if packed else "none").text(path)
    return path


def _gfa_lines(spark: SparkSession, d: str) -> DataFrame:
    """The graph as the lines of a GFA file. Some segments stand twice (the first counts) and some lines are broken."""
    s = lambda c: F.col(c).cast("string")
    n = _nodes(spark, d).join(by_shuffle(sequences(spark, d)), "name")
    line = F.concat_ws("\t", F.lit("S"), "name", "sequence", F.concat(F.lit("LN:i:"), s("len")), F.concat(F.lit("SN:Z:"), "contig"), F.concat(F.lit("SO:i:"), s("offset")))
    again = F.when(F.col("name").endswith("3"), F.concat_ws("\t", F.lit("S"), "name", F.lit("A\tLN:i:1\tSN:Z:other\tSO:i:7")))
    broken = F.when(F.col("name").endswith("5"), F.concat_ws("\t", F.lit("S"), F.concat("name", F.lit("x")), F.lit("A\tLN:i:1\tSN\tSO:i:7")))
    short = F.when(F.col("name").endswith("7"), F.concat_ws("\t", F.lit("S"), F.concat("name", F.lit("y")), F.lit("A\tLN:i:1")))
    text = F.when(F.col("name").endswith("9"), F.concat_ws("\t", F.lit("S"), F.concat("name", F.lit("z")), F.lit("A\tLN:i:one\tSN:Z:c\tSO:i:7")))
    edge = derived(spark, d, "gfa_edge").select(F.concat_ws("\t", F.lit("L"), "src", F.lit("+"), "dst", F.lit("+"), F.lit("0M")).alias("value"))
    return n.select(F.concat_ws("\n", line, again, broken, short, text).alias("value")).union(edge)


def _gfa(spark: SparkSession, d: str, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same file, read back."""
    return read_gfa(spark, _put(_gfa_lines(spark, d), spark, packed))


NODE_FILE_SQL = f"""SELECT name, len, "offset", contig, md5(sequence) AS sequence_md5 FROM gfa_node JOIN (SELECT concat('s', p_partkey::VARCHAR) AS name, {SEQUENCE} AS sequence FROM part) USING (name)"""


@query(NODE_FILE_SQL)
def gfa_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a GFA file."""
    return first_nodes(_gfa(spark, d)[0]).select("name", "len", "offset", "contig", F.md5("sequence").alias("sequence_md5"))


@query(NODE_FILE_SQL)
def gfa_nodes_packed(spark: SparkSession, d: str) -> DataFrame:
    """The same of .gz files."""
    return first_nodes(_gfa(spark, d, packed=True)[0]).select("name", "len", "offset", "contig", F.md5("sequence").alias("sequence_md5"))


@query("SELECT * FROM gfa_edge")
def gfa_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links of a GFA file."""
    return _gfa(spark, d)[1].select("src", "dst")


ALIGNED = ("query_name", "query_length", "query_start", "query_end", "path", "path_start", "path_end", "mapq", "is_primary", "cigar")


def _gaf_text(rows: DataFrame) -> DataFrame:
    """Alignments as GAF lines. Secondary ones of mapping quality 7 are cut short; others have numbers with letters behind them."""
    s = lambda c: F.col(c).cast("string")
    fields = [F.concat("query_name", F.lit(" ch=1")), s("query_length"), s("query_start"), s("query_end"), F.lit("+"), F.col("path"), F.lit("0"), s("path_start"), s("path_end"), F.lit("0"), F.lit("0"), F.concat(s("mapq"), F.lit("x"))]
    line = F.concat_ws("\t", *fields, F.when(F.col("is_primary"), "tp:A:P").otherwise("tp:A:S"), F.concat(F.lit("cg:Z:"), F.col("cigar") if "cigar" in rows.columns else F.lit("")))
    return rows.select(F.when((F.col("mapq") == 7) & ~F.col("is_primary"), F.concat_ws("\t", *fields[:11])).otherwise(line).alias("value"))


ALIGNED_SQL = f"SELECT {', '.join(ALIGNED)} FROM gaf WHERE NOT (mapq = 7 AND NOT is_primary)"


VALID_LINES_SQL = ALIGNED_SQL + " AND mapq >= 5 AND is_primary"


@query(ALIGNED_SQL)
def gaf_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of a GAF file; lines cut short are left out."""
    return read_gaf(spark, _put(_gaf_text(_gaf(spark, d)), spark)).select(*ALIGNED)


@query(ALIGNED_SQL)
def gaf_alignments_packed(spark: SparkSession, d: str) -> DataFrame:
    """The same of .gz files."""
    return read_gaf(spark, _put(_gaf_text(_gaf(spark, d)), spark, packed=True)).select(*ALIGNED)


@query(VALID_LINES_SQL)
def gaf_alignments_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The valid ones of block-gzipped GAF files with short lines, read in ranges that part members and lines anywhere."""
    path = scratch(spark, "blocks")
    write_blocks(_gaf_text(_gaf(spark, d)).union(spark.range(3).select(F.concat(F.lit("short line\t"), "id"))), path, member_bytes=10_007)
    return al.valid(parse_gaf(lines(spark, path, range_bytes=50_021))).select(*ALIGNED)


@query("""SELECT count(*) AS lines, min(n) AS first, max(n) AS last, count(DISTINCT n) AS numbers, count(*) FILTER (n <= 1000) AS kept FROM (SELECT row_number() OVER () AS n FROM gaf)""")
def gaf_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers of GAF files, and the lines that a limit of 1,000 keeps."""
    rows = numbered(lines(spark, _put(_gaf_text(_gaf(spark, d)), spark)))
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"), F.max("line").alias("last"), F.count_distinct("line").alias("numbers"), F.count_if(F.col("line") <= 1000).alias("kept"))


@query("SELECT * EXCLUDE (line_no, has_sv) FROM remap WHERE NOT (mapq = 7 AND NOT is_primary)")
def remap_lines(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of alleles in a GAF file."""
    r = derived(spark, d, "remap")
    return read_gaf(spark, _put(_gaf_text(r), spark)).select(*[c for c in r.columns if c not in ("line_no", "has_sv")])


@query("SELECT * FROM phase")
def phase_tags(spark: SparkSession, d: str) -> DataFrame:
    """Haplotypes of a TSV file with comments, empty lines, short lines and reads that stand twice (the first counts)."""
    row = F.concat_ws("\t", "read_name", "haplotype", "phase_set", "contig")
    again = F.when(F.col("read_name").endswith("5"), F.concat_ws("\t", "read_name", F.lit("H9\tother\tother\tmore")))
    noise = F.when(F.col("read_name").endswith("7"), F.lit("#read\tH1\tps\tchr1\n\nread\tH1"))
    return read_phase(spark, _put(derived(spark, d, "phase").select(F.concat_ws("\n", row, again, noise)), spark)).select("read_name", "haplotype", "phase_set", "contig")


def _fasta(spark: SparkSession, d: str) -> str:
    record = F.concat(F.lit(">"), "name", F.lit(" of the graph\n"), fx.wrapped(F.col("sequence")))
    return _put(sequences(spark, d).select(record), spark)


@query(f"SELECT concat('s', p_partkey::VARCHAR) AS name, md5({SEQUENCE}) AS sequence_md5 FROM part")
def fasta_reads(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of a FASTA file, in lines of 60."""
    return read_fasta(spark, _fasta(spark, d)).select("name", F.md5("sequence").alias("sequence_md5"))


@query(f"SELECT concat('s', p_partkey::VARCHAR) AS name, md5({SEQUENCE}) AS sequence_md5 FROM part WHERE concat('s', p_partkey::VARCHAR) IN (SELECT DISTINCT regexp_extract(query_name, '(s[0-9]+)_', 1) FROM remap)")
def fasta_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The sequences of the nodes that alleles are named by, fetched by an index."""
    index = written(fasta_index(spark, _fasta(spark, d), range_bytes=100_003), scratch(spark, "index"))
    wanted = derived(spark, d, "remap").select(F.regexp_extract("query_name", "(s[0-9]+)_", 1).alias("name"))
    return fetch_fasta(index, wanted).select("name", F.md5("sequence").alias("sequence_md5"))


@query(
    """SELECT op, count(*) AS n, sum(len)::BIGINT AS bases, max(len) AS longest FROM (
         SELECT unnest(regexp_extract_all(cigar, '[0-9]+[MID]')) AS x FROM gaf), LATERAL (SELECT right(x, 1) AS op, left(x, length(x) - 1)::INT AS len) GROUP BY op"""
)
def cigar_ops(spark: SparkSession, d: str) -> DataFrame:
    ops = _gaf(spark, d).select(F.explode(fx.cigar_ops(F.col("cigar"))).alias("o"))
    return ops.groupBy("o.op").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o.len").cast("long")).alias("bases"), F.max("o.len").alias("longest"))


STEPS_SQL = """p AS (SELECT DISTINCT path, regexp_extract_all(path, '(?s).[^<>]*') AS st FROM gaf),
 step AS (SELECT path, i::INT AS i, left(st[i], 1) AS strand, substr(st[i], 2) AS node, len(st) AS n FROM (SELECT path, st, unnest(range(1, len(st) + 1)) AS i FROM p)),
 met AS (SELECT step.*, g.len::BIGINT AS len, g.offset::BIGINT AS "offset", g.contig, g.name IS NOT NULL AS present FROM step LEFT JOIN gfa_node g ON g.name = step.node)"""


@query(STEPS_SQL + """ SELECT strand, node, count(*) AS n, min(i) AS first_i, max(i) AS last_i FROM met GROUP BY strand, node""")
def path_steps(spark: SparkSession, d: str) -> DataFrame:
    step = _gaf(spark, d).select("path").distinct().select(F.explode(fx.path_steps(F.col("path"))).alias("s"))
    return step.groupBy("s.strand", "s.node").agg(F.count(F.lit(1)).alias("n"), F.min("s.i").alias("first_i"), F.max("s.i").alias("last_i"))


@query(f"""SELECT concat('s', p_partkey::VARCHAR) AS name, md5(translate(reverse({SEQUENCE}), 'ACGTacgt', 'TGCAtgca')) AS rc_md5 FROM part""")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("name", F.md5(fx.reverse_complement(F.col("sequence"))).alias("rc_md5"))


@query(
    """SELECT a.line_no, round(CASE WHEN least(a.path_end - a.path_start, 700) > 0 AND least(a.path_end, 900) > greatest(a.path_start, 200)
         THEN (least(a.path_end, 900) - greatest(a.path_start, 200)) / least(a.path_end - a.path_start, 700)::DOUBLE ELSE 0 END, 6) AS ratio FROM remap a"""
)
def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = derived(spark, d, "remap")
    return r.select("line_no", F.round(fx.overlap_ratio(F.col("path_start"), F.col("path_end"), F.lit(200), F.lit(900)), 6).alias("ratio"))


VALID = "valid AS (SELECT * FROM gaf WHERE mapq >= 5 AND is_primary), several AS (SELECT query_name FROM valid GROUP BY query_name HAVING count(*) > 1), mapped AS (SELECT * FROM valid WHERE NOT (query_start = 0 AND query_end = 0))"


@query(VALID + " SELECT * EXCLUDE (line_no) FROM valid")
def valid_alignments(spark: SparkSession, d: str) -> DataFrame:
    return al.valid(_gaf(spark, d)).drop("aln_score", "line_no")


@query(VALID + " SELECT query_name, count(*) AS n FROM valid GROUP BY query_name HAVING count(*) > 1")
def multi_mapped(spark: SparkSession, d: str) -> DataFrame:
    return al.multi_mapped(_gaf(spark, d))


@query("SELECT DISTINCT query_name FROM (SELECT query_name, CASE WHEN mapq = 6 THEN 0 ELSE query_start END AS s, CASE WHEN mapq = 6 THEN 0 ELSE query_end END AS e FROM gaf) WHERE s = 0 AND e = 0")
def unmapped_reads(spark: SparkSession, d: str) -> DataFrame:
    """With the lines of mapping quality 6 taken as unmapped, as the data has none."""
    zero = lambda c: F.when(F.col("mapq") == 6, 0).otherwise(F.col(c))
    return al.unmapped_reads(_gaf(spark, d).withColumns({"query_start": zero("query_start"), "query_end": zero("query_end")}))


@query("SELECT contig, sum(len)::BIGINT AS contig_length FROM gfa_node GROUP BY contig UNION ALL SELECT 'overall', sum(len)::BIGINT FROM gfa_node")
def contig_length(spark: SparkSession, d: str) -> DataFrame:
    return al.contig_length(_nodes(spark, d))


COVERAGE_SQL = (
    VALID + ", " + STEPS_SQL + """,
 s AS (SELECT m.line_no, m.path_end - m.path_start AS span, m.path_start, met.* FROM mapped m JOIN met USING (path) WHERE present),
 own AS (SELECT *, CASE WHEN n = 1 THEN span WHEN i = 1 THEN len - path_start ELSE len END AS b FROM s),
 cum AS (SELECT *, CASE WHEN n > 1 AND i = n THEN span - coalesce(sum(b) OVER (PARTITION BY line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE b END AS bases,
   CASE WHEN contig IS DISTINCT FROM lag(contig) OVER (PARTITION BY line_no ORDER BY i) THEN 1 ELSE 0 END AS run FROM own),
 sums AS (SELECT contig, sum(bases) AS mapped_bases, sum(run) AS mapped_reads FROM cum GROUP BY contig UNION ALL SELECT 'overall', sum(bases), count(DISTINCT line_no) FROM cum),
 lens AS (SELECT contig, sum(len)::BIGINT AS contig_length FROM gfa_node GROUP BY contig UNION ALL SELECT 'overall', sum(len)::BIGINT FROM gfa_node),
 cov AS (SELECT lens.contig, coalesce(mapped_bases, 0)::BIGINT AS mapped_bases, coalesce(mapped_reads, 0)::BIGINT AS mapped_reads, contig_length,
   CASE WHEN contig_length > 0 THEN coalesce(mapped_bases, 0)::DOUBLE / contig_length ELSE 0 END AS coverage FROM lens LEFT JOIN sums USING (contig))"""
)


@query(COVERAGE_SQL + " SELECT contig, mapped_bases, mapped_reads, contig_length, round(coverage, 6) AS coverage FROM cov")
def contig_coverage(spark: SparkSession, d: str) -> DataFrame:
    return al.contig_coverage(_gaf(spark, d), _nodes(spark, d)).withColumn("coverage", F.round("coverage", 6))


INTER_SQL = (
    VALID + ", " + STEPS_SQL + """,
 multi AS (SELECT * FROM mapped JOIN several USING (query_name)),
 b0 AS (SELECT m.line_no, 0 AS seq, query_name AS read, node, strand, len, "offset", contig, m.path_start::BIGINT AS spot FROM multi m JOIN met USING (path) WHERE i = 1 AND present AND query_start >= 200),
 bef AS (SELECT path, coalesce(sum(len) FILTER (i < n AND present), 0) AS before FROM met GROUP BY path),
 b1 AS (SELECT m.line_no, 1 AS seq, query_name AS read, node, strand, len, "offset", contig, (m.path_end - before)::BIGINT AS spot FROM multi m JOIN met USING (path) JOIN bef USING (path) WHERE i = n AND present AND query_length - query_end >= 200),
 inter AS (SELECT line_no, seq, read, node, CASE WHEN strand = '>' THEN spot ELSE len - spot END AS pos, "offset", contig FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1))"""
)


@query(INTER_SQL + """ SELECT seq, read, node, pos, "offset" + pos AS ref, contig FROM inter""")
def inter_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    return lo.inter_breakpoints(_gaf(spark, d), _nodes(spark, d)).drop("line_no")


INTRA_SQL = (
    INTER_SQL + """,
 ops AS (SELECT line_no, query_name AS read, path, path_start::BIGINT AS ps, regexp_extract_all(cigar, '[0-9]+[MIDX]') AS o FROM mapped),
 o2 AS (SELECT line_no, read, path, ps, k, right(o[k], 1) AS op, left(o[k], length(o[k]) - 1)::BIGINT AS v FROM (SELECT *, unnest(range(1, len(o) + 1)) AS k FROM ops)),
 o3 AS (SELECT *, 1 + coalesce(sum(CASE WHEN op = 'I' THEN 0 ELSE v END) OVER (PARTITION BY line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cig FROM o2),
 sig AS (SELECT line_no, read, path, ps, (k + 1)::INT AS seq, op, v, cig FROM o3 WHERE op IN ('I', 'D') AND v >= 50),
 walk AS (
   SELECT line_no, read, path, ps, seq, op, v, cig AS c, 0::BIGINT AS tot, 0::BIGINT AS reach, FALSE AS sp, 0 AS i, FALSE AS done, NULL::VARCHAR AS node, NULL::VARCHAR AS contig, NULL::BIGINT AS pos, NULL::BIGINT AS "offset" FROM sig
   UNION ALL
   SELECT line_no, read, path, ps, seq, op, v,
     CASE WHEN present AND NOT ok AND mi < n AND strand = '<' AND op = 'D' AND c < r THEN c + v ELSE c END,
     CASE WHEN present AND NOT ok AND mi < n THEN r ELSE tot END,
     CASE WHEN present THEN r ELSE reach END,
     sp OR (present AND NOT ok AND mi < n AND strand = '<' AND op = 'D' AND c < r), mi, present AND ok,
     CASE WHEN present AND ok THEN mnode END, CASE WHEN present AND ok THEN mcontig END,
     CASE WHEN present AND ok THEN CASE WHEN strand = '>' THEN p WHEN op = 'D' AND NOT sp THEN len - p - v ELSE len - p END END, CASE WHEN present AND ok THEN moffset END
   FROM (SELECT *, CASE WHEN mi = 1 THEN ps + c ELSE c - tot END AS p,
           n = 1 OR coalesce(CASE WHEN mi < n THEN f <= r ELSE f >= r END, FALSE) AS ok
         FROM (SELECT w.*, m.i AS mi, m.n, m.strand, m.node AS mnode, m.len, m.contig AS mcontig, m."offset" AS moffset, m.present,
                 CASE WHEN m.i = m.n THEN w.reach WHEN m.i = 1 THEN m.len - ps ELSE w.tot + m.len END AS r,
                 CASE WHEN op <> 'D' OR sp OR m.strand = '>' THEN c WHEN m.strand = '<' THEN c + v END AS f
               FROM walk w JOIN met m ON m.path = w.path AND m.i = w.i + 1 WHERE NOT w.done))),
 intra AS (SELECT line_no, seq, read, node, pos, "offset", contig, op, v FROM walk WHERE done)"""
)


@query(INTRA_SQL + """ SELECT seq, read, node, pos, "offset" + pos AS ref, contig, op AS sv_type, v AS sv_size FROM intra""")
def intra_loci(spark: SparkSession, d: str) -> DataFrame:
    return lo.intra_loci(_gaf(spark, d), _nodes(spark, d)).drop("line_no")


LOCI_SQL = (
    INTRA_SQL + """,
 sgn AS (SELECT line_no, seq, read, node, pos, "offset" + pos AS ref, contig, 'INTER' AS type, '' AS sv_type, 0 AS sv_size FROM inter
   UNION ALL SELECT line_no, seq, read, node, pos, "offset" + pos, contig, 'INTRA', op, v FROM intra),
 loci AS (SELECT node, pos, min(ref) AS ref, min(contig) AS contig, list_sort(list(DISTINCT read)) AS reads,
   arg_min({'t': type, 's': sv_type, 'v': sv_size}, (line_no, seq)) AS f FROM sgn GROUP BY node, pos)"""
)


@query(LOCI_SQL + """ SELECT node, pos, ref, contig, array_to_string(reads, ',') AS reads, f.t AS type, f.s AS sv_type, f.v::BIGINT AS sv_size FROM loci""")
def sv_loci(spark: SparkSession, d: str) -> DataFrame:
    return _loci(spark, d).withColumn("reads", joined("reads"))


@query(LOCI_SQL + """ SELECT node, pos, ref, contig, array_to_string(reads, ',') AS reads, f.t AS type, f.s AS sv_type, f.v::BIGINT AS sv_size FROM loci""")
def sv_loci_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same of streams over GAF files in the order of the lines, a few files at a time; the second run finds nothing new."""
    path, out, checkpoint = _put(_gaf_text(gaf_in_order(spark, d)), spark), scratch(spark, "signals"), scratch(spark, "checkpoint")
    for files_per_batch in (3, 1):
        collect_signals(spark, path, _nodes(spark, d), out, checkpoint, files_per_batch)
    return loci_so_far(spark, out).withColumn("reads", joined("reads"))


@query(
    LOCI_SQL + """ SELECT count(*) FILTER (f.s = 'I') AS insertions, count(*) FILTER (f.s = 'D') AS deletions, count(*) FILTER (f.t = 'INTER') AS inter,
    count(*) FILTER (f.t = 'INTRA') AS intra, (SELECT count(*) FROM valid) AS primary_valid, (SELECT count(DISTINCT query_name) FROM gaf WHERE query_start = 0 AND query_end = 0) AS unmapped FROM loci"""
)
def signal_counters(spark: SparkSession, d: str) -> DataFrame:
    return lo.signal_counters(derived(spark, d, "gaf_by_read"), _nodes(spark, d))


def _loci(spark, d):
    return lo.sv_loci(derived(spark, d, "gaf_by_read"), _nodes(spark, d))


def _clusters(spark, d, last=False):
    nodes = _nodes(spark, d)
    return cl.of_signals(lo.signals(derived(spark, d, "gaf_by_read"), nodes), nodes, P.dist, last)


CLUSTER_SQL = (
    LOCI_SQL + f""",
 rk AS (SELECT l.*, row_number() OVER (PARTITION BY l.node ORDER BY pos) AS r FROM loci l JOIN gfa_node g ON g.name = l.node),
 fold AS (SELECT node, r, 1 AS k, pos AS last, pos AS start, ref, contig, reads FROM rk WHERE r = 1
   UNION ALL
   SELECT f.node, x.r, CASE WHEN j THEN f.k ELSE f.k + 1 END, x.pos, CASE WHEN j THEN f.start ELSE x.pos END, CASE WHEN j THEN f.ref ELSE x.ref END, CASE WHEN j THEN f.contig ELSE x.contig END,
     CASE WHEN j THEN list_sort(list_distinct(list_concat(f.reads, x.reads))) ELSE x.reads END
   FROM fold f JOIN rk x ON x.node = f.node AND x.r = f.r + 1, LATERAL (SELECT f.last + {P.dist} >= x.pos OR list_has_all(f.reads, x.reads) AS j)),
 clus AS (SELECT node, k, arg_max({{'s': start, 'r': ref, 'c': contig, 'reads': reads}}, r) AS c FROM fold GROUP BY node, k)"""
)


@query(CLUSTER_SQL + " SELECT node, k, c.s AS start, c.r AS ref, c.c AS contig, array_to_string(c.reads, ',') AS reads FROM clus")
def clusters_within_node(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).withColumn("reads", joined("reads"))


CANDIDATE_SQL = (
    CLUSTER_SQL + f""",
 ends AS (SELECT node, min(k) AS fk, arg_min(c.s, k) AS fs, max(k) AS bk, arg_max(c.s, k) AS bs FROM clus GROUP BY node),
 cand AS (SELECT y.node AS y, x.node AS x, y.fk AS y_k, x.bk AS x_k, g.len - x.bs + y.fs AS distance FROM gfa_edge e JOIN ends y ON y.node = e.dst JOIN ends x ON x.node = e.src JOIN gfa_node g ON g.name = x.node
   WHERE y.fs < {P.dist} AND g.len - x.bs + y.fs < {P.dist})"""
)


@query(CANDIDATE_SQL + " SELECT * FROM cand")
def neighbor_candidates(spark: SparkSession, d: str) -> DataFrame:
    return cl.candidates(_clusters(spark, d), derived(spark, d, "gfa_edge"), _nodes(spark, d), P.dist).drop("ord")


# A first cluster is inactive if it is some earlier, active node's candidate; unrolled, as recursion can't negate.
_ACTIVE = [
    f"act{k + 1} AS (SELECT DISTINCT y, y_k FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand z JOIN act{k} t ON t.y = z.y WHERE z.x = a.y AND z.x_k = a.y_k AND z.y < a.y))" if k else "act1 AS (SELECT DISTINCT y, y_k FROM cand)"
    for k in range(7)
]
_GIVEN = [
    "giv0 AS (SELECT c.y, c.y_k, c.x, c.x_k FROM cand c JOIN act7 t ON t.y = c.y)",
    *[f"giv{k + 1} AS (SELECT * FROM giv{k} UNION SELECT a.y, a.y_k, b.x, b.x_k FROM giv0 a JOIN giv{k} b ON b.y = a.x AND a.x_k = 1 AND a.x < a.y)" for k in range(4)],
]
MERGED_SQL = (
    CANDIDATE_SQL + ", " + ", ".join(_ACTIVE + _GIVEN) + """,
 more AS (SELECT y AS node, y_k AS k, list_distinct(flatten(list(c.reads))) AS more FROM giv4 JOIN clus ON clus.node = x AND clus.k = x_k GROUP BY y, y_k),
 gone AS (SELECT DISTINCT x AS node, x_k AS k FROM giv0),
 merged AS (SELECT node, k, c.s AS start, c.r AS ref, c.c AS contig, list_sort(list_distinct(list_concat(c.reads, coalesce(more, [])))) AS reads, gone.node IS NOT NULL AS merged_away
   FROM clus LEFT JOIN more USING (node, k) LEFT JOIN gone USING (node, k))"""
)


def _merged(spark, d, gone_too=False):
    clusters = written(_clusters(spark, d, last=True), scratch(spark, "clusters"))
    return cl.merge_neighbours(clusters, derived(spark, d, "gfa_edge"), _nodes(spark, d), P.dist, gone_too)


@query(MERGED_SQL + " SELECT node, k, start, ref, contig, array_to_string(reads, ',') AS reads, merged_away FROM merged")
def clusters_merged(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, gone_too=True).withColumn("reads", joined("reads"))


FINAL_SQL = MERGED_SQL + f", fin AS (SELECT * FROM merged WHERE NOT merged_away AND len(reads) > {P.support})"


def _final(spark, d):
    return cl.final_clusters(_merged(spark, d), P.support)


@query(FINAL_SQL + " SELECT node, k, start, ref, contig, array_to_string(reads, ',') AS reads FROM fin")
def final_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d).withColumn("reads", joined("reads"))


PHASE_SQL = (
    FINAL_SQL + """,
 tag AS (SELECT node, k, read, CASE WHEN haplotype IS NULL OR haplotype = 'none' OR phase_set = 'none' THEN 'untagged' WHEN haplotype IN ('H1', 'H2') THEN haplotype ELSE 'other' END AS tag
   FROM (SELECT node, k, unnest(reads) AS read FROM fin) LEFT JOIN phase ON phase.read_name = read),
 split AS (SELECT fin.node, fin.k, any_value(start) AS start, any_value(ref) AS ref, any_value(fin.contig) AS contig, coalesce(list_sort(list(read) FILTER (tag = 'H1')), []) AS h1,
   coalesce(list_sort(list(read) FILTER (tag = 'H2')), []) AS h2, coalesce(list_sort(list(read) FILTER (tag IN ('untagged', 'other'))), []) AS untagged FROM fin JOIN tag USING (node, k) GROUP BY fin.node, fin.k)"""
)


def _split(spark, d):
    return hp.phase_split(_final(spark, d), derived(spark, d, "phase"))


@query(PHASE_SQL + " SELECT node, k, start, ref, contig, array_to_string(h1, ',') AS h1, array_to_string(h2, ',') AS h2, array_to_string(untagged, ',') AS untagged FROM split")
def phase_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).withColumns({c: joined(c) for c in ("h1", "h2", "untagged")})


@query(PHASE_SQL + " SELECT tag, count(DISTINCT read) AS reads, count(DISTINCT (node, k)) AS clusters FROM tag WHERE tag <> 'other' GROUP BY tag")
def phase_summary(spark: SparkSession, d: str) -> DataFrame:
    return hp.phase_summary(_final(spark, d), derived(spark, d, "phase"))


COVERAGE_PARTS = COVERAGE_SQL[COVERAGE_SQL.index(" s AS (SELECT m.line_no") :]
GATE_SQL = (
    PHASE_SQL + "," + COVERAGE_PARTS + """,
 cnd AS (SELECT node, k, contig, start, len(h1) + len(h2) + len(untagged) AS cluster_reads, unnest([{'h': 'H1', 'n': len(h1), 'r': h1}, {'h': 'H2', 'n': len(h2), 'r': h2}, {'h': 'None', 'n': len(untagged), 'r': untagged}]) AS x FROM split),
 gat AS (SELECT concat(x.h, '-', node, '_', start) AS name, x.h AS hap, x.n AS n_reads, x.r AS reads, cluster_reads, greatest(5, coalesce(coverage, 0)) AS depth,
   CASE WHEN 2 * greatest(5, coalesce(coverage, 0)) < cluster_reads THEN 'high_coverage' WHEN greatest(5, coalesce(coverage, 0)) > 5 * cluster_reads THEN 'low_coverage'
     WHEN x.n < 3 THEN 'low_support' WHEN greatest(5, coalesce(coverage, 0)) > 100 THEN 'max_contig_depth' ELSE 'pass' END AS reason FROM cnd LEFT JOIN cov USING (contig))"""
)


def _gate(spark, d):
    return hp.gate(hp.candidates(_split(spark, d), phased=True), al.contig_coverage(_gaf(spark, d), _nodes(spark, d)), P.support)


@query(GATE_SQL + " SELECT name, hap, n_reads::INT AS n_reads, cluster_reads::INT AS cluster_reads, round(depth, 6) AS depth, round((n_reads - depth) / sqrt(depth), 4) AS zscore, reason FROM gat")
def assembly_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).select("name", "hap", F.size("reads").alias("n_reads"), "cluster_reads", F.round("depth", 6).alias("depth"), F.round("zscore", 4).alias("zscore"), "reason")


@query(GATE_SQL + " SELECT CASE WHEN reason = 'max_contig_depth' THEN 'high_coverage' ELSE reason END AS reason, count(*) AS n FROM gat GROUP BY ALL")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    return hp.gate_counts(_gate(spark, d))


@query(GATE_SQL + " SELECT name FROM gat WHERE reason = 'pass'")
def svtig_names(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).where("reason = 'pass'").select("name")


#: Reads as in a FASTA file (of the reads whose order number is not a multiple of 4): names and sequences.
READ_SQL = f"""rds AS (SELECT concat('r', o_orderkey::VARCHAR) AS read, {SEQUENCE.replace("p_partkey", "o_orderkey")} AS sequence FROM orders WHERE o_orderkey % 4 <> 0),
 got AS (SELECT name, read, sequence FROM (SELECT name, unnest(reads) AS read FROM gat WHERE reason = 'pass') JOIN rds USING (read))"""


def _reads_file(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 4 != 0")
    return orders.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.expr(SEQUENCE.replace("p_partkey", "o_orderkey")).alias("sequence"))


@query(GATE_SQL + ", " + READ_SQL + " SELECT name, read, md5(sequence) AS sequence_md5 FROM got")
def assembly_reads(spark: SparkSession, d: str) -> DataFrame:
    """The reads of the candidates that pass, with their sequences."""
    return read_sequences(_gate(spark, d).where("reason = 'pass'"), _reads_file(spark, d)).select("name", "read", F.md5("sequence").alias("sequence_md5"))


@query(
    GATE_SQL + ", " + READ_SQL + """, mid AS (SELECT name, sequence, row_number() OVER (PARTITION BY name ORDER BY length(sequence), sequence) - 1 AS r, count(*) OVER (PARTITION BY name) AS n FROM got)
 SELECT gat.name, CASE WHEN gat.reason = 'pass' AND mid.name IS NULL THEN 'no_contig' ELSE gat.reason END AS reason, md5(mid.sequence) AS contig_md5 FROM gat LEFT JOIN mid ON mid.name = gat.name AND gat.reason = 'pass' AND mid.r = mid.n // 2"""
)
def assembly_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What comes of each candidate, with the built-in median read as its contig."""
    gated = written(_gate(spark, d), scratch(spark, "gated"))
    done = written(attempts(gated.where("reason = 'pass'"), _reads_file(spark, d), median_read), scratch(spark, "attempts"))
    return hp.outcomes(gated, done).join(done.where("sequence IS NOT NULL").select("name", F.md5("sequence").alias("contig_md5")), "name", "left").select("name", "reason", "contig_md5")


FOLD_SQL = """ln AS (SELECT *, (query_end - query_start)::DOUBLE / query_length AS ratio, mapq >= 5 AND is_primary AS good, row_number() OVER (PARTITION BY query_name ORDER BY line_no) AS r FROM remap),
 rf AS (SELECT query_name AS name, r, ratio, path, path_start AS start, path_end AS "end", has_sv AS sv, query_length AS size, CASE WHEN good THEN 1 ELSE 0 END::BIGINT AS freq FROM ln WHERE r = 1
   UNION ALL
   SELECT f.name, l.r, CASE WHEN l.good OR (NOT f.sv AND l.has_sv) THEN greatest(f.ratio, l.ratio) ELSE f.ratio END, CASE WHEN t THEN l.path ELSE f.path END,
     CASE WHEN t THEN l.path_start ELSE f.start END, CASE WHEN t THEN l.path_end ELSE f."end" END, f.sv OR (NOT l.good AND l.has_sv), f.size, f.freq + CASE WHEN l.good THEN 1 ELSE 0 END
   FROM rf f JOIN ln l ON l.query_name = f.name AND l.r = f.r + 1, LATERAL (SELECT CASE WHEN l.good THEN f."end" - f.start < l.path_end - l.path_start ELSE NOT f.sv AND l.has_sv END AS t)),
 folded AS (SELECT * EXCLUDE (r) FROM rf QUALIFY row_number() OVER (PARTITION BY name ORDER BY r DESC) = 1)"""


def _fold(spark, d):
    return rm.fold(derived(spark, d, "remap"))


@query(FOLD_SQL + """ SELECT name, round(ratio, 6) AS ratio, path, start, "end", sv, size, freq FROM folded""")
def remap_fold(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d).withColumn("ratio", F.round("ratio", 6))


DECISION_SQL = (
    FOLD_SQL + f""",
 dec AS (SELECT *, CASE WHEN ratio <= 0 THEN 'no_mapping' WHEN freq > 1 THEN 'several_mappings' WHEN ratio < {P.min_map_ratio} THEN 'low_map_ratio' WHEN sv THEN 'sv_in_alignment' ELSE 'high_map_ratio' END AS reason FROM folded)"""
)


def _decided(spark, d):
    return rm.decisions(_fold(spark, d), P.min_map_ratio)


@query(DECISION_SQL + " SELECT name, reason, reason NOT IN ('no_mapping', 'high_map_ratio') AS keep FROM dec")
def remap_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("name", "reason", "keep")


DEDUP_SQL = (
    DECISION_SQL + """,
 kp AS (SELECT *, CASE WHEN name LIKE 'H1-%' THEN 'H1-' WHEN name LIKE 'H2-%' THEN 'H2-' WHEN name LIKE 'None-%' THEN 'None-' ELSE '' END AS hap FROM dec WHERE reason NOT IN ('no_mapping', 'high_map_ratio')),
 kr AS (SELECT *, row_number() OVER (PARTITION BY hap, path ORDER BY size DESC, name) AS r FROM kp),
 nms AS (SELECT hap, path, r, name, FALSE AS duplicate, [{'s': start, 'e': "end"}] AS have FROM kr WHERE r = 1
   UNION ALL
   SELECT k.hap, k.path, k.r, k.name, d, CASE WHEN d THEN have ELSE list_append(have, {'s': k.start, 'e': k."end"}) END
   FROM nms JOIN kr k ON k.hap = nms.hap AND k.path = nms.path AND k.r = nms.r + 1,
   LATERAL (SELECT len(list_filter(have, lambda h: CASE WHEN least(k."end" - k.start, h.e - h.s) > 0 AND least(k."end", h.e) > greatest(k.start, h.s)
     THEN (least(k."end", h.e) - greatest(k.start, h.s))::DOUBLE / least(k."end" - k.start, h.e - h.s) ELSE 0 END > 0.9)) > 0 AS d))"""
)


def _deduped(spark, d):
    return rm.without_duplicates(_decided(spark, d).where("keep"))


@query(DEDUP_SQL + " SELECT name, hap, path, duplicate FROM nms")
def dedup_svtigs(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d).select("name", "hap", "path", "duplicate")


OUTPUT_SQL = (
    DEDUP_SQL + """,
 reg AS (SELECT DISTINCT query_name AS name, (length(query_name) * 100)::INT AS pos, 'chr1' AS contig, 3 AS support FROM remap WHERE query_name NOT LIKE '%\\_%\\_%' ESCAPE '\\'),
 outp AS (SELECT n.name, reg.pos, reg.contig, reg.support, f.path, f.ratio FROM nms n JOIN folded f USING (name) JOIN reg ON reg.name = CASE WHEN n.name LIKE '%\\_%\\_%' ESCAPE '\\' THEN regexp_extract(n.name, '^(.*)_[^_]*$', 1) ELSE n.name END WHERE NOT duplicate)"""
)


def _output(spark, d):
    reg = derived(spark, d, "remap").select(F.col("query_name").alias("name")).where("NOT name RLIKE '_.*_'").distinct()
    reg = reg.select("name", (F.length("name") * 100).alias("pos"), F.lit("chr1").alias("contig"), F.lit(3).alias("support"))
    return rm.flagged(_deduped(spark, d), reg)


@query(OUTPUT_SQL + """ SELECT name, format('>{} contig={} pos={} support={} path={} map_ratio={}', name, contig, pos, support, path, printf('%g', ratio)) AS header FROM outp""")
def svtig_headers(spark: SparkSession, d: str) -> DataFrame:
    return rm.headers(_output(spark, d))


@query(OUTPUT_SQL + r""" SELECT count(*) FILTER (mapq >= 5 AND is_primary) AS good, count(*) FILTER (NOT is_primary) AS secondary, count(*) FILTER (mapq < 5) AS low_mapq,
    (SELECT count(*) FROM outp WHERE name LIKE '%\_%\_%' ESCAPE '\') AS extra FROM remap""")
def remap_counters(spark: SparkSession, d: str) -> DataFrame:
    return rm.counters(derived(spark, d, "remap"), _output(spark, d))


WRAPPED = "array_to_string(list_transform(range(0, (length(sequence) + 59) // 60), lambda i: substr(sequence, 60 * i + 1, 60)), chr(10))"


@query(
    OUTPUT_SQL + f""", seqs AS (SELECT outp.*, {SEQUENCE} AS sequence FROM outp JOIN part ON concat('s', p_partkey::VARCHAR) = regexp_extract(name, '(s[0-9]+)_', 1)),
 rec AS (SELECT name, concat(format('>{{}} contig={{}} pos={{}} support={{}} path={{}} map_ratio={{}}', name, contig, pos, support, path, printf('%g', ratio)), chr(10), {WRAPPED}) AS record FROM seqs)
 SELECT (row_number() OVER (ORDER BY name COLLATE "C"))::INT AS place, md5(record) AS record_md5 FROM rec""".replace(' COLLATE "C"', "")
)
def fasta_output(spark: SparkSession, d: str) -> DataFrame:
    """The alleles (here with a node's sequence each) as written to FASTA files, read back record by record in the files' order."""
    out = _output(spark, d)
    own = out.select("name", F.regexp_extract("name", "(s[0-9]+)_", 1).alias("node")).join(by_shuffle(sequences(spark, d).withColumnRenamed("name", "node")), "node")
    path = scratch(spark, "fasta")
    write_fasta(fasta_records(rm.headers(out), own), path)
    text = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\n\\z", "")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return numbered(text.select(F.concat(F.lit(">"), record).alias("record"), place.alias("line_no"))).select(F.col("line").cast("int").alias("place"), F.md5("record").alias("record_md5"))


@query(OUTPUT_SQL + " SELECT name, unnest(list_filter([CASE WHEN contains(name, 'H1') THEN 'H1' END, CASE WHEN contains(name, 'H2') THEN 'H2' END, CASE WHEN NOT contains(name, 'H1') AND NOT contains(name, 'H2') THEN 'untagged' END], lambda x: x IS NOT NULL)) AS file FROM outp")
def haplotype_files(spark: SparkSession, d: str) -> DataFrame:
    return rm.haplotype_files(_output(spark, d).select("name"))


@query(
    STEPS_SQL + f""", seqs AS (SELECT concat('s', p_partkey::VARCHAR) AS node, {SEQUENCE} AS sequence FROM part),
 whole AS (SELECT path, string_agg(CASE WHEN strand = '<' THEN translate(reverse(sequence), 'ACGTacgt', 'TGCAtgca') ELSE sequence END, '' ORDER BY i) AS w FROM step JOIN seqs USING (node) GROUP BY path),
 cut AS (SELECT path, path_start, path_end, CASE WHEN path_start <= length(w) THEN substr(w, path_start + 1, greatest(0, path_end - path_start + 1)) ELSE '' END AS s FROM gaf LEFT JOIN whole USING (path))
 SELECT path, path_start, path_end, coalesce(length(s), 0) AS bases, md5(coalesce(s, '')) AS sequence_md5 FROM cut"""
)
def path_sequence(spark: SparkSession, d: str) -> DataFrame:
    out = rm.path_sequences(_gaf(spark, d).select("path", "path_start", "path_end"), _nodes(spark, d), sequences(spark, d))
    return out.select("path", "path_start", "path_end", F.length("path_sequence").cast("long").alias("bases"), F.md5("path_sequence").alias("sequence_md5"))


@query("SELECT line_no, line_no % 3 = 1 AS has_sv FROM remap")
def realign_has_sv(spark: SparkSession, d: str) -> DataFrame:
    """Each remapped allele against its path's sequence. The allele is that sequence with 60 bases put in (every third), 40 bases put in, or two others."""
    rows = derived(spark, d, "remap").select("line_no", "path", "path_start", "path_end")
    rows = rm.path_sequences(rows, _nodes(spark, d), sequences(spark, d))
    s, k = F.col("path_sequence"), F.col("line_no") % 3
    put = lambda x: F.concat(F.substring(s, 1, 100), x, F.substring(s, 101, 10_000))
    allele = F.when(k == 1, put(F.repeat(F.lit("N"), 60))).when(k == 2, put(F.repeat(F.lit("N"), 40))).otherwise(F.concat(F.lit("NN"), F.substring(s, 3, 10_000)))
    rows = rows.withColumns({"query_sequence": allele, "query_start": F.lit(0), "query_end": F.length(allele) - 1})
    return rm.with_has_sv(rows).select("line_no", "has_sv")
