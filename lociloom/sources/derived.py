"""The data model derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GFA_NODE = """SELECT concat('s',cast(p_partkey as string)) AS name, cast(1000+(p_partkey*37)%1500 as int) AS len,
 CASE WHEN p_partkey%7=0 THEN concat('alt',cast(1+(p_partkey%3) as string))
      ELSE concat('chr',cast(1+(p_partkey-p_partkey%50)%1200 as string)) END AS contig,
 cast((p_partkey%50)*2000 as int) AS offset FROM part"""

GFA_EDGE = """SELECT concat('s',cast(a.p_partkey as string)) AS src, concat('s',cast(b.p_partkey as string)) AS dst
FROM part a JOIN (SELECT p_partkey AS k, p_partkey+1 AS t FROM part UNION ALL SELECT p_partkey AS k, p_partkey+2 AS t FROM part WHERE (p_partkey+1)%7=0) n ON n.k=a.p_partkey
JOIN part b ON b.p_partkey=n.t"""

GAF = """SELECT line_no, concat('r',cast(l_orderkey as string)) AS query_name, 9000 AS query_length,
 cast((l_suppkey*11+l_linenumber*97)%500 as int) AS query_start,
 cast(9000-(l_partkey*17+l_linenumber*41)%500 as int) AS query_end,
 CASE WHEN l_returnflag='R' THEN concat(
   CASE WHEN n>2 THEN concat('<s',cast(l_partkey+2 as string)) ELSE '' END,
   CASE WHEN n>1 THEN concat('<s',cast(l_partkey+1 as string)) ELSE '' END,
   concat('<s',cast(l_partkey as string)))
 ELSE concat(CASE WHEN (l_partkey+l_linenumber)%19=0 THEN '*s' ELSE '>s' END,cast(l_partkey as string),
   CASE WHEN n>1 THEN concat('>s',cast(l_partkey+1 as string)) ELSE '' END,
   CASE WHEN n>2 THEN concat('>s',cast(l_partkey+2 as string)) ELSE '' END) END AS path,
 ps AS path_start, ps+a+(CASE WHEN l_linestatus='F' THEN b ELSE 0 END)+c AS path_end,
 cast((l_suppkey*3+l_linenumber)%61 as int) AS mapq, (l_partkey+l_linenumber)%10<>0 AS is_primary,
 concat(cast(a as string),'M',cast(b as string),CASE WHEN l_linestatus='F' THEN 'D' ELSE 'I' END,cast(c as string),'M') AS cigar
FROM (SELECT *, 1+l_linenumber%3 AS n, cast((l_suppkey*13)%400 as int) AS ps,
   cast(50+(l_suppkey*7+l_linenumber*31+l_partkey*53)%(500+1200*(l_linenumber%3)) as int) AS a,
   cast(3*l_quantity as int) AS b, cast(60+l_suppkey%40 as int) AS c,
   {line_no} AS line_no FROM lineitem) t"""

#: A line's place is its rank by all columns. Only first arrivals depend on it, and they need the order, not the number, which
#: would take a sort of all lines in one task: Spark gets the columns themselves, DuckDB the rank.
ORDERED = "struct(l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate,l_discount,l_tax,l_returnflag,l_linestatus)"
RANKED = "row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate,l_discount,l_tax,l_returnflag,l_linestatus)"

#: The same order in two short columns, where the number goes through shuffles: the first of those columns, and the rank by the others within the read.
BY_READ = ORDERED.replace("struct(l_orderkey,", "struct(l_orderkey,row_number() OVER (PARTITION BY read_name ORDER BY ").replace("linestatus)", "linestatus) AS nth)")
READ_NAME = "concat('r',cast(l_orderkey as string))"
GAF_BY_READ = GAF.replace(f"{READ_NAME} AS query_name", "read_name AS query_name").replace("FROM lineitem", f"FROM (SELECT *, {READ_NAME} AS read_name FROM lineitem) l").format(line_no=BY_READ)

PHASE = """SELECT concat('r',cast(o_orderkey as string)) AS read_name,
 CASE o_orderstatus WHEN 'F' THEN 'H1' WHEN 'O' THEN 'H2' ELSE 'none' END AS haplotype,
 CASE WHEN o_custkey%9=0 THEN 'none' ELSE concat('ps',cast(o_custkey%20 as string)) END AS phase_set,
 'chr1' AS contig FROM orders WHERE o_orderkey%13<>0"""

REMAP = """SELECT event_id AS line_no,
 concat(CASE user_id%3 WHEN 0 THEN 'H1-' WHEN 1 THEN 'H2-' ELSE 'None-' END,'s',cast(user_id as string),'_',
   cast((event_id%40)*20 as string), CASE WHEN event_id%11=0 THEN '_2' ELSE '' END) AS query_name,
 cast(1000+(user_id*13)%3000 as int) AS query_length, cast(event_id%50 as int) AS query_start,
 cast(1000-(event_id*7)%600 as int) AS query_end, concat('>s',cast(user_id%10 as string)) AS path,
 cast((event_id*31)%400 as int) AS path_start, cast((event_id*31)%400+300+(event_id*17)%900 as int) AS path_end,
 cast((event_id*5)%13 as int) AS mapq, event_type<>'error' AS is_primary, event_id%4=0 AS has_sv FROM events"""

#: Node sequences: a repeated pattern, begun at a place that depends on the node.
SEQUENCE = "substring(repeat('ACGTTGCAAGGCTTACCGAT', 200), cast(1 + p_partkey % 20 as int), cast(1000 + (p_partkey * 37) % 1500 as int))"

TABLES = {"gfa_node": (GFA_NODE, ["part"]), "gfa_edge": (GFA_EDGE, ["part"]), "gaf": (GAF.format(line_no=ORDERED), ["lineitem"]), "gaf_by_read": (GAF_BY_READ, ["lineitem"]), "phase": (PHASE, ["orders"]), "remap": (REMAP, ["events"])}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = TABLES[name]
    return spark.sql(_bound(sql, tables), **{f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def gaf_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments in the order of their lines, without numbers. The table's own columns are sorted, as what is made of them is longer."""
    columns = ORDERED[len("struct(") : -1].split(",")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns).orderBy(*columns)
    return spark.sql(_bound(GAF.format(line_no="0"), ["lineitem"]), t_lineitem=lines).drop("line_no")


def _bound(sql: str, tables: list[str]) -> str:
    import re

    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{t_{t}}}", sql)
    return sql


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and sequence of each node."""
    return spark.sql(f"SELECT concat('s',cast(p_partkey as string)) AS name, {SEQUENCE} AS sequence FROM {{t_part}}", t_part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def with_sql(query: str) -> str:
    """The query for DuckDB (its own WITH parts first, if any, without the word) with the derived tables in front."""
    tables = {n: sql for n, (sql, _) in TABLES.items() if n != "gaf_by_read"} | {"gaf": GAF.format(line_no=RANKED)}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({sql})" for n, sql in tables.items()) + (" " if query.lstrip().upper().startswith("SELECT") else ", ") + query
