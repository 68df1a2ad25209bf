"""Which intervals stay, where each goes that overlaps an earlier one that stays: the greedy rule without a loop over a group.

An interval (group, start, end) of positive length goes if it shares more than MIN_DUP_OVERLAP of the shorter one's length with an earlier one that stays. Small groups are
folded within a row. Large ones are decided in rounds that spread over bins, so that a group of any size is dealt to all tasks:

* An interval's level is its length's power of two. It stands in the bins of its level's width that it touches (three at most), and, as a shorter one may lie within a
  longer one, in one bin of each higher level that its group has: that of its middle, which a longer interval that shares so much of it must cover.
* The first of a bin's own intervals (those of its level) comes from a partial aggregation, as does the first of the shorter ones in it. An interval stays for certain if no
  undecided one is before it where they could meet: no own or shorter one in the bins of its level, and no own one in those of higher levels.
* Those that stay for certain send away what they overlap, by a semi-join on bins; the rest goes into the next round.

Intervals of one level that stay differ by a tenth of their length at least, so that a bin has some dozens of them at most and the rounds are few, whatever the group's size.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap_ratio
from ..params import MIN_DUP_OVERLAP
from ..storage import drop, scratch, written

log = logging.getLogger("lociloom")

#: Groups of so many intervals at most are folded within a row.
GROUP = 2_000

_FOLD = f"""aggregate(every, cast(array() AS array<struct<place:struct<first:{{0}},name:string>,start:bigint,end:bigint>>),
 (stay, x) -> IF(exists(stay, s -> least(s.end, x.end) - greatest(s.start, x.start) > {MIN_DUP_OVERLAP} * least(s.end - s.start, x.end - x.start)), stay, concat(stay, array(x))))"""


def _apart(own: Column, level: Column) -> Column:
    return F.floor(own / F.pow(F.lit(2.0), level)).cast("long")


def _registered(rows: DataFrame) -> DataFrame:
    """rows with a row for each bin that an interval stands in: at (the bin's level), bin, own."""
    level, middle = F.col("level"), F.floor((F.col("start") + F.col("end")) / 2)
    own = F.transform(F.sequence(_apart(F.col("start"), level), _apart(F.col("end") - 1, level)), lambda b: F.struct(level.alias("at"), b.alias("bin"), F.lit(True).alias("own")))
    higher = F.transform(F.filter("levels", lambda h: h > level), lambda h: F.struct(h.alias("at"), _apart(middle, h).alias("bin"), F.lit(False).alias("own")))
    return rows.withColumn("b", F.explode(F.concat(own, higher))).select("*", "b.*").drop("b")


def _overlap(a: str, b: str) -> Column:
    return overlap_ratio(F.col(f"{a}.start"), F.col(f"{a}.end"), F.col(f"{b}.start"), F.col(f"{b}.end")) > MIN_DUP_OVERLAP


def _rounds(rows: DataFrame, key: list[str]) -> DataFrame:
    """Those of rows (key, place, start, end) that stay."""
    spark = rows.sparkSession
    base, k = scratch(spark, "overlaps"), 0
    rows = rows.withColumn("level", F.floor(F.log2((F.col("end") - F.col("start")).cast("double"))).cast("int"))
    levels = rows.groupBy(*key).agg(F.collect_set("level").alias("levels"))
    left = written(rows.join(levels, key), f"{base}/left-0")
    stay = []
    while not left.isEmpty():
        k += 1
        at = [*key, "at", "bin"]
        spread = written(_registered(left), f"{base}/spread-{k}")
        firsts = spread.groupBy(*at).agg(F.min(F.when(F.col("own"), F.col("place"))).alias("first"), F.min(F.when(~F.col("own"), F.col("place"))).alias("shorter"))
        before = (F.col("first") < F.col("place")) | (F.col("own") & F.coalesce(F.col("shorter") < F.col("place"), F.lit(False)))
        waits = spread.join(firsts, at).groupBy(*key, "place", "start", "end").agg(F.max(F.coalesce(before, F.lit(False))).alias("waits"))
        sure = written(waits.where("NOT waits").drop("waits"), f"{base}/stay-{k}")
        stay.append(sure)
        here = _registered(sure.join(left.select(*key, "place", "level", "levels"), [*key, "place"]))
        same = [F.col(f"i.{c}") == F.col(f"s.{c}") for c in at]
        met = spread.alias("i").join(here.alias("s"), [*same, F.col("i.own") | F.col("s.own"), _overlap("i", "s")], "semi").select(*key, "place").distinct()
        left = written(left.join(met, [*key, "place"], "anti").join(sure.select(*key, "place"), [*key, "place"], "anti"), f"{base}/left-{k}")
        for name in (f"left-{k - 1}", f"spread-{k}"):
            drop(spark, f"{base}/{name}")
    log.info("overlaps: %d rounds", k)
    out = stay[0].select(*key, "place", "start", "end")
    for s in stay[1:]:
        out = out.unionByName(s.select(*key, "place", "start", "end"))
    return out


def staying(rows: DataFrame, key: list[str], group: int = GROUP) -> DataFrame:
    """Those of the rows (key, place, start, end), each with an interval and a place of its own in its group, that stay; place: struct(first, name), by which they come in order."""
    rows = rows.select(*key, "place", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    sized = written(rows.join(sizes, key), scratch(rows.sparkSession, "intervals"))
    few, many = sized.where(F.col("_n") <= group).drop("_n"), sized.where(F.col("_n") > group).drop("_n")
    kind = rows.schema["place"].dataType["first"].dataType.simpleString()
    folded = few.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "start", "end"))).alias("every")).select(*key, F.explode(F.expr(_FOLD.format(kind))).alias("s")).select(*key, "s.*")
    return folded if many.isEmpty() else folded.unionByName(_rounds(many, key))
