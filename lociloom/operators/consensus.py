"""A built-in consensus of each candidate's reads, by a graph of their k-mers, as joins and aggregations over all candidates at once.

Reads are turned to the strand of their candidate's longest one. Words of k + 1 bases are counted by the reads that have them; those of a single read are mostly errors and go. Each
word is a step from its first k bases to its last k, and of the steps that leave a place, and of those that come to it, the one of most reads is taken: steps that are both make chains.
A chain's places find its end by doubling their pointers, in as many rounds as the longest chain's length has binary digits, and come together in the order of their distance from it. A candidate's
chains of at least SHARE of the longest one's bases are its contigs, those with most reads first.

Reads of one candidate with alleles that share no long stretches give a contig each; where they share some, the better covered way is the first contig. It is no aligner: errors that most reads have in one place stay, and repeats
of k bases and more end or shorten a chain. Circles are left out. Null and short reads have no words; a candidate whose reads make no chain has no contig.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reverse_complement
from ..storage import drop, scratch, written

log = logging.getLogger("lociloom")

#: Bases of a place, reads that must have a step, and the share of the longest chain that a contig must have.
K, READS, SHARE = 13, 2, 0.5


def _words(sequence: Column, n: int) -> Column:
    """The words of n bases in an array; as bytes, of which a slice takes no time that grows with its place."""
    data = sequence.cast("binary")
    return F.when(F.length(sequence) >= n, F.transform(F.sequence(F.lit(1), F.length(sequence) - n + 1), lambda i: F.substring(data, i, F.lit(n)))).otherwise(F.array().cast("array<binary>"))


def oriented(reads: DataFrame, k: int = K) -> DataFrame:
    """reads (name, read, sequence), each turned to the strand of its candidate's longest one if more of its words are there."""
    longest = reads.groupBy("name").agg(F.max(F.struct(F.length("sequence").alias("n"), "sequence"))["sequence"].alias("_longest"))
    both = reads.join(longest, "name").withColumn("_words", F.array_distinct(_words(F.col("_longest"), k)))
    met = lambda s: F.size(F.array_intersect(_words(s, k), "_words"))
    other = reverse_complement(F.col("sequence"))
    return both.withColumn("sequence", F.when(met(other) > met(F.col("sequence")), other).otherwise(F.col("sequence"))).drop("_longest", "_words")


def steps(reads: DataFrame, k: int = K, least: int = READS) -> DataFrame:
    """name, v, next and n (reads): the steps that are the best both from v and to next."""
    word = oriented(reads, k).select("name", F.explode(F.array_distinct(_words(F.col("sequence"), k + 1))).alias("w"))
    some = word.groupBy("name", "w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    some = some.select("name", F.substring("w", 1, k).alias("v"), F.substring("w", 2, k).alias("next"), F.struct("n", "w").alias("s")).where("v != next")
    leave = some.groupBy("name", "v").agg(F.max("s").alias("s"), F.max_by("next", "s").alias("next"))
    come = some.groupBy("name", "next").agg(F.max("s").alias("s"))
    return leave.join(come, ["name", "next", "s"]).select("name", "v", "next", F.col("s.n").alias("n"))


def chains(found: DataFrame) -> DataFrame:
    """name, end, far (steps to the end) and v and n of each place with a way to an end; n of the step that leaves it."""
    spark = found.sparkSession
    base, rounds = scratch(spark, "chains"), 0
    now = written(found.select("name", "v", F.col("next").alias("to"), F.lit(1).cast("long").alias("far"), "n"), f"{base}/0")
    while True:
        ahead = now.select("name", F.col("v").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"))
        met = now.join(ahead, ["name", "to"], "left")
        rounds += 1
        new = written(met.select("name", "v", F.coalesce("_to", "to").alias("to"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), "n", F.col("_to").isNotNull().alias("moved")), f"{base}/{rounds}")
        drop(spark, f"{base}/{rounds - 1}")
        left = new.where("moved").count()
        size = left if rounds == 1 else size
        now = new.drop("moved")
        if left == 0 or 2**rounds > size + 1:  # what still moves goes round
            break
    log.info("chains: %d rounds", rounds)
    return new.join(found.select("name", F.col("v").alias("to")), ["name", "to"], "anti").select("name", F.col("to").alias("end"), "far", "v", "n")


def contigs(reads: DataFrame, k: int = K, least: int = READS, share: float = SHARE) -> DataFrame:
    """name (of the contig: the candidate's, then with _2, _3 behind it), parent (the candidate's) and sequence, from reads (name, read, sequence)."""
    found = written(steps(reads.where("sequence IS NOT NULL"), k, least), scratch(reads.sparkSession, "steps"))
    chain = chains(found).groupBy("name", "end").agg(F.sum("n").alias("weight"), F.sort_array(F.collect_list(F.struct("far", "v")), asc=False).alias("places"))
    first = F.transform("places", lambda p: F.substring(p["v"], 1, 1).cast("string"))  # the places' first bases, and the end in full
    chain = chain.select("name", "weight", F.concat(F.array_join(first, ""), F.col("end").cast("string")).alias("sequence"))
    every = chain.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("weight", "sequence")), asc=False).alias("c"), F.max(F.length("sequence")).alias("longest"))
    kept = every.select("name", F.posexplode(F.filter("c", lambda c: F.length(c["sequence"]) >= share * F.col("longest"))).alias("i", "c"))
    return kept.select(F.when(F.col("i") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), (F.col("i") + 1).cast("string"))).alias("name"), F.col("name").alias("parent"), "c.sequence")


def attempts(passed: DataFrame, reads: DataFrame) -> DataFrame:
    """What comes of the candidates (name, reads), as the external assembler's attempts have it: a row for each contig, or one with the reason no_contig."""
    from ..adapters.external import read_sequences

    made = written(contigs(read_sequences(passed, reads)), scratch(passed.sparkSession, "contigs"))
    none = passed.select(F.col("name").alias("parent")).join(made.select("parent").distinct(), "parent", "anti").select(F.lit(None).cast("string").alias("name"), "parent", F.lit(None).cast("string").alias("sequence"), F.lit("no_contig").alias("reason"))
    return made.withColumn("reason", F.lit(None).cast("string")).unionByName(none)
