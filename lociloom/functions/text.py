"""Column functions for the text formats: integers, CIGAR strings, oriented paths, sequences, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import MAX_FETCH


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, even where body uses it inside array functions."""
    return F.transform(F.array(value), body)[0]


def prefix_int(c: Column) -> Column:
    """The integer that a text begins with (white space and a sign may precede); null if none or out of range."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def prefix_float(c: Column) -> Column:
    """The number that a text begins with; null if none."""
    return F.regexp_extract(c, r"(?i)^\s*([+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|nan|inf(?:inity)?))", 1).try_cast("float")


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len:int, op:string>>. Empty if an operation has no length or one that is no int; digits at the end do not count."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+)(\D)"), F.lit(0))
    size = lambda x: F.expr(f"substring({x}, 1, length({x}) - 1)")  # noqa: E731, F841
    ops = F.transform(found, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).try_cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))
    bad = cigar.isNull() | cigar.rlike(r"^\D|\D\D")
    return let(ops, lambda o: F.when(bad | F.exists(o, lambda x: x["len"].isNull()), F.filter(o, lambda x: F.lit(False))).otherwise(o))


def has_sv_run(cigar: Column, least: int = 50) -> Column:
    """True if an insertion, deletion or mismatch run has that length at least."""
    return F.exists(cigar_ops(cigar), lambda x: x["op"].isin("I", "D", "X") & (x["len"] >= least))


def path_steps(path: Column) -> Column:
    """array<struct<i:int, strand:string, node:string>>; a step's first character is its strand, whatever it is."""
    found = F.regexp_extract_all(path, F.lit(r"(?s)(.)([^<>]*)"), F.lit(0))
    return F.transform(found, lambda x, k: F.struct((k + 1).cast("int").alias("i"), F.substring(x, 1, 1).alias("strand"), F.substring(x, F.lit(2), F.length(x)).alias("node")))


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGTacgt", "TGCAtgca")


def fetched(sequence: str | Column) -> Column:
    """A sequence as it is fetched from a file, for reads, alignment and output alike: MAX_FETCH bases at most."""
    return F.substring(sequence, 1, MAX_FETCH)


def overlap_ratio(xs: Column, xe: Column, ys: Column, ye: Column) -> Column:
    """The share of the shorter interval that both have; 0 if a length is not positive or they do not meet."""
    shorter = F.least(xe - xs, ye - ys)
    both = F.least(xe, ye) - F.greatest(xs, ys)
    return F.when((shorter > 0) & (both > 0), both / F.when(shorter > 0, shorter)).otherwise(F.lit(0.0))


def haplotype_of(name: Column) -> Column:
    """The prefix of a name, H1-, H2- or None-; empty if none."""
    return F.when(name.startswith("H1-"), "H1-").when(name.startswith("H2-"), "H2-").when(name.startswith("None-"), "None-").otherwise("")


def parent_name(name: Column) -> Column:
    """Of a fragment (two different underscores at least) the text before the last underscore; null otherwise."""
    return F.when(name.rlike("(?s)_.*_"), F.regexp_extract(name, r"(?s)^(.*)_[^_]*$", 1))


def general(x: Column) -> Column:
    """A number as C's %g has it: up to six significant digits, of the exact value and half to even (but for subnormal numbers), no zeros at the end, scientific below 1e-4 and from 1e6 on."""
    number = F.call_function("format_number", F.abs(x.cast("double")), F.lit("0.00000E0"))

    def shown(six: Column) -> Column:
        power = F.regexp_extract(six, r"E(-?\d+)$", 1).cast("int")
        digits = F.concat(F.substring(six, 1, 1), F.substring(six, 3, 5))
        trim = lambda s: F.regexp_replace(s, r"\.?0*$", "")
        fraction = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        plain = F.when(power < 0, trim(fraction)).otherwise(trim(F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))))
        mantissa = trim(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5)))
        exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
        return F.when((power < -4) | (power >= 6), F.concat(mantissa, exponent)).otherwise(plain)

    told = F.when(x == 0, "0").when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").otherwise(let(number, shown))
    return F.concat(F.when(x < 0, "-").otherwise(""), told)


def svtig_header(name: Column, contig: Column, pos: Column, support: Column, path: Column, ratio: Column) -> Column:
    """The FASTA header of an allele; path and map_ratio only where it was remapped (ratio not null)."""
    head = F.concat(F.lit(">"), name, F.lit(" contig="), contig, F.lit(" pos="), pos.cast("string"), F.lit(" support="), support.cast("string"))
    return F.when(ratio.isNull() | (ratio < 0), head).otherwise(F.concat(head, F.lit(" path="), F.coalesce(path, F.lit("")), F.lit(" map_ratio="), general(ratio)))


def wrapped(sequence: Column, width: int = 60) -> Column:
    """The sequence in lines of that width."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
