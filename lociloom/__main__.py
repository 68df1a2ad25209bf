"""Command line: python -m lociloom -a reads.gaf -g graph.gfa -f reads.fa"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from .params import READ_TYPES, Params

VERSION = "1.0"


def parser() -> argparse.ArgumentParser:
    d = Params()
    p = argparse.ArgumentParser(prog="lociloom", description="Haplotype-resolved structural variants from reads on a pangenome graph.")
    p.add_argument("-a", "--gaf", required=True, help="alignments (GAF, may be gzipped)")
    p.add_argument("-g", "--graph", required=True, help="graph (GFA, may be gzipped)")
    p.add_argument("-f", "--fasta", required=True, help="reads (FASTA)")
    p.add_argument("-i", "--sample", default=d.sample)
    p.add_argument("-o", "--out", default=os.path.join(os.getcwd(), d.out))
    p.add_argument("-p", "--phase", help="haplotype tags (TSV)")
    p.add_argument("-s", "--support", type=int, default=d.support)
    p.add_argument("-d", "--dist", type=int, default=d.dist)
    p.add_argument("-w", "--reads", choices=READ_TYPES, default=d.reads)
    p.add_argument("-t", "--threads", type=int, default=d.threads)
    p.add_argument("-n", "--min-map-ratio", type=float, default=d.min_map_ratio)
    p.add_argument("-e", "--min-alignment-score", type=int, default=d.min_alignment_score)
    p.add_argument("-c", "--precise-clipping", type=float, default=d.precise_clipping)
    p.add_argument("-j", "--skip-untagged", action="store_true")
    p.add_argument("-r", "--no-remap", action="store_true")
    p.add_argument("-u", "--debug", action="store_true")
    p.add_argument("-b", "--assembler", choices=("wtdbg2", "abpoa", "shasta", "consensus"), default=d.assembler, help="abpoa and shasta are accepted, but wtdbg2 runs; consensus is built in and needs no program")
    p.add_argument("-m", "--asm", action="store_true", help="preset for assemblies: every locus counts")
    p.add_argument("--remap-gaf", help="alignments of the alleles to the graph, instead of running the aligner")
    p.add_argument("--max-lines", type=int, help="alignments after so many lines are not read (all are, if not given)")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    return p


def main(argv: list[str] | None = None) -> int:
    params = Params(**vars(parser().parse_args(argv)))
    logging.basicConfig(level=logging.DEBUG if params.debug else logging.INFO, format="%(asctime)s %(message)s")
    try:
        params.checked()
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans.pipeline import run
    from .storage import clean

    os.makedirs(params.out, exist_ok=True)
    spark = SparkSession.builder.appName("lociloom").getOrCreate()
    try:
        run(spark, params)
    finally:
        clean(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
