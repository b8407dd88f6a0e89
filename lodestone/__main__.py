"""Command line: mines a text file of baskets and reports the run.

Options of schedulers, placement and speculation of native programs have no counterpart:
Spark schedules. ``--sched`` and ``--part-strategy`` are taken and ignored, so that old
command lines still run.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from lodestone.operators import output
from lodestone.plans.levelwise import LOCAL_ELEMENTS, mine
from lodestone.plans.utility_list import mine_lists
from lodestone.session import Phases, local_session, stored
from lodestone.sources.spmf import read_spmf, to_transactions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description="High-utility itemset mining on Spark")
    p.add_argument("-i", "--input", required=True, help="file or folder of lines items:utility:utilities")
    p.add_argument("-o", "--output", default="/dev/stdout", help="folder for the itemsets; /dev/null: none")
    p.add_argument("-m", "--minutil", required=True, type=int, help="least utility of an itemset")
    p.add_argument("-a", "--algorithm", default="efim", choices=("efim", "fhm"), help="bounds level by level, or utility lists")
    p.add_argument("-t", "--threads", default=None, type=int, help="local cores; without it the session's master counts")
    p.add_argument("-s", "--sched", default=None, help="ignored")
    p.add_argument("--part-strategy", default=None, help="ignored")
    p.add_argument("--local-elements", default=LOCAL_ELEMENTS, type=int, help="projected databases up to this size finish inside a task; 0: none")
    p.add_argument("--merge", action="store_true", help="merge equal baskets at every level")
    p.add_argument("--no-subtree", action="store_true", help="explore by local utility alone, without subtree pruning")
    p.add_argument("--published-bound", action="store_true", help="keep the published local bound")
    p.add_argument("--json", action="store_true", help="report as JSON")
    p.add_argument("--debug", action="store_true", help="show Spark's log and the plan")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    own = spark is None
    spark = spark or (local_session(args.threads) if args.threads else SparkSession.builder.appName("lodestone").getOrCreate())
    if args.debug:
        spark.sparkContext.setLogLevel("INFO")
    began, phases = time.perf_counter(), Phases(spark)
    baskets, _ = read_spmf(spark, args.input)
    parsed = stored(baskets, "parsed")
    phases.mark("parse")
    tx, declared = to_transactions(parsed)
    if args.algorithm == "fhm":
        mined = mine_lists(tx, args.minutil, declared=declared, local_elements=args.local_elements, phases=phases)
    else:
        mined = mine(
            tx, args.minutil, declared=declared, local_elements=args.local_elements, merging=args.merge, tighten=not args.published_bound, subtree=not args.no_subtree, phases=phases
        )
    if args.debug:
        mined.found.explain("formatted")
    if args.output == "/dev/stdout":
        for row in output.lines(mined.found).toLocalIterator():
            print(row["value"])
    elif args.output != "/dev/null":
        output.write_lines(mined.found, args.output)
    seconds = mined.phases | {"total": time.perf_counter() - began}
    report = output.report(
        mined.found, min_util=args.minutil, candidates=mined.candidates, phases=seconds, tasks=mined.tasks, parallelism=spark.sparkContext.defaultParallelism, as_json=args.json
    ).first()
    if args.json:
        print(report["value"], file=sys.stderr)
    else:
        for name, value in report.asDict().items():
            print(f"{name}: {value}", file=sys.stderr)
    if own:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
