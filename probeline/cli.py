"""Command line: synthetic lookups, Q14 by approach and index, and Q1."""

from __future__ import annotations

import argparse

from probeline.operators.indexes import INDEXES, SEARCHES
from probeline.operators.lookup import STRATEGIES, lookup, mismatches
from probeline.operators.joins import scatter_keys
from probeline.plans import q1, q14
from probeline.plans.measure import experiment, measure
from probeline.session import build_session
from probeline.sources.delimited import append_measurement
from probeline.sources.generators import DATASETS, PATTERNS, datasets


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="probeline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    look = commands.add_parser("lookup", help="point lookups of generated keys")
    look.add_argument("-a", "--approach", choices=[*STRATEGIES, "hj"], default="plain")
    look.add_argument("-i", "--index", choices=[*INDEXES], default="btree")
    look.add_argument("-e", "--elements", type=int, default=1_000_000, help="indexed keys")
    look.add_argument("-l", "--lookups", type=int, default=1_000_000)
    look.add_argument("-m", "--max-bits", type=int, default=0, help="bits of sparse keys; 0 derives them")
    look.add_argument("-z", "--zipf", type=float, default=1.25)
    look.add_argument("-d", "--dataset", choices=DATASETS, default="dense")
    look.add_argument("-p", "--pattern", choices=PATTERNS, default="uniform")
    look.add_argument("-s", "--sort", action="store_true", help="sort the lookups first")
    look.add_argument("-w", "--window", type=int, default=0, help="probes of a window")
    look.add_argument("-b", "--block", type=int, default=10_000, help="probes that a kernel takes at a time")
    look.add_argument("-x", "--search", choices=[*SEARCHES], help="how the index searches its nodes")
    look.add_argument("-r", "--repetitions", type=int, default=1)
    look.add_argument("-o", "--output", help="append the measurement here")
    promo = commands.add_parser("q14", help="the promotion share")
    promo.add_argument("path")
    promo.add_argument("-a", "--approach", choices=[*q14.APPROACHES], default="hj")
    promo.add_argument("-i", "--index", choices=[*INDEXES], default="btree")
    promo.add_argument("-b", "--block", type=int, default=10_000, help="rows that a kernel takes at a time")
    promo.add_argument("-r", "--repetitions", type=int, default=1)
    promo.add_argument("-d", "-o", "--output", help="append the measurement here")
    commands.add_parser("q1", help="the pricing summary's counts").add_argument("path")
    return parser


def main(args: list[str] | None = None) -> int:
    given = _parser().parse_args(args)
    spark = build_session()
    if "block" in given:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given.block)
    if given.command == "q1":
        q1.q1_counts(spark, given.path).show()
        return 0
    if given.command == "q14":
        run = lambda: q14.APPROACHES[given.approach](spark, given.path, given.index).first()
        seen = measure(run, given.repetitions, warmups=0 if given.repetitions == 1 else 3)
        q14.APPROACHES[given.approach](spark, given.path, given.index).selectExpr("numerator", "denominator", "ratio / 1000000 as ratio_percent", "ratio").show()
        q14.validate(spark, given.path, q14.APPROACHES[given.approach](spark, given.path, given.index)).show()
    else:
        indexed, lookups = datasets(spark, given.dataset, given.pattern, given.elements, given.lookups, given.max_bits, given.zipf)
        # every strategy probes the same drawn keys
        indexed, lookups = indexed.cache(), (lookups.orderBy("key") if given.sort else lookups).cache()
        if given.approach == "hj":
            run = lambda: scatter_keys(lookups, indexed).count()
            right = lambda n: n == given.lookups
        else:
            found = lookup(lookups, indexed, given.index, given.approach, "exact", given.window, search=given.search)
            run = lambda: found.count()
            right = lambda n: n == given.lookups and (given.index == "no_op" or mismatches(found, indexed).first().n_mismatches == 0)
        seen = measure(run, given.repetitions, warmups=0 if given.repetitions == 1 else 3, validate=right)
    record = {"name": given.command, **experiment(spark, **{k: v for k, v in vars(given).items() if k not in ("command", "output")}), **seen.record()}
    print(record)
    if given.output:
        append_measurement(spark, given.output, record)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
