"""Command line: ``python -m pactum {convert,build,scenarios,score} ...``."""

from __future__ import annotations

import argparse
import json

from pactum.plans import build as steps
from pactum.schemas import SPLIT_SEED, TRAIN_RATIO
from pactum.session import get_spark


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="pactum")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("convert", help="raw nested JSON -> validated contracts")
    c.add_argument("--data-file", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--max-contracts", type=int, default=None)
    c.add_argument("--json-lines", action="store_true")
    b = sub.add_parser("build", help="processed contracts -> tables and search index")
    b.add_argument("--processed", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--envelope", action="store_true")
    s = sub.add_parser("scenarios", help="tables -> scenario dataset split by contract")
    s.add_argument("--tables", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--train-ratio", type=float, default=TRAIN_RATIO)
    s.add_argument("--seed", type=int, default=SPLIT_SEED)
    r = sub.add_parser("score", help="logged runs -> rubric metrics and benchmark means")
    r.add_argument("--turns", required=True)
    r.add_argument("--scenarios", required=True)
    r.add_argument("--tables", required=True)
    r.add_argument("--replies", default=None)
    r.add_argument("--out", required=True)
    r.add_argument("--max-turns", type=int, default=10)
    a = p.parse_args(argv)
    spark = get_spark()
    if a.cmd == "convert":
        print(json.dumps(steps.convert(spark, a.data_file, a.out, a.max_contracts, a.json_lines)))
    elif a.cmd == "build":
        print(json.dumps(steps.build(spark, a.processed, a.out, a.overwrite, envelope=a.envelope)))
    elif a.cmd == "scenarios":
        steps.scenarios(spark, a.tables, a.out, a.train_ratio, a.seed)
    else:
        steps.score_runs(spark, a.turns, a.scenarios, a.tables, a.out, a.replies, a.max_turns)


if __name__ == "__main__":
    main()
