"""Command line: ``python -m cohortlens <stage> <folders> [week]``, for use with spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cohortlens.plans import modelling, stages
from cohortlens.session import DEFAULTS


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cohortlens")
    sub = parser.add_subparsers(dest="stage", required=True)
    prepare = sub.add_parser("prepare", help="raw tables to weekly tables and outcomes")
    prepare.add_argument("source")
    prepare.add_argument("out")
    for name, text in (("indicators", "features of a week"), ("wide", "wide rows of a week")):
        stage = sub.add_parser(name, help=text)
        stage.add_argument("out")
        stage.add_argument("week", type=int)
    model = sub.add_parser("model", help="select, fit and evaluate")
    model.add_argument("out")
    model.add_argument("week", type=int)
    model.add_argument("--back", type=int, help="week of the out-of-time check")
    args = parser.parse_args(argv)

    builder = SparkSession.builder.appName(f"cohortlens-{args.stage}")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if args.stage == "prepare":
        stages.prepare(spark, args.source, args.out)
    elif args.stage == "indicators":
        stages.indicators(spark, args.out, args.week)
    elif args.stage == "wide":
        stages.wide_rows(spark, args.out, args.week, csv=True)
    else:
        back = None if args.back is None else stages.read_wide_rows(spark, args.out, args.back)
        wide = stages.read_wide_rows(spark, args.out, args.week)
        report = modelling.run(wide, back, log=f"{args.out}/runs")
        report.write(f"{args.out}/model/{args.week}")


if __name__ == "__main__":
    main()
