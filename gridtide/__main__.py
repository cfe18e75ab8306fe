"""Command line for spark-submit: look at tables, edit fields, compute risk, write the statistics report.

    python -m gridtide profile INPUT
    python -m gridtide preview INPUT [--rows N] [--order-by FIELD,FIELD]
    python -m gridtide fields INPUT [OUTPUT] --derive NAME=EXPRESSION --add NAME=TYPE:DEFAULT --drop NAME
        --rename OLD=NEW --order FIELD,FIELD | --az | --by-type  --move NAME=top|up|down|bottom
    python -m gridtide risk INPUT OUTPUT [--map YEARS=COLUMN ...]
    python -m gridtide report INPUT OUTPUT [--countries LABELS] [--flood COLUMN] [--csv]
    python -m gridtide stream risk|report INPUT OUTPUT CHECKPOINT [options as above]

``stream`` takes the files that have come since the last run, and ends.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gridtide import schema as S
from gridtide.operators.fields import (
    add_constant_field,
    derive_field,
    drop_fields,
    manage_fields,
    move_field,
    order_fields_az,
    order_fields_by_type,
)
from gridtide.plans.report import build_report, write_report
from gridtide.plans.risk import run_risk
from gridtide.plans.session import configure
from gridtide.plans.work import clear_work
from gridtide.sources.profile import file_profile, stored_field_profile
from gridtide.sources.scan import preview, read_code_labels, scan_grid
from gridtide.sources.sinks import default_field_output, write_fields
from gridtide.streaming.incremental import arrived_report, finish, read_arriving, stream_report_state, stream_risk


def _pair(text: str) -> tuple[str, str]:
    left, sep, right = text.partition("=")
    if not sep or not left.strip() or not right.strip():
        raise argparse.ArgumentTypeError(f"expected LEFT=RIGHT, got {text!r}")
    return left.strip(), right.strip()


def _names(text: str) -> list[str]:
    return [name.strip() for name in text.split(",") if name.strip()]


def parser() -> argparse.ArgumentParser:
    main_parser = argparse.ArgumentParser(prog="gridtide")
    commands = main_parser.add_subparsers(dest="command", required=True)

    commands.add_parser("profile").add_argument("input")

    preview_ = commands.add_parser("preview")
    preview_.add_argument("input")
    preview_.add_argument("--rows", type=int, default=100)
    preview_.add_argument("--order-by", type=_names, default=[])

    fields = commands.add_parser("fields")
    fields.add_argument("input")
    fields.add_argument("output", nargs="?")
    fields.add_argument("--derive", type=_pair, action="append", default=[])
    fields.add_argument("--add", type=_pair, action="append", default=[], help="NAME=TYPE or NAME=TYPE:DEFAULT")
    fields.add_argument("--drop", action="append", default=[])
    fields.add_argument("--rename", type=_pair, action="append", default=[])
    orders = fields.add_mutually_exclusive_group()
    orders.add_argument("--order", type=_names, help="comma-separated fields to keep, by new name")
    orders.add_argument("--az", action="store_true")
    orders.add_argument("--by-type", action="store_true")
    fields.add_argument("--move", type=_pair, action="append", default=[], help="after the ordering, by new name")
    fields.add_argument("--cluster-by", type=_names, default=[], help="lay the rows out for filters on these fields")

    risk = commands.add_parser("risk")
    report = commands.add_parser("report")
    stream = commands.add_parser("stream").add_subparsers(dest="kind", required=True)
    stream_risk_, stream_report = stream.add_parser("risk"), stream.add_parser("report")
    arrived = commands.add_parser("arrived", help="the report over what a report stream has taken so far")
    for one in (risk, report, arrived, stream_risk_, stream_report):
        one.add_argument("input")
        one.add_argument("output")
    for one in (stream_risk_, stream_report):
        one.add_argument("checkpoint")
        one.add_argument("--files-per-batch", type=int)
    for one in (risk, stream_risk_):
        one.add_argument("--map", type=_pair, action="append", help="default: bound by column name")
        one.add_argument("--exposure", default=S.EXPOSURE)
        one.add_argument("--vulnerability", default=S.VULNERABILITY)
    for one in (report, stream_report):
        one.add_argument("--flood", default="auto")
        one.add_argument("--keep-zeros", action="store_true")
    arrived.add_argument("--flood", help="name of the flood column that the stream found")
    for one in (report, arrived):
        one.add_argument("--countries", help="Parquet with the columns code and label")
        one.add_argument("--csv", action="store_true")
    for one in (fields, risk, report, arrived):
        one.add_argument("--versioned", action="store_true", help="publish by a manifest, for storage without rename")
    return main_parser


def _edited(cells: DataFrame, args: argparse.Namespace) -> DataFrame:
    for name, expression in args.derive:
        cells = derive_field(cells, name, expression)
    for name, kind in args.add:
        dtype, _, default = kind.partition(":")
        cells = add_constant_field(cells, name, dtype, default or "null")
    cells = manage_fields(drop_fields(cells, args.drop), dict(args.rename), args.order)
    if args.az:
        cells = order_fields_az(cells)
    elif args.by_type:
        cells = order_fields_by_type(cells)
    for name, where in args.move:
        cells = move_field(cells, name, where)
    return cells


def _stream(spark: SparkSession, args: argparse.Namespace) -> None:
    cells = read_arriving(spark, args.input, scan_grid(spark, args.input).schema, args.files_per_batch)
    if args.kind == "risk":
        query = stream_risk(cells, args.output, args.checkpoint, args.map, args.exposure, args.vulnerability)
    else:
        query = stream_report_state(cells, args.output, args.checkpoint, args.flood, exclude_zero=not args.keep_zeros)
    finish(query)


def run(spark: SparkSession, arguments: Sequence[str]) -> None:
    args = parser().parse_args(arguments)
    if args.command == "profile":
        cells = scan_grid(spark, args.input)
        file_profile(cells).show(truncate=False)
        stored_field_profile(spark, args.input).orderBy("position").show(len(cells.columns), truncate=False)
    elif args.command == "preview":
        preview(scan_grid(spark, args.input), args.rows, args.order_by).show(args.rows, truncate=False)
    elif args.command == "stream":
        _stream(spark, args)
    elif args.command == "fields":
        cells = _edited(scan_grid(spark, args.input), args)
        output = args.output or default_field_output(args.input)
        write_fields(cells, output, [args.input], cluster_by=args.cluster_by, versioned=args.versioned)
    elif args.command == "risk":
        run_risk(spark, args.input, args.output, args.map, args.exposure, args.vulnerability, versioned=args.versioned)
    else:
        labels = read_code_labels(spark, args.countries) if args.countries else None
        if args.command == "arrived":
            tables = arrived_report(spark, args.input, labels, args.flood)
        else:
            tables = build_report(scan_grid(spark, args.input), labels, args.flood, exclude_zero=not args.keep_zeros)
        write_report(tables, args.output, [args.input], csv=args.csv, versioned=args.versioned)


def main() -> None:
    import sys

    spark = configure(SparkSession.builder.appName("gridtide")).getOrCreate()
    try:
        run(spark, sys.argv[1:])
    finally:
        clear_work(spark)
        spark.stop()


if __name__ == "__main__":
    main()
