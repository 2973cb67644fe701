"""Command line of the weekly refresh, for spark-submit.

    spark-submit --py-files sentinela.zip sentinela/plans/weekly.py \\
        --run-date 2018-06-17 --root s3a://bucket/reports --consent enrolled \\
        --communities s3a://bucket/geo/communities --departments s3a://bucket/geo/departments
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from sentinela.functions.calendar import ReportDates
from sentinela.plans.refresh import Settings, default_sources, export_reports, run_refresh
from sentinela.session import tune


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Build all report tables of one week.")
    parser.add_argument("--run-date", type=dt.date.fromisoformat, required=True)
    parser.add_argument("--root", required=True, help="folder of the dated snapshots")
    parser.add_argument("--communities", required=True, help="table or path: group, long, lat")
    parser.add_argument("--departments", required=True, help="table or path: region, long, lat")
    parser.add_argument("--consent", required=True, help="enrolment flag column of the subject view")
    parser.add_argument("--export", help="folder for copies of the report tables")
    parser.add_argument("--format", default="csv", choices=["csv", "json", "parquet", "orc"])
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    options = arguments(argv)
    spark = tune(SparkSession.builder.appName("weekly-refresh")).getOrCreate()
    stored = run_refresh(
        spark, default_sources(options.communities, options.departments), options.root,
        ReportDates(options.run_date), Settings(consent=options.consent))
    if options.export:
        export_reports(stored, options.export, options.format)


if __name__ == "__main__":
    main()
