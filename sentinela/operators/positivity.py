"""Positives, tested and percentage per reporting period and etiology."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.functions.calendar import ReportDates
from sentinela.functions.scalars import percent, positives_cell
from sentinela.operators.cases import at_sites
from sentinela.operators.reshape import (
    ordered_codes, pivot_first, require_flags, unpivot_records, with_groups,
)

PERIODS = ["this_month", "last_month", "all_time"]


def positivity_table(
    cases: DataFrame,
    labels: Mapping[str, str],
    dates: ReportDates,
    *,
    by: Sequence[str] = (),
    site: str | Sequence[str] = "all",
    condition: Column | str | None = None,
    check_site: bool = False,
    groups: Sequence[tuple] | None = None,
) -> DataFrame:
    """Long positivity table, complete over the three periods and all labelled codes.

    ``by`` computes all sites in one job; ``groups`` lists values of ``by`` that get a
    table of zeros if they have no case. The cases are only counted per group and
    combination of periods they fall into (at most four): two counts per etiology, kept
    small by map-side aggregation. Overlapping periods are added up from those few rows,
    so no case row is ever repeated per period or etiology.
    """
    require_flags(cases, list(labels))
    cases = at_sites(cases, site, check=check_site)
    if condition is not None:
        cases = cases.where(condition)
    counts = {code: (F.count(code), F.count_if(F.col(code))) for code in labels}
    return _table(cases, labels, dates, by, groups, counts)


def positivity_from_cube(cube: DataFrame, labels: Mapping[str, str], dates: ReportDates, *,
                         by: Sequence[str] = (),
                         groups: Sequence[tuple] | None = None) -> DataFrame:
    """The same table from a daily cube of the cases."""
    counts = {code: (F.sum(f"{code}_tested"), F.sum(f"{code}_positive")) for code in labels}
    return _table(cube, labels, dates, by, groups, counts)


def _table(rows: DataFrame, labels: Mapping[str, str], dates: ReportDates, by: Sequence[str],
           groups: Sequence[tuple] | None, counts: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    inside = dates.periods(F.col("service_date"))
    flags = {period: F.coalesce(inside[period], F.lit(False)) for period in PERIODS[:2]}
    sums = {}
    for code, (tested, positive) in counts.items():
        sums |= {f"t_{code}": tested, f"p_{code}": positive}
    parts = rows.groupBy(*by, *[flag.alias(p) for p, flag in flags.items()]).agg(
        *[count.alias(name) for name, count in sums.items()])
    parts = with_groups(parts, by, groups)
    by_period = unpivot_records(parts, [*by, *sums], [
        {"group": F.lit(p), "inside": F.col(p) if p in flags else F.lit(True)} for p in PERIODS])
    long = unpivot_records(by_period, [*by, "group", "inside"], [
        {"etiology": F.lit(code), "label": F.lit(label), "ord": F.lit(order),
         "tested": F.col(f"t_{code}"), "positive": F.col(f"p_{code}")}
        for order, code, label in ordered_codes(labels)])
    n_tested, n_positive = [
        F.coalesce(F.sum(F.when(F.col("inside"), F.col(c))), F.lit(0))
        for c in ("tested", "positive")]
    return (
        long.groupBy(*by, "group", "etiology", "label", "ord")
        .agg(n_tested.alias("n_tested"), n_positive.alias("n_positive"))
        .withColumn("percent_positive", F.coalesce(
            percent(F.col("n_positive"), F.col("n_tested")), F.lit(0.0))))


def positivity_text(table: DataFrame, *, by: Sequence[str] = (),
                    headings: Mapping[str, str] | None = None) -> DataFrame:
    """The positivity table with one text column per period, in label order."""
    cells = table.withColumn("cell", positives_cell(
        F.col("n_positive"), F.col("n_tested"), F.col("percent_positive")))
    wide = pivot_first(cells, [*by, "ord", "label"], "group", PERIODS, "cell", fill="NA")
    headings = headings or {p: p for p in PERIODS}
    return wide.orderBy(*by, "ord").select(
        *by, "ord", F.col("label").alias("etiologia"),
        *[F.col(p).alias(headings[p]) for p in PERIODS])
