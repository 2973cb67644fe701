"""Daily cube: one scan of a line list that feeds every count of a report.

The cube has one row per group, service date and epidemiological week, so it grows with
sites and days instead of cases. Positivity, corridors and time series add up its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.functions.calendar import floor_date
from sentinela.operators.reshape import require_flags

DAY_KEYS = ["service_date", "epi_year", "epi_week"]


def daily_cube(cases: DataFrame, flags: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Cases per group and day, with tested and positive counts of every flag."""
    require_flags(cases, flags)
    counts = [F.count(F.lit(1)).alias("cases")]
    for flag in flags:
        counts += [F.count(flag).alias(f"{flag}_tested"),
                   F.count_if(F.col(flag)).alias(f"{flag}_positive")]
    return cases.groupBy(*by, *DAY_KEYS).agg(*counts)


def cube_weekly_counts(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Same result as ``corridor.weekly_counts`` on the line list."""
    return (cube.where(F.col("epi_week").isNotNull())
            .groupBy(*by, "epi_year", "epi_week").agg(F.sum("cases").alias("casos")))


def cube_period_counts(cube: DataFrame, etiologies: Sequence[str], scale: str = "month",
                       by: Sequence[str] = ("site_type", "site_name")) -> DataFrame:
    """Same result as ``timeseries.period_counts`` on the line list."""
    return (cube
            .groupBy(*by, floor_date(F.col("service_date"), scale).alias("service_date"))
            .agg(*[F.sum(f"{e}_positive").alias(e) for e in etiologies]))
