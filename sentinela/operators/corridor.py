"""Endemic corridors: this year's weekly cases against quantile bands of earlier years.

The cases are reduced once to counts per group, year and week. That table is bounded
by the calendar (at most 53 weeks a year), so every later step works on map lookups
inside one small group and needs neither joins nor unions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.functions.calendar import ReportDates
from sentinela.functions.results import all_of
from sentinela.functions.scalars import clamp
from sentinela.operators.cases import at_sites
from sentinela.operators.reshape import require_flags, unpivot_records, with_groups

# Corridor zones, from the highest band to the lowest.
ZONES = ["Brote", "Alerta", "Seguridad", "Éxito"]


def positive_for_all(cases: DataFrame, etiologies: str | Sequence[str] = "all") -> DataFrame:
    """Cases positive for every named etiology; ``"all"`` keeps every case."""
    names = [etiologies] if isinstance(etiologies, str) else list(etiologies)
    if names == ["all"]:
        return cases
    require_flags(cases, names)
    return cases.where(all_of(F.col(n) for n in names))


def weekly_counts(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cases per group, year and week. Rows without a week cannot be placed and are left out."""
    return (cases.where(F.col("epi_week").isNotNull())
            .groupBy(*by, "epi_year", "epi_week").agg(F.count(F.lit(1)).alias("casos")))


def _week_map(value: Column) -> Column:
    """Week to value; NULL values are left out of the map."""
    entry = F.when(value.isNotNull(), F.struct(F.col("epi_week"), value))
    return F.map_from_entries(F.collect_list(entry))


def _rolled_up(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weekly counts of coarser groups; also lets one stored table serve several groupings."""
    return counts.groupBy(*by, "epi_year", "epi_week").agg(F.sum("casos").alias("casos"))


def corridor_current(counts: DataFrame, year: int, by: Sequence[str] = (),
                     groups: Sequence[tuple] | None = None) -> DataFrame:
    """This year's line over weeks 1 to 52 (or the last seen week), NULL without cases.

    ``groups`` lists values of ``by`` that get 52 empty weeks if they have no case at all.
    """
    this_year = F.col("epi_year") == year
    rows = with_groups(_rolled_up(counts, by), by, groups)
    lines = rows.groupBy(*by).agg(
        F.greatest(F.lit(52), F.max(F.when(this_year, F.col("epi_week")))).alias("last_week"),
        _week_map(F.when(this_year, F.col("casos"))).alias("by_week"))
    return (lines
            .select(*by, "by_week", F.explode(F.sequence(F.lit(1), "last_week")).alias("epi_week"))
            .select(*by, "epi_week", F.try_element_at("by_week", F.col("epi_week")).alias("casos")))


def history_quantiles(counts: DataFrame, year: int, previous_years: int,
                      by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles and maximum per week over the earlier years that had cases that week."""
    earlier = F.col("epi_year").between(year - previous_years, year - 1)
    quartiles = F.percentile("casos", [0.25, 0.5, 0.75])
    weekly = _rolled_up(counts.where(earlier), by).groupBy(*by, "epi_week").agg(
        F.min("casos").cast("double").alias("min"),
        quartiles.alias("quartiles"),
        F.max("casos").cast("double").alias("max"))
    return weekly.select(
        *by, "epi_week", "min",
        *[F.col("quartiles")[i].alias(q) for i, q in enumerate(("q1", "q2", "q3"))], "max")


def corridor_bands(quantiles: DataFrame, ylim: float, by: Sequence[str] = ()) -> DataFrame:
    """The weekly summary in long form: six named lines per week."""
    lines = {
        "min": F.col("min"), "Éxito": F.col("q1"), "Seguridad": F.col("q2"),
        "Alerta": F.col("q3"), "Brote": F.lit(float(ylim)), "max": F.col("max"),
    }
    return unpivot_records(quantiles, [*by, "epi_week"], [
        {"zona": F.lit(zone), "quantile": value} for zone, value in lines.items()])


def corridor_range(quantiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Only the minimum and maximum lines."""
    return unpivot_records(quantiles, [*by, "epi_week"], [
        {"zona": F.lit(zone), "quantile": F.col(zone)} for zone in ("min", "max")])


def corridor_polygons(quantiles: DataFrame, ylim: float, by: Sequence[str] = ()) -> DataFrame:
    """Closed zone outlines: 53 weekly points plus one zero point at either end.

    Weeks without history are 0, except for the outbreak zone, which is ``ylim``
    throughout. ``zone_order`` follows the display order, ``point_order`` the outline.
    """
    bands = F.struct("q1", "q2", "q3")
    groups = quantiles.groupBy(*by).agg(_week_map(bands).alias("by_week"))
    groups = groups.where(F.size("by_week") > 0)
    points = groups.select(
        *by, "by_week", F.explode(F.sequence(F.lit(0), F.lit(54))).alias("point_order"))
    points = points.withColumn(
        "epi_week", F.least(F.greatest("point_order", F.lit(1)), F.lit(53)))
    found = F.try_element_at(F.col("by_week"), F.col("epi_week"))
    heights = {
        "Brote": F.lit(float(ylim)), "Alerta": found["q3"],
        "Seguridad": found["q2"], "Éxito": found["q1"],
    }
    closing = F.col("point_order").isin(0, 54)
    return unpivot_records(points, [*by, "point_order", "epi_week"], [
        {
            "zona": F.lit(zone),
            "zone_order": F.lit(ZONES.index(zone) + 1),
            "quantile": F.when(closing, 0.0).otherwise(F.coalesce(height, F.lit(0.0))),
        }
        for zone, height in heights.items()])


def clamped(table: DataFrame, column: str, ylim: float) -> DataFrame:
    """Limit a plotted column to the axis; NULL stays NULL."""
    return table.withColumn(column, clamp(F.col(column).cast("double"), ylim))


@dataclass(frozen=True)
class Corridor:
    """The three tables behind one corridor chart."""

    current: DataFrame
    range: DataFrame
    polygons: DataFrame


def corridor_from_counts(counts: DataFrame, dates: ReportDates, previous_years: int,
                         ylim: float, by: Sequence[str] = (),
                         groups: Sequence[tuple] | None = None) -> Corridor:
    """Corridor tables from weekly counts; pass a stored count table to scan cases once."""
    quantiles = history_quantiles(counts, dates.year, previous_years, by)
    return Corridor(
        current=corridor_current(counts, dates.year, by, groups),
        range=corridor_range(quantiles, by),
        polygons=corridor_polygons(quantiles, ylim, by))


def endemic_corridor(
    cases: DataFrame,
    dates: ReportDates,
    *,
    by: Sequence[str] = (),
    site: str | Sequence[str] = "all",
    etiologies: str | Sequence[str] = "all",
    previous_years: int = 7,
    ylim: float = 100,
    check_site: bool = False,
    groups: Sequence[tuple] | None = None,
) -> Corridor:
    """Corridor tables straight from a case line list."""
    cases = positive_for_all(at_sites(cases, site, check=check_site), etiologies)
    return corridor_from_counts(
        weekly_counts(cases, by), dates, previous_years, ylim, by, groups)
