"""Operators on period series: rolling statistics, overview, stacking, range cuts.

Every window here runs over *points*: at most one row per series and date, as made by
:func:`period_points`. A series is therefore bounded by the calendar (a century of days
is under 37,000 rows) however many raw rows it has, and one window task never sees
more than that. The raw rows are only ever touched by a map-side aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela.functions.calendar import floor_date
from sentinela.functions.scalars import valid


def period_points(rows: DataFrame, series: Sequence[str], time: str, unit: str,
                  values: Mapping[str, Column]) -> DataFrame:
    """Aggregate raw rows to one point per series and period, with the period date in ``t``."""
    return (rows.groupBy(*series, floor_date(F.col(time), unit).alias("t"))
            .agg(*[agg.alias(name) for name, agg in values.items()]))


# Days of a range of dates, which one row holds.
RANGE_DAYS = 64


def _require_points(points: DataFrame) -> None:
    if not isinstance(points.schema["t"].dataType, T.DateType):
        raise ValueError("series operators need period points with a date column t; "
                         "build them with period_points()")


def _trailing(points: DataFrame, series: Sequence[str], n: int) -> WindowSpec:
    _require_points(points)
    if n < 1:
        raise ValueError("the rolling period must be at least 1")
    return Window.partitionBy(*series).orderBy("t").rowsBetween(-(n - 1), 0)


def rolling_mean(points: DataFrame, series: Sequence[str], n: int, y: str = "y") -> DataFrame:
    """Mean of the last ``n`` points, missing ones skipped; the head uses what there is."""
    window = _trailing(points, series, n)
    rolled = F.col(y) if n == 1 else F.avg(valid(F.col(y))).over(window)
    return points.withColumn("rolled", rolled)


def _rolling_sum(value: Column, window: WindowSpec) -> Column:
    return F.sum(F.coalesce(valid(value.cast("double")), F.lit(0.0))).over(window)


def rolling_proportion(points: DataFrame, series: Sequence[str], n: int,
                       num: str = "num", den: str = "den") -> DataFrame:
    """Percentage of the summed counts of the last ``n`` points; 0 without a denominator."""
    window = _trailing(points, series, n)
    sums = points.withColumns({
        "sum_num": _rolling_sum(F.col(num), window),
        "sum_den": _rolling_sum(F.col(den), window)})
    return sums.withColumn("rolled", _share() * 100.0)


def _share() -> Column:
    return F.when(F.col("sum_den") != 0, F.col("sum_num") / F.col("sum_den")).otherwise(0.0)


def proportion_band(points: DataFrame, series: Sequence[str], n: int, *, sigma: float = 2.0,
                    wilson: bool = True, num: str = "num", den: str = "den") -> DataFrame:
    """Rolling percentage with a Wilson or normal interval of ``sigma`` deviations."""
    rolled = rolling_proportion(points, series, n, num, den)
    count, s2 = F.col("sum_den"), F.lit(float(sigma) ** 2)
    share = _share()
    if wilson:
        p = F.greatest(share, F.lit(0.0))
        half = sigma * F.sqrt(p * (1 - p) / count + s2 / (4 * count * count))
        centre, scale = p + s2 / (2 * count), 1 + s2 / count
        limits = (p, (centre - half) / scale, (centre + half) / scale)
        mid, low, high = [F.when(count != 0, 100.0 * v).otherwise(0.0) for v in limits]
    else:
        half = F.when(count != 0, sigma * F.sqrt(share * (1 - share) / count)).otherwise(1.0)
        mid, low, high = 100.0 * share, 100.0 * (share - half), 100.0 * (share + half)
    return rolled.withColumns({"rolled": mid, "low": low, "high": high})


def rolling_band(points: DataFrame, series: Sequence[str], n: int, low: str = "low",
                 mid: str = "mid", high: str = "high") -> DataFrame:
    """Means of three lines over the last ``n`` points, skipping points without a middle."""
    window = _trailing(points, series, n)
    known = valid(F.col(mid)).isNotNull()

    def mean(column: str) -> Column:
        total = F.sum(F.when(known, F.coalesce(F.col(column), F.lit(0.0)))).over(window)
        return total / F.nullif(F.count(F.when(known, 1)).over(window), F.lit(0))

    return points.withColumns({f"rolled_{c}": mean(c) for c in (low, mid, high)})


def rolling_error(points: DataFrame, series: Sequence[str], n: int, *, sigma: float = 2.0,
                  y: str = "y", error: str = "error") -> DataFrame:
    """Rolling mean with pooled standard errors: ``sqrt(sum(error^2)) / n``, ``sigma`` wide."""
    window = _trailing(points, series, n)
    known = valid(F.col(y))
    squares = F.when(known.isNotNull(), F.coalesce(F.col(error) * F.col(error), F.lit(0.0)))
    count = F.nullif(F.count(known).over(window), F.lit(0))
    half = sigma * F.sqrt(F.sum(squares).over(window)) / count
    mean = F.avg(known).over(window)
    lines = {"rolled": mean, "low": mean - half, "high": mean + half}
    if n == 1:
        # Nothing is averaged, so a NaN stays a NaN.
        lines = {name: F.coalesce(line, F.col(y)) for name, line in lines.items()}
    return points.withColumns(lines)


def series_overview(points: DataFrame, y: str = "y") -> DataFrame:
    """Mean over all series at every date, missing values skipped."""
    _require_points(points)
    return points.groupBy("t").agg(F.avg(valid(F.col(y))).alias("y"))


def overview_on_log_scale(overview: DataFrame) -> DataFrame:
    """The overview's values as powers of ten; values without one become NULL."""
    return overview.withColumn("y", F.log10("y"))


def overview_limits(overview: DataFrame, log_scale: bool = False) -> DataFrame:
    """Axis range of an overview, padded by a quarter; on a log scale only upwards."""
    y = F.col("y")
    usable = ~F.isnan(y) & (F.abs(y) != float("inf"))
    if log_scale:
        usable = usable & (y > 0)
    limits = overview.where(usable).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    if log_scale:
        return limits.select(
            F.log10(lo).alias("y_min"), (F.log10(hi) * 1.25).alias("y_max"))
    extra = F.when(hi - lo <= 0, hi).otherwise(hi - lo) * 0.25
    return limits.select((lo - extra).alias("y_min"), (hi + extra).alias("y_max"))


def series_names(sums: DataFrame, order: Sequence[str]) -> DataFrame:
    """(ord, name): the listed series and then all others, by name; one row per series."""
    listed = F.array(*[F.lit(name) for name in order]).cast("array<string>")
    first = sums.sparkSession.range(0, 1, 1, 1).select(F.posexplode(listed).alias("ord", "name")).select(
        (F.col("ord") + 1).alias("ord"), "name")
    others = sums.where(F.col("name").isNull() | ~F.col("name").isin(*order)).select("name").distinct()
    by_name = Window.orderBy(F.col("name").asc_nulls_first())
    return first.unionByName(others.select(
        (F.row_number().over(by_name) + len(order)).alias("ord"), "name"))


def date_ranges(sums: DataFrame, date_range: Column) -> Column:
    """The ranges and their dates, as one value; there are no more dates than days in the calendar."""
    ranges = sums.select("t").distinct().groupBy(date_range).agg(
        F.sort_array(F.collect_list("t")).alias("dates"))
    return ranges.agg(F.sort_array(F.collect_list(F.struct("range", "dates"))).alias("ranges")).scalar()


def stacked_series(points: DataFrame, series: str, order: Sequence[str], *,
                   fill: str = "all", y: str = "y") -> DataFrame:
    """Running total across series at every date, the last series at the bottom.

    A missing value stacks as the line between its neighbours; beyond the first or last
    value it takes that value (``"all"``) or 0 (``"inside"``); ``"none"`` stacks 0.
    Series that ``order`` does not name follow those it names, by name.

    Every series is worked off in ranges of dates: its last and first known values of a range
    are carried to the ranges after and before, and only then do dates become rows. A task holds
    the ranges of one series or the series of one date, never dates times series.
    """
    _require_points(points)
    if fill not in ("all", "inside", "none"):
        raise ValueError(f"fill must be all, inside or none, not {fill!r}")
    sums = points.groupBy("t", F.col(series).cast("string").alias("name")).agg(
        F.sum(valid(F.col(y))).cast("double").alias("y"))
    date_range = F.floor(F.datediff("t", F.lit(dt.date(1970, 1, 1))) / RANGE_DAYS).alias("range")
    cells = series_names(sums, order).select(
        "ord", "name", F.explode(date_ranges(sums, date_range)).alias("cell")).select(
        "ord", "name", "cell.range", "cell.dates")
    known = sums.where("y is not null").groupBy("name", date_range).agg(
        F.sort_array(F.collect_list(F.struct("t", "y"))).alias("points"))
    c, k = cells.alias("c"), known.alias("k")
    cells = c.join(k, F.col("c.name").eqNullSafe(F.col("k.name")) & (F.col("c.range") == F.col("k.range")),
                   "left").select("c.*", "k.points")

    line = Window.partitionBy("ord").orderBy("range")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(1, Window.unboundedFollowing)
    cells = cells.withColumns({
        "carried": F.last(F.element_at("points", -1), ignorenulls=True).over(before),
        "awaited": F.first(F.element_at("points", 1), ignorenulls=True).over(after)})
    grid = cells.withColumn("t", F.explode("dates")).withColumns({
        "y": F.get(F.filter("points", lambda p: p["t"] == F.col("t")), F.lit(0))["y"],
        # The nearest known values on both sides, in this range or from another.
        "prev": F.coalesce(F.try_element_at(
            F.filter("points", lambda p: p["t"] < F.col("t")), F.lit(-1)), "carried"),
        "next": F.coalesce(F.try_element_at(
            F.filter("points", lambda p: p["t"] > F.col("t")), F.lit(1)), "awaited")})
    prev_y, next_y = F.col("prev.y"), F.col("next.y")
    steps = F.datediff("t", F.col("prev.t")) / F.datediff(F.col("next.t"), F.col("prev.t"))
    zero = F.lit(0.0)
    inside = prev_y + (next_y - prev_y) * steps
    filled = {
        "all": F.coalesce("y", inside, prev_y, next_y, zero),
        "inside": F.coalesce("y", inside, zero),
        "none": F.coalesce("y", zero),
    }[fill]
    below = Window.partitionBy("t").orderBy(F.desc("ord")).rowsBetween(
        Window.unboundedPreceding, 0)
    return (grid.select("t", F.col("name").alias(series), "ord", "y", filled.alias("filled"))
            .withColumn("y_stacked", F.sum("filled").over(below)).drop("filled"))


def range_cut(points: DataFrame, series: Sequence[str], low: dt.date, high: dt.date,
              y: str = "y") -> DataFrame:
    """Points from ``low`` to ``high`` plus one with a value on each side.

    Where a side has no value its whole rest is kept; a series that lies entirely
    before or after the range keeps that open end.
    """
    _require_points(points)
    whole = Window.partitionBy(*series)
    has_value, t = F.col(y).isNotNull(), F.col("t")
    start, end = F.lit(low), F.lit(high)
    first, last = F.min("t").over(whole), F.max("t").over(whole)
    value_before = F.max(F.when((t < start) & has_value, t)).over(whole)
    value_after = F.min(F.when((t > end) & has_value, t)).over(whole)
    marked = points.withColumns({
        "_from": F.when(last < start, first).otherwise(F.coalesce(value_before, first)),
        "_to": F.when(first > end, last).otherwise(F.coalesce(value_after, last))})
    return marked.where(t.between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def series_extremes(rows: DataFrame, series: Sequence[str], y: str = "y") -> DataFrame:
    """Smallest and largest value per series, NULL and NaN skipped; works on raw rows."""
    value = valid(F.col(y))
    return rows.groupBy(*series).agg(F.min(value).alias("y_min"), F.max(value).alias("y_max"))


def log_domain(y: Column) -> Column:
    """Values that exist on a log scale; zero and below become NULL."""
    return F.when(y > 0, y)


def log_domain_all(*values: Column) -> list[Column]:
    """Several values of one point: all become NULL if one does not exist on a log scale."""
    exists = F.least(*values) > 0
    known = F.lit(True)
    for value in values:
        known = known & value.isNotNull()
    return [F.when(known & exists, value) for value in values]
