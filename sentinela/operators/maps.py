"""Located positive cases, community labels, map bounds and tile bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.functions.calendar import ReportDates
from sentinela.functions.results import any_of
from sentinela.functions.scalars import lookup, normal_noise, rank_in
from sentinela.operators.reshape import require_flags, unpivot_flags
from sentinela.syndromes import DEPARTMENT_CODES

PLACE_KEYS = ["subject_department", "subject_municipality", "subject_community"]


def join_locations(cases: DataFrame, locations: DataFrame,
                   keys: Sequence[str] = tuple(PLACE_KEYS)) -> DataFrame:
    """Left join on the place columns, where an unknown place matches an unknown place.

    No broadcast hint: Spark broadcasts the locations while they are below its size
    threshold and otherwise shuffles both sides and splits skewed places.
    """
    right = locations.select(*[F.col(k).alias(f"_{k}") for k in keys],
                             *[c for c in locations.columns if c not in keys])
    matches = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return cases.join(right, matches, "left").drop(*[f"_{k}" for k in keys])


def join_communities(cases: DataFrame, communities: DataFrame) -> DataFrame:
    """Left join of coordinates on the community code."""
    right = communities.select(F.col("group").alias("community_code"), "long", "lat")
    return cases.join(right, "community_code", "left")


def place_coordinates(locations: DataFrame, communities: DataFrame) -> DataFrame:
    """Places with a community code and known coordinates; both tables are small beside cases."""
    known = communities.select(F.col("group").alias("community_code"), "long", "lat").where(
        F.col("long").isNotNull() & F.col("lat").isNotNull()
        & ~F.isnan("long") & ~F.isnan("lat"))
    return locations.where(F.col("community_code").isNotNull()).join(known, "community_code")


def locate(cases: DataFrame, locations: DataFrame, communities: DataFrame) -> DataFrame:
    """Cases with coordinates, once per code of their place; the others are left out.

    The place tables meet first, so the cases are joined only once. An unknown place
    matches an unknown place.
    """
    places = place_coordinates(locations, communities)
    places = places.withColumnsRenamed({k: f"_{k}" for k in PLACE_KEYS})
    matches = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in PLACE_KEYS]
    return cases.join(places, matches).drop(*[f"_{k}" for k in PLACE_KEYS])


def case_map_points(
    cases: DataFrame,
    locations: DataFrame,
    communities: DataFrame,
    labels: Mapping[str, str],
    dates: ReportDates,
    *,
    department: str | Sequence[str],
    months: int = 12,
    department_codes: Mapping[int, str] = DEPARTMENT_CODES,
    separator: str = "</br>",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per positive result with a known place, over the last months.

    Only cases with some positive result reach the join; the result columns turn
    into rows after it. ``keep`` carries extra case columns along.
    """
    flags = list(labels)
    require_flags(cases, flags)
    wanted = [department] if isinstance(department, str) else list(department)
    codes = [code for code, name in department_codes.items() if name in wanted]
    recent = cases.where(
        F.col("subject_department").isin(*codes)
        & F.col("service_date").between(
            F.lit(dates.trailing_start(months)), F.lit(dates.last_friday))
        & any_of(F.col(f) for f in flags))
    recent = recent.withColumn(
        "department_name", lookup(F.col("subject_department"), department_codes))
    columns = ["department_name", "subject_department", "subject_community",
               "community_code", "service_date"]
    located = locate(recent, locations, communities)
    rows = unpivot_flags(located, flags, [*keep, *columns, "long", "lat"], drop="false")
    label = lookup(F.col("etiology"), labels)
    return rows.select(
        *keep, *columns, label.alias("etiology"),
        rank_in(F.col("etiology"), flags).alias("ord"),
        F.concat(label, F.lit(separator), F.col("service_date").cast("string")).alias("label"),
        "long", "lat")


def jitter(points: DataFrame, keys: Sequence[str], seed: int = 0,
           offset: float = 5e-4) -> DataFrame:
    """Shift both coordinates by independent normal noise (mean and deviation ``offset``)."""
    def shifted(column: str, stream: int) -> Column:
        noise = normal_noise(seed * 2 + stream, *[F.col(k) for k in keys])
        return F.col(column) + noise * offset + offset

    return points.withColumns(
        {"long_offset": shifted("long", 0), "lat_offset": shifted("lat", 1)})


def community_labels(points: DataFrame) -> DataFrame:
    """Number of points per community and position."""
    return points.groupBy("subject_community", "long", "lat").agg(F.count(F.lit(1)).alias("n"))


def map_bounds(departments: DataFrame, by: Sequence[str] = ("region",)) -> DataFrame:
    """Outer limits of a region's outline and the tighter box first shown."""
    limits = departments.groupBy(*by).agg(
        (F.max("lat") + 0.005).alias("lat1"),
        F.min("long").alias("lng1"),
        (F.min("lat") - 0.005).alias("lat2"),
        F.max("long").alias("lng2"))
    return limits.select(
        "*",
        (F.col("lat1") - 0.06).alias("fit_lat1"),
        (F.col("lng1") + 0.01).alias("fit_lng1"),
        (F.col("lat2") + 0.06).alias("fit_lat2"),
        (F.col("lng2") - 0.01).alias("fit_lng2"))


def undetected(points: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """All labels when no point was found at all, otherwise no rows."""
    none_found = points.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    return none_found.select(
        F.posexplode(F.array(*[F.lit(v) for v in labels.values()])).alias("ord", "etiology")
    ).select((F.col("ord") + 1).alias("ord"), "etiology")


def undetected_by_department(points: DataFrame, labels: Mapping[str, str],
                             departments: Sequence[str]) -> DataFrame:
    """All labels of every given department without a single point."""
    listed = points.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.array(*[F.lit(d) for d in departments])).alias("department_name"))
    names = F.array(*[F.lit(v) for v in labels.values()])
    return (listed.join(points.select("department_name").distinct(), "department_name", "left_anti")
            .select("department_name", F.posexplode(names).alias("ord", "etiology"))
            .withColumn("ord", F.col("ord") + 1))


def tile_bins(points: DataFrame, zooms: Sequence[int], by: Sequence[str] = (),
              long: str = "long", lat: str = "lat") -> DataFrame:
    """Points per Web-Mercator tile and zoom, with their mean position.

    Points are aggregated once at the deepest zoom; a tile's parent is found by
    halving its numbers, so lower zooms add up tiles instead of reading points again.
    Coordinates are added as whole billionths of a degree, in a high and a low part that
    cannot overflow: the mean does not depend on the order of rows.
    """
    deepest = max(zooms)
    n_tiles = float(1 << deepest)
    last = F.lit((1 << deepest) - 1)
    # Fixed value: latitude at which the Web-Mercator square ends.
    phi = F.radians(F.least(F.greatest(F.col(lat), F.lit(-85.0511287798)), F.lit(85.0511287798)))
    mercator = F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi))
    x = F.floor((F.col(long) + 180.0) / 360.0 * n_tiles)
    y = F.floor((F.lit(1.0) - mercator / F.lit(3.141592653589793)) / 2.0 * n_tiles)

    def inside(tile: Column) -> Column:
        return F.least(F.greatest(tile, F.lit(0)), last).cast("bigint")

    def parts(column: str) -> tuple[Column, Column]:
        whole = F.rint(F.col(column) * 1e9).cast("bigint")
        return F.shiftright(whole, 20), whole.bitwiseAND(F.lit((1 << 20) - 1))

    def mean(column: str) -> Column:
        high, low = F.sum(f"{column}_high"), F.sum(f"{column}_low")
        return (high / F.sum("n") * float(1 << 20) + low / F.sum("n")) / 1e9

    sums = {f"{name}_{part}": F.sum(value)
            for name, column in (("long", long), ("lat", lat))
            for part, value in zip(("high", "low"), parts(column))}
    fine = (
        points.where(F.col(long).isNotNull() & F.col(lat).isNotNull())
        .groupBy(*by, inside(x).alias("x"), inside(y).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"), *[v.alias(name) for name, v in sums.items()]))
    levels = fine.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in sorted(zooms)])))
    scale = F.pow(F.lit(2.0), F.lit(deepest) - F.col("zoom"))
    return (
        levels.withColumns({
            "x": F.floor(F.col("x") / scale).cast("bigint"),
            "y": F.floor(F.col("y") / scale).cast("bigint")})
        .groupBy(*by, "zoom", "x", "y")
        .agg(F.sum("n").alias("n"),
             mean("long").alias("long"), mean("lat").alias("lat")))
