"""Registered queries: every operator on the test tables, over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela import syndromes
from sentinela.functions import calendar as cal
from sentinela.functions import results, scalars
from sentinela.operators import (
    cases as case_ops, corridor, cube, curve, effort, maps, positivity, reshape, series, timeseries,
)
from sentinela.plans import refresh, sample, tables
from sentinela.plans.tables import DATES, ETIOLOGIES, PREVIOUS_YEARS
from sentinela.sources import snapshots, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SITE = ["site_name"]
FLAGS = list(ETIOLOGIES)
EVENT = ["event_type"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits of doubles whose last bits depend on the order of addition.

    Cut to twelve digits first, so that such sums fall on the same side of a tie.
    """
    def six(c: str) -> Column:
        return F.when(~F.isnan(c), F.round(F.col(c).cast("decimal(30,12)"), 6).cast("double")
                      ).otherwise(F.col(c))

    return df.withColumns({c: six(c) for c in columns})


# --- sources ---------------------------------------------------------------------------

@query
def bounded_view(spark, sf):
    return views.query_view(
        tables.read(spark, sf, "orders"),
        ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"],
        DATES.last_friday, "o_orderdate")


@query
def projected_view(spark, sf):
    return views.select_columns(
        tables.read(spark, sf, "orders"), ["o_custkey", "o_orderkey", "o_orderpriority"])


@query
def discovered_view(spark, sf):
    """Columns are discovered, repeated names dropped, then read like any other view."""
    found = tables.read(spark, sf, "orders")
    repeated = found.select(*found.columns, F.col("o_custkey").alias("o_orderkey"))
    return views.query_view(repeated, None, DATES.last_friday, "o_orderdate")


@query
def location_codes(spark, sf):
    return views.read_locations(tables.location_codes(spark, sf))


@query
def snapshot_roundtrip(spark, sf):
    store = snapshots.Snapshots(spark, snapshots.new_folder(spark, "snapshot"), DATES.last_friday)
    return store.get("orders", lambda: bounded_view(spark, sf))


@query
def weekly_refresh(spark, sf):
    """A whole weekly refresh into a new folder, and its stored positivity tables."""
    return refresh.stored_positivity(_refreshed(spark, sf))


def _refreshed(spark, sf) -> dict[str, DataFrame]:
    return refresh.run_refresh(
        spark, sample.sample_sources(spark, sf), snapshots.new_folder(spark, "refresh"),
        DATES, sample.SETTINGS)


def _each_syndrome(stored: dict[str, DataFrame], table: str,
                   shape: Callable[[DataFrame, syndromes.Syndrome], DataFrame]) -> DataFrame:
    """One stored table of all syndromes in a common shape."""
    return reduce(DataFrame.unionByName, [
        shape(stored[f"{name}_{table}"], pack).withColumn("syndrome", F.lit(name))
        for name, pack in syndromes.SYNDROMES.items()])


@query
def refresh_monthly(spark, sf):
    """Stored monthly positives of all syndromes, by printed names."""
    return _each_syndrome(_refreshed(spark, sf), "monthly", lambda table, pack:
        reshape.unpivot_records(table, ["site_type", "department", "site", "service_date"], [
            {"etiology": F.lit(e), "cases": F.col(e)} for e in pack.labels]))


@query
def refresh_corridor_current(spark, sf):
    """Stored lines of the year, true and as drawn inside the axis."""
    def shape(table: DataFrame, pack: syndromes.Syndrome) -> DataFrame:
        part = F.col("disposition") if pack.has_disposition else F.lit("all")
        return table.select("site_name", part.alias("disposition"), "epi_week", "casos", "shown")

    return _each_syndrome(_refreshed(spark, sf), "corridor_current", shape)


@query
def refresh_positivity_text(spark, sf):
    """Stored text cells of the positivity tables."""
    def shape(table: DataFrame, pack: syndromes.Syndrome) -> DataFrame:
        part = F.col("disposition") if pack.has_disposition else F.lit("all")
        return table.withColumn("disposition", part)

    return _each_syndrome(_refreshed(spark, sf), "positivity_text", shape)


@query
def refresh_map_points(spark, sf):
    """Stored located positives; the shown position is near the true one."""
    return _each_syndrome(_refreshed(spark, sf), "map_points", lambda table, pack: table.select(
        "unique_id", "department_name", "community_code", "etiology", "long", "lat",
        (F.abs(F.col("long_offset") - F.col("long") - 5e-4) < 10 * 5e-4).alias("near")))


@query
def refresh_effort_text(spark, sf):
    """Stored text cells of the screening effort."""
    return _refreshed(spark, sf)["screening_effort_text"]


# --- calendar --------------------------------------------------------------------------

@query
def calendar_params(spark, sf):
    """Every order date taken as the run date of a report."""
    day = F.col("run_date")
    friday = cal.last_friday_of(day)
    month = F.trunc(friday, "month")
    days = tables.read(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("run_date")).distinct()
    return days.select(
        "run_date",
        friday.alias("last_friday"),
        cal.first_sunday_of(friday).alias("first_sunday"),
        month.alias("this_month_start"),
        F.add_months(month, -1).alias("last_month_start"),
        cal.next_month_start(month).alias("next_month_start"),
        F.add_months(friday, -3).alias("trailing_start"),
        cal.floor_date(day, "week").alias("week_start"),
        cal.floor_date(day, "month").alias("month_start"),
        cal.floor_date(day, "quarter").alias("quarter_start"),
        cal.floor_date(day, "year").alias("year_start"),
        cal.spanish_month(day).alias("month_name"),
        F.concat(F.year(friday) - PREVIOUS_YEARS, F.lit(" a "), F.year(friday) - 1)
        .alias("history_years"),
        F.concat(F.add_months(friday, -3).cast("string"), F.lit(" a "), friday.cast("string"))
        .alias("map_dates"))


@query
def trailing_range(spark, sf):
    return tables.cases(spark, sf).where(cal.in_trailing_months(
        F.col("service_date"), F.lit(DATES.last_friday), 3)).select("unique_id", "service_date")


@query
def epoch_timestamps(spark, sf):
    rows = tables.effort_rows(spark, sf)
    return rows.groupBy(F.to_date(cal.from_epoch(F.col("PDAInsertEpoch"))).alias("insert_date")
                        ).agg(F.count(F.lit(1)).alias("n"))


@query
def age_days(spark, sf):
    raw = tables.raw_view(spark, sf, {"o_orderkey": "o_orderkey"})
    return raw.select(
        "o_orderkey",
        scalars.approximate_age_days(
            F.col("edadAnios"), F.col("edadMeses"), F.col("edadDias")).alias("age_aprox"),
        F.datediff(F.to_date("fechaHoraAdmision"),
                   cal.parse_birth_date(F.col("fechaDeNacimiento"))).alias("age_dates"))


# --- cases -----------------------------------------------------------------------------

@query
def first_seen_cases(spark, sf):
    """First order of every customer, kept only if it also meets the other conditions."""
    firsts = case_ops.keep_first_seen(
        tables.cases(spark, sf), ["subject_id"], ["service_date", "unique_id"],
        also=(F.col("service_date") < F.lit(DATES.next_month_start))
        & F.col("site_name").isin("BUILDING", "FURNITURE", "MACHINERY") & (F.col("unique_id") % 11 != 0))
    return firsts.select("unique_id", "subject_id", "service_date", "site_name")


@query
def first_seen_null_ids(spark, sf):
    """A third of the ids are NULL and form one large group."""
    orders = tables.read(spark, sf, "orders").select(
        F.expr("case when o_orderkey % 3 <> 0 then o_custkey end").alias("subject_id"),
        F.col("o_orderkey").alias("unique_id"), F.to_date("o_orderdate").alias("service_date"))
    return case_ops.keep_first_seen(orders, ["subject_id"], ["service_date", "unique_id"])


def _line_list(spark, sf, syndrome, columns) -> DataFrame:
    raw = tables.raw_view(spark, sf, columns)
    return case_ops.syndrome_cases(
        raw, syndrome, DATES, tables.SITES, ["PDAInsertDate", "SASubjectID"])


@query
def respiratory_line_list(spark, sf):
    return _line_list(spark, sf, syndromes.RESPIRATORY, tables.RESPIRATORY)


@query
def diarrheal_line_list(spark, sf):
    return _line_list(spark, sf, syndromes.DIARRHEAL, tables.DIARRHEAL)


@query
def febrile_line_list(spark, sf):
    return _line_list(spark, sf, syndromes.FEBRILE, tables.FEBRILE)


def _decoded(spark, sf, syndrome, columns) -> DataFrame:
    raw = tables.raw_view(spark, sf, {"o_orderkey": "o_orderkey", **columns})
    return case_ops.derive(raw, [syndrome.results(), syndrome.residuals()], ["o_orderkey"])


@query
def respiratory_results(spark, sf):
    return _decoded(spark, sf, syndromes.RESPIRATORY, tables.RESPIRATORY)


@query
def diarrheal_results(spark, sf):
    return _decoded(spark, sf, syndromes.DIARRHEAL, tables.DIARRHEAL)


@query
def febrile_results(spark, sf):
    return _decoded(spark, sf, syndromes.FEBRILE, tables.FEBRILE)


@query
def sorted_line_list(spark, sf):
    return case_ops.sort_cases(tables.cases(spark, sf)).select(
        "site_type", "site_department", "service_date", "unique_id", *FLAGS)


@query
def site_membership(spark, sf):
    return case_ops.at_sites(tables.cases(spark, sf), tables.HOSPITALS).select(
        "unique_id", "site_name")


@query
def unknown_sites(spark, sf):
    """Requested sites that no case has."""
    return case_ops.unknown_sites(
        tables.cases(spark, sf), [*tables.SITES, "FURNITUR", "Ninguno"])


@query
def scale_names(spark, sf):
    """First and last period of all cases on every time scale, under its axis name."""
    day = F.col("service_date")
    rows = reshape.unpivot_records(
        tables.cases(spark, sf).select("service_date").distinct(), [],
        [{"scale": F.lit(cal.scale_name(s)), "period": cal.floor_date(day, s)}
         for s in cal.SCALE_NAMES])
    return rows.groupBy("scale").agg(
        F.min("period").alias("first_period"), F.max("period").alias("last_period"))


@query
def report_captions(spark, sf):
    """The texts of a report, beside the number of cases up to its last day."""
    texts = refresh.captions(DATES, sample.SETTINGS)
    total = tables.cases(spark, sf).where(F.col("service_date") <= F.lit(DATES.last_friday)).agg(
        F.count(F.lit(1)).alias("cases"))
    return reshape.unpivot_records(total, ["cases"], [
        {"name": F.lit(name), "text": F.lit(text)} for name, text in texts.items()])


@query
def recoded_sites(spark, sf):
    """Recodes with and without a default, and the order of the recoded values."""
    names = {"BUILDING": "Hospital B", "MACHINERY": "Hospital M"}
    rows = tables.cases(spark, sf)
    site = F.col("site_name")
    return rows.groupBy(
        scalars.recode(site, names).alias("site"),
        scalars.rank_in(site, list(names)).alias("ord"),
        scalars.lookup(F.col("subject_department"), syndromes.DEPARTMENT_CODES).alias("department"),
        scalars.site_type_of(F.when(site == "BUILDING", "H").when(site == "FURNITURE", "CS"))
        .alias("site_type"),
        scalars.title_case(F.lower(site)).alias("titled"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def hex_ids(spark, sf):
    rows = tables.read(spark, sf, "customer")
    return rows.select("c_custkey", scalars.hex_text(F.encode("c_name", "UTF-8")).alias("id_text"))


@query
def results_long(spark, sf):
    """One row per decoded result; results that do not apply are left out."""
    return reshape.unpivot_flags(tables.cases(spark, sf), FLAGS, ["unique_id"])


@query
def positive_results(spark, sf):
    long = reshape.unpivot_flags(tables.cases(spark, sf), FLAGS, ["unique_id"], drop="nothing")
    return long.where("result").select("unique_id", "etiology")


# --- positivity ------------------------------------------------------------------------

@query
def positivity_table(spark, sf):
    return positivity.positivity_table(tables.cases(spark, sf), ETIOLOGIES, DATES)


@query
def positivity_by_site(spark, sf):
    return positivity.positivity_table(tables.cases(spark, sf), ETIOLOGIES, DATES, by=SITE)


@query
def positivity_by_condition(spark, sf):
    admitted = results.admitted_or_unknown(F.col("admitted"), F.col("emergency"))
    return positivity.positivity_table(
        tables.cases(spark, sf), ETIOLOGIES, DATES, site=tables.HOSPITALS, condition=admitted)


@query
def positivity_by_disposition(spark, sf):
    """Both hospital dispositions of every site in one job."""
    rows = tables.cases(spark, sf).withColumn(
        "disposition", results.disposition(F.col("admitted"), F.col("emergency")))
    return positivity.positivity_table(
        rows, ETIOLOGIES, DATES, by=["site_name", "disposition"], site=tables.HOSPITALS)


@query
def positivity_text_table(spark, sf):
    return positivity.positivity_text(positivity_by_site(spark, sf), by=SITE)


@query
def daily_cube(spark, sf):
    return cube.daily_cube(tables.cases(spark, sf), FLAGS, ["site_type", "site_name"])


@query
def positivity_from_cube(spark, sf):
    return positivity.positivity_from_cube(daily_cube(spark, sf), ETIOLOGIES, DATES, by=SITE)


@query
def weekly_counts_from_cube(spark, sf):
    return cube.cube_weekly_counts(daily_cube(spark, sf), SITE)


@query
def period_counts_from_cube(spark, sf):
    return cube.cube_period_counts(daily_cube(spark, sf), FLAGS, "quarter")


@query
def report_roundtrip(spark, sf):
    """A report table written as JSON lines and read back."""
    table = positivity_by_site(spark, sf)
    path = snapshots.new_folder(spark, "report")
    snapshots.write_report(table, path, "json")
    return spark.read.schema(table.schema).json(path)


# --- corridor --------------------------------------------------------------------------

def _counts(spark, sf, by=SITE) -> DataFrame:
    return corridor.weekly_counts(tables.cases(spark, sf), by)


def _quantiles(spark, sf, by=SITE) -> DataFrame:
    return corridor.history_quantiles(_counts(spark, sf, by), DATES.year, PREVIOUS_YEARS, by)


@query
def weekly_counts(spark, sf):
    return _counts(spark, sf)


@query
def corridor_current(spark, sf):
    return corridor.corridor_current(_counts(spark, sf), DATES.year, SITE)


@query
def corridor_bands(spark, sf):
    return corridor.corridor_bands(_quantiles(spark, sf, ()), 40)


@query
def corridor_bands_by_site(spark, sf):
    return corridor.corridor_bands(_quantiles(spark, sf), 40, SITE)


@query
def corridor_range(spark, sf):
    return corridor.corridor_range(_quantiles(spark, sf), SITE)


@query
def corridor_polygons(spark, sf):
    return corridor.corridor_polygons(_quantiles(spark, sf), 40, SITE)


@query
def corridor_polygons_clamped(spark, sf):
    return corridor.clamped(corridor.corridor_polygons(_quantiles(spark, sf, ()), 45), "quantile", 45)


@query
def corridor_etiology(spark, sf):
    """This year's line of the cases positive for two etiologies at two sites."""
    return corridor.endemic_corridor(
        tables.cases(spark, sf), DATES, site=tables.HOSPITALS, etiologies=["flu", "rsv"],
        previous_years=PREVIOUS_YEARS).current


@query
def corridor_etiology_range(spark, sf):
    return corridor.endemic_corridor(
        tables.cases(spark, sf), DATES, by=SITE, etiologies="pneumo",
        previous_years=PREVIOUS_YEARS).range


# --- curve, maps -----------------------------------------------------------------------

@query
def epidemic_curve(spark, sf):
    return curve.epidemic_curve(tables.cases(spark, sf), ETIOLOGIES, "hospital")


def _locations(spark, sf) -> DataFrame:
    return views.read_locations(tables.location_codes(spark, sf))


def _map_points(spark, sf) -> DataFrame:
    return maps.case_map_points(
        tables.cases(spark, sf), _locations(spark, sf), tables.communities(spark, sf),
        ETIOLOGIES, DATES, department=["Santa Rosa", "Quetzaltenango"],
        months=tables.MAP_MONTHS, keep=["unique_id"])


@query
def case_map_points(spark, sf):
    return _map_points(spark, sf)


@query
def case_map_labels(spark, sf):
    return maps.community_labels(_map_points(spark, sf))


@query
def case_map_bounds(spark, sf):
    bounds = maps.map_bounds(tables.department_outlines(spark, sf))
    return rounded(bounds, *[c for c in bounds.columns if c != "region"])


@query
def case_map_undetected(spark, sf):
    """Labels of each department without a case in one community's last three months."""
    cases = tables.cases(spark, sf).where("subject_community = 'C9'")
    departments = ["Santa Rosa", "Quetzaltenango", "Guatemala"]
    points = maps.case_map_points(
        cases, _locations(spark, sf), tables.communities(spark, sf), ETIOLOGIES, DATES,
        department=departments, months=tables.MAP_MONTHS)
    return maps.undetected_by_department(points, ETIOLOGIES, departments)


@query
def case_map_none_found(spark, sf):
    """All labels if one department has no point at all, by its cases of two communities."""
    def listed(community: str) -> DataFrame:
        points = maps.case_map_points(
            tables.cases(spark, sf).where(F.col("subject_community") == community),
            _locations(spark, sf), tables.communities(spark, sf), ETIOLOGIES, DATES,
            department="Santa Rosa", months=tables.MAP_MONTHS)
        return maps.undetected(points, ETIOLOGIES).select(
            F.lit(community).alias("community"), "ord", "etiology")

    return listed("C9").unionByName(listed("C3"))


@query
def jittered_points(spark, sf):
    """What is fixed about the noise: it leaves the point in place and is bounded and not nil."""
    points = maps.jitter(_map_points(spark, sf), ["unique_id", "etiology", "long", "lat"], seed=7)
    shifts = {c: F.col(f"{c}_offset") - F.col(c) for c in ("long", "lat")}
    return points.select(
        "unique_id", "etiology", "long", "lat",
        *[(F.abs(s - 5e-4) < 10 * 5e-4).alias(f"{c}_near") for c, s in shifts.items()],
        (shifts["long"] != shifts["lat"]).alias("independent"))


@query
def location_join_nullsafe(spark, sf):
    return maps.join_locations(tables.cases(spark, sf), _locations(spark, sf)).select(
        "unique_id", *maps.PLACE_KEYS, "community_code")


@query
def community_join(spark, sf):
    located = maps.join_locations(tables.cases(spark, sf), _locations(spark, sf))
    return maps.join_communities(located, tables.communities(spark, sf)).select(
        "unique_id", "community_code", "long", "lat")


@query
def tile_bins(spark, sf):
    located = maps.locate(
        tables.cases(spark, sf), _locations(spark, sf), tables.communities(spark, sf))
    return rounded(maps.tile_bins(located, range(10, 16)), "long", "lat")


# --- period time series ----------------------------------------------------------------

def _timeseries(scale: str) -> Query:
    def run(spark, sf):
        return timeseries.case_timeseries(
            tables.cases(spark, sf), site_type="hospital", etiology="flu",
            sites=["MACHINERY", "BUILDING"], scale=scale,
            site_names={"BUILDING": "Hospital B"})
    return run


for _scale in cal.SCALE_NAMES:
    QUERIES[f"timeseries_{_scale}"] = _timeseries(_scale)


@query
def timeseries_long(spark, sf):
    return timeseries.period_counts_long(tables.cases(spark, sf), FLAGS, "week")


@query
def timeseries_site_series(spark, sf):
    return timeseries.series_long(
        tables.cases(spark, sf), site_type="centro de salud", etiology="pneumo",
        site_names={"FURNITURE": "Centro F"})


@query
def timeseries_max(spark, sf):
    return timeseries.largest_count(
        timeseries.period_counts(tables.cases(spark, sf), FLAGS), FLAGS)


# --- screening effort ------------------------------------------------------------------

def _effort(spark, sf) -> DataFrame:
    rows = tables.effort_rows(spark, sf)
    subjects = rows.withColumn("PDAInsertDate", cal.from_epoch(F.col("PDAInsertEpoch")))
    return effort.screening_effort(
        subjects, rows.where("has_eligibility"), DATES,
        consent=sample.SETTINGS.consent, sites=tables.SITES,
        soft_catchment=tables.SOFT_CATCHMENT)


@query
def screening_effort_counts(spark, sf):
    return _effort(spark, sf)


@query
def screening_effort_text(spark, sf):
    return effort.effort_text(_effort(spark, sf))


@query
def screening_effort(spark, sf):
    headings = [f"{d} ({s})" for d in ("Quetzaltenango", "Santa Rosa") for s in tables.SITES]
    return effort.effort_table(_effort(spark, sf), headings)


@query
def catchment_filter(spark, sf):
    rows = tables.effort_rows(spark, sf).where(
        effort.in_catchment(tables.SITES, tables.SOFT_CATCHMENT))
    return rows.groupBy("SiteName", "NombreMunicipio", "catchment").agg(
        F.count(F.lit(1)).alias("n"))


# --- series operators ------------------------------------------------------------------

def _daily(spark, sf, **values) -> DataFrame:
    return series.period_points(tables.read(spark, sf, "events"), EVENT, "ts", "day", values)


def _with_gaps(spark, sf) -> DataFrame:
    """Daily means with some days missing: at the start, inside and at the end."""
    gap = (F.dayofmonth("t") <= 2) | (F.dayofmonth("t") % 7 == 4) | (F.dayofmonth("t") >= 29)
    wide = _daily(spark, sf, y=F.avg("value"))
    return wide.withColumn("y", F.when(~gap | (F.col("event_type") == "click"), F.col("y")))


@query
def rolling_mean(spark, sf):
    rolled = series.rolling_mean(_with_gaps(spark, sf), EVENT, 7)
    return rounded(rolled, "y", "rolled")


def _share(spark, sf) -> DataFrame:
    high = F.count_if(F.col("value") > 20)
    some = F.when(F.dayofmonth(F.first("ts")) > 3, F.count(F.lit(1))).otherwise(0)
    return _daily(spark, sf, num=high, den=some)


@query
def rolling_proportion(spark, sf):
    return rounded(series.rolling_proportion(_share(spark, sf), EVENT, 3),
                   "sum_num", "sum_den", "rolled")


@query
def wilson_band(spark, sf):
    return rounded(series.proportion_band(_share(spark, sf), EVENT, 3),
                   "sum_num", "sum_den", "rolled", "low", "high")


@query
def normal_band(spark, sf):
    return rounded(series.proportion_band(_daily(
        spark, sf, num=F.count_if(F.col("value") > 20), den=F.count(F.lit(1))), EVENT, 5, wilson=False),
        "sum_num", "sum_den", "rolled", "low", "high")


@query
def rolling_band(spark, sf):
    points = _daily(spark, sf, low=F.min("value"), mid=F.avg("value"), high=F.max("value"))
    points = points.withColumn("mid", F.when(F.dayofmonth("t") % 5 != 0, F.col("mid")))
    rolled = series.rolling_band(points, EVENT, 4)
    return rounded(rolled, "low", "mid", "high", "rolled_low", "rolled_mid", "rolled_high")


@query
def rolling_error(spark, sf):
    points = _daily(spark, sf, y=F.avg("value"), error=F.max("value") / F.count("value"))
    rolled = series.rolling_error(points, EVENT, 5)
    return rounded(rolled, "y", "error", "rolled", "low", "high")


@query
def series_overview(spark, sf):
    return rounded(series.series_overview(_with_gaps(spark, sf)), "y")


@query
def series_overview_log(spark, sf):
    overview = series.series_overview(_with_gaps(spark, sf))
    return rounded(series.overview_on_log_scale(overview), "y")


@query
def overview_limits(spark, sf):
    overview = series.series_overview(_with_gaps(spark, sf))
    return rounded(series.overview_limits(overview), "y_min", "y_max")


@query
def overview_limits_log(spark, sf):
    overview = series.series_overview(_with_gaps(spark, sf))
    return rounded(series.overview_limits(overview, log_scale=True), "y_min", "y_max")


# Display order of the stacked event series.
EVENT_ORDER = ["view", "click", "signup", "purchase", "error"]


def _stacked(fill: str) -> Query:
    def run(spark, sf):
        stacked = series.stacked_series(
            _with_gaps(spark, sf), "event_type", EVENT_ORDER, fill=fill)
        return rounded(stacked, "y", "y_stacked")
    return run


QUERIES["stacked_series"] = _stacked("all")
QUERIES["stacked_series_inside"] = _stacked("inside")
QUERIES["stacked_series_none"] = _stacked("none")


@query
def range_cut(spark, sf):
    cut = series.range_cut(
        _with_gaps(spark, sf), EVENT, dt.date(2024, 1, 5), dt.date(2024, 1, 17))
    return rounded(cut, "y")


@query
def series_extremes(spark, sf):
    return series.series_extremes(tables.read(spark, sf, "events"), EVENT, "value")


@query
def log_domain(spark, sf):
    rows = tables.read(spark, sf, "events")
    shifted = F.round(F.col("value") - 10, 2)
    low, high = series.log_domain_all(shifted, F.col("value"))
    return rows.select("event_id", series.log_domain(shifted).alias("y"),
                       low.alias("low"), high.alias("high"))
