"""The weekly refresh: snapshots of all sources, then every report table of a week."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela import syndromes
from sentinela.functions.calendar import ReportDates, from_epoch
from sentinela.functions.results import disposition
from sentinela.functions.scalars import recode
from sentinela.operators import (
    cases as case_ops, corridor, cube, effort, maps, positivity, timeseries,
)
from sentinela.operators.reshape import unpivot_records
from sentinela.session import at_most_partitions, partitions_for
from sentinela.sources import views
from sentinela.sources.snapshots import Snapshots, write_report
from sentinela.syndromes import Syndrome

Builder = Callable[[], DataFrame]


@dataclass(frozen=True)
class Settings:
    """What differs between deployments."""

    consent: str
    sites: tuple[str, ...] = tuple(syndromes.ACTIVE_SITES)
    hospitals: tuple[str, ...] = tuple(syndromes.HOSPITAL_SITES)
    soft_catchment: Mapping[str, str] = field(default_factory=lambda: syndromes.SOFT_CATCHMENT)
    previous_years: int = syndromes.PREVIOUS_YEARS
    map_months: int = syndromes.MAP_MONTHS
    map_departments: tuple[str, ...] = tuple(syndromes.DEPARTMENT_NAMES.values())
    group_columns: Mapping[str, list[str]] | None = None
    syndrome_columns: Mapping[str, list[str] | None] = field(
        default_factory=lambda: {s: columns for s, (_, columns) in views.SYNDROME_VIEWS.items()})
    order_by: tuple[str, ...] = case_ops.FIRST_SEEN_ORDER
    epoch_dates: bool = False
    summary_partitions: int = 200


@dataclass(frozen=True)
class Sources:
    """Where to read from: catalog names, Parquet paths, reader options or DataFrames.

    ``groups`` and ``syndromes`` name the entry of ``views`` that they are columns of.
    """

    views: Mapping[str, object]
    groups: Mapping[str, str]
    syndromes: Mapping[str, str]
    locations: object
    communities: object
    departments: object


def default_sources(communities: object, departments: object) -> Sources:
    """The views under their catalog names."""
    by_syndrome = {s: view for s, (view, _) in views.SYNDROME_VIEWS.items()}
    return Sources(
        views={view: view for view in [*views.GROUP_VIEWS.values(), *by_syndrome.values()]},
        groups=views.GROUP_VIEWS, syndromes=by_syndrome,
        locations=views.LOCATION_VIEW, communities=communities, departments=departments)


def run_refresh(spark: SparkSession, sources: Sources, root: str, dates: ReportDates,
                settings: Settings, parallel: int = 8) -> dict[str, DataFrame]:
    """Build or reuse every table of the week ``dates``; returns them by name.

    Tables are written in phases, those of one phase side by side, so the many small
    report jobs share the cluster. Every view that a report needs is read once per week into
    a snapshot of all columns asked of it; data groups and syndrome views are projections
    of that. Every line list is read once for its daily cube and once for its recent
    located cases; all other tables add those up. Shuffles of rows start with partitions
    for the stored size, those of counts with few. An interrupted refresh goes on after
    the tables already finished.
    """
    week = Snapshots(spark, root, dates.last_friday)
    always = Snapshots(spark, root, None)
    done: dict[str, DataFrame] = {}

    def phase(builders: Mapping[str, Builder]) -> None:
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            stored = pool.map(lambda item: week.get(*item), builders.items())
            done.update(zip(builders, stored))

    needed = _stored_views(sources, settings)
    phase({f"source_{view}": partial(_view, spark, sources.views[view], columns)
           for view, columns in needed.items()})
    largest = max(week.bytes(f"source_{view}") for view in needed)
    projections = _projections(done, needed, sources, dates, settings)
    locations = always.get("locations", lambda: views.read_locations(
        views.open_source(spark, sources.locations)))
    communities = views.open_source(spark, sources.communities)

    packs = [syndromes.SYNDROMES[name] for name in sources.syndromes]
    builders: dict[str, Builder] = {
        "map_bounds": lambda: maps.map_bounds(views.open_source(spark, sources.departments)),
        "screening_effort": lambda: effort.screening_effort(
            _dated(projections["group_subject"], settings), projections["group_eligibility"], dates,
            consent=settings.consent, sites=settings.sites,
            soft_catchment=settings.soft_catchment),
    }
    for pack in packs:
        builders[f"{pack.name}_cases"] = partial(
            _line_list, projections[f"view_{pack.name}"], pack, dates, settings)
    with partitions_for(spark, largest):
        phase(builders)
        phase({f"{pack.name}_map_points": partial(
            _map_points, pack, done, locations, communities, dates, settings) for pack in packs})

    # From here on only counts and located cases are shuffled.
    with at_most_partitions(spark, settings.summary_partitions):
        phase({f"{pack.name}_daily": partial(_daily, pack, done) for pack in packs})
        builders = {
            "screening_effort_text": lambda: effort.effort_text(done["screening_effort"]),
            "captions": lambda: unpivot_records(spark.range(0, 1, 1, 1), [], [
                {"name": F.lit(name), "text": F.lit(text)}
                for name, text in captions(dates, settings).items()]),
        }
        for pack in packs:
            builders |= _cube_tables(pack, done, dates, settings)
        phase(builders)
        phase({f"{pack.name}_positivity_text": partial(
            positivity.positivity_text, done[f"{pack.name}_positivity"], by=_grouping(pack))
            for pack in packs})
    return done | projections


def _group_columns(settings: Settings) -> Mapping[str, list[str]]:
    return settings.group_columns or views.group_columns(settings.consent)


def _stored_views(sources: Sources, settings: Settings) -> dict[str, list[str] | None]:
    """The views behind the report tables, with the columns that all their readers ask for."""
    asked: dict[str, list] = {}
    for group in ("subject", "eligibility"):
        asked.setdefault(sources.groups[group], [])
    for name, view in sources.syndromes.items():
        asked.setdefault(view, []).append(settings.syndrome_columns[name])
    for group, columns in _group_columns(settings).items():
        if sources.groups[group] in asked:
            asked[sources.groups[group]].append(columns)
    return {view: views.wanted_columns(lists) for view, lists in asked.items()}


def _view(spark: SparkSession, source: object, columns: list[str] | None) -> DataFrame:
    return views.select_columns(views.open_source(spark, source), columns)


def _projections(done: Mapping[str, DataFrame], stored: Mapping[str, object], sources: Sources,
                 dates: ReportDates, settings: Settings) -> dict[str, DataFrame]:
    """Data groups and bounded syndrome views, as columns of the stored views."""
    columns = _group_columns(settings)
    groups = {
        f"group_{group}": views.select_columns(done[f"source_{view}"], columns[group])
        for group, view in sources.groups.items() if view in stored}
    return groups | {
        f"view_{name}": views.query_view(
            done[f"source_{view}"], settings.syndrome_columns[name], dates.last_friday)
        for name, view in sources.syndromes.items()}


def _dated(subjects: DataFrame, settings: Settings) -> DataFrame:
    if not settings.epoch_dates:
        return subjects
    dates = ("PDAInsertDate", "fechaHoraAdmision")
    return subjects.withColumns({c: from_epoch(F.col(c)) for c in dates})


def _line_list(raw: DataFrame, syndrome: Syndrome, dates: ReportDates,
               settings: Settings) -> DataFrame:
    """The line list as stored: sorted by date within each file, without a shuffle.

    Readers of a date range then skip most row groups by their statistics.
    """
    cases = case_ops.syndrome_cases(raw, syndrome, dates, settings.sites, settings.order_by)
    return cases.sortWithinPartitions("service_date")


def _grouping(syndrome: Syndrome) -> list[str]:
    return ["site_name", "disposition"] if syndrome.has_disposition else ["site_name"]


def _groups(syndrome: Syndrome, settings: Settings) -> list[tuple]:
    """Sites, or sites and dispositions, that are reported even without a case."""
    if not syndrome.has_disposition:
        return [(site,) for site in settings.sites]
    return [(site, part) for site in settings.sites
            for part in (("admitted", "emergency") if site in settings.hospitals else ("all",))]


def with_disposition(cases: DataFrame) -> DataFrame:
    """Hospital cases split by disposition; a clinic shows all its cases together."""
    split = disposition(F.col("admitted"), F.col("emergency"))
    return cases.withColumn(
        "disposition", F.when(F.col("site_type") == "hospital", split).otherwise("all"))


def _daily(syndrome: Syndrome, done: Mapping[str, DataFrame]) -> DataFrame:
    """The daily cube of a line list, all sites and dispositions in one job."""
    cases = done[f"{syndrome.name}_cases"]
    if syndrome.has_disposition:
        cases = with_disposition(cases)
    return cube.daily_cube(cases, list(syndrome.table_labels),
                           ["site_type", "site_department", *_grouping(syndrome)])


def _map_points(syndrome: Syndrome, done: Mapping[str, DataFrame], locations: DataFrame,
                communities: DataFrame, dates: ReportDates, settings: Settings) -> DataFrame:
    """Located recent positives, with the shifted coordinates that a map shows."""
    points = maps.case_map_points(
        done[f"{syndrome.name}_cases"], locations, communities, syndrome.labels, dates,
        department=settings.map_departments, months=settings.map_months, keep=["unique_id"])
    return maps.jitter(points, ["unique_id", "etiology", "long", "lat"])


def captions(dates: ReportDates, settings: Settings) -> dict[str, str]:
    """Texts beside the results, and the headings of the positivity periods."""
    texts = dates.captions(settings.previous_years, settings.map_months)
    return texts | {f"heading_{p}": heading for p, heading in dates.period_headings().items()}


def _shown(table: DataFrame, column: str, ylim: float) -> DataFrame:
    """A corridor table with the height drawn inside the axis beside the true one."""
    return corridor.clamped(table.withColumn("shown", F.col(column)), "shown", ylim)


def _monthly(daily: DataFrame, etiologies: list[str]) -> DataFrame:
    """Monthly positives per site, with the names a report prints."""
    counts = cube.cube_period_counts(
        daily, etiologies, by=("site_type", "site_department", "site_name"))
    return counts.withColumns({
        "department": recode(F.col("site_department"), syndromes.DEPARTMENT_NAMES),
        "site": recode(F.col("site_name"), syndromes.SITE_NAMES)})


def _cube_tables(syndrome: Syndrome, done: Mapping[str, DataFrame], dates: ReportDates,
                 settings: Settings) -> dict[str, Builder]:
    """Tables that add up the daily cube or the located cases."""
    name, by, etiologies = syndrome.name, _grouping(syndrome), list(syndrome.labels)
    daily, points = done[f"{name}_daily"], done[f"{name}_map_points"]
    groups = _groups(syndrome, settings)
    bands = corridor.corridor_from_counts(
        cube.cube_weekly_counts(daily, by), dates, settings.previous_years, syndrome.ylim, by,
        groups)
    return {
        f"{name}_positivity": lambda: positivity.positivity_from_cube(
            daily, syndrome.table_labels, dates, by=by, groups=groups),
        f"{name}_corridor_current": lambda: _shown(bands.current, "casos", syndrome.ylim),
        f"{name}_corridor_range": lambda: _shown(bands.range, "quantile", syndrome.ylim),
        f"{name}_corridor_polygons": lambda: _shown(bands.polygons, "quantile", syndrome.ylim),
        f"{name}_monthly": lambda: _monthly(daily, etiologies),
        f"{name}_axis": lambda: timeseries.axis_limits(
            cube.cube_period_counts(daily, etiologies), etiologies),
        f"{name}_map_labels": lambda: maps.community_labels(points),
        f"{name}_map_undetected": lambda: maps.undetected_by_department(
            points, syndrome.labels, settings.map_departments),
        f"{name}_unknown_sites": lambda: case_ops.unknown_sites(daily, settings.sites),
    }


# What readers of a report see; the other stored tables only lead up to these.
REPORT_TABLES = (
    "positivity", "positivity_text", "corridor_current", "corridor_range", "corridor_polygons",
    "map_points", "map_labels", "map_undetected", "monthly", "axis", "unknown_sites",
)


def export_reports(stored: Mapping[str, DataFrame], folder: str, file_format: str) -> None:
    """Copies of the report tables in another format."""
    names = ["map_bounds", "captions", "screening_effort_text", *[
        f"{s}_{table}" for s in syndromes.SYNDROMES for table in REPORT_TABLES]]
    for name in names:
        write_report(stored[name], f"{folder}/{name}", file_format)


def stored_positivity(stored: Mapping[str, DataFrame]) -> DataFrame:
    """The positivity tables of all syndromes of a refresh, one below the other."""
    parts = []
    for name, pack in syndromes.SYNDROMES.items():
        table = stored[f"{name}_positivity"]
        if not pack.has_disposition:
            table = table.withColumn("disposition", F.lit("all"))
        parts.append(table.withColumn("syndrome", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)
