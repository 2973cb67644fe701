"""From raw view rows to the deduplicated case line list."""

from __future__ import annotations

import threading
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela.functions.calendar import ReportDates, parse_birth_date
from sentinela.functions.scalars import approximate_age_days, site_type_of
from sentinela.syndromes import ACTIVE_SITES, RESIDUAL_LABELS, Syndrome

# Columns of the case line list that precede the result flags.
CASE_COLUMNS = [
    "unique_id", "subject_id", "service_date", "epi_year", "epi_week",
    "site_type", "site_name", "site_department",
    "subject_department", "subject_municipality", "subject_community",
    "age_years", "age_months", "age_days", "age_aprox", "age_dates",
]

# The source declares no order, so "first seen" is pinned to the insertion date,
# then to columns that make the choice repeatable.
FIRST_SEEN_ORDER = ("PDAInsertDate", "fechaHoraAdmision", "SASubjectID")


def first_seen(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column],
               flag: str = "first_seen") -> DataFrame:
    """Mark the first row of every key; all NULL keys form one group.

    Followed by a filter on the flag, Spark keeps one candidate per key and input
    partition before the shuffle, so a key that holds a third of all rows
    reaches its task as at most one row per map task. Rows that tie are ordered by a
    hash of all columns, so the choice does not depend on the order of the input.
    """
    window = Window.partitionBy(*keys).orderBy(
        *[(F.col(o) if isinstance(o, str) else o).asc_nulls_last() for o in order_by],
        F.xxhash64(*df.columns))
    return df.withColumn(flag, F.row_number().over(window))


def keep_first_seen(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column],
                    also: Column | None = None) -> DataFrame:
    """Keep first rows that also meet a condition.

    The first row is chosen among all rows: a subject whose first row fails the
    condition is dropped, not replaced by a later row.
    """
    marked = df if also is None else df.withColumn("_also", also)
    firsts = first_seen(marked, keys, order_by, "_rank").where(F.col("_rank") == 1)
    if also is not None:
        firsts = firsts.where("_also").drop("_also")
    return firsts.drop("_rank")


def known_sites(cases: DataFrame, site: Sequence[str], column: str) -> list[str]:
    """Which of the requested sites occur; at most as many rows as were requested."""
    rows = cases.where(F.col(column).isin(*site)).select(column).distinct().collect()
    return [r[0] for r in rows]


def unknown_sites(cases: DataFrame, sites: Sequence[str],
                  column: str = "site_name") -> DataFrame:
    """The given sites that never occur, one row each; the names stay on the cluster."""
    wanted = cases.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.array(*[F.lit(s) for s in sites])).alias(column))
    return wanted.join(cases.select(column).distinct(), column, "left_anti")


def _warn_of(missing: Sequence[str]) -> None:
    if missing:
        warnings.warn(f"sites not found: {', '.join(sorted(missing))}; they have no rows", stacklevel=3)


def _ended(seen: Observation) -> bool:
    try:
        return seen._jo.future().isCompleted()
    except Exception:       # the session is gone
        return False


def _warn_when_run(seen: Observation, names: Mapping[str, str]) -> None:
    """Wait for the job that fills the observation, then warn about the sites it has not met."""
    try:
        counts = seen.get
    except Exception:
        # Adaptive execution drops a part without rows, and with it the counts; or no job ever ran.
        if not _ended(seen):
            return
        counts = {}
    _warn_of([site for name, site in names.items() if not counts.get(name)])


def warn_of_unseen(rows: DataFrame, sites: Sequence[str], column: str) -> DataFrame:
    """The same rows; the first job that reads them also counts the given sites.

    Once that job has ended, sites without rows give a warning. It needs no job of its own
    and no rows beyond those the job reads anyway. Where Spark knows without a job that
    there is no row, the warning comes at once.
    """
    most = rows._jdf.queryExecution().optimizedPlan().maxRows()
    if most.isDefined() and most.get() == 0:
        _warn_of(sites)
        return rows
    seen = Observation()
    names = {f"site_{k}": site for k, site in enumerate(sites)}
    observed = rows.observe(seen, *[
        F.count_if(F.col(column) == site).alias(name) for name, site in names.items()])
    threading.Thread(target=_warn_when_run, args=(seen, names), daemon=True).start()
    return observed


def at_sites(cases: DataFrame, site: str | Sequence[str] = "all",
             column: str = "site_name", check: bool = False) -> DataFrame:
    """Keep the given sites, ``"all"`` keeps everything.

    A site without rows gives a warning as soon as the caller's job has run. ``check=True``
    warns at once and also lists the sites there are, for which it reads the site column.
    """
    wanted = [site] if isinstance(site, str) else list(site)
    if not all(isinstance(s, str) for s in wanted):
        raise TypeError("the site name must be text")
    if wanted == ["all"]:
        return cases
    if check:
        missing = sorted(set(wanted) - set(known_sites(cases, wanted, column)))
        if missing:
            others = [str(r[0]) for r in cases.select(column).distinct().collect()]
            warnings.warn(
                f"sites not found: {', '.join(missing)}; those present: "
                f"{', '.join(sorted(others))}", stacklevel=2)
    kept = cases.where(F.col(column).isin(*wanted))
    # Counted after the filter, which so still reaches the scan.
    return kept if check else warn_of_unseen(kept, wanted, column)


def derive(df: DataFrame, stages: Sequence[Mapping[str, Column]],
           keep: Sequence[str | Column]) -> DataFrame:
    """Add named expressions stage by stage; a stage sees the names of earlier ones.

    The first stage reads the raw columns and lists only ``keep`` beside its own
    results, so a derived name never replaces a raw one that another rule still needs.
    """
    first, *later = stages
    df = df.select(*keep, *[rule.alias(name) for name, rule in first.items()])
    for stage in later:
        df = df.select("*", *[rule.alias(name) for name, rule in stage.items()])
    return df


def minimal_dataset(
    raw: DataFrame,
    condition: Column,
    stages: Sequence[Mapping[str, Column]],
    dates: ReportDates,
    places: Sequence[str] = tuple(ACTIVE_SITES),
    order_by: Sequence[str] = FIRST_SEEN_ORDER,
) -> DataFrame:
    """Case line list: one row per subject, with one boolean per rule.

    Results are decoded after the deduplication, for the surviving rows only. The
    flags would be no narrower in the shuffle than the raw codes they come from.
    """
    service_date = F.to_date("fechaHoraAdmision")
    kept = (
        condition
        & F.col("SiteName").isin(*places)
        & (service_date < F.lit(dates.next_month_start))
        & F.col("SASubjectID").isNotNull()
    )
    firsts = keep_first_seen(raw, ["SubjectID"], order_by, kept)
    is_text = isinstance(raw.schema["fechaDeNacimiento"].dataType, T.StringType)
    born = F.col("fechaDeNacimiento")
    fixed = {
        "unique_id": F.col("SubjectID"),
        "subject_id": F.col("SASubjectID"),
        "service_date": service_date,
        "epi_year": F.col("epiYearAdmision"),
        "epi_week": F.col("epiWeekAdmision"),
        "site_type": site_type_of(F.col("SiteType")),
        "site_name": F.col("SiteName"),
        "site_department": F.col("SiteDepartamento"),
        "subject_department": F.col("departamento"),
        "subject_municipality": F.col("municipio"),
        "subject_community": F.col("censo_comunidad"),
        "age_years": F.col("edadAnios"),
        "age_months": F.col("edadMeses"),
        "age_days": F.col("edadDias"),
        "age_aprox": approximate_age_days(
            F.col("edadAnios"), F.col("edadMeses"), F.col("edadDias")),
        "age_dates": F.datediff(
            service_date, parse_birth_date(born) if is_text else F.to_date(born)),
    }
    return derive(firsts, stages, [fixed[name].alias(name) for name in CASE_COLUMNS])


def syndrome_cases(raw: DataFrame, syndrome: Syndrome, dates: ReportDates,
                   places: Sequence[str] = tuple(ACTIVE_SITES),
                   order_by: Sequence[str] = FIRST_SEEN_ORDER) -> DataFrame:
    """The line list of one syndrome from the rows of its view."""
    stages = [syndrome.results(), syndrome.residuals()]
    cases = minimal_dataset(raw, syndrome.condition(), stages, dates, places, order_by)
    last = list(RESIDUAL_LABELS)
    return cases.select(*[c for c in cases.columns if c not in last], *last)


def sort_cases(cases: DataFrame) -> DataFrame:
    """Total order of the line list, NULLs last.

    The id ends the sort key so that one busy day can be split over several tasks.
    """
    return cases.orderBy(*[
        F.col(c).asc_nulls_last()
        for c in ("site_type", "site_department", "service_date", "unique_id")])
