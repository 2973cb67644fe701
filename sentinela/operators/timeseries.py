"""Positives per site and calendar period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.functions.calendar import floor_date
from sentinela.functions.scalars import recode
from sentinela.operators.reshape import (
    listed_only, pivot_first, require_flags, unpivot_records,
)
from sentinela.syndromes import SITE_NAMES


def period_counts(cases: DataFrame, etiologies: Sequence[str], scale: str = "month",
                  by: Sequence[str] = ("site_type", "site_name")) -> DataFrame:
    """Positives of every etiology per group and period; periods without any case are absent."""
    require_flags(cases, etiologies)
    return (cases
            .groupBy(*by, floor_date(F.col("service_date"), scale).alias("service_date"))
            .agg(*[F.count_if(F.col(e)).alias(e) for e in etiologies]))


def period_counts_long(cases: DataFrame, etiologies: Sequence[str], scale: str = "month",
                       by: Sequence[str] = ("site_type", "site_name")) -> DataFrame:
    """The period counts with one row per etiology."""
    keys = [*by, "service_date"]
    return unpivot_records(period_counts(cases, etiologies, scale, by), keys, [
        {"etiology": F.lit(e), "cases": F.col(e)} for e in etiologies])


def case_timeseries(
    cases: DataFrame,
    *,
    site_type: str,
    etiology: str,
    sites: Sequence[str],
    scale: str = "month",
    site_names: Mapping[str, str] = SITE_NAMES,
) -> DataFrame:
    """One row per period and one column per site; NULL where a site had no case at all.

    ``sites`` gives the columns and their order; a site of the type that is not given fails
    the query, so no count is lost (``series_long`` takes any sites). A case row only adds
    to its own site's count; sites become columns afterwards, from one row per site and period.
    """
    counts = period_counts(
        cases.where(F.col("site_type") == site_type), [etiology], scale, ("site_name",))
    counts = counts.withColumn("site_name", listed_only("site_name", sites))
    wide = pivot_first(counts, ["service_date"], "site_name", sites, etiology)
    return (wide.toDF("service_date", *[site_names.get(s, s) for s in sites])
            .orderBy(F.col("service_date").asc_nulls_last()))


def series_long(cases: DataFrame, *, site_type: str, etiology: str, scale: str = "month",
                site_names: Mapping[str, str] = SITE_NAMES) -> DataFrame:
    """The same series in long form, for any number of sites."""
    counts = period_counts(
        cases.where(F.col("site_type") == site_type), [etiology], scale, ("site_name",))
    return counts.select(
        recode(F.col("site_name"), site_names).alias("site_name"), "service_date",
        F.col(etiology).alias("cases"))


def largest_count(counts: DataFrame, etiologies: Sequence[str]) -> DataFrame:
    """Largest value of a period count table, as one row (``max_cases``)."""
    # greatest() skips NULLs but needs two arguments, hence the repeated first column.
    return counts.agg(
        F.greatest(*[F.max(e) for e in [etiologies[0], *etiologies]]).alias("max_cases"))


def axis_limits(counts: DataFrame, etiologies: Sequence[str]) -> DataFrame:
    """The largest count and the axis limit one above it, which is 1 without any case."""
    return largest_count(counts, etiologies).withColumn(
        "axis_limit", F.coalesce("max_cases", F.lit(0)) + 1)


def axis_limit(counts: DataFrame, etiologies: Sequence[str]) -> int:
    """Upper axis limit shared by all charts of a syndrome: the largest count plus one."""
    return (largest_count(counts, etiologies).first()["max_cases"] or 0) + 1
