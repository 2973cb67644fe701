"""Screening effort: screened, enrolled and eligible patients per site."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela.functions.calendar import ReportDates
from sentinela.functions.results import any_of
from sentinela.functions.scalars import (
    count_and_percent, hex_text, site_heading, title_case,
)
from sentinela.operators.reducers import reduce_to
from sentinela.operators.reshape import listed_only, pivot_first, unpivot_records
from sentinela.syndromes import ACTIVE_SITES, SOFT_CATCHMENT

# Eligibility flags and the measures shown, in row order.
ELIGIBILITY = ["elegibleRespira", "elegibleDiarrea", "elegibleFebril"]
MEASURES = {
    "screened": "Tamizados",
    "enrolled": "Elegibles e inscritos",
    "elegibleRespira": "Síndrome respiratorio",
    "elegibleDiarrea": "Síndrome diarreico",
    "elegibleFebril": "Síndrome febril",
}


def in_catchment(sites: Sequence[str] = tuple(ACTIVE_SITES),
                 soft: Mapping[str, str] = SOFT_CATCHMENT) -> Column:
    """Active sites within the catchment, or in a site's extra municipality."""
    rule = F.col("catchment") == 1
    for site, municipality in soft.items():
        rule = rule | ((F.col("SiteName") == site) & (F.col("NombreMunicipio") == municipality))
    return F.col("SiteName").isin(*sites) & rule


def subject_key(df: DataFrame, column: str = "SubjectID") -> Column:
    """The id as text (bytes in hexadecimal); a missing id is empty text and so matches itself."""
    binary = isinstance(df.schema[column].dataType, T.BinaryType)
    text = hex_text(F.col(column)) if binary else F.col(column).cast("string")
    return F.coalesce(text, F.lit(""))


def screening_effort(
    subjects: DataFrame,
    eligibility: DataFrame,
    dates: ReportDates,
    *,
    consent: str,
    sites: Sequence[str] = tuple(ACTIVE_SITES),
    soft_catchment: Mapping[str, str] = SOFT_CATCHMENT,
) -> DataFrame:
    """Totals per department and site of the left join of subjects and eligibility.

    Both sides are counted per subject before they meet, so a subject id repeated on
    both sides adds up by multiplication instead of fanning out. Of the eligibility of all
    years only rows of the period's subjects (and few others, told by a bitmap) are counted
    and shuffled. A total with any unknown flag in it is NULL.
    """
    # A subject row enters the flags only through this three-valued part of "enrolled".
    base = F.col("SASubjectID").isNotNull() & (F.col(consent) == 1)
    screened = (
        subjects
        .where(in_catchment(sites, soft_catchment)
               & F.to_date("PDAInsertDate").between(
                   F.lit(dates.first_sunday), F.lit(dates.last_friday)))
        .groupBy(
            subject_key(subjects).alias("subject"),
            title_case(F.col("NombreDepartamento")).alias("department"),
            F.col("SiteName").alias("site"), base.alias("base"))
        .agg(F.count(F.lit(1)).alias("times")))

    flags = {f: F.col(f) == 1 for f in ELIGIBILITY}
    flags["enrolled"] = any_of(flags.values())
    per_subject = (
        reduce_to(eligibility, subject_key(eligibility), screened, "subject")
        .groupBy(subject_key(eligibility).alias("subject"))
        .agg(F.count(F.lit(1)).alias("rows"),
             *[F.count_if(v).alias(f"{f}_true") for f, v in flags.items()],
             *[F.count_if(v.isNull()).alias(f"{f}_null") for f, v in flags.items()]))

    # With base TRUE a flag keeps its value; with base unknown a TRUE turns unknown too;
    # with base FALSE everything is FALSE. A subject without eligibility is all unknown.
    def matched(name: str, otherwise: int) -> Column:
        return F.coalesce(F.col(name), F.lit(otherwise)) * F.col("times")

    sums = [F.sum(matched("rows", 1)).alias("screened")]
    for flag in ("enrolled", *ELIGIBILITY):
        true, null = matched(f"{flag}_true", 0), matched(f"{flag}_null", 1)
        known = F.sum(F.when(F.col("base"), true).otherwise(0))
        unknown = F.sum(F.when(F.col("base"), null)
                        .when(F.col("base").isNull(), true + null).otherwise(0))
        sums.append(F.when(unknown == 0, known).alias(flag))
    return (screened.join(per_subject, "subject", "left")
            .groupBy("department", "site").agg(*sums))


def effort_text(effort: DataFrame) -> DataFrame:
    """Long table of measure, site heading and text; shares of enrolled (enrolled: of screened)."""
    enrolled = F.col("enrolled")
    cells = {
        "screened": F.coalesce(F.col("screened").cast("string"), F.lit("NA")),
        "enrolled": count_and_percent(enrolled, F.col("screened")),
        **{f: count_and_percent(F.col(f), enrolled) for f in ELIGIBILITY},
    }
    table = effort.withColumn("sitio", site_heading(F.col("department"), F.col("site")))
    return unpivot_records(table, ["sitio"], [
        {"ord": F.lit(i), "grupo": F.lit(title), "n": cells[measure]}
        for i, (measure, title) in enumerate(MEASURES.items(), 1)])


def effort_table(effort: DataFrame, headings: Sequence[str]) -> DataFrame:
    """Measures as rows and the given sites as columns; a site not given fails the query."""
    long = effort_text(effort).withColumn("sitio", listed_only("sitio", headings))
    return pivot_first(long, ["ord", "grupo"], "sitio", headings, "n").orderBy("ord")
