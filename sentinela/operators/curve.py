"""Epidemic curve: weekly positives by department and etiology on a full grid."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.functions.scalars import recode
from sentinela.operators.reshape import ordered_codes, require_flags, unpivot_records
from sentinela.syndromes import DEPARTMENT_NAMES


def epidemic_curve(cases: DataFrame, labels: Mapping[str, str], site_type: str,
                   department_names: Mapping[str, str] = DEPARTMENT_NAMES) -> DataFrame:
    """Counts for every etiology and department, and the years and weeks with positives.

    Etiologies are those of ``labels`` and departments those of all cases, whatever their site
    type; where there is no positive the count is 0. Axes and counts come from one aggregate of
    the cases, whose shuffle Spark reuses, so the line list is read once.
    """
    require_flags(cases, list(labels))
    codes = ordered_codes(labels)
    keys = ["site_department", "epi_year", "epi_week"]
    ours = (F.col("site_type") == site_type) & F.col("epi_year").isNotNull()
    wide = (
        cases.withColumn("site_department", recode(F.col("site_department"), department_names))
        .groupBy(*keys)
        .agg(*[F.count_if(ours & F.col(code)).alias(code) for _, code, _ in codes]))
    counts = unpivot_records(wide, keys, [
        {"etiology": F.lit(label), "ord": F.lit(order), "n": F.col(code)}
        for order, code, label in codes])

    # Structs, because collect_set leaves out bare NULLs and an unknown department counts.
    hit = F.col("n") > 0
    grid = counts.agg(
        F.collect_set(F.struct("site_department")).alias("d"),
        F.collect_set(F.struct("etiology", "ord")).alias("e"),
        F.collect_set(F.when(hit, F.struct("epi_year"))).alias("y"),
        F.collect_set(F.when(hit, F.struct("epi_week"))).alias("w"))
    axes = {
        "d": ["site_department"], "e": ["etiology", "ord"], "y": ["epi_year"], "w": ["epi_week"],
    }
    for axis in axes:
        grid = grid.withColumn(axis, F.explode(axis))
    grid = grid.select([f"{axis}.{c}" for axis, cols in axes.items() for c in cols])
    counts = counts.where(hit)

    g, c = grid.alias("g"), counts.alias("c")
    matches = [F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "ord"]]
    return g.join(c, matches, "left").select(
        "g.site_department", "g.etiology", "g.ord", "g.epi_year", "g.epi_week",
        F.coalesce("c.n", F.lit(0)).alias("n"))
