"""Sources and settings that run the weekly refresh on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.calendar import from_epoch
from sentinela.plans import tables
from sentinela.plans.refresh import Settings, Sources
from sentinela.sources import views

SETTINGS = Settings(
    consent="pacienteInscrito",
    sites=tuple(tables.SITES),
    hospitals=tuple(tables.HOSPITALS),
    soft_catchment=tables.SOFT_CATCHMENT,
    previous_years=tables.PREVIOUS_YEARS,
    group_columns={
        "sites": ["n_nationkey", "n_name"],
        "subject": ["SubjectID", "SASubjectID", "PDAInsertDate", "SiteName", "catchment",
                    "NombreDepartamento", "NombreMunicipio", "pacienteInscrito"],
        "eligibility": views.ELIGIBILITY_COLUMNS,
        "respiratory": views.RESPIRATORY_COLUMNS,
        "diarrheal": ["SubjectID", "rotavirus"],
        "febrile": [c for c in views.FEBRILE_COLUMNS if c in {"SubjectID", *tables.FEBRILE}],
    },
    syndrome_columns={"respiratory": None, "diarrheal": None, "febrile": None},
    order_by=("PDAInsertDate", "SASubjectID"),
)


def sample_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """The test tables in the place of the views."""
    effort_rows = tables.effort_rows(spark, sf_dir)
    raw: dict[str, DataFrame] = {
        "respiratory": tables.raw_view(spark, sf_dir, tables.RESPIRATORY),
        "diarrheal": tables.raw_view(spark, sf_dir, tables.DIARRHEAL),
        "febrile": tables.raw_view(spark, sf_dir, tables.FEBRILE),
    }
    contents = {
        "sites": tables.read(spark, sf_dir, "nation"),
        "subject": effort_rows.withColumn("PDAInsertDate", from_epoch(F.col("PDAInsertEpoch"))),
        "eligibility": effort_rows.where("has_eligibility"),
        **raw,
    }
    return Sources(
        views=contents,
        groups={name: name for name in contents},
        syndromes={name: name for name in raw},
        locations=tables.location_codes(spark, sf_dir),
        communities=tables.communities(spark, sf_dir),
        departments=tables.department_outlines(spark, sf_dir),
    )
