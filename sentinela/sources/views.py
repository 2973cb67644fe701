"""Reading the surveillance views: bounded, pruned and checked early."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: views and columns of the data groups --------------------------------

GROUP_VIEWS = {
    "sites": "Control.Sitios",
    "subject": "Clinicos.Basica_Respira",
    "eligibility": "Clinicos.Basica_Respira",
    "respiratory": "Clinicos.Basica_Respira",
    "diarrheal": "Clinicos.Basica_Diarrea",
    "febrile": "Clinicos.Basica_Febril",
}
SITE_COLUMNS = [
    "Departamento", "DeptoID", "Municipio", "TipoSitio", "NombreShortName", "Nombre",
    "Longitude", "Latitude", "Altitude",
]
SUBJECT_COLUMNS = [
    "SubjectID", "SASubjectID", "actualAdmitido", "PDAInsertDate", "fechaHoraAdmision",
    "epiYearAdmision", "epiWeekAdmision", "SiteName", "SiteType", "NombreDepartamento",
    "NombreMunicipio", "catchment", "edadAnios", "edadMeses", "edadDias", "fechaDeNacimiento",
]
ELIGIBILITY_COLUMNS = ["SubjectID", "elegibleRespira", "elegibleDiarrea", "elegibleFebril"]
RESPIRATORY_COLUMNS = ["SubjectID", "viralPCR_Hizo", "viralPCR_FluA", "viralPCR_FluB"]
DIARRHEAL_COLUMNS = ["SubjectID", "pruebaRotavirusHizo", "rotavirus"]
FEBRILE_COLUMNS = [
    "SubjectID", "dengue_ELISA_lgM", "dengue_ELISA_lgM_convaleciente", "dengue_ELISA_lgG",
    "dengue_PCR", "dengue_tipo1", "dengue_tipo2", "dengue_tipo3", "dengue_tipo4",
]

COMMON_CASE_COLUMNS = [
    "SubjectID", "SASubjectID", "PDAInsertDate", "fechaHoraAdmision", "SiteName", "SiteType",
    "SiteDepartamento", "epiYearAdmision", "epiWeekAdmision", "departamento", "municipio",
    "comunidad", "censo_comunidad", "edadAnios", "edadMeses", "edadDias", "fechaDeNacimiento",
]
RESPIRATORY_VIEW = [
    "elegibleRespira", "Binax_HizoPrueba", "Binax_Resultado",
    "viralPCR_Hizo", "viralPCR_FluA", "viralPCR_FluB", "viralPCR_RSV", "viralPCR_hMPV",
    "muestraFroteOPColecta", "muestraFroteNP",
    "pertussis_sosp", "SeHizoPCR_Pertussis",
    "Bordetella_spp_PCR", "B_Pertussis_PCR", "B_Parapertussis_PCR",
]
DIARRHEAL_VIEW = [
    "elegibleDiarrea", "tamizadoEmergencia", "actualAdmitido",
    "campylobacter", "shigella", "EPEC", "ETEC", "rotavirus",
    "RTqPCR_NV1", "RTqPCR_NV2", "ASTROVIRUS", "SAPOVIRUS", "salmonella",
]
DIARRHEAL_SAMPLE_VIEW = [
    "muestraHecesColecta", "muestraHecesColectaTipo",
    "MuestraHecesNoRazon", "MuestraHecesNoRazonOtra_esp",
    "muestraHecesHisopoSecoNoRazon", "muestraHecesHisopoSecoNoRazonOtra_esp",
    "muestraHecesHisopoSecoFechaHora",
    "muestraHecesHisopoCaryBlairColecta", "muestraHecesHisopoCaryBlairNoRazon",
    "muestraHecesHisopoCaryBlairNoRazonOtra_esp", "muestraHecesHisopoCaryBlairFechaHora",
    "muestraHecesHisopoCaryBlairTipo",
    "muestraHecesEnteraColecta", "muestraHecesEnteraNoRazon",
    "muestraHecesEnteraNoRazonOtra_Esp", "muestraHecesEnteraFechaHora",
    "muestraHecesEnteraLiquida", "muestraHecesEnteraCubreFondo",
    "recepcionMuestraOriginal", "recepcionMuestraHisopo", "recepcionMuestraPVA",
    "recepcionMuestraFormalina", "recepcionMuestraCongeladas", "recepcionMuestraNorovirus",
]
LOCATION_COLUMNS = {
    "cod_depto": "subject_department",
    "cod_depto_muni": "subject_municipality",
    "comunidad": "subject_community",
    "cod_censo": "community_code",
}
LOCATION_VIEW = "LegalValue.centros_poblados"

# --- end of fixed values ----------------------------------------------------------------

# Columns read from each syndrome's view; None reads whatever the view has.
SYNDROME_VIEWS = {
    "respiratory": ("Clinicos.Basica_Respira", [*COMMON_CASE_COLUMNS, *RESPIRATORY_VIEW]),
    "diarrheal": ("Clinicos.Basica_Diarrea",
                  [*COMMON_CASE_COLUMNS, *DIARRHEAL_VIEW, *DIARRHEAL_SAMPLE_VIEW]),
    "febrile": ("Clinicos.Basica_Febril", None),
}


def group_columns(consent: str) -> dict[str, list[str]]:
    """Columns of every data group; ``consent`` names the view's enrolment flag."""
    return {
        "sites": SITE_COLUMNS,
        "subject": [*SUBJECT_COLUMNS, consent],
        "eligibility": ELIGIBILITY_COLUMNS,
        "respiratory": RESPIRATORY_COLUMNS,
        "diarrheal": DIARRHEAL_COLUMNS,
        "febrile": FEBRILE_COLUMNS,
    }


def jdbc_source(url: str, view: str, *, partition_column: str, lower, upper,
                partitions: int, **options: str) -> dict[str, str]:
    """A database view read by parallel range queries on one column."""
    return {
        "format": "jdbc", "url": url, "dbtable": view,
        "partitionColumn": partition_column, "lowerBound": str(lower),
        "upperBound": str(upper), "numPartitions": str(partitions), **options,
    }


def open_source(spark: SparkSession, source: str | Mapping[str, str] | DataFrame) -> DataFrame:
    """A DataFrame from a catalog name, a Parquet path, reader options or a DataFrame."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        return spark.read.parquet(source) if "/" in source else spark.table(source)
    options = dict(source)
    return spark.read.format(options.pop("format", "parquet")).options(**options).load()


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Keep the first column of every name."""
    if len(set(df.columns)) == len(df.columns):
        return df
    places = {}
    for i, name in enumerate(df.columns):
        places.setdefault(name, i)
    by_place = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"_c{i}").alias(name) for name, i in places.items()])


def select_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Project and name columns as asked for; a missing one fails before any job starts."""
    df = drop_repeated_columns(df)
    if columns is None:
        return df
    wanted = list(dict.fromkeys(columns))
    present = {c.lower() for c in df.columns}
    missing = [c for c in wanted if c.lower() not in present]
    if missing:
        raise ValueError(f"columns not in the view: {', '.join(missing)}")
    return df.select(*wanted).toDF(*wanted)


def query_view(df: DataFrame, columns: Sequence[str] | None, max_date: dt.date,
               date_column: str = "PDAInsertDate") -> DataFrame:
    """Rows inserted up to the start of ``max_date``, with the given columns.

    The bound is a date compared with a timestamp: rows later on that day stay out.
    Both the filter and the projection reach the scan.
    """
    return select_columns(df.where(F.col(date_column) <= F.lit(max_date)), columns)


def wanted_columns(lists: Sequence[Sequence[str] | None]) -> list[str] | None:
    """Columns that serve all readers of a view; None, for whatever it has, if one asks for that."""
    if any(columns is None for columns in lists):
        return None
    return list(dict.fromkeys(c for columns in lists for c in columns))


def read_locations(df: DataFrame) -> DataFrame:
    """Place codes of the communities, under the names the case line list uses."""
    return df.select(*[F.col(old).alias(new) for old, new in LOCATION_COLUMNS.items()])
