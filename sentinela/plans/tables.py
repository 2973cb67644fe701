"""The test tables seen as surveillance data.

Orders play the case records, customers the patients and nations the places. The
mapping is plain arithmetic on keys, written once as SQL text that Spark and the
checking database both understand; only the epidemiological week is written twice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.calendar import ReportDates, epi_year_week

# A Sunday near the end of the order dates: last Friday is 2001-07-27.
DATES = ReportDates(dt.date(2001, 7, 29))
PREVIOUS_YEARS = 6
MAP_MONTHS = 3

SITES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
HOSPITALS = ["BUILDING", "MACHINERY"]
CLINICS = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]
SOFT_CATCHMENT = {"FURNITURE": "NATION_3"}
ETIOLOGIES = {"flu": "Influenza", "rsv": "Virus sincitial", "pneumo": "Neumococo"}


def cycle(number: int, *values: str) -> str:
    """SQL that walks through values as the order key grows, one step every ``number`` keys."""
    span = number * len(values)
    step = f"o_orderkey % {span} - o_orderkey % {number}"
    branches = " ".join(f"when {i * number} then {v}" for i, v in enumerate(values))
    return f"case {step} {branches} end"


# Columns every raw view has.
COMMON = {
    "SubjectID": "o_custkey",
    "SASubjectID": "case when o_orderkey % 11 <> 0 then concat('SA', o_orderkey) end",
    "PDAInsertDate": "o_orderdate",
    "fechaHoraAdmision": "o_orderdate",
    "SiteName": "c_mktsegment",
    "SiteType": "case c_mktsegment when 'BUILDING' then 'H' when 'MACHINERY' then 'H' "
                "when 'FURNITURE' then 'CS' when 'AUTOMOBILE' then 'CS' end",
    "SiteDepartamento": "case n_regionkey when 0 then 'SR' when 1 then 'QU' "
                        "else concat('R', n_regionkey) end",
    "departamento": "case n_regionkey when 0 then 1 when 1 then 6 when 2 then 9 "
                    "else n_regionkey + 20 end",
    "municipio": "n_nationkey",
    "censo_comunidad": "case when c_custkey % 7 <> 0 then concat('C', c_custkey % 40) end",
    "edadAnios": "cast(o_orderkey % 90 as int)",
    "edadMeses": "cast(case when o_orderkey % 4 <> 0 then o_orderkey % 14 - 2 end as int)",
    "edadDias": "cast(case when o_orderkey % 6 <> 0 then o_orderkey % 31 end as int)",
    "fechaDeNacimiento": "case when o_orderkey % 9 = 0 then 'sin dato' "
                         "else concat(1920 + o_orderkey % 70, '-0', 1 + o_orderkey % 9, "
                         "'-1', o_orderkey % 10) end",
}
RESPIRATORY = {
    "elegibleRespira": cycle(1, "1", "1", "0", "1", "null"),
    "Binax_HizoPrueba": cycle(2, "1", "0", "1", "null"),
    "Binax_Resultado": cycle(3, "0", "1", "null", "0"),
    "viralPCR_Hizo": cycle(5, "1", "1", "0", "null", "1"),
    "viralPCR_FluA": cycle(7, "0", "1", "0", "null"),
    "viralPCR_FluB": cycle(11, "0", "0", "1", "null"),
    "viralPCR_RSV": cycle(13, "0", "0", "1", "0", "null"),
    "viralPCR_hMPV": cycle(17, "0", "0", "0", "1"),
    "muestraFroteOPColecta": cycle(19, "1", "0", "null"),
    "muestraFroteNP": cycle(23, "0", "1", "null", "0"),
}
DIARRHEAL = {
    "elegibleDiarrea": cycle(1, "1", "1", "0", "1", "null"),
    "tamizadoEmergencia": cycle(2, "1", "0", "null", "1", "1"),
    "actualAdmitido": cycle(3, "0", "1", "null", "0"),
    "campylobacter": cycle(997, "0", "1", "null", "0", "0"),
    "salmonella": cycle(5, "0", "1", "null"),
    "shigella": cycle(499, "0", "0", "null", "1"),
    "EPEC": cycle(7, "0", "null", "1", "0"),
    "ETEC": cycle(11, "null", "0", "1", "0", "0"),
    "rotavirus": cycle(251, "0", "0", "null", "1"),
    "RTqPCR_NV1": cycle(13, "0", "0", "1", "null"),
    "RTqPCR_NV2": cycle(127, "0", "0", "null"),
    "ASTROVIRUS": cycle(61, "0", "null", "0"),
    "SAPOVIRUS": cycle(31, "0", "0", "null", "1"),
}
FEBRILE = {
    "elegibleFebril": cycle(1, "1", "1", "0", "1", "null"),
    "dengue_ELISA_lgM": cycle(2, "0", "1", "null"),
    "dengue_PCR": cycle(3, "1", "0", "null", "null"),
    "dengue_tipo1": cycle(5, "0", "0", "1", "null"),
    "dengue_tipo2": cycle(7, "0", "0", "null"),
    "dengue_tipo3": cycle(11, "0", "0", "0", "1"),
    "dengue_tipo4": cycle(13, "0", "null", "0"),
    "CHK_IgM": cycle(17, "0", "1", "null"),
    "CHK_PCR": cycle(19, "0", "0", "1", "null"),
    "Zika_PCR": cycle(23, "0", "0", "1", "null"),
    "malaria_gotaGruesa": cycle(2, "'0'", "'1'", "'NE'", "null"),
    "malaria_PCR": cycle(29, "'0'", "'NE'", "null"),
    "rickettsias_ELISA": cycle(3, "'NE'", "'0'", "'1'", "null"),
    "rickettsias_IF": cycle(5, "'0'", "null", "'NE'"),
    "rickettsia_IF_Convaleciente": cycle(7, "null", "'0'", "'NE'", "'1'"),
    "rickettsias_PCR": cycle(31, "'NE'", "'0'", "null"),
    "Lepto_PanBioKit": cycle(1, "'0'", "'1'", "'NE'", "'80'", "null"),
}
# Flags of the simple case list: nullable, and positive for a realistic share.
CASE_FLAGS = {
    "flu": "case when o_orderkey % 3 <> 0 then o_totalprice > 400000 end",
    "rsv": "case when o_orderkey % 3 <> 0 then o_orderpriority = '1-URGENT' end",
    "pneumo": "case when o_orderkey % 5 = 0 then o_orderstatus = 'F' end",
    "emergency": "case o_orderkey % 7 when 0 then null when 1 then false else true end",
    "admitted": "case o_orderkey % 4 when 0 then null when 1 then true else false end",
}
EFFORT = {
    "PDAInsertEpoch": None,
    "NombreDepartamento": "case when n_regionkey < 3 then 'SANTA ROSA' else 'quetzaltenango' end",
    "NombreMunicipio": "n_name",
    "catchment": cycle(1, "1", "0", "1", "null"),
    "pacienteInscrito": "case when c_mktsegment = 'FURNITURE' and o_orderkey % 50 = 0 then null "
                        "when o_orderkey % 3 <> 0 then 1 else 0 end",
    "elegibleRespira": "case when c_mktsegment = 'HOUSEHOLD' and o_orderkey % 13 = 0 then null "
                       "else cast(o_orderkey % 2 as int) end",
    "elegibleDiarrea": "case when o_orderkey % 3 = 0 then 1 else 0 end",
    "elegibleFebril": "case when o_orderkey % 5 = 0 then 1 else 0 end",
}
PLACE = {
    "community_code": "case when (c_custkey % 40) % 10 <> 3 "
                      "then n_nationkey * 100 + cast(c_custkey % 40 as int) end",
}


# Known schemas spare a job per table that would only look at a file footer.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and nation; Spark picks the join by size."""
    orders = read(spark, sf_dir, "orders")
    customers = read(spark, sf_dir, "customer")
    nations = read(spark, sf_dir, "nation")
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))


def _project(df: DataFrame, *parts: dict[str, str]) -> DataFrame:
    texts = {name: text for part in parts for name, text in part.items()}
    return df.selectExpr(*[f"{text} as {name}" for name, text in texts.items()])


def raw_view(spark: SparkSession, sf_dir: str, results: dict[str, str]) -> DataFrame:
    """A syndrome view: common columns, the given result columns and the epi week."""
    year, week = epi_year_week(F.to_date("o_orderdate"))
    base = records(spark, sf_dir).withColumns({"_year": year, "_week": week})
    return _project(base, COMMON, results,
                    {"epiYearAdmision": "_year", "epiWeekAdmision": "_week"})


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case line list with nullable flags, one row per order."""
    year, week = epi_year_week(F.to_date("o_orderdate"))
    base = records(spark, sf_dir).withColumns({"epi_year": year, "epi_week": week})
    return _project(base, {
        "unique_id": "o_orderkey",
        "subject_id": "o_custkey",
        "service_date": "cast(o_orderdate as date)",
        "epi_year": "epi_year",
        "epi_week": "epi_week",
        "site_type": "case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'hospital' "
                     "else 'centro de salud' end",
        "site_name": "c_mktsegment",
        "site_department": COMMON["SiteDepartamento"],
        "subject_department": COMMON["departamento"],
        "subject_municipality": COMMON["municipio"],
        "subject_community": COMMON["censo_comunidad"],
    }, CASE_FLAGS)


def effort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and eligibility columns; the id is raw bytes, the insertion date epoch seconds."""
    base = records(spark, sf_dir).withColumn(
        "_epoch", F.datediff(F.to_date("o_orderdate"), F.lit(dt.date(1970, 1, 1))) * 86400)
    return _project(base, {**EFFORT, "PDAInsertEpoch": "_epoch"}, {
        "SubjectID": "encode(c_name, 'UTF-8')",
        "SASubjectID": COMMON["SASubjectID"],
        "SiteName": COMMON["SiteName"],
        "has_eligibility": "o_orderkey % 4 = 0 or c_mktsegment <> 'HOUSEHOLD'",
    })


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation: the source of the place tables."""
    return read(spark, sf_dir, "customer").join(
        read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def location_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community codes in the layout of the source view."""
    return _project(places(spark, sf_dir), {
        "cod_depto": COMMON["departamento"],
        "cod_depto_muni": COMMON["municipio"],
        "comunidad": COMMON["censo_comunidad"],
        "cod_censo": PLACE["community_code"],
    }).distinct()


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates per community code: some codes have none, some have two."""
    codes = location_codes(spark, sf_dir).select("cod_censo").where(
        "cod_censo is not null and cod_censo % 7 <> 0").distinct()
    copies = codes.selectExpr(
        "cod_censo", "explode(case when cod_censo % 11 = 0 then array(0, 1) else array(0) end) as k")
    return copies.selectExpr(
        "cod_censo as group",
        "-91 + (cod_censo % 50 + k) / 100.0D as long",
        "14 + (cod_censo % 30 + k) / 100.0D as lat")


def department_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline points per department name."""
    return _project(places(spark, sf_dir), {
        "region": "case n_regionkey when 0 then 'Guatemala' when 1 then 'Santa Rosa' "
                  "else 'Quetzaltenango' end",
        "long": "-91 + (c_custkey % 1000) / 1000.0D",
        "lat": "14 + (c_custkey % 700) / 1000.0D",
    })
