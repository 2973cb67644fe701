"""Rule packs of the three surveilled syndromes.

``results`` read raw laboratory columns; ``residuals`` read the decoded flags. The
two are evaluated in separate projections (see ``operators.cases``) because some
raw and decoded names differ only in letter case, which Spark does not tell apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela.functions.results import (
    all_of, any_equals, any_of, decode, flag_set, has_result, known_negative,
)

Rules = Callable[[], dict[str, Column]]

# --- fixed values: reported etiologies and their labels, in display order ------------

RESPIRATORY_LABELS = {
    "flu": "Influenza (A y B)",
    "rsv": "Virus sincitial respiratorio",
    "hmpv": "Metaneumovirus humano",
    "pneumococcus": "Neumococo*",
}
DIARRHEAL_LABELS = {
    "rota": "Rotavirus",
    "noro1": "Norovirus 1",
    "noro2": "Norovirus 2",
    "astro": "Astrovirus",
    "sapo": "Sapovirus",
    "campy": "Campylobacter",
    "sal": "Salmonella",
    "shig": "Shigella",
    "epec": "E. coli enteropatógena",
    "etec": "E. coli enterotóxica",
}
FEBRILE_LABELS = {
    "dengue": "Dengue",
    "chik": "Chikungunya",
    "zika": "Zika",
}
FEBRILE_TABLE_LABELS = {
    "malaria": "Malaria",
    "leptospira": "Leptospira",
    "rickettsia": "Rickettsia",
}
RESIDUAL_LABELS = {
    "none": "Sin etiología determinada",
    "not_tested": "Pruebas pendientes**",
}

# --- end of fixed values --------------------------------------------------------------


@dataclass(frozen=True)
class Syndrome:
    """Eligibility, result rules and labels of one syndrome."""

    name: str
    eligible: str
    results: Rules
    residuals: Rules
    labels: dict[str, str]
    table_labels: dict[str, str]
    ylim: int
    series_etiologies: tuple[str, ...]
    has_disposition: bool = False

    def condition(self) -> Column:
        return F.col(self.eligible) == 1


def _respiratory_results() -> dict[str, Column]:
    pcr_done = F.col("viralPCR_Hizo") == 1
    swab_taken = flag_set("muestraFroteOPColecta") | flag_set("muestraFroteNP")
    return {
        "pneumococcus": decode(
            (F.col("Binax_HizoPrueba") == 1) & (F.col("edadAnios") >= 18),
            any_equals(1, "Binax_Resultado")),
        "flu": decode(pcr_done, any_equals(1, "viralPCR_FluA", "viralPCR_FluB")),
        "rsv": decode(pcr_done, any_equals(1, "viralPCR_RSV")),
        "hmpv": decode(pcr_done, any_equals(1, "viralPCR_hMPV")),
        "not_tested": swab_taken & ~F.coalesce(pcr_done, F.lit(False)),
    }


def _respiratory_residuals() -> dict[str, Column]:
    # The PCR flags keep their NULLs here; only an untested pneumococcus counts as FALSE.
    return {"none": all_of([
        known_negative("pneumococcus"), ~F.col("flu"), ~F.col("rsv"), ~F.col("hmpv")])}


# Decoded flag and the single raw column it reads.
_DIARRHEAL_SINGLE = {
    "emergency": "tamizadoEmergencia",
    "admitted": "actualAdmitido",
    "campy": "campylobacter",
    "sal": "salmonella",
    "shig": "shigella",
    "rota": "rotavirus",
    "noro1": "RTqPCR_NV1",
    "noro2": "RTqPCR_NV2",
    "astro": "ASTROVIRUS",
    "sapo": "SAPOVIRUS",
}
# Flags the diarrheal residuals look at; salmonella is not one of them.
_DIARRHEAL_RESIDUAL_FLAGS = [
    "campy", "shig", "epec", "etec", "rota", "noro1", "noro2", "sapo", "astro",
]


def _diarrheal_results() -> dict[str, Column]:
    either_coli = has_result("EPEC", "ETEC")
    flags = {flag: decode(has_result(raw), any_equals(1, raw))
             for flag, raw in _DIARRHEAL_SINGLE.items()}
    flags["epec"] = decode(either_coli, any_equals(1, "EPEC"))
    flags["etec"] = decode(either_coli, any_equals(1, "ETEC"))
    return flags


def _diarrheal_residuals() -> dict[str, Column]:
    return {
        "none": all_of(known_negative(f) for f in _DIARRHEAL_RESIDUAL_FLAGS),
        "not_tested": all_of(F.col(f).isNull() for f in _DIARRHEAL_RESIDUAL_FLAGS),
    }


def _febrile_results() -> dict[str, Column]:
    dengue_types = [f"dengue_tipo{i}" for i in range(1, 5)]
    malaria = ("malaria_gotaGruesa", "malaria_PCR")
    rickettsia = (
        "rickettsias_ELISA", "rickettsias_IF", "rickettsia_IF_Convaleciente", "rickettsias_PCR")
    return {
        # The dengue PCR only says that a test was made; the types carry its result.
        "dengue": decode(
            has_result("dengue_ELISA_lgM", "dengue_PCR"),
            any_equals(1, "dengue_ELISA_lgM", *dengue_types)),
        "chik": decode(has_result("CHK_IgM", "CHK_PCR"), any_equals(1, "CHK_IgM", "CHK_PCR")),
        "zika": decode(has_result("Zika_PCR"), any_equals(1, "Zika_PCR")),
        "malaria": decode(
            has_result(*malaria, except_codes=("NE",)), any_equals("1", *malaria)),
        "rickettsia": decode(
            has_result(*rickettsia, except_codes=("NE",)), any_equals("1", *rickettsia)),
        "leptospira": decode(
            has_result("Lepto_PanBioKit", except_codes=("NE", "80")),
            any_equals("1", "Lepto_PanBioKit")),
    }


# Flags the febrile residuals look at.
_FEBRILE_RESIDUAL_FLAGS = ["dengue", "chik", "zika", "malaria"]


def _febrile_residuals() -> dict[str, Column]:
    # "none" is TRUE or unknown, never FALSE, so its tested and positive counts agree.
    return {
        "none": F.when(all_of(known_negative(f) for f in _FEBRILE_RESIDUAL_FLAGS), True),
        "not_tested": any_of(F.col(f).isNull() for f in _FEBRILE_RESIDUAL_FLAGS),
    }


RESPIRATORY = Syndrome(
    name="respiratory", eligible="elegibleRespira",
    results=_respiratory_results, residuals=_respiratory_residuals,
    labels=RESPIRATORY_LABELS, table_labels=RESPIRATORY_LABELS | RESIDUAL_LABELS,
    ylim=40, series_etiologies=("flu", "rsv", "hmpv", "pneumococcus"),
)
DIARRHEAL = Syndrome(
    name="diarrheal", eligible="elegibleDiarrea",
    results=_diarrheal_results, residuals=_diarrheal_residuals,
    labels=DIARRHEAL_LABELS, table_labels=DIARRHEAL_LABELS | RESIDUAL_LABELS,
    ylim=32, series_etiologies=("rota", "noro2", "etec", "epec"), has_disposition=True,
)
FEBRILE = Syndrome(
    name="febrile", eligible="elegibleFebril",
    results=_febrile_results, residuals=_febrile_residuals,
    labels=FEBRILE_LABELS,
    table_labels=FEBRILE_LABELS | FEBRILE_TABLE_LABELS | RESIDUAL_LABELS,
    ylim=30, series_etiologies=("dengue", "chik", "zika"),
)
SYNDROMES = {s.name: s for s in (RESPIRATORY, DIARRHEAL, FEBRILE)}

# Number of earlier years in a corridor, months shown on the case map.
PREVIOUS_YEARS = 7
MAP_MONTHS = 3

# Active sites, their display names and department names.
ACTIVE_SITES = ["CS-NSR", "H-Cuilapa", "H-Xela", "CS-SM"]
HOSPITAL_SITES = ["H-Cuilapa", "H-Xela"]
SITE_NAMES = {
    "H-Cuilapa": "Hospital de Cuilapa",
    "H-Xela": "Hospital de Quetzaltenango",
    "CS-NSR": "Centro de Salud NSR",
}
DEPARTMENT_NAMES = {"SR": "Santa Rosa", "QU": "Quetzaltenango"}
DEPARTMENT_CODES = {1: "Guatemala", 6: "Santa Rosa", 9: "Quetzaltenango"}
SOFT_CATCHMENT = {"CS-SM": "SAN MARTIN SACATEPEQUEZ"}
