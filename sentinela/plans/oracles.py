"""The same questions in SQL, for a second engine to answer on the same tables."""

from __future__ import annotations

from sentinela.plans import tables as t
from sentinela.syndromes import DIARRHEAL, FEBRILE, RESPIRATORY

# Inexact doubles are compared at six digits. They are first cut to twelve, so that sums
# which differ only in their last bits fall on the same side of a tie.

ORACLES: dict[str, str] = {}

WEDNESDAY = ("(cast(o_orderdate as date) - cast(dayofweek(cast(o_orderdate as date)) as int) + 3)")
EPI = {
    "epi_year": f"cast(year({WEDNESDAY}) as int)",
    "epi_week": f"cast(floor((dayofyear({WEDNESDAY}) - 1) / 7.0) + 1 as int)",
}
RECORDS = ("from orders join customer on o_custkey = c_custkey "
           "join nation on c_nationkey = n_nationkey")


def columns(*parts: dict[str, str]) -> str:
    return ", ".join(f"{text} as {name}" for part in parts for name, text in part.items())


CASES = f"""cases as (select o_orderkey as unique_id, o_custkey as subject_id,
  cast(o_orderdate as date) as service_date, {columns(EPI)},
  case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'hospital'
       else 'centro de salud' end as site_type,
  c_mktsegment as site_name, {t.COMMON['SiteDepartamento']} as site_department,
  {t.COMMON['departamento']} as subject_department,
  n_nationkey as subject_municipality,
  {t.COMMON['censo_comunidad']} as subject_community, {columns(t.CASE_FLAGS)} {RECORDS})"""


def raw(results: dict[str, str]) -> str:
    return f"""raw as (select o_orderkey, {columns(t.COMMON, results)},
      {EPI['epi_year']} as epiYearAdmision, {EPI['epi_week']} as epiWeekAdmision {RECORDS})"""


PLACES = f"""places as (select distinct {t.COMMON['departamento']} as subject_department,
  n_nationkey as subject_municipality,
  {t.COMMON['censo_comunidad']} as subject_community,
  {t.PLACE['community_code']} as community_code
  from customer join nation on c_nationkey = n_nationkey),
communities as (select c.community_code,
  -91 + (c.community_code % 50 + k.k) / 100::double as long,
  14 + (c.community_code % 30 + k.k) / 100::double as lat
  from (select distinct community_code from places
        where community_code is not null and community_code % 7 <> 0) c
  join (values (0), (1)) k(k) on k.k = 0 or c.community_code % 11 = 0)"""

# --- sources ---------------------------------------------------------------------------

ORACLES["bounded_view"] = """select o_orderkey, o_custkey, o_orderdate, o_orderstatus from orders
where o_orderdate <= timestamp '2001-07-27'"""
ORACLES["projected_view"] = "select o_custkey, o_orderkey, o_orderpriority from orders"
ORACLES["discovered_view"] = "select * from orders where o_orderdate <= timestamp '2001-07-27'"
ORACLES["location_codes"] = f"with {PLACES} select * from places"
ORACLES["snapshot_roundtrip"] = ORACLES["bounded_view"]

# --- calendar --------------------------------------------------------------------------

MONTHS = ("['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', "
          "'septiembre', 'octubre', 'noviembre', 'diciembre']")
ORACLES["calendar_params"] = f"""
with days as (select distinct cast(o_orderdate as date) as d from orders),
fridays as (select d, d - cast(dayofweek(d) as int) as sunday,
  d - cast(dayofweek(d) as int) - 2 as f from days)
select d as run_date, f as last_friday,
  cast(f - interval 1 year as date)
    - cast(dayofweek(cast(f - interval 1 year as date)) as int) as first_sunday,
  cast(date_trunc('month', f) as date) as this_month_start,
  cast(date_trunc('month', f) - interval 1 month as date) as last_month_start,
  cast(date_trunc('month', f) + interval 1 month as date) as next_month_start,
  cast(f - interval 3 month as date) as trailing_start,
  sunday as week_start,
  cast(date_trunc('month', d) as date) as month_start,
  cast(date_trunc('quarter', d) as date) as quarter_start,
  cast(date_trunc('year', d) as date) as year_start,
  ({MONTHS})[month(d)] as month_name,
  concat(year(f) - 6, ' a ', year(f) - 1) as history_years,
  concat(strftime(f - interval 3 month, '%Y-%m-%d'), ' a ', strftime(f, '%Y-%m-%d')) as map_dates
from fridays"""
ORACLES["trailing_range"] = f"""with {CASES} select unique_id, service_date from cases
where service_date between date '2001-04-27' and date '2001-07-27'"""
ORACLES["epoch_timestamps"] = f"""select cast(o_orderdate as date) as insert_date, count(*) as n
{RECORDS} group by 1"""
ORACLES["age_days"] = f"""with {raw({})}
select o_orderkey,
  edadAnios * 365 + greatest(0, coalesce(edadMeses * 30, 0)) + greatest(0, coalesce(edadDias, 0))
    as age_aprox,
  cast(date_diff('day', try_cast(fechaDeNacimiento as date), cast(fechaHoraAdmision as date))
    as int) as age_dates
from raw"""

# --- cases -----------------------------------------------------------------------------

ORACLES["first_seen_cases"] = f"""with {CASES},
ranked as (select *, row_number() over
  (partition by subject_id order by service_date, unique_id) as rn from cases)
select unique_id, subject_id, service_date, site_name from ranked
where rn = 1 and service_date < date '2001-08-01'
  and site_name in ('BUILDING', 'FURNITURE', 'MACHINERY') and unique_id % 11 <> 0"""
ORACLES["first_seen_null_ids"] = """with ids as (
  select case when o_orderkey % 3 <> 0 then o_custkey end as subject_id,
    o_orderkey as unique_id, cast(o_orderdate as date) as service_date from orders)
select subject_id, unique_id, service_date from (select *, row_number() over
  (partition by subject_id order by service_date, unique_id) as rn from ids) where rn = 1"""

# Result rules as flat CASE expressions: results first, then what is read from them.
RESPI = ("""
  case when Binax_HizoPrueba = 1 and edadAnios >= 18 then Binax_Resultado = 1 end as pneumococcus,
  case when viralPCR_Hizo = 1 then viralPCR_FluA = 1 or viralPCR_FluB = 1 end as flu,
  case when viralPCR_Hizo = 1 then viralPCR_RSV = 1 end as rsv,
  case when viralPCR_Hizo = 1 then viralPCR_hMPV = 1 end as hmpv,
  ((muestraFroteOPColecta is not null and muestraFroteOPColecta = 1)
    or (muestraFroteNP is not null and muestraFroteNP = 1))
    and (viralPCR_Hizo is null or viralPCR_Hizo <> 1) as not_tested""",
    """(not pneumococcus and pneumococcus is not null) and not flu and not rsv and not hmpv
    as "none" """)


def plain(column: str, name: str) -> str:
    return f"case when {column} is not null then {column} = 1 end as {name}"


def negative(*names: str) -> str:
    return " and ".join(f"(not {n} and {n} is not null)" for n in names)


SINGLES = [
    ("tamizadoEmergencia", "emergency"), ("actualAdmitido", "admitted"),
    ("campylobacter", "campy"), ("salmonella", "sal"), ("shigella", "shig"),
    ("rotavirus", "rota"), ("RTqPCR_NV1", "noro1"), ("RTqPCR_NV2", "noro2"),
    ("ASTROVIRUS", "astro"), ("SAPOVIRUS", "sapo"),
]
NINE = ("campy", "shig", "f_epec", "f_etec", "rota", "noro1", "noro2", "sapo", "astro")
DIARREA = (", ".join(plain(c, n) for c, n in SINGLES) + """,
  case when EPEC is not null or ETEC is not null then EPEC = 1 end as f_epec,
  case when EPEC is not null or ETEC is not null then ETEC = 1 end as f_etec""",
    f"""{negative(*NINE)} as "none",
    {' and '.join(f'{n} is null' for n in NINE)} as not_tested""")

FOUR = ("dengue", "chik", "zika", "malaria")
RICKETTSIA = ("rickettsias_ELISA", "rickettsias_IF", "rickettsia_IF_Convaleciente",
              "rickettsias_PCR")


def done(*names: str) -> str:
    return " or ".join(f"({n} is not null and {n} <> 'NE')" for n in names)


FEBRIL = (f"""
  case when dengue_ELISA_lgM is not null or dengue_PCR is not null then
    dengue_ELISA_lgM = 1 or dengue_tipo1 = 1 or dengue_tipo2 = 1 or dengue_tipo3 = 1
    or dengue_tipo4 = 1 end as dengue,
  case when CHK_IgM is not null or CHK_PCR is not null then CHK_IgM = 1 or CHK_PCR = 1 end as chik,
  {plain('Zika_PCR', 'zika')},
  case when {done('malaria_gotaGruesa', 'malaria_PCR')}
    then malaria_gotaGruesa = '1' or malaria_PCR = '1' end as malaria,
  case when {done(*RICKETTSIA)}
    then {' or '.join(f"{n} = '1'" for n in RICKETTSIA)} end as rickettsia,
  case when Lepto_PanBioKit is not null and Lepto_PanBioKit not in ('NE', '80')
    then Lepto_PanBioKit = '1' end as leptospira""",
    f"""(({negative(*FOUR)}) or null) as "none",
    {' or '.join(f'{n} is null' for n in FOUR)} as not_tested""")

FINAL = {
    "respiratory": "pneumococcus, flu, rsv, hmpv, \"none\", not_tested",
    "diarrheal": "emergency, admitted, campy, sal, shig, rota, noro1, noro2, astro, sapo, "
                 "f_epec as epec, f_etec as etec, \"none\", not_tested",
    "febrile": "dengue, chik, zika, malaria, rickettsia, leptospira, \"none\", not_tested",
}
ELIGIBLE = {"respiratory": "elegibleRespira", "diarrheal": "elegibleDiarrea",
            "febrile": "elegibleFebril"}

LINE = """SubjectID as unique_id, SASubjectID as subject_id,
  cast(fechaHoraAdmision as date) as service_date,
  epiYearAdmision as epi_year, epiWeekAdmision as epi_week,
  case when SiteType = 'H' then 'hospital' when SiteType is not null then 'centro de salud' end
    as site_type,
  SiteName as site_name, SiteDepartamento as site_department,
  departamento as subject_department, municipio as subject_municipality,
  censo_comunidad as subject_community,
  edadAnios as age_years, edadMeses as age_months, edadDias as age_days,
  edadAnios * 365 + greatest(0, coalesce(edadMeses * 30, 0)) + greatest(0, coalesce(edadDias, 0))
    as age_aprox,
  cast(date_diff('day', try_cast(fechaDeNacimiento as date), cast(fechaHoraAdmision as date))
    as int) as age_dates"""


def line_list(name: str, view: dict[str, str], rules: tuple[str, str]) -> str:
    return f"""with {raw(view)},
ranked as (select *, row_number() over
  (partition by SubjectID order by PDAInsertDate, SASubjectID nulls last) as rn from raw),
kept as (select * from ranked where rn = 1 and {ELIGIBLE[name]} = 1 and SASubjectID is not null
  and cast(fechaHoraAdmision as date) < date '2001-08-01'),
decoded as (select *, {rules[0]} from kept), residual as (select *, {rules[1]} from decoded)
select {LINE}, {FINAL[name]} from residual"""


def decoded(name: str, view: dict[str, str], rules: tuple[str, str]) -> str:
    return f"""with {raw(view)}, decoded as (select *, {rules[0]} from raw),
residual as (select *, {rules[1]} from decoded) select o_orderkey, {FINAL[name]} from residual"""


for _name, _view, _rules in (("respiratory", t.RESPIRATORY, RESPI),
                             ("diarrheal", t.DIARRHEAL, DIARREA),
                             ("febrile", t.FEBRILE, FEBRIL)):
    ORACLES[f"{_name}_line_list"] = line_list(_name, _view, _rules)
    ORACLES[f"{_name}_results"] = decoded(_name, _view, _rules)

ORACLES["sorted_line_list"] = f"""with {CASES} select site_type, site_department, service_date,
  unique_id, flu, rsv, pneumo from cases order by 1, 2, 3, 4"""
ORACLES["site_membership"] = f"""with {CASES} select unique_id, site_name from cases
where site_name in ('BUILDING', 'MACHINERY')"""
ORACLES["recoded_sites"] = f"""with {CASES} select
  case site_name when 'BUILDING' then 'Hospital B' when 'MACHINERY' then 'Hospital M'
    else site_name end as site,
  cast(case site_name when 'BUILDING' then 1 when 'MACHINERY' then 2 end as int) as ord,
  case subject_department when 1 then 'Guatemala' when 6 then 'Santa Rosa'
    when 9 then 'Quetzaltenango' end as department,
  case site_name when 'BUILDING' then 'hospital' when 'FURNITURE' then 'centro de salud' end
    as site_type,
  upper(site_name[1]) || lower(site_name[2:]) as titled, count(*) as n
from cases group by 1, 2, 3, 4, 5"""
ORACLES["hex_ids"] = "select c_custkey, lower(hex(c_name)) as id_text from customer"
FLAGS = ("flu", "rsv", "pneumo")
LONG = " union all ".join(
    f"select unique_id, '{f}' as etiology, {f} as result from cases" for f in FLAGS)
ORACLES["results_long"] = f"with {CASES} select * from ({LONG}) where result is not null"
ORACLES["positive_results"] = f"""with {CASES} select unique_id, etiology from ({LONG})
where result"""

# --- positivity ------------------------------------------------------------------------

LABELS = "(values ('flu', 'Influenza', 1), ('rsv', 'Virus sincitial', 2), " \
         "('pneumo', 'Neumococo', 3)) l(etiology, label, ord)"


def period_rows(source: str, extra: str = "") -> str:
    """Rows repeated for every period they belong to, then for every result they have."""
    return f"""periods as (
  select 'this_month' as "group", * from {source}
    where service_date between date '2001-07-01' and date '2001-08-01'
  union all select 'last_month', * from {source}
    where service_date between date '2001-06-01' and date '2001-07-01'
  union all select 'all_time', * from {source}),
results as ({' union all '.join(
    f'''select "group", {extra} '{f}' as etiology, {f} as result from periods
    where {f} is not null''' for f in FLAGS)})"""


def positivity(source_cte: str, keys: tuple[str, ...] = ()) -> str:
    listed = "".join(f"{k}, " for k in keys)
    on = " and ".join(["s.g = r.\"group\"", "s.etiology = r.etiology", *[
        f"s.{k} = r.{k}" for k in keys]])
    groups = f"(select distinct {listed[:-2]} from chosen)" if keys else "(select 1 as one)"
    return f"""with {CASES}, chosen as ({source_cte}), {period_rows('chosen', listed)},
summary as (select "group", {listed} etiology, count(*) as n_tested,
  count(*) filter (where result) as n_positive from results group by all),
grid as (select * from {groups} k, (values ('this_month'), ('last_month'), ('all_time')) p(g),
  {LABELS})
select {''.join(f's.{k}, ' for k in keys)} s.g as "group", s.etiology, s.label, s.ord,
  coalesce(n_tested, 0) as n_tested, coalesce(n_positive, 0) as n_positive,
  coalesce(round_even(n_positive / n_tested * 100, 0), 0)::double as percent_positive
from grid s left join summary r on {on}"""


STORED = {"respiratory": (t.RESPIRATORY, RESPI, RESPIRATORY),
          "diarrheal": (t.DIARRHEAL, DIARREA, DIARRHEAL),
          "febrile": (t.FEBRILE, FEBRIL, FEBRILE)}
SPLIT = """case when site_type = 'hospital' then case when emergency and not admitted
      then 'emergency' else 'admitted' end else 'all' end"""


def stored_cases(name: str) -> str:
    """The line list of a refresh, with the disposition its tables are split by."""
    view, rules, pack = STORED[name]
    # The view snapshot ends at last Friday, before the first row per subject is chosen.
    lines = line_list(name, view, rules).replace(
        "from raw),", "from raw where PDAInsertDate <= timestamp '2001-07-27'),", 1)
    disposition = SPLIT if name == "diarrheal" else "'all'"
    return f"cases as (select *, {disposition} as disposition from ({lines}))"


def stored_groups(name: str) -> str:
    groups = ", ".join(f"('{site}', '{part}')" for site in t.SITES for part in (
        ("admitted", "emergency") if name == "diarrheal" and site in t.HOSPITALS else ("all",)))
    return f"grid as (select * from (values {groups}) g(site_name, disposition))"


def each_stored(body) -> str:
    """One query over the line list of every syndrome, one below the other."""
    return " union all ".join(
        f"select '{name}' as syndrome, * from (with {stored_cases(name)}, {stored_groups(name)} "
        f"{body(pack)})" for name, (_, _, pack) in STORED.items())


def stored_positivity() -> str:
    """Positivity of the three line lists; only diarrheal hospital cases are split."""
    periods = {"this_month": "service_date between date '2001-07-01' and date '2001-08-01'",
               "last_month": "service_date between date '2001-06-01' and date '2001-07-01'",
               "all_time": "true"}

    def cells(pack) -> str:
        return " union all ".join(
            f"""select site_name, disposition, '{period}' as "group", '{code}' as etiology,
            '{label}' as label, {i} as ord,
            count("{code}") filter (where {inside}) as n_tested,
            count(*) filter (where {inside} and "{code}") as n_positive
            from grid left join cases using (site_name, disposition)
            group by site_name, disposition"""
            for period, inside in periods.items()
            for i, (code, label) in enumerate(pack.table_labels.items(), 1))

    return f"""select *, case when n_tested = 0 then 0
      else round_even(n_positive / n_tested * 100, 0) end::double as percent_positive from ({each_stored(cells)})"""


ORACLES["weekly_refresh"] = stored_positivity()

ALL = "select * from cases"
ORACLES["positivity_table"] = positivity(ALL)
ORACLES["positivity_by_site"] = positivity(ALL, ("site_name",))
ORACLES["positivity_by_condition"] = positivity(
    """select * from cases where site_name in ('BUILDING', 'MACHINERY')
    and ((admitted or not emergency) or (admitted is null or emergency is null))""")
ORACLES["positivity_by_disposition"] = positivity(
    """select *, 'admitted' as disposition from cases where site_name in ('BUILDING', 'MACHINERY')
    and ((admitted or not emergency) or (admitted is null or emergency is null))
    union all select *, 'emergency' from cases where site_name in ('BUILDING', 'MACHINERY')
    and emergency and not admitted""", ("site_name", "disposition"))
ORACLES["positivity_text_table"] = f"""with long as ({positivity(ALL, ("site_name",))}),
cells as (select *, concat(n_positive, ' / ', n_tested, ' (',
  cast(percent_positive as bigint), ')') as cell from long)
select site_name, ord, label as etiologia,
  max(cell) filter (where "group" = 'this_month') as this_month,
  max(cell) filter (where "group" = 'last_month') as last_month,
  max(cell) filter (where "group" = 'all_time') as all_time
from cells group by all"""

ORACLES["refresh_positivity_text"] = f"""with cells as (select *,
  concat(n_positive, ' / ', n_tested, ' (', cast(percent_positive as bigint), ')') as cell
  from ({stored_positivity()}))
select syndrome, site_name, disposition, ord, label as etiologia,
  max(cell) filter (where "group" = 'this_month') as this_month,
  max(cell) filter (where "group" = 'last_month') as last_month,
  max(cell) filter (where "group" = 'all_time') as all_time
from cells group by all"""
ORACLES["refresh_monthly"] = each_stored(lambda pack: " union all ".join(
    f"""select site_type, case site_department when 'SR' then 'Santa Rosa' when 'QU'
    then 'Quetzaltenango' else site_department end as department, site_name as site,
    date_trunc('month', service_date)::date as service_date, '{e}' as etiology,
    count(*) filter (where "{e}") as cases from cases group by all""" for e in pack.labels))
ORACLES["refresh_corridor_current"] = each_stored(lambda pack: f""",
counts as (select site_name, disposition, epi_year, epi_week, count(*) as casos from cases
  group by all),
ends as (select g.site_name, g.disposition, greatest(52,
  coalesce(max(epi_week) filter (where epi_year = 2001), 0)) as last
  from grid g left join counts using (site_name, disposition) group by 1, 2),
weeks as (select site_name, disposition, cast(unnest(generate_series(1, last)) as int) as epi_week
  from ends)
select w.*, casos, case when casos is not null
  then least(greatest(casos, 0), {pack.ylim})::double end as shown from weeks w
left join counts c on c.site_name = w.site_name and c.disposition = w.disposition
  and c.epi_week = w.epi_week and c.epi_year = 2001""").replace(" ,\ncounts", ",\ncounts")

ORACLES["report_roundtrip"] = ORACLES["positivity_by_site"]

# --- corridor --------------------------------------------------------------------------

COUNTS = """counts as (select site_name, epi_year, epi_week, count(*) as casos
  from cases group by all)"""
ALL_COUNTS = "counts as (select epi_year, epi_week, count(*) as casos from cases group by all)"
ORACLES["weekly_counts"] = f"with {CASES}, {COUNTS} select * from counts"
ORACLES["corridor_current"] = f"""with {CASES}, {COUNTS},
ends as (select site_name, greatest(52, coalesce(max(epi_week) filter (where epi_year = 2001), 0))
  as last from counts group by 1),
grid as (select site_name, cast(unnest(generate_series(1, last)) as int) as epi_week from ends)
select g.site_name, g.epi_week, c.casos from grid g left join counts c
  on c.site_name = g.site_name and c.epi_week = g.epi_week and c.epi_year = 2001"""


def bands(counts: str, keys: str) -> str:
    return f"""{CASES}, {counts}, weekly as (select {keys} epi_week,
  min(casos)::double as "min", quantile_cont(casos, 0.25)::double as q1,
  quantile_cont(casos, 0.5)::double as q2, quantile_cont(casos, 0.75)::double as q3,
  max(casos)::double as "max"
  from counts where epi_year between 1995 and 2000 group by all)"""


LINES = [("min", '"min"'), ("Éxito", "q1"), ("Seguridad", "q2"), ("Alerta", "q3"),
         ("Brote", "40::double"), ("max", '"max"')]


def lines(keys: str, chosen=LINES) -> str:
    return " union all ".join(
        f"select {keys} epi_week, '{z}' as zona, {e} as quantile from weekly" for z, e in chosen)


ORACLES["corridor_bands"] = f"with {bands(ALL_COUNTS, '')} {lines('')}"
ORACLES["corridor_bands_by_site"] = f"with {bands(COUNTS, 'site_name,')} {lines('site_name,')}"
ORACLES["corridor_range"] = (
    f"with {bands(COUNTS, 'site_name,')} {lines('site_name,', [LINES[0], LINES[-1]])}")


def polygons(prefix: str, keys: str, ylim: int, value: str = "quantile") -> str:
    on = "w.epi_week = g.epi_week" + (" and w.site_name = g.site_name" if keys else "")
    source = f"(select distinct {keys[:-1]} from weekly)" if keys else "(select 1 as one)"
    return f"""with {prefix},
zones as (select * from (values ('Brote', 1), ('Alerta', 2), ('Seguridad', 3), ('Éxito', 4))
  z(zona, zone_order)),
grid as (select * from {source} s, zones, (select cast(unnest(generate_series(1, 53)) as int)
  as epi_week) w),
full_weeks as (select {'g.site_name,' if keys else ''} g.epi_week as point_order, g.epi_week,
  g.zona, g.zone_order,
  case g.zona when 'Brote' then {ylim}::double else coalesce(case g.zona when 'Alerta' then w.q3
    when 'Seguridad' then w.q2 else w.q1 end, 0) end as quantile
  from grid g left join weekly w on {on}),
closed as (select * from full_weeks
  union all select {keys} 0, epi_week, zona, zone_order, 0 from full_weeks where epi_week = 1
  union all select {keys} 54, epi_week, zona, zone_order, 0 from full_weeks where epi_week = 53)
select {keys} point_order, epi_week, zona, zone_order, {value} as quantile from closed"""


ORACLES["corridor_polygons"] = polygons(bands(COUNTS, "site_name,"), "site_name,", 40)
ORACLES["corridor_polygons_clamped"] = polygons(
    bands(ALL_COUNTS, ""), "", 45, "least(greatest(quantile, 0), 45)::double")
ORACLES["corridor_etiology"] = f"""with {CASES},
counts as (select epi_week, count(*) as casos from cases
  where site_name in ('BUILDING', 'MACHINERY') and flu and rsv and epi_year = 2001 group by 1),
grid as (select cast(unnest(generate_series(1, greatest(52, coalesce(
  (select max(epi_week) from counts), 0)))) as int) as epi_week)
select g.epi_week, casos from grid g left join counts c on c.epi_week = g.epi_week"""
ORACLES["corridor_etiology_range"] = f"""with {CASES},
counts as (select site_name, epi_year, epi_week, count(*) as casos from cases where pneumo
  and epi_year between 1995 and 2000 group by all)
select site_name, epi_week, 'min' as zona, min(casos)::double as quantile from counts group by all
union all
select site_name, epi_week, 'max', max(casos)::double from counts group by all"""

ORACLES["daily_cube"] = f"""with {CASES} select site_type, site_name, service_date, epi_year, epi_week,
  count(*) as cases, {', '.join(f'count({f}) as {f}_tested, '
  f'count(*) filter (where {f}) as {f}_positive' for f in FLAGS)} from cases group by all"""
ORACLES["positivity_from_cube"] = ORACLES["positivity_by_site"]
ORACLES["weekly_counts_from_cube"] = ORACLES["weekly_counts"]
ORACLES["period_counts_from_cube"] = f"""with {CASES} select site_type, site_name,
  cast(date_trunc('quarter', service_date) as date) as service_date,
  {', '.join(f'count(*) filter (where {f}) as {f}' for f in FLAGS)} from cases group by 1, 2, 3"""

ORACLES["unknown_sites"] = f"""with {CASES}
select s as site_name from (values ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'),
  ('MACHINERY'), ('FURNITUR'), ('Ninguno')) w(s) where s not in (select site_name from cases)"""
ORACLES["scale_names"] = f"""with {CASES}, starts as (
  select 'Semana' as scale, service_date - (dayofweek(service_date))::int as period from cases
  union all select 'Mes', date_trunc('month', service_date)::date from cases
  union all select 'Trimestre', date_trunc('quarter', service_date)::date from cases
  union all select 'Año', date_trunc('year', service_date)::date from cases)
select scale, min(period)::date as first_period, max(period)::date as last_period
from starts group by 1"""
ORACLES["report_captions"] = f"""with {CASES}
select (select count(*) from cases where service_date <= date '2001-07-27') as cases, name, text
from (values ('history_years', '1995 a 2000'), ('map_dates', '2001-04-27 a 2001-07-27'),
  ('effort_dates', '2000-07-23 a 2001-07-27'), ('data_until', '2001-07-27'),
  ('heading_this_month', 'Mes más reciente (julio) (n, %)'),
  ('heading_last_month', 'Mes anterior (junio) (n, %)'),
  ('heading_all_time', 'Histórico (n, %)')) w(name, text)"""

# --- curve, maps -----------------------------------------------------------------------

ORACLES["epidemic_curve"] = f"""with {CASES},
everywhere as (select *, case site_department when 'SR' then 'Santa Rosa' when 'QU'
  then 'Quetzaltenango' else site_department end as dept from cases),
long as (select * from everywhere where site_type = 'hospital'),
hits as ({' union all '.join(
    f"select dept, '{f}' as code, epi_year, epi_week from long where {f}" for f in FLAGS)}),
counts as (select dept, code, epi_year, epi_week, count(*) as n from hits group by all),
grid as (select * from (select distinct dept from everywhere),
  (select l.etiology as code from {LABELS}),
  (select distinct epi_year from counts), (select distinct epi_week from counts))
select g.dept as site_department, l.label as etiology, l.ord, g.epi_year, g.epi_week,
  coalesce(n, 0) as n
from grid g join {LABELS} on l.etiology = g.code
left join counts c on c.dept = g.dept and c.code = g.code and c.epi_year = g.epi_year
  and c.epi_week = g.epi_week"""

SAME_PLACE = """p.subject_department is not distinct from c.subject_department
  and p.subject_municipality is not distinct from c.subject_municipality
  and p.subject_community is not distinct from c.subject_community"""
MAP = f"""{CASES}, {PLACES},
recent as (select *, case subject_department when 1 then 'Guatemala' when 6 then 'Santa Rosa'
  when 9 then 'Quetzaltenango' end as department_name from cases
  where service_date between date '2001-04-27' and date '2001-07-27'),
located as (select c.*, p.community_code from recent c left join places p on {SAME_PLACE}
  where department_name in ('Santa Rosa', 'Quetzaltenango')),
long as ({' union all '.join(
    f"select *, '{f}' as code from located where {f}" for f in FLAGS)}),
points as (select unique_id, department_name, subject_department, subject_community,
  x.community_code, service_date, l.label as etiology, l.ord,
  concat(l.label, '</br>', strftime(service_date, '%Y-%m-%d')) as label, m.long, m.lat
  from long x join {LABELS} on l.etiology = x.code
  left join communities m on m.community_code = x.community_code
  where x.community_code is not null and m.long is not null and m.lat is not null)"""
ORACLES["case_map_points"] = f"with {MAP} select * from points"
ORACLES["case_map_labels"] = f"""with {MAP} select subject_community, long, lat, count(*) as n
from points group by all"""
# Found department by department, for the cases of one community each.
FOUND = f"""{MAP.replace("where department_name in ('Santa Rosa', 'Quetzaltenango')",
                         "where department_name is not null")},
found as (select distinct subject_community, department_name from points)"""
ORACLES["case_map_undetected"] = f"""with {FOUND}
select d as department_name, l.ord, l.label as etiology
from (values ('Santa Rosa'), ('Quetzaltenango'), ('Guatemala')) w(d), {LABELS}
where d not in (select department_name from found where subject_community = 'C9')"""
ORACLES["case_map_none_found"] = f"""with {FOUND}
select c as community, l.ord, l.label as etiology from (values ('C9'), ('C3')) w(c), {LABELS}
where c not in (select subject_community from found
  where department_name = 'Santa Rosa' and subject_community is not null)"""
ORACLES["jittered_points"] = f"""with {MAP} select unique_id, etiology, long, lat,
  true as long_near, true as lat_near, true as independent from points"""
ORACLES["case_map_bounds"] = """with outline as (select
  case n_regionkey when 0 then 'Guatemala' when 1 then 'Santa Rosa' else 'Quetzaltenango' end
    as region,
  -91 + (c_custkey % 1000) / 1000::double as long, 14 + (c_custkey % 700) / 1000::double as lat
  from customer join nation on c_nationkey = n_nationkey),
b as (select region, max(lat) as n, min(lat) as s, min(long) as w, max(long) as e
  from outline group by 1)
select region, round((n + 0.005)::decimal(30, 12), 6)::double as lat1, round((w)::decimal(30, 12), 6)::double as lng1, round((s - 0.005)::decimal(30, 12), 6)::double as lat2,
  round((e)::decimal(30, 12), 6)::double as lng2, round((n + 0.005 - 0.06)::decimal(30, 12), 6)::double as fit_lat1, round((w + 0.01)::decimal(30, 12), 6)::double as fit_lng1,
  round((s - 0.005 + 0.06)::decimal(30, 12), 6)::double as fit_lat2, round((e - 0.01)::decimal(30, 12), 6)::double as fit_lng2 from b"""
ORACLES["refresh_map_points"] = each_stored(lambda pack: f""", {PLACES},
recent as (select *, case subject_department when 6 then 'Santa Rosa'
  when 9 then 'Quetzaltenango' end as department_name from cases
  where service_date between date '2001-04-27' and date '2001-07-27'),
located as (select c.*, p.community_code from recent c join places p on {SAME_PLACE}
  where department_name is not null),
long as ({' union all '.join(
    f"""select unique_id, department_name, community_code, '{label}' as etiology from located
    where "{e}" """ for e, label in pack.labels.items())})
select x.*, m.long, m.lat, true as near from long x
join communities m on m.community_code = x.community_code""")
JOINED = f"""{CASES}, {PLACES}, located as (select c.*, p.community_code from cases c
  left join places p on {SAME_PLACE})"""
ORACLES["location_join_nullsafe"] = f"""with {JOINED} select unique_id, subject_department,
  subject_municipality, subject_community, community_code from located"""
ORACLES["community_join"] = f"""with {JOINED}
select unique_id, l.community_code, long, lat from located l
left join communities m on m.community_code = l.community_code"""
ORACLES["tile_bins"] = f"""with {JOINED},
points as (select long, lat, radians(least(greatest(lat, -85.0511287798), 85.0511287798)) as phi
  from located l join communities m on m.community_code = l.community_code),
zoomed as (select *, cast(unnest(generate_series(10, 15)) as int) as zoom from points),
tiles as (select *,
  least(greatest(floor((long + 180) / 360 * power(2, zoom)), 0), power(2, zoom) - 1)::bigint as x,
  least(greatest(floor((1 - ln(tan(phi) + 1 / cos(phi)) / pi()) / 2 * power(2, zoom)), 0),
    power(2, zoom) - 1)::bigint as y from zoomed)
select zoom, x, y, count(*) as n, round((sum(long::decimal(14, 9))::double / count(*))::decimal(30, 12), 6)::double as long, round((sum(lat::decimal(14, 9))::double / count(*))::decimal(30, 12), 6)::double as lat
from tiles group by all"""

# --- period time series ----------------------------------------------------------------

PERIOD = {
    "week": "service_date - cast(dayofweek(service_date) as int)",
    "month": "cast(date_trunc('month', service_date) as date)",
    "quarter": "cast(date_trunc('quarter', service_date) as date)",
    "year": "cast(date_trunc('year', service_date) as date)",
}
for _scale, _floor in PERIOD.items():
    ORACLES[f"timeseries_{_scale}"] = f"""with {CASES},
sums as (select site_name, {_floor} as period, coalesce(sum(flu::int), 0)::bigint as n
  from cases where site_type = 'hospital' group by all)
select period as service_date, max(n) filter (where site_name = 'MACHINERY') as MACHINERY,
  max(n) filter (where site_name = 'BUILDING') as "Hospital B" from sums group by all"""
ORACLES["timeseries_long"] = f"""with {CASES}, {' , '.join(f'''s_{f} as (
  select site_type, site_name, {PERIOD['week']} as period, '{f}' as etiology,
  coalesce(sum({f}::int), 0)::bigint as n from cases group by all)''' for f in FLAGS)}
select site_type, site_name, period as service_date, etiology, n as cases
from ({' union all '.join(f'select * from s_{f}' for f in FLAGS)})"""
ORACLES["timeseries_site_series"] = f"""with {CASES}
select case site_name when 'FURNITURE' then 'Centro F' else site_name end as site_name,
  {PERIOD['month']} as service_date, coalesce(sum(pneumo::int), 0)::bigint as cases
from cases where site_type = 'centro de salud' group by all"""
ORACLES["timeseries_max"] = f"""with {CASES}, sums as (
  select site_type, site_name, {PERIOD['month']} as period, sum(flu::int) as a,
  sum(rsv::int) as b, sum(pneumo::int) as c from cases group by all)
select max(n)::bigint as max_cases from (select a as n from sums union all select b from sums
  union all select c from sums)"""

# --- screening effort ------------------------------------------------------------------

_EFFORT = {k: v for k, v in t.EFFORT.items() if v is not None}
CATCHMENT = """SiteName in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')
  and (catchment = 1 or (SiteName = 'FURNITURE' and NombreMunicipio = 'NATION_3'))"""
EFFORT = f"""base as (select c_name as SubjectID, {t.COMMON['SASubjectID']} as SASubjectID,
  cast(o_orderdate as date) as insert_date, c_mktsegment as SiteName, {columns(_EFFORT)},
  o_orderkey % 4 = 0 or c_mktsegment <> 'HOUSEHOLD' as has_eligibility {RECORDS}),
joined as (select s.SiteName, case s.NombreDepartamento when 'SANTA ROSA' then 'Santa Rosa'
    else 'Quetzaltenango' end as department, s.SASubjectID, s.pacienteInscrito, s.insert_date,
  e.elegibleRespira = 1 as er, e.elegibleDiarrea = 1 as ed, e.elegibleFebril = 1 as ef
  from (select * from base where {CATCHMENT}) s
  left join (select * from base where has_eligibility) e on e.SubjectID = s.SubjectID),
flags as (select *, SASubjectID is not null and pacienteInscrito = 1 and (er or ed or ef)
  as enrolled from joined
  where insert_date between date '2000-07-23' and date '2001-07-27'),
kept as (select department, SiteName, enrolled, er and enrolled as er, ed and enrolled as ed,
  ef and enrolled as ef from flags),
totals as (select department, SiteName as site, count(*) as screened,
  {', '.join(f'case when count({c}) = count(*) then count(*) filter (where {c}) end as {n}'
             for c, n in (('enrolled', 'enrolled'), ('er', 'elegibleRespira'),
                          ('ed', 'elegibleDiarrea'), ('ef', 'elegibleFebril')))}
  from kept group by all)"""
ORACLES["screening_effort_counts"] = f"with {EFFORT} select * from totals"


def cell(part: str, whole: str) -> str:
    return f"""concat(coalesce({part}::varchar, 'NA'), ' (', case when {whole} = 0 then
    case when {part} = 0 then 'NaN' when {part} > 0 then 'Inf' else 'NA' end
    else coalesce(round_even({part} / {whole} * 100, 0)::bigint::varchar, 'NA') end, '%)')"""


EFFORT_TEXT = f"""{EFFORT}, texts as (select concat(department, ' (', site, ')') as sitio, x.*
  from totals, lateral (values (1, 'Tamizados', screened::varchar),
    (2, 'Elegibles e inscritos', {cell('enrolled', 'screened')}),
    (3, 'Síndrome respiratorio', {cell('elegibleRespira', 'enrolled')}),
    (4, 'Síndrome diarreico', {cell('elegibleDiarrea', 'enrolled')}),
    (5, 'Síndrome febril', {cell('elegibleFebril', 'enrolled')})) x(ord, grupo, n))"""
ORACLES["screening_effort_text"] = f"with {EFFORT_TEXT} select sitio, ord, grupo, n from texts"
HEADINGS = [f"{d} ({s})" for d in ("Quetzaltenango", "Santa Rosa") for s in t.SITES]
ORACLES["screening_effort"] = f"""with {EFFORT_TEXT} select ord, grupo,
  {', '.join(f"max(n) filter (where sitio = '{h}') as " + f'"{h}"' for h in HEADINGS)}
from texts group by all"""
ORACLES["refresh_effort_text"] = ORACLES["screening_effort_text"]
ORACLES["catchment_filter"] = f"""with {EFFORT} select SiteName, NombreMunicipio, catchment,
  count(*) as n from base where {CATCHMENT} group by all"""

# --- series operators ------------------------------------------------------------------

GAPS = """points as (select event_type, t, case when event_type = 'click'
    or not (day(t) <= 2 or day(t) % 7 = 4 or day(t) >= 29) then y end as y
  from (select event_type, cast(ts as date) as t, avg(value) as y from events group by all))"""
ORACLES["rolling_mean"] = f"""with {GAPS} select event_type, t, round((y)::decimal(30, 12), 6)::double as y,
  round((avg(y) over (partition by event_type order by t rows between 6 preceding and current row))::decimal(30, 12), 6)::double as rolled from points"""


def shares(den: str, n: int) -> str:
    over = f"over (partition by event_type order by t rows between {n - 1} preceding and current row)"
    return f"""points as (select event_type, cast(ts as date) as t,
  count(*) filter (where value > 20) as num, {den} as den from events group by event_type,
  cast(ts as date)),
summed as (select *, (sum(num) {over})::double as sum_num, (sum(den) {over})::double as sum_den
  from points),
shared as (select *, case when sum_den <> 0 then sum_num / sum_den else 0 end as p from summed)"""


SOME = "case when day(cast(ts as date)) > 3 then count(*) else 0 end"
ORACLES["rolling_proportion"] = f"""with {shares(SOME, 3)} select event_type, t, num, den,
  sum_num, sum_den, round((100 * p)::decimal(30, 12), 6)::double::double as rolled from shared"""

def wilson(sign: str) -> str:
    """One limit in closed form; there is none for a share above one."""
    limit = f"""100 * (p + 2 / sum_den
      {sign} 2 * sqrt(p * (1 - p) / sum_den + 1 / (sum_den * sum_den))) / (1 + 4 / sum_den)"""
    return f"""case when sum_den = 0 then 0 when isnan({limit}) then 'nan'::double
      else round(({limit})::decimal(30, 12), 6)::double end"""


ORACLES["wilson_band"] = f"""with {shares(SOME, 3)} select event_type, t, num, den, sum_num, sum_den,
  round((100 * p)::decimal(30, 12), 6)::double as rolled,
  {wilson('-')} as low, {wilson('+')} as high from shared"""
ORACLES["normal_band"] = f"""with {shares('count(*)', 5)} select event_type, t, num, den, sum_num,
  sum_den, round((100 * p)::decimal(30, 12), 6)::double as rolled,
  round((100 * (p - 2 * sqrt(p * (1 - p) / sum_den)))::decimal(30, 12), 6)::double as low,
  round((100 * (p + 2 * sqrt(p * (1 - p) / sum_den)))::decimal(30, 12), 6)::double as high from shared"""
ORACLES["rolling_band"] = """with points as (select event_type, cast(ts as date) as t,
  min(value) as low, avg(value) as mid, max(value) as high from events group by all),
known as (select event_type, t, low, case when day(t) % 5 <> 0 then mid end as mid, high
  from points)
select event_type, t, round((low)::decimal(30, 12), 6)::double as low, round((mid)::decimal(30, 12), 6)::double as mid, round((high)::decimal(30, 12), 6)::double as high,
  round((avg(case when mid is not null then low end) over w)::decimal(30, 12), 6)::double as rolled_low,
  round((avg(mid) over w)::decimal(30, 12), 6)::double as rolled_mid,
  round((avg(case when mid is not null then high end) over w)::decimal(30, 12), 6)::double as rolled_high
from known window w as (partition by event_type order by t
  rows between 3 preceding and current row)"""
ORACLES["rolling_error"] = """with points as (select event_type, cast(ts as date) as t,
  avg(value) as y, max(value) / count(value) as error from events group by all),
sums as (select *, avg(y) over w as m, 2 * sqrt(sum(error * error) over w) / count(y) over w as h
  from points window w as (partition by event_type order by t
    rows between 4 preceding and current row))
select event_type, t, round((y)::decimal(30, 12), 6)::double as y, round((error)::decimal(30, 12), 6)::double as error, round((m)::decimal(30, 12), 6)::double as rolled,
  round((m - h)::decimal(30, 12), 6)::double as low, round((m + h)::decimal(30, 12), 6)::double as high from sums"""
OVERVIEW = f"{GAPS}, overview as (select t, avg(y) as y from points group by t)"
ORACLES["series_overview"] = f"with {OVERVIEW} select t, round((y)::decimal(30, 12), 6)::double as y from overview"
ORACLES["series_overview_log"] = f"""with {OVERVIEW}
select t, round((log10(y))::decimal(30, 12), 6)::double as y from overview"""
ORACLES["overview_limits"] = f"""with {OVERVIEW}, b as (select min(y) as lo, max(y) as hi
  from overview)
select round((lo - 0.25 * case when hi > lo then hi - lo else hi end)::decimal(30, 12), 6)::double as y_min,
  round((hi + 0.25 * case when hi > lo then hi - lo else hi end)::decimal(30, 12), 6)::double as y_max from b"""
ORACLES["overview_limits_log"] = f"""with {OVERVIEW}
select round((log10(min(y)))::decimal(30, 12), 6)::double as y_min, round((1.25 * log10(max(y)))::decimal(30, 12), 6)::double as y_max from overview
where y > 0"""
EVENT_ORDER = ["view", "click", "signup", "purchase", "error"]


def stacked(missing: str) -> str:
    order = ", ".join(f"('{n}', {i})" for i, n in enumerate(EVENT_ORDER, 1))
    return f"""with {GAPS}, names as (select * from (values {order}) n(event_type, ord)),
grid as (select d.t, n.event_type, n.ord, p.y from (select distinct t from points) d, names n
  left join points p on p.t = d.t and p.event_type = n.event_type),
near as (select *, last_value(case when y is not null then t end ignore nulls) over b as pt,
  last_value(y ignore nulls) over b as py,
  first_value(case when y is not null then t end ignore nulls) over a as nt,
  first_value(y ignore nulls) over a as ny
  from grid window b as (partition by event_type order by t
      rows between unbounded preceding and 1 preceding),
    a as (partition by event_type order by t rows between 1 following and unbounded following)),
filled as (select *, coalesce(y, {missing}, 0) as f from near)
select t, event_type, ord, round((y)::decimal(30, 12), 6)::double as y, round((sum(f) over
  (partition by t order by ord desc rows between unbounded preceding and current row))::decimal(30, 12), 6)::double
  as y_stacked from filled"""


BETWEEN = "py + (ny - py) * (date_diff('day', pt, t) / date_diff('day', pt, nt)::double)"
ORACLES["stacked_series"] = stacked(f"{BETWEEN}, py, ny")
ORACLES["stacked_series_inside"] = stacked(BETWEEN)
ORACLES["stacked_series_none"] = stacked("0")
ORACLES["range_cut"] = f"""with {GAPS}, b as (select event_type, coalesce(max(t) filter
    (where t < date '2024-01-05' and y is not null), min(t)) as lo,
  coalesce(min(t) filter (where t > date '2024-01-17' and y is not null), max(t)) as hi
  from points group by 1)
select p.event_type, p.t, round((p.y)::decimal(30, 12), 6)::double as y from points p
join b on b.event_type = p.event_type and p.t between b.lo and b.hi"""
ORACLES["series_extremes"] = """select event_type, min(value) as y_min, max(value) as y_max
from events where not isnan(value) group by 1"""
ORACLES["log_domain"] = """with s as (select event_id, round(value - 10, 2) as d, value from events)
select event_id, case when d > 0 then d end as y,
  case when d > 0 and value > 0 then d end as low,
  case when d > 0 and value > 0 then value end as high from s"""
