"""Hand-written cases for the report operators."""

import datetime as dt
import itertools
import random
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinela.functions import scalars
from sentinela.functions.calendar import ReportDates
from sentinela.operators import cases as case_ops
from sentinela.operators import corridor, cube, curve, effort, maps, positivity, timeseries
from sentinela.operators.reshape import require_flags, unpivot_flags
from sentinela.syndromes import RESPIRATORY

D = dt.date
DATES = ReportDates(D(2018, 6, 17))     # last Friday 2018-06-15


def ask(df):
    return [tuple(r) for r in df.collect()]


# --- line list ---------------------------------------------------------------------------

RAW = ("SubjectID string, SASubjectID string, PDAInsertDate timestamp_ntz, "
       "fechaHoraAdmision timestamp_ntz, SiteName string, SiteType string, "
       "SiteDepartamento string, epiYearAdmision int, epiWeekAdmision int, departamento int, "
       "municipio int, censo_comunidad string, edadAnios int, edadMeses int, edadDias int, "
       "fechaDeNacimiento string, elegibleRespira int, Binax_HizoPrueba int, "
       "Binax_Resultado int, viralPCR_Hizo int, viralPCR_FluA int, viralPCR_FluB int, "
       "viralPCR_RSV int, viralPCR_hMPV int, muestraFroteOPColecta int, muestraFroteNP int")


def raw_row(subject, day, eligible=1, sa="SA", site="H-Xela", kind="H", admitted=None):
    admitted = admitted or D(2018, 5, 2)
    return (subject, sa, dt.datetime(2018, 5, day), dt.datetime.combine(admitted, dt.time(23)),
            site, kind, "QU", 2018, 18, 9, 901, "C1", 2, None, -3, "2016-05-01", eligible,
            0, None, 1, 1, 0, 0, 0, 1, 0)


def line_list(spark, rows):
    return case_ops.syndrome_cases(spark.createDataFrame(rows, RAW), RESPIRATORY, DATES)


def test_first_row_decides_even_if_it_is_dropped(spark):
    rows = [raw_row("a", 1, eligible=0), raw_row("a", 2), raw_row("b", 3), raw_row("b", 1, sa="S1"),
            raw_row("c", 1, sa=None), raw_row("c", 2), raw_row("d", 1, site="Otro"),
            raw_row("e", 1, admitted=D(2018, 7, 1)), raw_row("f", 1, admitted=D(2018, 6, 30)),
            raw_row("g", 1, eligible=None)]
    found = {(r["unique_id"], r["subject_id"]) for r in line_list(spark, rows).collect()}
    assert found == {("b", "S1"), ("f", "SA")}


def test_missing_ids_form_one_group(spark):
    rows = [raw_row(None, 2, sa="S2"), raw_row(None, 1, sa="S1"), raw_row("a", 1)]
    found = sorted(r["subject_id"] for r in line_list(spark, rows).collect())
    assert found == ["S1", "SA"]


def test_line_list_columns_and_ages(spark):
    row = line_list(spark, [raw_row("a", 1, kind=None)]).first().asDict()
    assert list(row)[:16] == case_ops.CASE_COLUMNS
    assert list(row)[16:] == ["pneumococcus", "flu", "rsv", "hmpv", "none", "not_tested"]
    assert row["site_type"] is None
    assert row["age_aprox"] == 730 and row["age_dates"] == 731
    assert row["service_date"] == D(2018, 5, 2)


def test_order_of_input_and_partitions_do_not_matter(spark):
    rows = [raw_row(s, d) for s in "abcdef" for d in range(1, 9)]
    wanted = sorted(map(str, line_list(spark, rows).collect()))
    backwards = spark.createDataFrame(rows[::-1], RAW).repartition(5)
    got = case_ops.syndrome_cases(backwards, RESPIRATORY, DATES)
    assert sorted(map(str, got.collect())) == wanted


def test_unknown_site_warns_and_gives_no_rows(spark):
    df = spark.createDataFrame([("a",), ("b",)], "site_name string")
    with pytest.warns(UserWarning, match="zzz"):
        assert case_ops.at_sites(df, ["zzz"], check=True).count() == 0
    assert case_ops.at_sites(df, "all").count() == 2
    assert case_ops.at_sites(df, ["a", "zzz"]).count() == 1
    with pytest.raises(TypeError):
        case_ops.at_sites(df, [1])


def warnings_of(action):
    """What a job warns of; the warning comes from a thread that waits for the job."""
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        action()
        for _ in range(60):
            if any("sites not found" in str(w.message) for w in caught):
                break
            time.sleep(0.03)
    return [str(w.message) for w in caught if "sites not found" in str(w.message)]


@pytest.mark.parametrize("stored", [True, False])
def test_positivity_warns_of_sites_without_rows(spark, tmp_path, stored):
    """With the table's defaults, once the caller's own job has run, and without another job."""
    rows = [("u1", "a", D(2018, 6, 1), True), ("u2", "b", D(2018, 6, 1), False)]
    df = spark.createDataFrame(rows, "unique_id string, site_name string, service_date date, flu boolean")
    if stored:
        df.write.parquet(str(tmp_path / "cases"))
        df = spark.read.parquet(str(tmp_path / "cases"))
    dates = ReportDates(D(2018, 6, 17))

    def run(site):
        table = positivity.positivity_table(df, {"flu": "Influenza"}, dates, site=site)
        tracker = spark.sparkContext.statusTracker()
        group = f"site-{site}-{stored}"
        spark.sparkContext.setJobGroup(group, "site")
        found.append((table.collect(), len(tracker.getJobIdsForGroup(group))))

    found = []
    assert warnings_of(lambda: run(["a", "zzz", "yyy"])) == ["sites not found: yyy, zzz; they have no rows"]
    assert warnings_of(lambda: run("nowhere")) == ["sites not found: nowhere; they have no rows"]
    assert warnings_of(lambda: run(["a", "b"])) == []
    assert warnings_of(lambda: run("all")) == []
    spark.sparkContext.setJobGroup("rest", "rest")
    assert sum(r["n_tested"] for r in found[1][0]) == 0 < sum(r["n_tested"] for r in found[0][0])
    assert found[0][1] <= found[3][1]        # no more jobs than without a list of sites


def test_sorted_nulls_last(spark):
    df = spark.createDataFrame(
        [(None, "Q", D(2018, 1, 1), 1), ("h", None, D(2018, 1, 1), 2), ("h", "Q", None, 3),
         ("h", "Q", D(2018, 1, 1), 4)],
        "site_type string, site_department string, service_date date, unique_id int")
    assert [r["unique_id"] for r in case_ops.sort_cases(df).collect()] == [4, 3, 2, 1]


# --- positivity --------------------------------------------------------------------------

LABELS = {"flu": "Influenza", "rsv": "RSV"}
CASES = ("unique_id int, service_date date, epi_year int, epi_week int, site_type string, "
         "site_name string, site_department string, flu boolean, rsv boolean, extra boolean")


def case_rows(spark, rows):
    return spark.createDataFrame(rows, CASES)


def sample(spark):
    rows = []
    days = [D(2018, 5, 1), D(2018, 6, 1), D(2018, 7, 1), D(2018, 4, 30), None]
    flags = list(itertools.product((None, False, True), repeat=2))
    for i, (day, (flu, rsv)) in enumerate(itertools.product(days, flags)):
        site = "A" if i % 3 else "B"
        rows.append((i, day, 2018, 1 + i % 9, "hospital", site, "SR", flu, rsv, True))
    return case_rows(spark, rows)


def brute_positivity(rows, by):
    inside = {
        "this_month": lambda d: d is not None and D(2018, 6, 1) <= d <= D(2018, 7, 1),
        "last_month": lambda d: d is not None and D(2018, 5, 1) <= d <= D(2018, 6, 1),
        "all_time": lambda d: True}
    out = {}
    for key in {tuple(r[b] for b in by) for r in rows}:
        for period, code in itertools.product(inside, LABELS):
            results = [r[code] for r in rows if tuple(r[b] for b in by) == key
                       and inside[period](r["service_date"]) and r[code] is not None]
            out[(*key, period, code)] = (len(results), sum(results))
    return out


@pytest.mark.parametrize("by", [(), ("site_name",)])
@pytest.mark.parametrize("through_cube", [False, True])
def test_positivity_counts(spark, by, through_cube):
    df = sample(spark)
    if through_cube:
        daily = cube.daily_cube(df, list(LABELS), ["site_name"])
        table = positivity.positivity_from_cube(daily, LABELS, DATES, by=by)
    else:
        table = positivity.positivity_table(df, LABELS, DATES, by=by)
    got = {(*[r[b] for b in by], r["group"], r["etiology"]): (r["n_tested"], r["n_positive"])
           for r in table.collect()}
    assert got == brute_positivity(df.collect(), by)
    assert all(positive <= tested for tested, positive in got.values())


def test_positivity_of_no_cases_is_a_table_of_zeros(spark):
    table = positivity.positivity_table(sample(spark), LABELS, DATES, site="none such").collect()
    assert len(table) == 6
    assert {(r["n_tested"], r["n_positive"], r["percent_positive"]) for r in table} == {(0, 0, 0.0)}


def test_listed_groups_appear_without_cases(spark):
    table = positivity.positivity_table(
        sample(spark), LABELS, DATES, by=["site_name"], groups=[("A",), ("Z",)])
    sizes = {r["site_name"]: r["count"] for r in table.groupBy("site_name").count().collect()}
    assert sizes == {"A": 6, "B": 6, "Z": 6}
    assert table.where("site_name = 'Z' and n_tested = 0 and percent_positive = 0").count() == 6
    weeks = corridor.endemic_corridor(
        sample(spark), DATES, by=["site_name"], groups=[("Z",)]).current
    assert weeks.where("site_name = 'Z' and casos is null").count() == 52


def test_percentages_round_ties_to_even(spark):
    rows = [(i, D(2018, 6, 5), 2018, 1, "hospital", "A", "SR", i < 1, i < 3, True) for i in range(8)]
    table = positivity.positivity_table(case_rows(spark, rows), LABELS, DATES)
    got = {r["etiology"]: r["percent_positive"] for r in table.collect()}
    assert got == {"flu": 12.0, "rsv": 38.0}      # 12.5 and 37.5


def test_positivity_text(spark):
    rows = [(i, D(2018, 6, 5), 2018, 1, "hospital", "A", "SR", i < 1, None, True) for i in range(8)]
    table = positivity.positivity_table(case_rows(spark, rows), LABELS, DATES)
    text = positivity.positivity_text(table, headings=DATES.period_headings())
    assert text.columns == ["ord", "etiologia", "Mes más reciente (junio) (n, %)",
                            "Mes anterior (mayo) (n, %)", "Histórico (n, %)"]
    assert ask(text) == [(1, "Influenza", "1 / 8 (12)", "0 / 0 (0)", "1 / 8 (12)"),
                         (2, "RSV", "0 / 0 (0)", "0 / 0 (0)", "0 / 0 (0)")]


def test_flags_are_checked(spark):
    with pytest.raises(ValueError, match="not found"):
        require_flags(sample(spark), ["flu", "nothing"])
    with pytest.raises(ValueError, match="not boolean"):
        corridor.positive_for_all(sample(spark), ["epi_week"])


# --- corridor ----------------------------------------------------------------------------

def weekly(spark, counts):
    """Cases from {(site, year, week): n}."""
    rows, i = [], 0
    for (site, year, week), n in counts.items():
        for _ in range(n):
            rows.append((i, D(year, 1, 1), year, week, "hospital", site, "SR", True, i % 2 == 0, True))
            i += 1
    return case_rows(spark, rows)


COUNTS = {("A", 2015, 1): 2, ("A", 2016, 1): 4, ("A", 2017, 1): 9, ("A", 2016, 7): 5,
          ("A", 2016, 53): 1, ("A", 2018, 3): 6, ("A", 2010, 1): 50, ("B", 2017, 2): 3}


def test_corridor_uses_only_weeks_with_cases(spark):
    tables = corridor.endemic_corridor(
        weekly(spark, COUNTS), DATES, by=["site_name"], previous_years=7, ylim=40)
    current = {(r["site_name"], r["epi_week"]): r["casos"] for r in tables.current.collect()}
    assert len(current) == 104                      # 52 weeks for both sites
    assert current[("A", 3)] == 6
    assert {v for k, v in current.items() if k != ("A", 3)} == {None}
    limits = {(r["site_name"], r["epi_week"], r["zona"]): r["quantile"]
              for r in tables.range.collect()}
    assert limits[("A", 1, "min")] == 2 and limits[("A", 1, "max")] == 9
    assert limits[("A", 7, "min")] == limits[("A", 7, "max")] == 5
    assert ("A", 3, "min") not in limits

    polygon = tables.polygons.orderBy("site_name", "zone_order", "point_order").collect()
    assert len(polygon) == 2 * 4 * 55
    a = [r for r in polygon if r["site_name"] == "A"]
    for zone in corridor.ZONES:
        points = [r for r in a if r["zona"] == zone]
        assert [p["epi_week"] for p in points] == [1, *range(1, 54), 53]
        assert points[0]["quantile"] == points[-1]["quantile"] == 0.0
    value = {(r["zona"], r["epi_week"]): r["quantile"] for r in a if 1 <= r["point_order"] <= 53}
    assert [value[(z, 1)] for z in corridor.ZONES] == [40.0, 6.5, 4.0, 3.0]
    assert [value[(z, 2)] for z in corridor.ZONES] == [40.0, 0.0, 0.0, 0.0]
    assert [value[(z, 53)] for z in corridor.ZONES] == [40.0, 1.0, 1.0, 1.0]


def test_current_year_reaches_week_53_only_if_seen(spark):
    for week, last in ((5, 52), (53, 53)):
        counts = corridor.weekly_counts(weekly(spark, {("A", 2018, week): 1}))
        assert corridor.corridor_current(counts, 2018).count() == last


def test_no_cases_still_give_52_empty_weeks_and_no_zones(spark):
    tables = corridor.endemic_corridor(weekly(spark, COUNTS), DATES, site="none such")
    assert ask(tables.current.select("casos").distinct()) == [(None,)]
    assert tables.current.count() == 52
    assert tables.range.count() == tables.polygons.count() == 0


def test_quantiles_are_ordered_and_counts_roll_up(spark):
    by_site = corridor.weekly_counts(weekly(spark, COUNTS), ["site_name"])
    rows = corridor.history_quantiles(by_site, 2018, 7).collect()
    assert {r["epi_week"] for r in rows} == {1, 2, 7, 53}
    for r in rows:
        assert r["min"] <= r["q1"] <= r["q2"] <= r["q3"] <= r["max"]


def test_quantiles_equal_linear_interpolation(spark):
    draw = random.Random(5)
    counts = {("A", year, week): draw.randint(1, 9)
              for year in range(2011, 2018) for week in range(1, 54) if draw.random() < 0.7}
    rows = corridor.history_quantiles(
        corridor.weekly_counts(weekly(spark, counts)), 2018, 7).collect()
    assert len(rows) == len({week for _, _, week in counts})
    for r in rows:
        seen = [n for (_, _, week), n in counts.items() if week == r["epi_week"]]
        assert [r[c] for c in ("min", "q1", "q2", "q3", "max")] == pytest.approx(
            list(np.percentile(seen, [0, 25, 50, 75, 100])))


def test_deduplication_against_a_loop(spark):
    draw = random.Random(9)
    rows = [(draw.choice([None, None, None, *"abcdefgh"]), draw.choice([None, 1, 2, 3]), i,
             draw.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, day int, id int, good boolean").repartition(7)
    got = {r["id"] for r in case_ops.keep_first_seen(
        df, ["k"], ["day", "id"], also=F.col("good")).collect()}
    first = {}
    for row in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        first.setdefault(row[0], row)
    assert got == {r[2] for r in first.values() if r[3]}


def test_etiologies_are_combined_with_and(spark):
    both = corridor.endemic_corridor(weekly(spark, COUNTS), DATES, etiologies=["flu", "rsv"])
    assert both.current.where("epi_week = 3").first()["casos"] == 3


def test_clamping(spark):
    df = spark.createDataFrame([(-1.0,), (5.0,), (50.0,), (None,), (float("inf"),)], "v double")
    assert [r[0] for r in corridor.clamped(df, "v", 40).collect()] == [
        0.0, 5.0, 40.0, None, float("inf")]


# --- curve, series ---------------------------------------------------------------------

def test_curve_grid_has_all_observed_combinations(spark):
    rows = [(1, None, 2017, 3, "hospital", "A", "SR", True, None, True),
            (2, None, 2018, 5, "hospital", "A", "ZZ", True, True, True),
            (3, None, 2018, 9, "hospital", "A", None, False, True, True),
            (4, None, 2016, 1, "clinic", "A", "SR", True, True, True),
            (5, None, None, 1, "hospital", "A", "SR", True, True, True),
            (6, None, 2012, 1, "hospital", "A", "SR", False, False, True)]
    got = ask(curve.epidemic_curve(case_rows(spark, rows), LABELS, "hospital")
              .select("site_department", "etiology", "epi_year", "epi_week", "n"))
    assert len(got) == len(set(got)) == 3 * 2 * 2 * 3
    assert {r for r in got if r[4]} == {
        ("Santa Rosa", "Influenza", 2017, 3, 1), ("ZZ", "Influenza", 2018, 5, 1),
        ("ZZ", "RSV", 2018, 5, 1), (None, "RSV", 2018, 9, 1)}


def test_timeseries_null_without_cases_zero_without_results(spark):
    day = D(2018, 5, 9)
    rows = [(1, day, 2018, 1, "hospital", "H-Xela", "QU", None, True, True),
            (2, day, 2018, 1, "hospital", "H-Xela", "QU", None, True, True),
            (3, D(2018, 6, 9), 2018, 1, "hospital", "H-Cuilapa", "SR", True, None, True),
            (4, D(2018, 6, 10), 2018, 1, "hospital", "otro", "SR", True, None, True),
            (5, D(2018, 6, 9), 2018, 1, "centro de salud", "CS-NSR", "SR", True, True, True)]
    df = case_rows(spark, rows)
    sites = ["H-Cuilapa", "H-Xela", "otro"]
    wide = timeseries.case_timeseries(df, site_type="hospital", etiology="flu", sites=sites)
    with pytest.raises(Exception, match="without a heading: otro"):
        timeseries.case_timeseries(
            df, site_type="hospital", etiology="flu", sites=sites[:2]).collect()
    assert wide.columns == [
        "service_date", "Hospital de Cuilapa", "Hospital de Quetzaltenango", "otro"]
    assert ask(wide) == [(D(2018, 5, 1), None, 0, None), (D(2018, 6, 1), 1, None, 1)]
    long = timeseries.series_long(df, site_type="hospital", etiology="flu")
    assert {tuple(r) for r in long.collect()} == {
        ("Hospital de Quetzaltenango", D(2018, 5, 1), 0),
        ("Hospital de Cuilapa", D(2018, 6, 1), 1), ("otro", D(2018, 6, 1), 1)}
    assert timeseries.axis_limit(timeseries.period_counts(df, list(LABELS)), list(LABELS)) == 3


def test_axis_limit_of_nothing(spark):
    counts = timeseries.period_counts(case_rows(spark, []), ["flu"])
    assert timeseries.axis_limit(counts, ["flu"]) == 1


def test_unpivot_modes(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, True)], "id int, a boolean, b boolean")
    count = {m: unpivot_flags(df, ["a", "b"], ["id"], drop=m).count()
             for m in ("nothing", "null", "false")}
    assert count == {"nothing": 4, "null": 3, "false": 2}


# --- maps --------------------------------------------------------------------------------

def map_inputs(spark):
    cases = spark.createDataFrame([
        (1, 6, 601, "Uno", D(2018, 6, 1), True, True),
        (2, 6, 601, None, D(2018, 6, 15), True, None),
        (3, 6, 601, "Dos", D(2018, 3, 15), True, False),      # no coordinates
        (4, 9, 901, "Tres", D(2018, 4, 1), False, True),      # two coordinate rows
        (5, 9, 901, "Tres", D(2018, 3, 14), True, True),      # a day too early
        (6, 5, 601, "Uno", D(2018, 6, 1), True, True),        # unknown department
        (7, 6, 601, "Nada", D(2018, 6, 1), True, True),       # place not listed
        (8, 6, 601, "Sin", D(2018, 6, 1), True, True),        # place without code
    ], "unique_id int, subject_department int, subject_municipality int, "
       "subject_community string, service_date date, flu boolean, rsv boolean")
    locations = spark.createDataFrame(
        [(6, 601, "Uno", 1), (6, 601, None, 2), (6, 601, "Dos", 3), (9, 901, "Tres", 4),
         (6, 601, "Sin", None)],
        "subject_department int, subject_municipality int, subject_community string, "
        "community_code int")
    communities = spark.createDataFrame(
        [(1, -90.1, 14.1), (2, -90.2, 14.2), (4, -91.0, 14.8), (4, -91.1, 14.9), (3, None, 14.3)],
        "`group` int, long double, lat double")
    return cases, locations, communities


def points(spark, department, **kwargs):
    cases, locations, communities = map_inputs(spark)
    return maps.case_map_points(cases, locations, communities, LABELS, DATES,
                                department=department, months=3, keep=["unique_id"], **kwargs)


def test_map_points(spark):
    rosa = points(spark, "Santa Rosa")
    assert {(r["unique_id"], r["etiology"], r["community_code"]) for r in rosa.collect()} == {
        (1, "Influenza", 1), (1, "RSV", 1), (2, "Influenza", 2)}
    both = points(spark, ["Santa Rosa", "Quetzaltenango"]).collect()
    assert len(both) == 5
    assert {r["label"] for r in both if r["unique_id"] == 2} == {"Influenza</br>2018-06-15"}
    labels = {(r["subject_community"], r["n"]) for r in maps.community_labels(rosa).collect()}
    assert labels == {("Uno", 2), (None, 1)}


def test_undetected_lists_all_labels_only_if_nothing_was_found(spark):
    assert maps.undetected(points(spark, "Santa Rosa"), LABELS).count() == 0
    assert ask(maps.undetected(points(spark, "Guatemala"), LABELS).orderBy("ord")) == [
        (1, "Influenza"), (2, "RSV")]


def test_undetected_by_department(spark):
    found = maps.undetected_by_department(
        points(spark, ["Santa Rosa", "Guatemala"]), LABELS, ["Guatemala", "Santa Rosa"])
    assert sorted(ask(found)) == [("Guatemala", 1, "Influenza"), ("Guatemala", 2, "RSV")]


def test_jitter_is_repeatable_independent_and_shaped(spark):
    base = spark.range(20000).selectExpr("id", "cast(id as double) as long", "1.0D as lat")
    moved = maps.jitter(base, ["id"], seed=3)
    stats = moved.select((F.col("long_offset") - F.col("long")).alias("a"),
                         (F.col("lat_offset") - F.col("lat")).alias("b"))
    row = stats.agg(F.avg("a"), F.stddev("a"), F.avg("b"), F.stddev("b"), F.corr("a", "b")).first()
    assert row[0] == pytest.approx(5e-4, abs=2e-5) and row[2] == pytest.approx(5e-4, abs=2e-5)
    assert row[1] == pytest.approx(5e-4, rel=0.05) and row[3] == pytest.approx(5e-4, rel=0.05)
    assert abs(row[4]) < 0.05
    again = maps.jitter(base.repartition(7), ["id"], seed=3)
    assert again.exceptAll(moved).count() == 0


def test_bounds(spark):
    outline = spark.createDataFrame(
        [("R", -90.0, 14.0), ("R", -89.0, 15.0), ("S", 0.0, 0.0)], "region string, long double, lat double")
    row = maps.map_bounds(outline).where("region = 'R'").first()
    assert tuple(row)[1:] == pytest.approx(
        (15.005, -90.0, 13.995, -89.0, 14.945, -89.99, 14.055, -89.01))


def test_tile_bins_keep_all_points_at_every_zoom(spark):
    df = spark.createDataFrame(
        [(-90.5, 14.6), (-90.5001, 14.6001), (-91.5, 14.8), (180.0, 89.9), (-180.0, -89.9), (None, 1.0)],
        "long double, lat double")
    bins = maps.tile_bins(df, [0, 3, 12])
    total = {r["zoom"]: r["n"] for r in bins.groupBy("zoom").agg(F.sum("n").alias("n")).collect()}
    assert total == {0: 5, 3: 5, 12: 5}
    assert bins.where("zoom = 12").count() == 4
    edge = bins.where("zoom = 3").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert tuple(edge) == (0, 7, 0, 7)


# --- effort ------------------------------------------------------------------------------

SUBJECT = ("SubjectID binary, SASubjectID string, PDAInsertDate timestamp_ntz, SiteName string, "
           "NombreDepartamento string, NombreMunicipio string, catchment int, pacienteInscrito int")
ELIGIBLE = "SubjectID binary, elegibleRespira int, elegibleDiarrea int, elegibleFebril int"


def brute_effort(subjects, eligible, sites):
    """Row by row: filter, left join with repeated ids, three-valued flags, sums."""
    def both(*v):
        return False if False in v else (None if None in v else True)

    def either(*v):
        return True if True in v else (None if None in v else False)

    groups = {}
    for sid, sa, inserted, site, dep, muni, catchment, consent in subjects:
        if site not in sites or not (
                catchment == 1 or (site == "CS-SM" and muni == "SAN MARTIN SACATEPEQUEZ")):
            continue
        if not DATES.first_sunday <= inserted.date() <= DATES.last_friday:
            continue
        for flags in [e[1:] for e in eligible if e[0] == sid] or [(None, None, None)]:
            flags = [None if f is None else f == 1 for f in flags]
            enrolled = both(sa is not None, None if consent is None else consent == 1, either(*flags))
            groups.setdefault((dep.title(), site), []).append(
                [enrolled, *[both(f, enrolled) for f in flags]])
    return {k: (len(rows), *[None if None in c else sum(c) for c in zip(*rows)])
            for k, rows in groups.items()}


def test_effort_against_row_by_row(spark):
    ids = [bytes([i]) for i in range(1, 7)] + [None]
    when = [dt.datetime(2018, 5, 1), dt.datetime(2017, 6, 11), dt.datetime(2017, 6, 10, 23),
            dt.datetime(2018, 6, 15, 23), dt.datetime(2018, 6, 16)]
    subjects, n = [], 0
    for sid, site, consent in itertools.product(ids, ["CS-SM", "H-Xela", "Otro"], [None, 0, 1]):
        n += 1
        subjects.append((sid, None if n % 4 == 0 else "S", when[n % 5], site,
                         ["SANTA ROSA", "quetzaltenango"][n % 2],
                         ["SAN MARTIN SACATEPEQUEZ", "X"][n % 3 == 0], [None, 0, 1, 1][n % 4], consent))
    eligible = [(ids[0], 1, 0, 0), (ids[0], 0, 0, 0), (ids[1], None, 1, 0), (ids[2], None, 0, 0),
                (ids[3], 1, 1, 1), (ids[3], 1, 1, 1), (ids[6], 1, 0, None)]
    totals = effort.screening_effort(
        spark.createDataFrame(subjects, SUBJECT), spark.createDataFrame(eligible, ELIGIBLE), DATES,
        consent="pacienteInscrito")
    got = {(r["department"], r["site"]): tuple(r)[2:] for r in totals.collect()}
    assert got == brute_effort(subjects, eligible, ["CS-NSR", "H-Cuilapa", "H-Xela", "CS-SM"])

    clean = [s for s in subjects if s[7] is not None and s[0] in (ids[0], ids[3])]
    totals = effort.screening_effort(
        spark.createDataFrame(clean, SUBJECT), spark.createDataFrame(eligible, ELIGIBLE), DATES,
        consent="pacienteInscrito")
    got = {(r["department"], r["site"]): tuple(r)[2:] for r in totals.collect()}
    assert got == brute_effort(clean, eligible, ["H-Xela", "CS-SM"])
    assert any(v is not None and v > 0 for row in got.values() for v in row[1:])


def test_effort_table(spark):
    totals = spark.createDataFrame(
        [("Santa Rosa", "H", 8, 2, 1, 0, 2), ("Santa Rosa", "C", 3, 0, 0, 0, None)],
        "department string, site string, screened long, enrolled long, elegibleRespira long, "
        "elegibleDiarrea long, elegibleFebril long")
    headings = ["Santa Rosa (C)", "Santa Rosa (H)"]
    table = effort.effort_table(totals, headings)
    with pytest.raises(Exception, match="without a heading"):
        effort.effort_table(totals, headings[:1]).collect()
    assert table.columns == ["ord", "grupo", "Santa Rosa (C)", "Santa Rosa (H)"]
    assert [tuple(r)[1:] for r in table.collect()] == [
        ("Tamizados", "3", "8"), ("Elegibles e inscritos", "0 (0%)", "2 (25%)"),
        ("Síndrome respiratorio", "0 (NaN%)", "1 (50%)"),
        ("Síndrome diarreico", "0 (NaN%)", "0 (0%)"), ("Síndrome febril", "NA (NA%)", "2 (100%)")]


def test_recodes(spark):
    df = spark.createDataFrame([("SR",), ("ZZ",), (None,)], "c string")
    names = {"SR": "Santa Rosa", "QU": "Quetzaltenango"}
    c = F.col("c")
    assert ask(df.select(scalars.lookup(c, names), scalars.recode(c, names),
                         scalars.rank_in(c, ["QU", "SR"]))) == [
        ("Santa Rosa", "Santa Rosa", 2), (None, "ZZ", None), (None, None, None)]


def test_title_case(spark):
    df = spark.createDataFrame([("SAN josé-EL ÁNGEL",), (None,)], "t string")
    assert ask(df.select(scalars.title_case(F.col("t")))) == [("San José-El Ángel",), (None,)]


def test_ages(spark):
    df = spark.createDataFrame([(1, None, None), (1, -2, 40), (0, 3, -1), (None, 1, 1)],
                               "y int, m int, d int")
    age = scalars.approximate_age_days(F.col("y"), F.col("m"), F.col("d"))
    assert [r[0] for r in df.select(age).collect()] == [365, 405, 90, None]


def test_curve_has_labels_without_positives_and_departments_of_other_sites(spark):
    rows = [(1, None, 2017, 3, "hospital", "A", "SR", True, False, True),
            (2, None, 2017, 3, "clinic", "B", "QU", True, True, True)]
    got = ask(curve.epidemic_curve(case_rows(spark, rows), LABELS, "hospital")
              .select("site_department", "etiology", "epi_year", "epi_week", "n"))
    assert len(got) == 2 * len(LABELS) and sum(r[4] for r in got) == 1
