"""Views, snapshots, sinks and the weekly refresh."""

import datetime as dt
import os
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from oracle_check import as_rows, database
from sentinela.plans import refresh, sample, tables, weekly
from sentinela.plans.oracles import ORACLES
from sentinela.sources import snapshots, views
from sentinela.syndromes import ACTIVE_SITES

D = dt.date


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="sentinela-test-")


def inserted(spark):
    return spark.createDataFrame([
        (1, dt.datetime(2018, 6, 14, 10)), (2, dt.datetime(2018, 6, 15)),
        (3, dt.datetime(2018, 6, 15, 0, 0, 1)), (4, None)], "id int, PDAInsertDate timestamp_ntz")


def test_bound_is_the_start_of_the_day(spark):
    got = views.query_view(inserted(spark), ["id"], D(2018, 6, 15))
    assert sorted(r["id"] for r in got.collect()) == [1, 2]


def test_missing_columns_fail_before_a_job(spark):
    with pytest.raises(ValueError, match="nope"):
        views.query_view(inserted(spark), ["id", "nope"], D(2018, 6, 15))


def test_columns_are_named_as_asked_and_not_repeated(spark):
    got = views.select_columns(inserted(spark), ["ID", "pdainsertdate", "ID"])
    assert got.columns == ["ID", "pdainsertdate"]


def test_first_of_repeated_columns_wins(spark):
    df = inserted(spark).select("id", F.lit(9).alias("x"), F.lit("later").alias("id"))
    got = views.drop_repeated_columns(df)
    assert got.columns == ["id", "x"]
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4]


def test_sources_open(spark, folder):
    path = f"{folder}/v"
    inserted(spark).write.parquet(path)
    inserted(spark).createOrReplaceTempView("inserted_view")
    for source in (path, "inserted_view", {"format": "parquet", "path": path}, inserted(spark)):
        assert views.open_source(spark, source).count() == 4


def test_jdbc_reads_are_partitioned():
    source = views.jdbc_source(
        "jdbc:sqlserver://host", "Clinicos.Basica_Respira", partition_column="PDAInsertDate",
        lower=D(2007, 1, 1), upper=D(2018, 1, 1), partitions=64, user="u")
    assert source["format"] == "jdbc" and source["numPartitions"] == "64"
    assert (source["lowerBound"], source["upperBound"]) == ("2007-01-01", "2018-01-01")


def test_every_view_lists_its_columns():
    columns = views.group_columns("flag")
    assert set(columns) == set(views.GROUP_VIEWS)
    assert "flag" in columns["subject"]
    # Every group with patient rows can be joined on the subject.
    assert all(c[0] == "SubjectID" for g, c in columns.items() if g != "sites")
    for _, wanted in views.SYNDROME_VIEWS.values():
        assert wanted is None or len(wanted) == len(set(wanted))


def test_snapshot_is_built_once(spark, folder):
    store = snapshots.Snapshots(spark, folder, D(2018, 6, 15))
    calls = []

    def build():
        calls.append(1)
        return inserted(spark)

    assert store.get("x", build).count() == store.get("x", build).count() == 4
    assert len(calls) == 1
    assert os.path.exists(f"{folder}/as_of=2018-06-15/x/_SUCCESS")
    with pytest.raises(FileExistsError):
        store.write("x", inserted(spark))
    undated = snapshots.Snapshots(spark, folder, None)
    assert undated.get("places", build).count() == 4 and os.path.exists(f"{folder}/places/_SUCCESS")


def test_unfinished_snapshot_is_written_again(spark, folder):
    store = snapshots.Snapshots(spark, folder, D(2018, 6, 15))
    inserted(spark).limit(1).write.parquet(store.path("x"))
    os.remove(f"{store.path('x')}/_SUCCESS")
    assert store.get("x", lambda: inserted(spark)).count() == 4


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get(snapshots.CHECKPOINT_SETTING)
    assert snapshots.shared_folder(spark) == folder
    assert snapshots.new_folder(spark, "a").startswith(folder)
    assert snapshots.new_folder(spark, "a") != snapshots.new_folder(spark, "a")


def unset_session(master):
    conf = SimpleNamespace(get=lambda name, default=None: default)
    context = SimpleNamespace(master=master, getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_only_a_local_session_may_use_a_temporary_folder():
    assert os.path.isdir(snapshots.shared_folder(unset_session("local[2]")))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        snapshots.shared_folder(unset_session("yarn"))


@pytest.mark.parametrize("file_format", ["parquet", "csv", "json", "orc"])
def test_report_formats(spark, folder, file_format):
    path = f"{folder}/out"
    table = spark.createDataFrame([(1, "Éxito")], "id int, zona string")
    snapshots.write_report(table, path, file_format)
    reader = spark.read.option("header", True).option("inferSchema", True)
    assert [(r["id"], r["zona"]) for r in reader.format(file_format).load(path).collect()] == [
        (1, "Éxito")]
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.write_report(table, path, file_format)


def test_refresh_resumes_without_reading_the_sources(spark, folder):
    sf = "/root/testdata/sf0.001"
    sources = sample.sample_sources(spark, sf)
    first = refresh.run_refresh(spark, sources, folder, tables.DATES, sample.SETTINGS)
    sizes = {name: t.count() for name, t in first.items()}
    assert sizes["respiratory_corridor_current"] == 52 * len(tables.SITES)
    assert sizes["screening_effort_text"] == 5 * sizes["screening_effort"]

    # Lose one table: only that one is built again, and nothing else is touched.
    week = f"{folder}/as_of={tables.DATES.last_friday}"
    os.remove(f"{week}/diarrheal_corridor_range/_SUCCESS")
    before = {n: os.path.getmtime(f"{week}/{n}/_SUCCESS") for n in os.listdir(week)
              if n != "diarrheal_corridor_range"}
    assert set(before) <= set(first)
    gone = refresh.Sources(
        views={v: "no_such_table" for v in sources.views},
        groups=sources.groups, syndromes=sources.syndromes,
        locations="no_such_table", communities=sources.communities,
        departments="no_such_table")
    again = refresh.run_refresh(spark, gone, folder, tables.DATES, sample.SETTINGS)
    assert {name: t.count() for name, t in again.items()} == sizes
    assert {n: os.path.getmtime(f"{week}/{n}/_SUCCESS") for n in before} == before


def catalog_views(spark, sf):
    """The views under their catalog names with all listed columns, unused ones empty."""
    wanted = views.group_columns("inscrito")
    subject = {c: tables.EFFORT[c] for c in ("NombreDepartamento", "NombreMunicipio", "catchment")}
    contents = {"Clinicos.Basica_Respira": tables.RESPIRATORY | subject | {
                    "inscrito": tables.EFFORT["pacienteInscrito"]},
                "Clinicos.Basica_Diarrea": tables.DIARRHEAL,
                "Clinicos.Basica_Febril": tables.FEBRILE}
    for schema in ("Clinicos", "Control", "LegalValue"):
        spark.sql(f"create database if not exists {schema}")
    for name, columns in contents.items():
        needed = [c for group, view in views.GROUP_VIEWS.items() if view == name for c in wanted[group]]
        needed += [c for view, listed in views.SYNDROME_VIEWS.values() if view == name
                   for c in listed or []]
        df = tables.raw_view(spark, sf, columns)
        present = {c.lower() for c in df.columns}
        missing = dict.fromkeys(c for c in needed if c.lower() not in present)
        df = df.withColumns({c: F.lit(None).cast("int") for c in missing})
        df.write.mode("overwrite").saveAsTable(name)
    sites = spark.createDataFrame([("x",) * len(views.SITE_COLUMNS)], views.SITE_COLUMNS)
    sites.write.mode("overwrite").saveAsTable(views.GROUP_VIEWS["sites"])
    tables.location_codes(spark, sf).write.mode("overwrite").saveAsTable(views.LOCATION_VIEW)

def test_refresh_of_catalog_views(spark, folder):
    """The listed columns of every view, found by name, give the checked positivity."""
    sf = "/root/testdata/sf0.001"
    catalog_views(spark, sf)
    sources = refresh.default_sources(
        tables.communities(spark, sf), tables.department_outlines(spark, sf))
    settings = refresh.Settings(
        sites=tuple(tables.SITES), hospitals=tuple(tables.HOSPITALS),
        soft_catchment=tables.SOFT_CATCHMENT, consent="inscrito",
        previous_years=tables.PREVIOUS_YEARS)
    stored = refresh.run_refresh(spark, sources, folder, tables.DATES, settings)
    assert set(stored["group_subject"].columns) == set(views.group_columns("inscrito")["subject"])
    # One stored table, and so one scan, per view; the view no report needs is not read.
    assert {n for n in os.listdir(f"{folder}/as_of=2001-07-27") if n.startswith("source_")} == {
        f"source_Clinicos.Basica_{v}" for v in ("Respira", "Diarrea", "Febril")}
    points = stored["respiratory_map_points"]
    assert {"unique_id", "long_offset", "lat_offset"} <= set(points.columns)
    shown = stored["febrile_corridor_polygons"]
    assert shown.where("shown > 30 or shown < 0").count() == 0
    monthly = stored["diarrheal_monthly"]
    assert {"site", "department"} <= set(monthly.columns)
    limits = stored["diarrheal_axis"].first()
    assert limits["axis_limit"] == limits["max_cases"] + 1
    assert stored["febrile_positivity_text"].count() * 3 == stored["febrile_positivity"].count()
    assert stored["captions"].count() == 7
    assert set(stored["view_diarrheal"].columns) == set(views.SYNDROME_VIEWS["diarrheal"][1])
    positivity = refresh.stored_positivity(stored)
    found = as_rows(positivity.columns, positivity.collect())
    result = database(sf).execute(ORACLES["weekly_refresh"])
    assert found == as_rows([d[0] for d in result.description], result.fetchall())

    refresh.export_reports(stored, f"{folder}/export", "csv")
    back = spark.read.option("header", True).csv(f"{folder}/export/febrile_corridor_current")
    assert back.count() == 52 * len(tables.SITES)


def test_command_line():
    options = weekly.arguments([
        "--run-date", "2018-06-17", "--root", "r", "--communities", "a/c", "--departments", "a/d",
        "--consent", "inscrito"])
    assert options.run_date == D(2018, 6, 17) and options.consent == "inscrito"


def test_command_line_runs_even_without_a_single_case(spark, folder):
    """The default sites do not occur in the test views: zeros and empty weeks for all of them."""
    sf = "/root/testdata/sf0.001"
    catalog_views(spark, sf)
    tables.communities(spark, sf).write.parquet(f"{folder}/communities")
    tables.department_outlines(spark, sf).write.parquet(f"{folder}/departments")
    weekly.main([
        "--run-date", "2001-07-29", "--root", f"{folder}/root", "--consent", "inscrito",
        "--communities", f"{folder}/communities", "--departments", f"{folder}/departments",
        "--export", f"{folder}/export", "--format", "parquet"])
    week = f"{folder}/root/as_of=2001-07-27"
    assert spark.read.parquet(f"{week}/source_Clinicos.Basica_Febril").count() > 0
    unknown = spark.read.parquet(f"{week}/respiratory_unknown_sites").collect()
    assert sorted(r["site_name"] for r in unknown) == sorted(ACTIVE_SITES)
    assert spark.read.parquet(f"{week}/febrile_map_undetected").count() > 0
    for name in ("cases", "daily", "corridor_polygons", "map_points"):
        assert spark.read.parquet(f"{week}/respiratory_{name}").count() == 0
    zeros = spark.read.parquet(f"{week}/diarrheal_positivity")
    assert zeros.count() == 6 * 3 * 12 and zeros.agg(F.sum("n_tested")).first()[0] == 0
    weeks = spark.read.parquet(f"{week}/diarrheal_corridor_current")
    assert weeks.count() == 6 * 52 and weeks.where("casos is not null").count() == 0
    assert spark.read.parquet(f"{folder}/export/map_bounds").count() == 3
    assert spark.read.parquet(f"{folder}/export/diarrheal_axis").first()["axis_limit"] == 1
