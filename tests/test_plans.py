"""What the physical plans may and may not contain, whatever the data size."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from sentinela.functions.calendar import from_epoch
from sentinela.operators import cases, effort, maps, reducers
from sentinela.plans import queries, tables
from sentinela.session import PARTITIONS, at_most_partitions, partitions_for, size_settings

SF = "/root/testdata/sf0.001"
# The refresh writes files; its parts are checked one by one.
LAZY = sorted(n for n in queries.QUERIES if not n.startswith("refresh_")
              and n not in ("weekly_refresh", "snapshot_roundtrip", "report_roundtrip"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_no_python_no_forced_broadcast(spark, no_broadcast, name):
    plan = plan_of(entry_module.queries()[name](spark, SF))
    for node in ("CartesianProduct", "NestedLoopJoin", "BroadcastHashJoin", "Python", "Pandas",
                 "ArrowEval", "Scan ExistingRDD"):
        assert node not in plan, f"{node} in the plan of {name}"


@pytest.mark.parametrize("name", ["first_seen_cases", "first_seen_null_ids", "respiratory_line_list"])
def test_deduplication_prunes_before_the_shuffle(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, SF))
    assert plan.count("WindowGroupLimit") == 2
    partial = plan.index("Partial")
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < partial


def test_bound_and_columns_reach_the_scan(spark):
    plan = plan_of(queries.bounded_view(spark, SF))
    assert "LessThanOrEqual(o_orderdate,2001-07-27" in plan
    assert "o_totalprice" not in plan


def test_report_dates_reach_the_scan_of_stored_tables(spark, tmp_path):
    rows = tables.effort_rows(spark, SF).withColumn(
        "PDAInsertDate", from_epoch(F.col("PDAInsertEpoch"))).drop("PDAInsertEpoch")
    rows.write.parquet(str(tmp_path / "effort"))
    stored = spark.read.parquet(str(tmp_path / "effort"))
    plan = plan_of(effort.screening_effort(
        stored, stored, tables.DATES, consent="pacienteInscrito", sites=tables.SITES, soft_catchment=tables.SOFT_CATCHMENT))
    assert "GreaterThanOrEqual(PDAInsertDate,2000-07-23" in plan
    tables.cases(spark, SF).write.parquet(str(tmp_path / "cases"))
    points = maps.case_map_points(
        spark.read.parquet(str(tmp_path / "cases")), queries.location_codes(spark, SF),
        tables.communities(spark, SF), tables.ETIOLOGIES, tables.DATES, department="Santa Rosa")
    plan = plan_of(points)
    assert "GreaterThanOrEqual(service_date,2000-07-27)" in plan
    assert "EqualTo(subject_department,6)" in plan or "In(subject_department, [6])" in plan


def test_map_joins_the_cases_once(spark, no_broadcast, tmp_path):
    """The place tables meet first; the cases are shuffled once and only for an inner join."""
    tables.cases(spark, SF).write.parquet(str(tmp_path / "cases"))
    for name, table in (("codes", queries.location_codes(spark, SF)),
                        ("communities", tables.communities(spark, SF))):
        table.write.parquet(str(tmp_path / name))
    read = [spark.read.parquet(str(tmp_path / n)) for n in ("cases", "codes", "communities")]
    plan = plan_of(maps.case_map_points(
        *read, tables.ETIOLOGIES, tables.DATES, department="Santa Rosa"))
    assert "LeftOuter" not in plan and plan.count("SortMergeJoin") == 2
    assert plan.count("Exchange hashpartitioning") == 4
    assert plan.count("unique_id") == 0     # pruned; the cases' columns are carried only once


def test_counts_read_only_their_columns(spark):
    plan = plan_of(queries.weekly_counts(spark, SF))
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan


def test_positivity_shuffles_counts_only(spark):
    plan = plan_of(queries.positivity_by_site(spark, SF))
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and plan.index("partial_count") > plan.index("Exchange")


def test_curve_reads_the_cases_once(spark):
    df = queries.epidemic_curve(spark, SF)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 3     # orders, customers and nations, once each
    assert "ReusedExchange" in final


def test_series_windows_only_see_aggregated_points(spark):
    """Below every window the raw events are aggregated, in each task before the shuffle."""
    for name in ("rolling_mean", "wilson_band", "stacked_series", "range_cut"):
        plan = plan_of(entry_module.queries()[name](spark, SF))
        assert plan.rindex("Window") < plan.rindex("Exchange hashpartitioning")
        assert plan.rindex("Exchange hashpartitioning") < plan.rindex("partial_")


def test_partitions_grow_with_the_input(spark):
    small, large = size_settings(10 ** 9), size_settings(100 * 10 ** 12)
    with partitions_for(spark, 20 * 10 ** 12):
        assert 70_000 < int(spark.conf.get(PARTITIONS)) < 80_000
    assert small[PARTITIONS] == "200" and 20_000 < int(large[PARTITIONS]) < 30_000
    with at_most_partitions(spark, 3):
        assert spark.conf.get(PARTITIONS) == "3"
    assert spark.conf.get(PARTITIONS, None) is None
    spark.conf.set(PARTITIONS, "5")
    try:
        with at_most_partitions(spark, 300):
            assert spark.conf.get(PARTITIONS) == "5"
        assert spark.conf.get(PARTITIONS) == "5"
    finally:
        spark.conf.unset(PARTITIONS)


@pytest.mark.parametrize("partitions", ["1", "3", "17"])
def test_partition_count_does_not_change_results(spark, partitions):
    names = ["first_seen_cases", "corridor_polygons", "screening_effort_counts", "stacked_series"]
    wanted = {n: sorted(map(str, entry_module.queries()[n](spark, SF).collect())) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n in names:
            assert sorted(map(str, entry_module.queries()[n](spark, SF).collect())) == wanted[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_third_of_all_rows_under_one_id(spark):
    """The hot id reaches the second stage as at most one row per input partition."""
    df = queries.first_seen_null_ids(spark, SF)
    hot = tables.read(spark, SF, "orders").where("o_orderkey % 3 = 0").count()
    assert hot * 3 >= tables.read(spark, SF, "orders").count()
    assert df.where("subject_id is null").count() == 1


def test_eligibility_is_cut_before_its_exchange(spark, no_broadcast):
    """The bitmap is a value of the plan, tested where the eligibility is read."""
    plan = plan_of(queries.screening_effort_counts(spark, SF))
    assert "BroadcastHashJoin" not in plan
    lines = plan.splitlines()
    cut = next(k for k, line in enumerate(lines) if "Filter" in line and "subquery" in line.lower())
    assert "xxhash64" in lines[cut]
    above = [line for line in lines[:cut] if "partial_count" in line or "Exchange" in line]
    # Nothing has been shuffled yet: the nearest step above that moves rows is an exchange.
    assert "Exchange hashpartitioning" in above[-1]


def test_bitmap_keeps_all_keys_and_few_others(spark):
    rows, keys = spark.range(100_000), spark.range(0, 100_000, 50).withColumnRenamed("id", "k")
    kept = reducers.reduce_to(rows, F.col("id"), keys, "k")
    assert kept.where("id % 50 = 0").count() == 2000
    assert kept.count() < 2200
    tiny = reducers.reduce_to(rows, F.col("id"), keys, "k", bits=64)       # full: nothing is cut
    assert tiny.count() == 100_000
    assert reducers.reduce_to(rows, F.col("id"), keys.limit(0), "k").count() == 0


def test_site_filter_with_its_warning_reaches_the_scan(spark, tmp_path):
    tables.cases(spark, SF).write.parquet(str(tmp_path / "cases"))
    kept = cases.at_sites(spark.read.parquet(str(tmp_path / "cases")), ["5 - LOW"])
    plan = plan_of(kept.groupBy("site_name").count())
    assert "PushedFilters: [IsNotNull(site_name), EqualTo(site_name,5 - LOW)" in plan \
        or "In(site_name, [5 - LOW])" in plan
    assert "ReadSchema: struct<site_name:string>" in plan
