import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentinela.functions import calendar as cal
from sentinela.functions.calendar import ReportDates

D = dt.date


def on(spark, day, *columns):
    df = spark.createDataFrame([(day,)], "d date")
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize("run,friday", [
    (D(2018, 6, 8), D(2018, 6, 1)),     # a Friday
    (D(2018, 6, 9), D(2018, 6, 1)),     # a Saturday
    (D(2018, 6, 10), D(2018, 6, 8)),    # a Sunday
    (D(2018, 6, 13), D(2018, 6, 8)),
])
def test_last_friday(spark, run, friday):
    assert ReportDates(run).last_friday == friday
    assert on(spark, run, cal.last_friday_of(F.col("d"))) == (friday,)


def test_literal_and_column_dates_agree(spark):
    days = [D(1999, 12, 20) + dt.timedelta(days=i) for i in range(0, 900)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    friday = cal.last_friday_of(F.col("d"))
    for row in df.select(
            "d", friday.alias("f"), cal.first_sunday_of(friday).alias("s"),
            F.trunc(friday, "month").alias("m"), cal.next_month_start(friday).alias("n"),
            F.add_months(friday, -3).alias("t")).collect():
        dates = ReportDates(row["d"])
        assert (dates.last_friday, dates.first_sunday, dates.this_month_start,
                dates.next_month_start, dates.trailing_start(3)) == (
            row["f"], row["s"], row["m"], row["n"], row["t"])


def test_week_floor_starts_on_sunday(spark):
    col = cal.floor_date(F.col("d"), "week")
    assert on(spark, D(2024, 1, 7), col) == (D(2024, 1, 7),)
    assert on(spark, D(2024, 1, 6), col) == (D(2023, 12, 31),)


def test_unknown_scale_is_rejected():
    with pytest.raises(ValueError):
        cal.scale_name("decade")
    assert cal.scale_name("week") == "Semana"


def test_epi_week_53(spark):
    year, week = cal.epi_year_week(F.col("d"))
    assert on(spark, D(2014, 12, 31), year, week) == (2014, 53)
    assert on(spark, D(2015, 1, 4), year, week) == (2015, 1)


def test_month_arithmetic_clamps(spark):
    inside = cal.in_trailing_months(F.col("d"), F.lit(D(2018, 5, 31)), 3)
    assert on(spark, D(2018, 2, 28), inside) == (True,)
    assert on(spark, D(2018, 2, 27), inside) == (False,)
    assert ReportDates(D(2018, 6, 3)).trailing_start(3) == D(2018, 3, 1)


def test_first_of_month_is_in_two_periods(spark):
    dates = ReportDates(D(2018, 6, 17))     # last Friday 2018-06-15

    def periods(day):
        flags = dates.periods(F.col("d"))
        return on(spark, day, *[flags[p] for p in ("this_month", "last_month", "all_time")])

    assert periods(D(2018, 6, 1)) == (True, True, True)
    assert periods(D(2018, 7, 1)) == (True, False, True)
    assert periods(D(2018, 6, 30)) == (True, False, True)
    assert periods(D(2018, 5, 1)) == (False, True, True)
    assert periods(D(2018, 4, 30)) == (False, False, True)
    assert periods(D(2018, 7, 2)) == (False, False, True)


def test_birth_dates(spark):
    def born(text):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(cal.parse_birth_date(F.col("t"))).first()[0]

    day = D(1990, 1, 5)
    assert born("1990-01-05") == born("1990/1/5") == born("19900105") == born(" 1990.01.05 ") == day
    for bad in ("sin dato", "1990", "1990-13-01", "1990-02-30", "", None, "05-01-1990"):
        assert born(bad) is None


def test_epoch_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(946684799.5,)], "s double")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert df.select(F.to_date(cal.from_epoch(F.col("s")))).first()[0] == D(1999, 12, 31)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_headings_and_captions():
    dates = ReportDates(D(2018, 1, 14))     # last Friday 2018-01-12
    assert dates.period_headings() == {
        "this_month": "Mes más reciente (enero) (n, %)",
        "last_month": "Mes anterior (diciembre) (n, %)",
        "all_time": "Histórico (n, %)"}
    assert dates.captions(7, 3) == {
        "history_years": "2011 a 2017", "map_dates": "2017-10-12 a 2018-01-12",
        "effort_dates": "2017-01-08 a 2018-01-12", "data_until": "2018-01-12"}


def test_spanish_month(spark):
    assert on(spark, D(2018, 9, 3), cal.spanish_month(F.col("d"))) == ("septiembre",)
