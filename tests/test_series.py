"""Series operators against plain-Python loops over series with gaps."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sentinela.operators import series as ops

D = dt.date
DAYS = [D(2024, 1, 1) + dt.timedelta(days=i) for i in (0, 1, 2, 4, 5, 9, 10)]
# Missing at the head, inside and at the tail; a NaN; a series of one point.
VALUES = {
    "a": [None, 2.0, float("nan"), 5.0, None, 1.0, None],
    "b": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0],
    "c": [None, None, None, None, None, None, None],
    "d": [None, None, 8.0, None, None, None, None],
}


def points(spark):
    rows = [(s, t, y) for s, ys in VALUES.items() for t, y in zip(DAYS, ys)]
    return spark.createDataFrame(rows, "s string, t date, y double")


def ok(y):
    return y is not None and not math.isnan(y)


def by_series(df, *columns):
    out = {}
    for r in df.orderBy("s", "t").collect():
        out.setdefault(r["s"], []).append(tuple(r[c] for c in columns))
    return out


@pytest.mark.parametrize("n", [2, 3, 20])
def test_rolling_mean(spark, n):
    got = by_series(ops.rolling_mean(points(spark), ["s"], n), "rolled")
    for s, ys in VALUES.items():
        for i, (value,) in enumerate(got[s]):
            window = [y for y in ys[max(0, i - n + 1):i + 1] if ok(y)]
            assert value == (pytest.approx(sum(window) / len(window)) if window else None)


def test_rolling_mean_of_one_is_the_series(spark):
    got = by_series(ops.rolling_mean(points(spark), ["s"], 1), "y", "rolled")
    assert all(str(y) == str(r) for rows in got.values() for y, r in rows)
    with pytest.raises(ValueError):
        ops.rolling_mean(points(spark), ["s"], 0)


SHARES = [(1, 4), (None, 5), (0, 0), (3, None), (0, 0), (0, 0), (0, 0), (2, 2), (5, 20)]


def share_points(spark):
    rows = [("x", D(2024, 1, 1) + dt.timedelta(days=i), n, d) for i, (n, d) in enumerate(SHARES)]
    return spark.createDataFrame(rows, "s string, t date, num long, den long")


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("wilson", [True, False])
def test_proportions(spark, n, wilson):
    rolled = by_series(ops.rolling_proportion(share_points(spark), ["s"], n), "rolled")["x"]
    bands = by_series(ops.proportion_band(share_points(spark), ["s"], n, wilson=wilson),
                      "rolled", "low", "high")["x"]
    for i in range(len(SHARES)):
        window = SHARES[max(0, i - n + 1):i + 1]
        num, den = sum(a or 0 for a, _ in window), sum(b or 0 for _, b in window)
        p = num / den if den else 0.0
        assert rolled[i][0] == pytest.approx(100 * p)
        if not den:
            expected = (0, 0, 0) if wilson else (0, -100, 100)
        elif p > 1:
            continue        # no interval exists for a share above one
        elif wilson:
            z = 2.0
            centre = (p + z * z / (2 * den)) / (1 + z * z / den)
            half = z / (1 + z * z / den) * math.sqrt(p * (1 - p) / den + z * z / (4 * den * den))
            expected = (100 * p, 100 * (centre - half), 100 * (centre + half))
        else:
            half = 2 * math.sqrt(p * (1 - p) / den)
            expected = (100 * p, 100 * (p - half), 100 * (p + half))
        assert bands[i] == pytest.approx(expected, abs=1e-9)


def test_rolling_band_skips_points_without_a_middle(spark):
    rows = [("x", DAYS[0], 1.0, 2.0, 3.0), ("x", DAYS[1], 9.0, None, 9.0),
            ("x", DAYS[2], None, 4.0, 8.0), ("x", DAYS[3], 5.0, None, 5.0)]
    df = spark.createDataFrame(rows, "s string, t date, low double, mid double, high double")
    got = by_series(ops.rolling_band(df, ["s"], 2), "rolled_low", "rolled_mid", "rolled_high")["x"]
    assert got == [(1.0, 2.0, 3.0), (1.0, 2.0, 3.0), (0.0, 4.0, 8.0), (0.0, 4.0, 8.0)]
    alone = by_series(ops.rolling_band(df, ["s"], 1), "rolled_mid")["x"]
    assert alone == [(2.0,), (None,), (4.0,), (None,)]


def test_rolling_error(spark):
    rows = [("x", DAYS[0], 2.0, 3.0), ("x", DAYS[1], None, 9.0), ("x", DAYS[2], 4.0, 4.0),
            ("x", DAYS[3], 6.0, None)]
    df = spark.createDataFrame(rows, "s string, t date, y double, error double")
    got = by_series(ops.rolling_error(df, ["s"], 3), "rolled", "low", "high")["x"]
    assert got[0] == (2.0, -4.0, 8.0) == got[1]
    assert got[2] == (3.0, 3.0 - 5.0, 3.0 + 5.0)
    assert got[3] == (5.0, 1.0, 9.0)


def test_rolling_error_of_one_keeps_nan(spark):
    rows = [("x", DAYS[0], float("nan"), 1.0), ("x", DAYS[1], None, 1.0), ("x", DAYS[2], 4.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, t date, y double, error double")
    got = by_series(ops.rolling_error(df, ["s"], 1), "rolled", "low", "high")["x"]
    assert all(math.isnan(v) for v in got[0])
    assert got[1:] == [(None, None, None), (4.0, 2.0, 6.0)]


def test_overview_and_limits(spark):
    overview = ops.series_overview(points(spark))
    got = {r["t"]: r["y"] for r in overview.collect()}
    for i, t in enumerate(DAYS):
        known = [ys[i] for ys in VALUES.values() if ok(ys[i])]
        assert got[t] == pytest.approx(sum(known) / len(known))
    lo, hi = min(got.values()), max(got.values())
    assert tuple(ops.overview_limits(overview).first()) == pytest.approx(
        (lo - 0.25 * (hi - lo), hi + 0.25 * (hi - lo)))
    assert tuple(ops.overview_limits(overview, log_scale=True).first()) == pytest.approx(
        (math.log10(lo), 1.25 * math.log10(hi)))
    logs = {r["t"]: r["y"] for r in ops.overview_on_log_scale(overview).collect()}
    assert logs == {t: pytest.approx(math.log10(y)) for t, y in got.items()}
    flat = spark.createDataFrame([(DAYS[0], 4.0), (DAYS[1], 4.0)], "t date, y double")
    assert tuple(ops.overview_limits(flat).first()) == (3.0, 5.0)


def fill_value(ys, i, mode):
    if ok(ys[i]):
        return ys[i]
    before = [j for j in range(i) if ok(ys[j])]
    after = [j for j in range(i + 1, len(ys)) if ok(ys[j])]
    if mode == "none":
        return 0.0
    if before and after:
        a, b = before[-1], after[0]
        share = (DAYS[i] - DAYS[a]).days / (DAYS[b] - DAYS[a]).days
        return ys[a] + (ys[b] - ys[a]) * share
    if mode == "all" and (before or after):
        return ys[before[-1]] if before else ys[after[0]]
    return 0.0


@pytest.mark.parametrize("mode", ["all", "inside", "none"])
def test_stacking(spark, mode):
    order = ["b", "a", "c", "d"]
    got = by_series(ops.stacked_series(points(spark), "s", order, fill=mode), "t", "y_stacked")
    for i, t in enumerate(DAYS):
        total = 0.0
        for s in reversed(order):
            total += fill_value(VALUES[s], i, mode)
            assert got[s][i] == (t, pytest.approx(total))
    with pytest.raises(ValueError):
        ops.stacked_series(points(spark), "s", order, fill="some")


def brute_cut(ys, low, high):
    first = next((i for i, t in enumerate(DAYS) if t >= low), None)
    last = next((i for i in reversed(range(len(DAYS))) if DAYS[i] <= high), None)
    if first is None:
        first = 0
    else:
        while first > 0:
            first -= 1
            if ys[first] is not None:
                break
    if last is None:
        last = len(DAYS) - 1
    else:
        while last < len(DAYS) - 1:
            last += 1
            if ys[last] is not None:
                break
    return DAYS[first:last + 1]


@pytest.mark.parametrize("low,high", [
    (D(2024, 1, 3), D(2024, 1, 6)), (D(2024, 1, 7), D(2024, 1, 8)), (D(2023, 1, 1), D(2023, 2, 1)),
    (D(2025, 1, 1), D(2025, 2, 1)), (D(2024, 1, 1), D(2024, 1, 11)), (D(2024, 1, 10), D(2024, 1, 11)),
    (D(2024, 1, 1), D(2024, 1, 1)), (D(2023, 1, 1), D(2025, 1, 1))])
def test_range_cut(spark, low, high):
    got = by_series(ops.range_cut(points(spark), ["s"], low, high), "t")
    for s, ys in VALUES.items():
        assert [t for (t,) in got[s]] == brute_cut(ys, low, high), s


def test_extremes(spark):
    got = {r["s"]: (r["y_min"], r["y_max"])
           for r in ops.series_extremes(points(spark), ["s"]).collect()}
    assert got == {"a": (1.0, 5.0), "b": (1.0, 7.0), "c": (None, None), "d": (8.0, 8.0)}


def test_log_domain(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (0.0, 1.0), (-1.0, 1.0), (2.0, 0.0), (None, 3.0)], "a double, b double")
    a, b = ops.log_domain_all(F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.select(ops.log_domain(F.col("a")), a, b).collect()]
    assert got == [(1.0, 1.0, 2.0), (None, None, None), (None, None, None), (2.0, None, None),
                   (None, None, None)]


def test_points_are_required(spark):
    raw = spark.createDataFrame([("x", dt.datetime(2024, 1, 1, 5), 1.0)], "s string, t timestamp_ntz, y double")
    with pytest.raises(ValueError, match="period points"):
        ops.rolling_mean(raw, ["s"], 3)
    weekly = ops.period_points(raw, ["s"], "t", "week", {"y": F.avg("y")})
    assert [tuple(r) for r in weekly.collect()] == [("x", D(2023, 12, 31), 1.0)]


def test_stacking_keeps_series_that_the_order_does_not_name(spark):
    rows = [(D(2020, 1, 1), "a", 1.0), (D(2020, 1, 1), "b", 5.0), (D(2020, 1, 1), None, 2.0)]
    df = spark.createDataFrame(rows, "t date, s string, y double")
    got = {r["s"]: (r["ord"], r["y_stacked"]) for r in ops.stacked_series(df, "s", ["b"]).collect()}
    assert got["b"] == (1, 8.0) and set(got) == {"a", "b", None}
    assert max(total for _, total in got.values()) == 8.0


@pytest.mark.parametrize("mode", ["all", "inside", "none"])
def test_stacking_carries_over_ranges_of_dates(spark, mode, monkeypatch):
    """Values months apart: what lies between is carried over whole ranges without any."""
    monkeypatch.setattr(ops, "RANGE_DAYS", 8)
    days = [D(2023, 11, 20) + dt.timedelta(3 * k) for k in range(60)]
    values = {"a": {0: 1.0, 59: 60.0}, "b": {20: 4.0, 21: 6.0, 45: 30.0}, "c": {k: float(k) for k in range(60)},
              "none": {}}
    rows = [(t, s, own.get(k)) for s, own in values.items() for k, t in enumerate(days)]
    df = spark.createDataFrame(rows, "t date, s string, y double")
    got = {(r["t"], r["s"]): r["y_stacked"] for r in ops.stacked_series(df, "s", list(values), fill=mode).collect()}
    assert len(got) == 240
    for k, t in enumerate(days):
        total = 0.0
        for s in reversed(values):
            own = values[s]
            low, high = max((i for i in own if i <= k), default=None), min((i for i in own if i >= k), default=None)
            if k in own:
                total += own[k]
            elif mode != "none" and low is not None and high is not None:
                total += own[low] + (own[high] - own[low]) * (k - low) / (high - low)
            elif mode == "all" and (low is not None or high is not None):
                total += own[high if low is None else low]
            assert got[t, s] == pytest.approx(total)


def test_stacking_of_fifty_thousand_series(spark):
    """A point or two of each; no row holds all names, no task dates times series."""
    n = 50_000
    df = spark.range(n).select(
        F.explode(F.array(F.lit(D(2020, 1, 1)), F.lit(D(2020, 1, 11)), F.lit(D(2020, 6, 1)))).alias("t"),
        F.format_string("s%05d", "id").alias("s"), F.col("id").alias("k"))
    df = df.select("t", "s", F.when((F.col("k") % 2 == 0) | (F.col("t") != D(2020, 1, 11)), 1.0).alias("y"))
    got = ops.stacked_series(df, "s", ["s00007"])
    tops = got.groupBy("t").agg(F.count("*").alias("n"), F.max("y_stacked").alias("top"),
                                F.max(F.when(F.col("s") == "s00007", F.col("y_stacked"))).alias("first"))
    rows = {r["t"]: (r["n"], r["top"], r["first"]) for r in tops.collect()}
    assert rows == {d: (n, float(n), float(n)) for d in (D(2020, 1, 1), D(2020, 1, 11), D(2020, 6, 1))}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(t") == 1        # the calendar, which is bounded
