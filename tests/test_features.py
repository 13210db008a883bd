"""Islands, frost windows, station features (FIXTURES 2.5 / 2.6 goldens) and brute-force checks."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cropframe.operators import features as FE
from cropframe.operators import integrate

# Station normals sample (FIXTURES 2.6): (station, day-of-month, month, tmin, tmax, prcp), year 2010.
_S1, _S2 = "GHCND:USC00327027", "GHCND:USC00117000"
STATION_ROWS = (
    [(_S1, d, 1, t, x, p) for d, t, x, p in zip(range(1, 8), [-33, -35, -36, -37, -37, -38, -38],
                                                [145, 144, 143, 142, 142, 142, 143], [2, 4, 2, 3, 5, 2, 1])]
    + [(_S2, d, 1, t, x, p) for d, t, x, p in zip(range(1, 8), [-94, -93, -92, -92, -91, -91, -90],
                                                  [31, 31, 32, 32, 33, 33, 34], [69, 68, 67, 66, 65, 64, 63])]
    + [(_S1, d, 7, t, x, p) for d, t, x, p in zip(range(1, 8), [110, 112, 115, 118, 121, 124, 126],
                                                  [285, 287, 288, 290, 292, 293, 295], [95, 92, 89, 86, 83, 80, 77])]
    + [(_S2, d, 7, t, x, p) for d, t, x, p in zip(range(1, 8), [187, 188, 189, 190, 191, 192, 193],
                                                  [308, 309, 310, 311, 312, 313, 313],
                                                  [118, 115, 112, 109, 106, 103, 100])])


@pytest.fixture(scope="module")
def stations(spark):
    rows = [(s, dt.date(2010, m, d), t, x, p) for s, d, m, t, x, p in STATION_ROWS]
    return spark.createDataFrame(rows, "STATION string, DATE date, `DLY-TMIN-NORMAL` int, "
                                       "`DLY-TMAX-NORMAL` int, `DLY-PRCP-NORMAL` int")


def test_station_gdd_golden(stations):
    g = FE.growing_degree_days(stations)
    tot = {r.STATION: r.s for r in g.groupBy("STATION").agg(F.sum("GDD").alias("s")).collect()}
    assert tot[_S2] == pytest.approx(101.5) and tot[_S1] == pytest.approx(87.85)
    # property: last cumulative value equals the group sum
    last = g.groupBy("STATION", "YEAR").agg(F.max("CUMULATIVE_GDD").alias("c"), F.sum("GDD").alias("s")).collect()
    assert all(math.isclose(r.c, r.s) for r in last)


def test_station_frost_window_golden(stations):
    f = {r.STATION: r for r in FE.frost_free_period(stations).collect()}
    for s in (_S1, _S2):
        assert f[s].LAST_SPRING_FROST == dt.date(2010, 1, 7)
        assert f[s].FIRST_FALL_FROST is None and f[s].FROST_FREE_DAYS is None


def test_station_precip_golden(stations):
    p = FE.precipitation_features(stations)
    m = p["monthly_precipitation"].groupBy("STATION").agg(F.sum("MONTHLY_PRCP").alias("s")).collect()
    assert {r.STATION: r.s for r in m} == {_S2: 1225, _S1: 621}
    dry = p["max_consecutive_dry_days"].collect()
    assert len(dry) == 1 and dry[0].MAX_CONSECUTIVE_DRY_DAYS == 1  # one row has PRCP <= 1


def _brute_runs(flags):
    best = cur = 0
    for f in flags:
        cur = cur + 1 if f else 0
        best = max(best, cur)
    return best or None


def test_longest_runs_brute_force(spark):
    import random
    rng = random.Random(7)
    rows = []
    for st in ("A", "B"):
        d0 = dt.date(2019, 12, 20)
        for i in range(40):
            rows.append((st, d0 + dt.timedelta(days=i), 1 if rng.random() < 0.55 else 0))
    df = spark.createDataFrame(rows, "state_code string, date date, f int").withColumn("year", F.year("date"))
    out = FE.longest_runs(df, "f", ["state_code", "year"], ["date"], "mx")
    got = {(r.state_code, r.year): r.mx for r in out.select("state_code", "year", "mx").distinct().collect()}
    for (st, yr), mx in got.items():
        flags = [f for s, d, f in sorted(rows) if s == st and d.year == yr]
        assert mx == _brute_runs(flags), (st, yr)


def test_spell_across_year_end_is_split(spark):
    rows = [("A", dt.date(2019, 12, 30), 35.0), ("A", dt.date(2019, 12, 31), 35.0),
            ("A", dt.date(2020, 1, 1), 35.0), ("A", dt.date(2020, 1, 2), 10.0)]
    df = (spark.createDataFrame(rows, "state_code string, date date, tmax double")
          .select("*", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day")))
    h = {r.year: r.m for r in FE.heat_stress_features(df).groupBy("year")
         .agg(F.max("max_consecutive_heat_days").alias("m")).collect()}
    assert h == {2019: 2, 2020: 1}


def test_frost_window_leap_year_day_182(spark):
    rows = [("A", 2020, 6, 30, -1.0), ("A", 2020, 6, 29, -1.0), ("A", 2020, 10, 1, -2.0), ("A", 2019, 6, 30, 5.0)]
    df = spark.createDataFrame(rows, "state_code string, year int, month int, day int, tmin double")
    r = {x.year: x for x in FE.frost_risk_features(df).collect()}
    assert r[2020].last_spring_frost_day == 181  # Jun 30 of a leap year is day 182 -> counted as fall
    assert r[2020].first_fall_frost_day == 182
    assert r[2020].frost_free_days == 1
    assert r[2019].last_spring_frost_day is None


def test_lagged_yield_golden(spark):
    rows = [(1997, "CORN", 115.1), (2002, "CORN", 113.4), (2007, "CORN", 132.5), (2012, "CORN", 132.3),
            (2017, "CORN", 137.9)]
    df = spark.createDataFrame(rows, "YEAR int, CROP string, YIELD double")
    got = {r.YEAR: r for r in integrate.lagged_yield(df).collect()}
    assert got[1997].PREV_YIELD is None
    assert got[2002].YIELD_CHANGE == pytest.approx(-1.7) and got[2002].YIELD_CHANGE_PCT == pytest.approx(-1.476977, 1e-6)
    assert got[2007].YIELD_CHANGE_PCT == pytest.approx(16.843034, 1e-6)
    assert got[2017].YIELD_CHANGE_PCT == pytest.approx(4.232804, 1e-6)


def test_standardize_mean_zero_std_one_and_no_target(spark):
    df = spark.createDataFrame([(1997, 1.0, 10.0, 5.0), (2002, 2.0, 10.0, 6.0), (2007, 3.0, 10.0, 9.0)],
                               "year int, x double, c double, yield double")
    z = integrate.standardize(df)
    assert "yield_std" not in z.columns and "year_std" not in z.columns
    vals = [r.x_std for r in z.collect()]
    assert sum(vals) == pytest.approx(0.0) and [r.c_std for r in z.collect()] == [None] * 3  # zero std -> NULL


def test_thornthwaite_negative_temperature_contributes_zero(spark):
    rows = [("A", 2000, m, float(t), 50.0) for m, t in zip(range(1, 13), [-5, -2, 3, 8, 14, 19, 22, 21, 16, 10, 4, -3])]
    df = spark.createDataFrame(rows, "state_code string, year int, month int, tmean double, ppt double")
    out = FE.water_balance_features(df).collect()
    hi = out[0].heat_index
    expect = sum((t / 5) ** 1.514 for t in [3, 8, 14, 19, 22, 21, 16, 10, 4])
    assert hi == pytest.approx(expect)
    assert all(r.pet == 0.0 for r in out if r.tmean <= 0)
