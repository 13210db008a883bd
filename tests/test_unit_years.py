"""Day sets against the window form, and both unit readings against the two-pass operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cropframe.operators import features as FE
from cropframe.operators import unit_years as U


def daily(spark, seed, gaps=True):
    rnd = random.Random(seed)
    rows = []
    for s in ("A", "B", "C"):
        for y in (2000, 2001):
            for d in range(366 if y == 2000 else 365):
                if gaps and rnd.random() < 0.2:
                    continue
                hot = None if rnd.random() < 0.05 else rnd.choice([29.0, 31.0, 35.0]) if s != "C" else 20.0
                date = datetime.date(y, 1, 1) + datetime.timedelta(d)
                rows.append((s, y, date.month, date.day, date, hot, rnd.choice([0.0, 0.5, 3.0])))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "state_code string, year int, month int, day int, date date, tmax double, ppt double")


@pytest.mark.parametrize("gaps", [True, False])
def test_day_sets_equal_windows(spark, gaps):
    df = daily(spark, 5, gaps)
    want = FE.heat_stress_features(df).groupBy("state_code", "year").agg(
        F.sum("extreme_heat_day").alias("n"), F.max("max_consecutive_heat_days").alias("m"),
        F.round(F.sum("heat_degree_days"), 6).alias("h")).collect()
    got = {(r.state_code, r.year): (r.hot_days, r.max_consecutive_heat_days, round(r.heat_degree_days, 6))
           for r in U.heat_years(df).collect()}
    assert got == {(r.state_code, r.year): (r.n, r.m, r.h) for r in want} and got["C", 2000][1] is None
    want = FE.drought_features(df).groupBy("state_code", "year").agg(F.max("max_consecutive_dry_days").alias("m")).collect()
    assert {(r.state_code, r.year): r.max_consecutive_dry_days for r in U.dry_years(df).collect()} == {
        (r.state_code, r.year): r.m for r in want}


def test_whole_year_and_repeated_days(spark):
    rows = [("A", 2000, datetime.date(2000, 1, 1) + datetime.timedelta(d), 0.0) for d in range(366)] * 2
    df = spark.createDataFrame(rows, "state_code string, year int, date date, ppt double")
    r = U.dry_years(df).first()
    assert r.max_consecutive_dry_days == 366 and r.dry_days == 732


def test_no_window_and_one_scan(spark):
    plan = U.heat_years(daily(spark, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def normals(spark, top):
    """Units in tenths (top 300) or not (top 90): every column's decision follows its largest value."""
    rnd = random.Random(top)
    rows = []
    for s in range(6):
        for y in (1999, 2000, 2001)[s % 2:]:
            for d in range(0, 365, 1 + s % 3):
                tmin = rnd.randint(-60, top // 2)
                rows.append((f"S{s}", datetime.date(y, 1, 1) + datetime.timedelta(d), tmin, tmin + rnd.randint(0, top // 2),
                             rnd.choice([0, 0, 1, 5, 9, 30, 4 * top])))
    rows.append(("S9", datetime.date(2000, 5, 5), None, None, None))
    return spark.createDataFrame(rows, "STATION string, DATE date, `DLY-TMIN-NORMAL` int, `DLY-TMAX-NORMAL` int, `DLY-PRCP-NORMAL` int")


@pytest.mark.parametrize("top", [90, 300])
def test_station_years_equal_the_separate_operators(spark, top):
    df = normals(spark, top)
    years = U.station_years(df)
    got = {(r.STATION, r.YEAR): r for r in years.collect()}
    gdd = FE.growing_degree_days(df).groupBy("STATION", "YEAR").agg(F.sum("GDD").alias("g"), F.count("GDD").alias("n")).collect()
    assert len(gdd) == len(got)
    for r in gdd:
        mine = got[r.STATION, r.YEAR]
        assert mine.gdd_days == r.n and (mine.gdd_total == pytest.approx(r.g) if r.g is not None else mine.gdd_total is None)
    p = FE.precipitation_features(df)
    for r in p["wet_days"].collect():
        assert got[r.STATION, r.YEAR].WET_DAYS_COUNT == r.WET_DAYS_COUNT
    assert {k: r.MAX_CONSECUTIVE_DRY_DAYS for k, r in got.items() if r.MAX_CONSECUTIVE_DRY_DAYS} == {
        (r.STATION, r.YEAR): r.MAX_CONSECUTIVE_DRY_DAYS for r in p["max_consecutive_dry_days"].collect()}
    assert {k: r.GROWING_SEASON_PRCP for k, r in got.items() if r.GROWING_SEASON_PRCP is not None} == {
        (r.STATION, r.YEAR): r.GROWING_SEASON_PRCP for r in p["growing_season_precipitation"].collect() if r.GROWING_SEASON_PRCP is not None}
    want = {r.STATION: tuple(r) for r in FE.frost_free_period(df).collect()}
    assert {r.STATION: tuple(r) for r in U.frost_free(years).collect()} == want
