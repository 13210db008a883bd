"""Crop calendar tables (F9, F10) built once as small DataFrames.

The reference enumerates (month, day) lists in Python for every row or month;
here each calendar is a fixed-size table (crops x regions x <=366 days) that
joins to the facts with a broadcast hash join on (month, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe import dims

# Periods whose start follows the season start / whose end follows the season end.
_START_PERIODS = ("planting", "fall_planting")
_END_PERIODS = ("maturation", "grain_fill", "boll_development")


def _shift(d: Column, days: Column) -> Column:
    return F.date_add(d, days)


def _trunc_int(x: Column) -> Column:
    """int(x) truncates toward zero."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")


def adjusted_seasons(spark: SparkSession) -> DataFrame:
    """F9 season part: crop, region, adjusted start/end month/day (dates computed on 2020)."""
    cal = dims.season_calendar(spark)
    sh = dims.regional_shifts(spark)
    s = _shift(F.make_date(F.lit(2020), "start_month", "start_day"), F.col("start_shift"))
    e = _shift(F.make_date(F.lit(2020), "end_month", "end_day"), F.col("end_shift"))
    return (cal.join(sh, "crop")
            .select("crop", "region",
                    F.month(s).alias("start_month"), F.dayofmonth(s).alias("start_day"),
                    F.month(e).alias("end_month"), F.dayofmonth(e).alias("end_day")))


def adjusted_periods(spark: SparkSession) -> DataFrame:
    """F9 period part: crop, region, period_idx, period, adjusted start/end month/day."""
    cp = dims.critical_periods(spark)
    sh = dims.regional_shifts(spark)
    s0 = F.make_date(F.lit(2020), "start_month", "start_day")
    e0 = F.make_date(F.lit(2020), "end_month", "end_day")
    ss, es = F.col("start_shift"), F.col("end_shift")
    is_start = F.col("period").isin(*_START_PERIODS)
    is_end = F.col("period").isin(*_END_PERIODS)
    s = F.when(is_start, _shift(s0, ss)).when(is_end, _shift(s0, _trunc_int(es * 0.5))) \
         .otherwise(_shift(s0, _trunc_int(ss * 0.3)))
    e = F.when(is_start, _shift(e0, _trunc_int(ss * 0.5))).when(is_end, _shift(e0, es)) \
         .otherwise(_shift(e0, _trunc_int(es * 0.3)))
    return (cp.join(sh, "crop")
            .select("crop", "region", "period_idx", "period",
                    F.month(s).alias("start_month"), F.dayofmonth(s).alias("start_day"),
                    F.month(e).alias("end_month"), F.dayofmonth(e).alias("end_day")))


def _explode_days(df: DataFrame, keys: list[str], start_year: int = 2019) -> DataFrame:
    """enumerate (month, day) from start to end; an end month before the start month
    falls in the next year (2020, a leap year, so wrapped ranges include Feb 29)."""
    start = F.make_date(F.lit(start_year), "start_month", "start_day")
    end_year = F.when(F.col("end_month") < F.col("start_month"), start_year + 1).otherwise(start_year)
    end = F.make_date(end_year, "end_month", "end_day")
    d = F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("d")
    return (df.select(*keys, d)
            .select(*keys, F.month("d").alias("month"), F.dayofmonth("d").alias("day")))


def season_days(spark: SparkSession) -> DataFrame:
    """crop, region, month, day for every day of each adjusted growing season."""
    return _explode_days(adjusted_seasons(spark), ["crop", "region"])


def period_days(spark: SparkSession) -> DataFrame:
    """crop, region, period_idx, period, month, day for every day of each critical period."""
    return _explode_days(adjusted_periods(spark), ["crop", "region", "period_idx", "period"])


def season_lengths(spark: SparkSession) -> DataFrame:
    """crop, region, days: number of (month, day) pairs in each adjusted season."""
    return season_days(spark).groupBy("crop", "region").agg(F.count(F.lit(1)).alias("days"))


def crop_months(spark: SparkSession, calendar: str = "monthly", wheat_mode: str = "harvest_year") -> DataFrame:
    """crop, month, year_offset: months inside each crop's season (P5 / A10 calendars).

    ``calendar='monthly'`` uses the coarse calendar of the state-month statistics,
    ``'phenology'`` the start/end months of the daily calendar. For a season that
    wraps the year end, ``wheat_mode='harvest_year'`` assigns the autumn months to
    the following (harvest) year; ``'calendar_year'`` keeps only the months of the
    planting year, which is what the reference computes for a single year.
    """
    if calendar == "monthly":
        bounds = {c: se for c, se in dims.MONTHLY_SEASONS.items()}
    elif calendar == "phenology":
        bounds = {c: (v[0], v[2]) for c, v in dims.PHENOLOGY_SEASONS.items()}
    else:
        raise ValueError(f"unknown calendar {calendar!r}")
    rows = []
    for crop, (s, e) in bounds.items():
        if s <= e:
            rows += [(crop, m, 0) for m in range(s, e + 1)]
        elif wheat_mode == "harvest_year":
            rows += [(crop, m, 1) for m in range(s, 13)] + [(crop, m, 0) for m in range(1, e + 1)]
        elif wheat_mode == "calendar_year":
            rows += [(crop, m, 0) for m in range(s, 13)]
        elif wheat_mode == "wrap":
            rows += [(crop, m, 0) for m in range(s, 13)] + [(crop, m, 0) for m in range(1, e + 1)]
        else:
            raise ValueError(f"unknown wheat_mode {wheat_mode!r}")
    return spark.createDataFrame(rows, "crop string, month int, year_offset int")


def period_months(spark: SparkSession) -> DataFrame:
    """Crop, period_idx, period, month for months overlapping each unadjusted period."""
    rows = []
    for crop in dims.CROPS:
        for i, (name, sm, _sd, em, _ed) in enumerate(dims.CRITICAL_PERIODS[crop]):
            months = list(range(sm, em + 1)) if sm <= em else list(range(sm, 13)) + list(range(1, em + 1))
            rows += [(crop, i, name, m) for m in months]
    return spark.createDataFrame(rows, "crop string, period_idx int, period string, month int")


def region_of(state_col: Column) -> Column:
    """Region of a state; unknown -> Central; missing state -> Iowa's region."""
    pairs = []
    for k, v in dims.STATE_REGIONS.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    st = F.coalesce(state_col, F.lit(dims.DEFAULT_STATE))
    return F.coalesce(F.try_element_at(m, st), F.lit(dims.DEFAULT_REGION))
