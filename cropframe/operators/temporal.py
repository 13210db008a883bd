"""Temporal alignment: growing-season filters, season statistics, census alignment, phenology.

(P4-P7, A10-A15, A34, A35, W7, W8, F3)

Calendars are fixed-size tables from ``functions.calendar``; they meet the
facts through broadcast hash joins on (crop, region, month, day) or month, so
the reference's per-row ``apply`` becomes one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cropframe import dims
from cropframe.functions import agro
from cropframe.functions import calendar as cal
from cropframe.schema import with_frame_stats

VAR_NAMES = {
    "tmin": "temperature_min", "tmax": "temperature_max", "tmean": "temperature_mean", "ppt": "precipitation",
    "DLY-TMIN-NORMAL": "temperature_min", "DLY-TMAX-NORMAL": "temperature_max",
    "DLY-TMEAN-NORMAL": "temperature_mean", "DLY-PRCP-NORMAL": "precipitation",
}
_SKIP = {"month", "day", "year", "latitude", "longitude"}


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _with_region(df: DataFrame, state_code: str | None, per_row_state: bool = True,
                 state_col: str = "state_code") -> DataFrame:
    """Region used for the calendar: the given state, else each row's state, else Iowa's."""
    if state_code is not None:
        st = F.lit(state_code)
    elif per_row_state and state_col in df.columns:
        st = F.col(state_col)
    else:
        st = F.lit(None).cast("string")
    return df.withColumn("_region", cal.region_of(st))


def filter_growing_season(df: DataFrame, crop: str, state_code: str | None = None,
                          per_row_state: bool = True) -> DataFrame:
    """P4 (daily: month+day columns) / P5 (monthly) growing-season filter.

    Daily rows keep the (month, day) pairs of the crop's adjusted season. The
    state is taken from ``state_code`` when given, else from each row's
    ``state_code`` column (``per_row_state``), else Iowa (the reference default).
    Monthly rows keep the months of the unadjusted season (wrap -> OR).
    """
    spark = _spark(df)
    if "day" in df.columns:
        days = cal.season_days(spark).filter(F.col("crop") == crop).select(
            F.col("region").alias("_region"), "month", "day")
        base = _with_region(df, state_code, per_row_state)
        return base.join(F.broadcast(days), ["_region", "month", "day"], "left_semi").drop("_region")
    months = cal.crop_months(spark, "phenology", "wrap").filter(F.col("crop") == crop).select("month")
    return df.join(F.broadcast(months), "month", "left_semi")


def season_days_by_crop(df: DataFrame, state_code: str | None = None, per_row_state: bool = True) -> DataFrame:
    """P4 over all crops: one row per crop whose adjusted season holds the day (the calendar is broadcast)."""
    days = cal.season_days(_spark(df)).select("crop", F.col("region").alias("_region"), "month", "day")
    return _with_region(df, state_code, per_row_state).join(F.broadcast(days), ["_region", "month", "day"]).drop("_region")


def period_days_by_crop(df: DataFrame, state_code: str | None = None, per_row_state: bool = True) -> DataFrame:
    """P6 over all crops and periods: one row per critical period that holds the day."""
    days = cal.period_days(_spark(df)).select("crop", "period", F.col("region").alias("_region"), "month", "day")
    return _with_region(df, state_code, per_row_state).join(F.broadcast(days), ["_region", "month", "day"]).drop("_region")


def filter_critical_period(df: DataFrame, crop: str, period: str, state_code: str | None = None,
                           per_row_state: bool = True) -> DataFrame:
    """P6 (daily, adjusted period) / P7 (monthly, months overlapping the unadjusted period)."""
    spark = _spark(df)
    if "day" in df.columns:
        days = (cal.period_days(spark).filter((F.col("crop") == crop) & (F.col("period") == period))
                .select(F.col("region").alias("_region"), "month", "day"))
        base = _with_region(df, state_code, per_row_state)
        return base.join(F.broadcast(days), ["_region", "month", "day"], "left_semi").drop("_region")
    months = (cal.period_months(spark).filter((F.col("crop") == crop) & (F.col("period") == period))
              .select("month"))
    return df.join(F.broadcast(months), "month", "left_semi")


def season_stats_monthly(state_month: DataFrame, calendar: str = "monthly",
                         wheat_mode: str = "harvest_year", crops: list[str] | None = None) -> DataFrame:
    """A10 + A11 + A12: growing-season statistics per state, season year and crop, wide.

    Input: A3 output (state_code, year, month, variable, mean_value, min_value,
    max_value). ppt -> sum of monthly means; other variables -> mean of means,
    min of mins, max of maxes; GDD base 10 = sum over months of max(0, tmean-10)
    with tmean falling back to (tmin+tmax)/2. Output columns are named like the
    reference's pivot (growing_season_<var>_<stat>, growing_degree_days_base10).
    """
    spark = _spark(state_month)
    cm = cal.crop_months(spark, calendar, wheat_mode)
    if crops:
        cm = cm.filter(F.col("crop").isin(*crops))
    mv = {v: F.when(F.col("variable") == v, F.col("mean_value")) for v in ("ppt", "tmax", "tmean", "tmin")}
    lo = {v: F.when(F.col("variable") == v, F.col("min_value")) for v in ("tmax", "tmean", "tmin")}
    hi = {v: F.when(F.col("variable") == v, F.col("max_value")) for v in ("tmax", "tmean", "tmin")}
    # month-level wide row (one row per state-year-month): needed for the GDD fallback
    monthly = (state_month.groupBy("state_code", "year", "month")
               .agg(*[F.max(mv[v]).alias(f"{v}_mean") for v in mv],
                    *[F.min(lo[v]).alias(f"{v}_min") for v in lo],
                    *[F.max(hi[v]).alias(f"{v}_max") for v in hi]))
    j = monthly.join(F.broadcast(cm), "month")
    t = F.coalesce(F.col("tmean_mean"), (F.col("tmin_mean") + F.col("tmax_mean")) / 2)
    g = (j.groupBy("state_code", (F.col("year") + F.col("year_offset")).alias("year"), "crop")
         .agg(F.sum("ppt_mean").alias("growing_season_ppt_total"),
              *[x for v in ("tmax", "tmean", "tmin") for x in (
                  F.avg(f"{v}_mean").alias(f"growing_season_{v}_mean"),
                  F.min(f"{v}_min").alias(f"growing_season_{v}_min"),
                  F.max(f"{v}_max").alias(f"growing_season_{v}_max"))],
              F.sum(agro.gdd_simple(t)).alias("growing_degree_days_base10"),
              F.count(t).alias("_n_t")))
    return g.withColumn("growing_degree_days_base10",
                        F.when(F.col("_n_t") > 0, F.col("growing_degree_days_base10"))).drop("_n_t")


def season_stats_long(state_month: DataFrame, calendar: str = "monthly",
                      wheat_mode: str = "harvest_year") -> DataFrame:
    """A10 long form: state_code, year, crop, metric, value (before the A11 pivot)."""
    wide = season_stats_monthly(state_month, calendar, wheat_mode)
    metrics = [c for c in wide.columns if c not in ("state_code", "year", "crop")]
    return unpivot(wide, ["state_code", "year", "crop"], metrics, "metric", "value")


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    out = df.unpivot(ids, cols, name, value)
    return out.filter(F.col(value).isNotNull())


def _stat_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(column, standard name) for the numeric climate columns, in schema order."""
    out = []
    for f in df.schema.fields:
        if f.name in _SKIP or f.name.lower() in _SKIP:
            continue
        if f.dataType.typeName() not in ("double", "float", "integer", "long", "short"):
            continue
        out.append((f.name, VAR_NAMES.get(f.name, f.name)))
    return out


def season_statistics(daily: DataFrame, crop: str, keys: list[str] | None = None,
                      state_code: str | None = None, per_row_state: bool = True,
                      periods: bool = True) -> DataFrame:
    """A13 + A14 (+ A35 when ``keys`` is given): statistics of the growing season.

    Precipitation -> total, max daily, days with rain (> 0); other variables ->
    mean, min, max; temperatures -> GDD base 10 (capped at 30 for max columns),
    one column per temperature variable (gdd_base10_<var>; ``gdd_base10`` is
    tmean's). Critical periods add <period>_<var>_total / _mean. One read and one
    aggregate: rows join a calendar that says whether the season and which
    periods hold the day, and every statistic is conditional on it.
    """
    keys = keys or []
    spark = _spark(daily)
    cols = [(c, n) for c, n in _stat_columns(daily) if c not in keys]
    daily_rows = "day" in daily.columns
    if daily_rows:
        on = ["_region", "month", "day"]
        season = cal.season_days(spark).filter(F.col("crop") == crop).select(
            F.col("region").alias("_region"), "month", "day", F.lit(True).alias("_season"))
        periods_of = cal.period_days(spark).filter(F.col("crop") == crop).withColumnRenamed("region", "_region")
        base = _with_region(daily, state_code, per_row_state)
    else:
        on = ["month"]
        season = cal.crop_months(spark, "phenology", "wrap").filter(F.col("crop") == crop).select(
            "month", F.lit(True).alias("_season"))
        periods_of = cal.period_months(spark).filter(F.col("crop") == crop)
        base = daily
    in_periods = periods_of.groupBy(*on).agg(F.collect_set("period").alias("_periods"))
    calendar = season.distinct().join(in_periods, on, "full")
    tagged = base.join(F.broadcast(calendar), on)  # the calendar has at most 366 days x 3 regions

    in_season = F.coalesce("_season", F.lit(False))
    named = {}  # a name several columns give (days_with_rain) keeps the last one's statistic
    for c, name in cols:
        x = F.when(in_season, F.col(f"`{c}`"))
        low = name.lower()
        if "precipitation" in low or "ppt" in low:
            named[f"{name}_total"] = F.coalesce(F.sum(x), F.lit(0.0))
            named[f"{name}_max_daily"] = F.max(x)
            if daily_rows:
                named["days_with_rain"] = F.count_if(x > 0)
        else:
            named |= {f"{name}_mean": F.avg(x), f"{name}_min": F.min(x), f"{name}_max": F.max(x)}
            if "temp" in low:
                g = agro.gdd_simple(x, 10.0, 30.0 if "max" in low else None)
                named["gdd_base10" if name == "temperature_mean" else f"gdd_base10_{name}"] = F.coalesce(
                    F.sum(g), F.lit(0.0))
    for p in [p[0] for p in dims.CRITICAL_PERIODS.get(crop, [])] if periods else []:
        inp = F.coalesce(F.array_contains("_periods", p), F.lit(False))
        for c, name in cols:
            x = F.when(inp, F.col(f"`{c}`"))
            low = name.lower()
            if "precipitation" in low or "ppt" in low:
                named[f"{p}_{name}_total"] = F.when(F.count_if(inp) > 0, F.coalesce(F.sum(x), F.lit(0.0)))
            else:
                named[f"{p}_{name}_mean"] = F.avg(x)
    aggs = [v.alias(k) for k, v in named.items()]
    if not keys:
        return tagged.agg(*aggs)
    found = tagged.groupBy(*keys).agg(*aggs, F.count_if(in_season).alias("_days"))
    return found.filter(F.col("_days") > 0).drop("_days")


def season_statistics_by_crop(daily: DataFrame, keys: list[str], state_code: str | None = None,
                              per_row_state: bool = True) -> DataFrame:
    """A13 + A35 for all crops in one job: crop, ``keys`` and the season's statistics, names as ``season_statistics``.

    Each day counts for every crop whose adjusted season holds it (at most the five
    crops of the calendar), then one aggregate.
    """
    cols = [(c, n) for c, n in _stat_columns(daily) if c not in keys]
    aggs = {}
    for c, name in cols:
        x, low = F.col(f"`{c}`"), name.lower()
        if "precipitation" in low:
            aggs |= {f"{name}_total": F.coalesce(F.sum(x), F.lit(0.0)), f"{name}_max_daily": F.max(x),
                     "days_with_rain": F.count_if(x > 0)}
            continue
        aggs |= {f"{name}_mean": F.avg(x), f"{name}_min": F.min(x), f"{name}_max": F.max(x)}
        if "temp" in low:
            gdd = F.coalesce(F.sum(agro.gdd_simple(x, 10.0, 30.0 if "max" in low else None)), F.lit(0.0))
            aggs["gdd_base10" if name == "temperature_mean" else f"gdd_base10_{name}"] = gdd
    rows = season_days_by_crop(daily, state_code, per_row_state)
    return rows.groupBy("crop", *keys).agg(*[e.alias(n) for n, e in aggs.items()])


def period_statistics_by_crop(daily: DataFrame, keys: list[str], state_code: str | None = None,
                              per_row_state: bool = True) -> DataFrame:
    """A14 + A35 for all crops and critical periods, long: crop, period, ``keys``, n_days, <var>_mean, precipitation_total."""
    aggs = [F.count(F.lit(1)).alias("n_days")]
    for c, name in [(c, n) for c, n in _stat_columns(daily) if c not in keys]:
        x = F.col(f"`{c}`")
        aggs.append(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{name}_total") if "precipitation" in name
                    else F.avg(x).alias(f"{name}_mean"))
    return period_days_by_crop(daily, state_code, per_row_state).groupBy("crop", "period", *keys).agg(*aggs)


def season_months_by_crop(monthly: DataFrame) -> DataFrame:
    """P5 for all crops: one row per crop whose unadjusted season holds the month."""
    return monthly.join(F.broadcast(cal.crop_months(_spark(monthly), "phenology", "wrap").select("crop", "month").distinct()), "month")


def period_months_by_crop(monthly: DataFrame) -> DataFrame:
    """P7 for all crops and periods: one row per unadjusted critical period that overlaps the month."""
    months = cal.period_months(_spark(monthly)).select("crop", "period", "month").distinct()
    return monthly.join(F.broadcast(months), "month")


def phenology_by_crop(df: DataFrame, state_code: str | None = None, per_row_state: bool = True) -> DataFrame:
    """W7 (daily) / W8 (monthly) for all crops: every row once per crop with that crop's stage.

    Daily rows take the calendar of their own state's region (``per_row_state``), else
    of ``state_code``, else Iowa's; monthly rows that of ``state_code``, else Iowa's.
    """
    spark = _spark(df)
    days = cal.period_days(spark)
    rows = df.withColumn("crop", F.explode(F.array(*[F.lit(c) for c in dims.CROPS])))
    if "day" in df.columns:
        on = ["crop", "_region", "month", "day"]
        stage = days.withColumnRenamed("region", "_region").groupBy(*on).agg(F.max_by("period", "period_idx").alias("phenology_stage"))
        rows = _with_region(rows, state_code, per_row_state)
    else:
        on = ["crop", "month"]
        region = cal.region_of(F.lit(state_code) if state_code else F.lit(None).cast("string"))
        counts = days.where(F.col("region") == region).groupBy(*on, "period", "period_idx").agg(F.count(F.lit(1)).alias("_n"))
        stage = counts.groupBy(*on).agg(F.max_by("period", F.struct("_n", -F.col("period_idx"))).alias("phenology_stage"))
    return (rows.join(F.broadcast(stage), on, "left").drop("_region")  # at most 366 days x 3 regions x 5 crops
            .withColumn("phenology_stage", F.coalesce("phenology_stage", F.lit("outside_growing_season"))))


def census_alignment(climate: DataFrame, state_level: bool = True,
                     census_years: list[int] | None = None, group_cols: list[str] | None = None) -> DataFrame:
    """Mean over {cy-1, cy, cy+1} (the years present) of every numeric column per census year.

    Each climate row is routed to the census years within one year of it
    (a range join expressed as an equi join on the exploded candidate years), then
    one aggregate. Group: (state_code, variable) or (variable), as available.
    """
    years = census_years or dims.CENSUS_YEARS
    if group_cols is None:
        group_cols = [c for c in (["state_code", "variable"] if state_level else ["variable"])
                      if c in climate.columns]
    num = [f.name for f in climate.schema.fields
           if f.dataType.typeName() in ("double", "float", "integer", "long", "short")
           and f.name not in ("year", "month", "day") and f.name not in group_cols]
    cy = F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("census_year")
    routed = climate.select("*", cy).filter(F.col("census_year").isin(*years))
    return (routed.groupBy(*group_cols, "census_year")
            .agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in num])
            .withColumn("census_year", F.col("census_year").cast("int")))


def climate_indices(df: DataFrame, temp_col: str = "tmean", precip_col: str = "ppt") -> DataFrame:
    """daily flags (heat > 30, frost < 0, dry < 1, wet > 10) and monthly indices."""
    t, p = F.col(temp_col), F.col(precip_col)
    out = df
    if "day" in df.columns:
        out = out.select("*", agro.flag(t > 30).alias("heat_stress_day"), agro.flag(t < 0).alias("frost_day"),
                         agro.flag(p < 1).alias("dry_day"), agro.flag(p > 10).alias("wet_day"))
    if "month" in df.columns:
        out = out.select("*", agro.aridity_index(p, t).alias("aridity_index"),
                         agro.gdd_simple(t).alias("gdd_base10"), agro.gdd_simple(t, 30.0).alias("cdd_base30"))
    return out


def phenology_stage(df: DataFrame, crop: str, state_code: str | None = None) -> DataFrame:
    """W7 (daily) / W8 (monthly): phenology stage of each row.

    Daily: the latest period (by stage order) containing the day wins, else
    ``outside_growing_season``. Monthly: the period with most days in the
    month; ties -> earlier period. State: argument, else Iowa (reference).
    """
    spark = _spark(df)
    region = cal.region_of(F.lit(state_code) if state_code else F.lit(None).cast("string"))
    pdays = cal.period_days(spark).filter(F.col("crop") == crop).filter(F.col("region") == region)
    if "day" in df.columns:
        stage = (pdays.groupBy("month", "day")
                 .agg(F.max_by("period", "period_idx").alias("phenology_stage")))
        return (df.join(F.broadcast(stage), ["month", "day"], "left")
                .withColumn("phenology_stage", F.coalesce(F.col("phenology_stage"),
                                                          F.lit("outside_growing_season"))))
    counts = pdays.groupBy("month", "period", "period_idx").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("month").orderBy(F.col("_n").desc(), F.col("period_idx"))
    dom = (counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
           .select("month", F.col("period").alias("phenology_stage")))
    return (df.join(F.broadcast(dom), "month", "left")
            .withColumn("phenology_stage", F.coalesce(F.col("phenology_stage"), F.lit("outside_growing_season"))))


def stage_counts(df: DataFrame) -> DataFrame:
    """Rows per phenology stage."""
    return df.groupBy("phenology_stage").agg(F.count(F.lit(1)).alias("n_rows"))
