"""Climate feature operators.

Ordered computations (runs, cumulative sums, frost windows) use windows
partitioned by (unit, year): a partition never holds more than one year of
days for one state or station, however skewed the data, and every window
in a chain shares that partitioning, so a chain costs one shuffle. Aggregates
over few, huge groups (climatology by month) use a hash aggregate plus a
broadcast join back, because a window there would put a twelfth of all rows
into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropframe import dims
from cropframe.functions import agro
from cropframe.schema import find_column, with_frame_stats

PRCP = ("ppt", "prcp")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def longest_runs(df: DataFrame, flag_col: str, keys: list[str], order: list[str], out: str,
                 run_col: str | None = None) -> DataFrame:
    """Gaps and islands: length of the longest run of flagged consecutive rows per ``keys``.

    start = flagged and previous row not flagged (or first row); group = running
    count of starts; run length = rows per group. Windows only (same partitioning):
    rows keep their place and get ``out`` (NULL when the key has no flagged row).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    f = _q(flag_col)
    prev = F.lag(f).over(w)
    start = F.when((f == 1) & (prev.isNull() | (prev != 1)), 1).otherwise(0)
    x = df.withColumn("_start", start)
    x = x.withColumn("_grp", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_grp", flag_col))
    x = x.withColumn("_run", F.when(f == 1, run))
    if run_col:
        x = x.withColumn(run_col, F.col("_run"))
    x = x.withColumn(out, F.max("_run").over(Window.partitionBy(*keys)))
    return x.drop("_start", "_grp", "_run")


def heat_stress_features(df: DataFrame, base_temp: float = 30.0, keys: tuple[str, ...] = ("state_code", "year"),
                         order: tuple[str, ...] = ("date",)) -> DataFrame:
    """F2 + W3: heat degree days, extreme-heat flag, intensity, longest hot spell per (state, year).

    The reference runs islands over the whole file and pools years across states
    (D10); here runs are per state and year by default (``keys=('year',)`` pools).
    """
    tcol = find_column(df, "tmax")
    if tcol is None:
        return df
    t = _q(tcol)
    out = df.withColumn("heat_degree_days", agro.heat_degree_days(t, base_temp))
    if "day" not in df.columns:
        return out
    out = out.withColumn("extreme_heat_day", agro.flag(t > base_temp))
    out = out.withColumn("heat_stress_intensity", agro.heat_stress_intensity(t, base_temp))
    keys = [k for k in keys if k in df.columns]
    return longest_runs(out, "extreme_heat_day", keys, list(order), "max_consecutive_heat_days")


def drought_features(df: DataFrame, threshold: float = 1.0, keys: tuple[str, ...] = ("state_code", "year"),
                     order: tuple[str, ...] = ("date",),
                     climatology_keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """W4 + A20 + F4: dry-day flag (< threshold), longest dry spell, standardised precipitation.

    Climatology (mean, sample std per month over all rows) is a 12-row aggregate
    joined back by broadcast: its size is bounded by the calendar, not the data.
    """
    pcol = find_column(df, *PRCP)
    if pcol is None:
        return df
    p = _q(pcol)
    out = df
    if "day" in df.columns:
        out = out.withColumn("dry_day", agro.flag(p < threshold))
        out = longest_runs(out, "dry_day", [k for k in keys if k in df.columns], list(order),
                           "max_consecutive_dry_days")
    if "month" in df.columns and "year" in df.columns:
        ck = list(climatology_keys)
        clim = df.groupBy(*ck).agg(F.avg(p).alias("_clim_mean"), F.stddev_samp(p).alias("_clim_std"))
        out = (out.join(F.broadcast(clim) if ck == ["month"] else clim, ck, "left")
               .withColumn("standardized_precip", agro.standardized(p, "_clim_mean", "_clim_std"))
               .drop("_clim_mean", "_clim_std"))
    return out


def frost_risk_features(df: DataFrame, keys: tuple[str, ...] = ("state_code", "year"),
                        threshold: float = 0.0, split_doy: int = 182) -> DataFrame:
    """F5 + A31 + W5: frost flag (tmin <= 0), frost days per month, last spring / first fall frost.

    Day of year < 182 is spring, >= 182 fall (182 = Jun 30 in leap years, as in
    the reference); frost_free_days = first fall - last spring (NULL if either is
    missing). Conditional max/min over the (state, year) window: one pass.
    """
    tcol = find_column(df, "tmin")
    if tcol is None or "day" not in df.columns:
        return df
    t = _q(tcol)
    keys = [k for k in keys if k in df.columns]
    out = df.withColumn("frost_day", agro.flag(t <= threshold))
    if "month" in df.columns and "year" in df.columns:
        out = out.withColumn("frost_days_in_month",
                             F.sum("frost_day").over(Window.partitionBy(*keys, "month")))
    doy = F.dayofyear(F.make_date("year", "month", "day"))
    out = out.withColumn("_doy", doy)
    w = Window.partitionBy(*keys)
    out = out.withColumn("last_spring_frost_day",
                         F.max(F.when((F.col("frost_day") == 1) & (F.col("_doy") < split_doy), F.col("_doy"))).over(w))
    out = out.withColumn("first_fall_frost_day",
                         F.min(F.when((F.col("frost_day") == 1) & (F.col("_doy") >= split_doy), F.col("_doy"))).over(w))
    out = out.withColumn("frost_free_days", F.col("first_fall_frost_day") - F.col("last_spring_frost_day"))
    return out.drop("_doy")


def water_balance_features(df: DataFrame, heat_index_keys: tuple[str, ...] = ("state_code", "year")) -> DataFrame:
    """F6 + F7 (daily, Hargreaves) or F8 + A21 (monthly, Thornthwaite): PET and P - PET.

    Unit decisions (tenths when the column max > 100) and the frame-mean
    latitude are scalar subqueries over the input.
    """
    tcol = find_column(df, "tmean")
    pcol = find_column(df, *PRCP)
    if tcol is None or pcol is None:
        return df
    t_raw = _q(tcol)
    # frame statistics (unit decision, mean latitude) from one aggregate attached once
    stats = [F.max(t_raw).alias("tmax_all")]
    if "latitude" in df.columns:
        stats.append(F.avg("latitude").alias("lat"))
    cols = [_q(c) for c in df.columns]
    df = with_frame_stats(df, df.agg(F.struct(*stats)).scalar(), "_wb")
    tf = F.when(F.col("_wb.tmax_all") > 100, F.lit(10.0)).otherwise(F.lit(1.0))
    pf = 10.0 if "PRCP-NORMAL" in pcol else 1.0
    t = t_raw / tf
    if "day" in df.columns and "month" in df.columns and "year" in df.columns:
        lat = F.col("_wb.lat") if "latitude" in df.columns else F.lit(40.0)
        doy = F.dayofyear(F.make_date("year", "month", "day"))
        ra = agro.extraterrestrial_radiation(doy, lat)
        tmax_c, tmin_c = tcol.replace("mean", "max"), tcol.replace("mean", "min")
        if tmax_c in df.columns and tmin_c in df.columns:
            tr = (_q(tmax_c) - _q(tmin_c)) / tf
        else:
            tr = F.lit(10.0)
        pet = agro.hargreaves_pet(t, tr, ra)
        out = df.withColumn("pet", pet).withColumn("water_balance", _q(pcol) / pf - F.col("pet"))
        return out.select(*cols, "pet", "water_balance")
    if "month" in df.columns:
        keys = [k for k in heat_index_keys if k in df.columns]
        i = F.sum(agro.thornthwaite_i(t)).over(Window.partitionBy(*keys))
        out = df.withColumn("_hi", i)
        out = out.withColumn("pet", agro.thornthwaite_pet(t, F.col("_hi"), F.col("month")))
        out = out.withColumn("water_balance", _q(pcol) / pf - F.col("pet")).withColumn("heat_index", F.col("_hi"))
        return out.select(*cols, "pet", "water_balance", "heat_index")
    return df.select(*cols)


def climate_crop_interactions(df: DataFrame, crop: str | None = None, crop_col: str | None = None) -> DataFrame:
    """F11 + F12: crop-threshold interactions for every temperature / precipitation column.

    With ``crop_col`` every row takes the thresholds of its own crop (F13: a null
    crop the mean over crops, an unknown one CORN's), in one pass over all crops.

    Temperature columns are found by ``tmean|tmax|tmin`` and also by the
    ``temperature_`` names season statistics produce (the reference only knows
    the former, so its state-level chain never fires; both spellings work here).
    Tenths are detected per column from its global max (scalar subquery).
    """
    if crop_col:
        pick = agro.thresholds_for(None)
        known = {c: agro.thresholds_for(c) for c in dims.CROPS}
        th = {n: F.when(_q(crop_col).isNull(), F.lit(pick[n])) for n in pick}
        for n in th:
            for c, values in known.items():
                th[n] = th[n].when(_q(crop_col) == c, F.lit(values[n]))
            th[n] = th[n].otherwise(F.lit(agro.thresholds_for("?")[n]))
    else:
        th = agro.thresholds_for(crop)
    temps = [c for c in df.columns if any(k in c.lower() for k in ("tmean", "tmax", "tmin", "temperature_"))
             and not c.lower().startswith("gdd")]
    out, rescaled = agro.with_tenths(df, {c: 100.0 for c in temps}) if temps else (df, {})
    new_cols = []
    for c in df.columns:
        low = c.lower()
        if c in rescaled:
            kind = "max" if "max" in low else ("min" if "min" in low else "mean")
            if low.endswith(("_min", "_max")) and "temperature_mean" in low:
                kind = "mean"
            suffix = {"mean": "ideal_deviation", "max": "heat_stress", "min": "frost_risk"}[kind]
            new_cols.append(agro.temperature_interaction(rescaled[c], kind, th).alias(f"{c}_{suffix}"))
        elif any(k in low for k in ("ppt", "prcp", "precip")) and any(
                k in low for k in ("total", "sum", "season")):
            pfac = 10.0 if "normal" in low else 1.0
            for name, e in agro.precipitation_interactions(_q(c) / pfac, th).items():
                new_cols.append(e.alias(f"{c}_{name}"))
    return out.select(*[_q(c) for c in df.columns], *new_cols)


# --- station (normals) features -------------------------------------------------

TMIN, TMAX, PRCP_N = "DLY-TMIN-NORMAL", "DLY-TMAX-NORMAL", "DLY-PRCP-NORMAL"


def growing_degree_days(df: DataFrame, base: float = 10.0, cap: float = 30.0) -> DataFrame:
    """F1 + W1: daily GDD from (possibly tenths) tmin/tmax and cumulative GDD per station-year."""
    cols = [_q(c) for c in df.columns]
    df, r = agro.with_tenths(df, {TMIN: 100.0, TMAX: 100.0})
    out = df.select(*cols, agro.daily_gdd(r[TMIN], r[TMAX], base, cap).alias("GDD"))
    if "DATE" in df.columns:
        out = out.withColumn("YEAR", F.year("DATE"))
        w = Window.partitionBy("STATION", "YEAR").orderBy("DATE").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("CUMULATIVE_GDD", F.sum("GDD").over(w))
    return out


def frost_free_period(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per station, last frost before Jul 1 and first frost from Jul 1 of the station's first year.

    The reference reads the year from row 0 of the whole frame (D11); here each
    station uses its own first year. Aggregated per (station, year) first; a
    station's frosts before and after the cut come from those few rows.
    """
    tmin = agro.tenths_rescaled(df, TMIN, 100)
    year = F.year("DATE")
    spring, frost = F.col("DATE") < F.make_date(year, F.lit(7), F.lit(1)), tmin <= threshold
    x = df.groupBy("STATION", year.alias("_year")).agg(
        F.max(F.when(frost & spring, F.col("DATE"))).alias("_spring"),
        F.min(F.when(frost, F.col("DATE"))).alias("_any"),
        F.min(F.when(frost & ~spring, F.col("DATE"))).alias("_fall"))
    # the cut is in the first year: later years only add frosts after it
    out = x.groupBy("STATION").agg(
        F.min_by("_spring", "_year").alias("LAST_SPRING_FROST"), F.min("_year").alias("_first"),
        F.min_by("_fall", "_year").alias("_first_fall"), F.sort_array(F.collect_list(F.struct("_year", "_any"))).alias("_y"))
    later = F.array_min(F.transform(F.filter("_y", lambda r: r["_year"] > F.col("_first")), lambda r: r["_any"]))
    out = out.select("STATION", "LAST_SPRING_FROST", F.coalesce("_first_fall", later).alias("FIRST_FALL_FROST"))
    return out.withColumn("FROST_FREE_DAYS", F.datediff("FIRST_FALL_FROST", "LAST_SPRING_FROST"))


def precipitation_features(df: DataFrame, wet: float = 1.0, dry: float = 1.0,
                           season_months: tuple[int, ...] = (4, 5, 6, 7, 8, 9)) -> dict[str, DataFrame]:
    """Monthly totals, growing-season total, wet-day count and longest dry spell.

    Monthly totals use the raw column (as the reference); flags use the rescaled
    one (tenths only if the global max > 1000). Dry spells restart each year and
    are per station; station-years without a dry day are absent.
    """
    prcp = agro.tenths_rescaled(df, PRCP_N, 1000)
    base = df.select("STATION", "DATE", F.year("DATE").alias("YEAR"), F.month("DATE").alias("MONTH"),
                     _q(PRCP_N).alias("_raw"), prcp.alias("_p"))
    monthly = base.groupBy("STATION", "YEAR", "MONTH").agg(F.sum("_raw").alias("MONTHLY_PRCP"))
    season = (monthly.filter(F.col("MONTH").isin(*season_months))
              .groupBy("STATION", "YEAR").agg(F.sum("MONTHLY_PRCP").alias("GROWING_SEASON_PRCP")))
    wet_days = base.groupBy("STATION", "YEAR").agg(F.count_if(F.col("_p") > wet).alias("WET_DAYS_COUNT"))
    flagged = base.withColumn("_dry", agro.flag(F.col("_p") <= dry))
    runs = longest_runs(flagged, "_dry", ["STATION", "YEAR"], ["DATE"], "MAX_CONSECUTIVE_DRY_DAYS")
    dry = (runs.filter(F.col("MAX_CONSECUTIVE_DRY_DAYS").isNotNull())
           .groupBy("STATION", "YEAR").agg(F.max("MAX_CONSECUTIVE_DRY_DAYS").alias("MAX_CONSECUTIVE_DRY_DAYS")))
    return {"monthly_precipitation": monthly, "growing_season_precipitation": season,
            "wet_days": wet_days, "max_consecutive_dry_days": dry}


def station_monthly_aggregates(obs: DataFrame, attrs: tuple[str, ...] = ("STATION",)) -> DataFrame:
    """A4: MEAN / MIN / MAX / SUM of VALUE per station attributes, month and variable."""
    return (obs.withColumn("MONTH", F.month("DATE"))
            .groupBy(*attrs, "MONTH", "VARIABLE")
            .agg(F.avg("VALUE").alias("MEAN"), F.min("VALUE").alias("MIN"),
                 F.max("VALUE").alias("MAX"), F.sum("VALUE").alias("SUM")))


def seasonal_aggregates(monthly: DataFrame, attrs: tuple[str, ...] = ("STATION",)) -> DataFrame:
    """A5: meteorological-season roll-up: mean of means, min of mins, max of maxes, sum of sums."""
    return (monthly.withColumn("SEASON", agro.season_label(F.col("MONTH"), upper=True))
            .groupBy(*attrs, "SEASON", "VARIABLE")
            .agg(F.avg("MEAN").alias("MEAN"), F.min("MIN").alias("MIN"),
                 F.max("MAX").alias("MAX"), F.sum("SUM").alias("SUM")))


def station_climate_features(df: DataFrame) -> dict[str, DataFrame]:
    """GDD frame, frost dates and precipitation features over one scan (season label added)."""
    labelled = df.withColumn("MONTH", F.month("DATE")).withColumn("SEASON", agro.season_label(F.month("DATE")))
    return {"climate_with_gdd": growing_degree_days(labelled),
            "frost_dates": frost_free_period(df),
            "precipitation_features": precipitation_features(df)}
