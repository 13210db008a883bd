"""Registered queries: daily climate features and station-normal features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe.operators import features as FE
from cropframe.operators import integrate, temporal, unit_years
from cropframe.plans import composites
from cropframe.plans.registry import register
from cropframe.plans.sql_views import with_views
from cropframe.session import materialize
from cropframe.sources import bindings as B


def date_str(c) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def _islands_sql(src: str, keys: str, order: str, flag: str, out: str) -> str:
    """CTE chain computing the longest run of ``flag`` rows per keys (lag + running sum)."""
    return f"""
isl_a AS (SELECT {keys}, {order}, {flag} AS f FROM {src}),
isl_b AS (SELECT *, CASE WHEN f = 1 AND coalesce(lag(f) OVER (PARTITION BY {keys} ORDER BY {order}), 0) <> 1
                        THEN 1 ELSE 0 END AS st FROM isl_a),
isl_c AS (SELECT *, sum(st) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS grp FROM isl_b),
isl_d AS (SELECT {keys}, grp, count(*) AS len FROM isl_c WHERE f = 1 GROUP BY {keys}, grp),
{out} AS (SELECT {keys}, max(len) AS {out} FROM isl_d GROUP BY {keys})"""


# F2 + W3 ----------------------------------------------------------------------
@register("heat_stress", "F2,W3,D10,J7", sql=with_views("climate_daily") + "," + _islands_sql(
    "climate_daily", "state_code, year", "date", "CASE WHEN tmax > 30 THEN 1 ELSE 0 END",
    "max_consecutive_heat_days") + """
SELECT a.state_code, a.year, a.hot_days, round(a.hdd, 6) AS heat_degree_days,
       round(a.hsi, 6) AS heat_stress_intensity, m.max_consecutive_heat_days
FROM (SELECT state_code, year, CAST(sum(CASE WHEN tmax > 30 THEN 1 ELSE 0 END) AS BIGINT) AS hot_days,
             sum(CASE WHEN tmax IS NULL THEN 0 ELSE greatest(tmax - 30, 0) END) AS hdd,
             sum(CASE WHEN tmax > 30 THEN tmax - 30 ELSE 0 END) AS hsi
      FROM climate_daily GROUP BY state_code, year) a
LEFT JOIN max_consecutive_heat_days m ON a.state_code = m.state_code AND a.year = m.year""")
def q_heat_stress(spark, sf_dir):
    """F2 + W3: heat degree days, hot-day count, intensity and longest hot spell per state-year."""
    return unit_years.heat_years(B.climate_daily(spark, sf_dir))


# W4 ---------------------------------------------------------------------------
@register("dry_spells", "W4,J7", sql=with_views("climate_daily") + "," + _islands_sql(
    "climate_daily", "state_code, year", "date", "CASE WHEN ppt < 1.0 THEN 1 ELSE 0 END",
    "max_consecutive_dry_days") + """
SELECT a.state_code, a.year, a.dry_days, m.max_consecutive_dry_days
FROM (SELECT state_code, year, CAST(sum(CASE WHEN ppt < 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS dry_days
      FROM climate_daily GROUP BY state_code, year) a
LEFT JOIN max_consecutive_dry_days m ON a.state_code = m.state_code AND a.year = m.year""")
def q_dry_spells(spark, sf_dir):
    """Dry days (< 1) and longest dry spell per state-year."""
    return unit_years.dry_years(B.climate_daily(spark, sf_dir))


# A20 + F4 ---------------------------------------------------------------------
@register("standardized_precip", "A20,F4", sql=with_views("climate_daily") + """,
clim AS (SELECT month, avg(ppt) AS m, stddev_samp(ppt) AS s FROM climate_daily GROUP BY month)
SELECT d.state_code, strftime(d.date, '%Y-%m-%d') AS date,
       round(CASE WHEN c.s <> 0 THEN (d.ppt - c.m) / c.s END, 6) AS standardized_precip
FROM climate_daily d JOIN clim c ON d.month = c.month""")
def q_standardized_precip(spark, sf_dir):
    """A20 + F4: monthly climatology over all rows (12-row broadcast) and standardised precipitation."""
    f = FE.drought_features(materialize(B.climate_daily(spark, sf_dir)))
    return f.select("state_code", date_str("date").alias("date"), "standardized_precip")


# F5 + A31 + W5 ----------------------------------------------------------------
@register("frost_risk", "F5,A31,W5,J7,J8", sql=with_views("climate_daily") + """,
f AS (SELECT *, CASE WHEN tmin <= 0 THEN 1 ELSE 0 END AS fr, dayofyear(date) AS doy FROM climate_daily),
m AS (SELECT state_code, year, month, sum(fr) AS n FROM f GROUP BY ALL)
SELECT a.state_code, a.year, a.frost_days, a.last_spring_frost_day, a.first_fall_frost_day,
       a.first_fall_frost_day - a.last_spring_frost_day AS frost_free_days, b.max_frost_days_in_month
FROM (SELECT state_code, year, CAST(sum(fr) AS BIGINT) AS frost_days,
             CAST(max(CASE WHEN fr = 1 AND doy < 182 THEN doy END) AS INTEGER) AS last_spring_frost_day,
             CAST(min(CASE WHEN fr = 1 AND doy >= 182 THEN doy END) AS INTEGER) AS first_fall_frost_day
      FROM f GROUP BY state_code, year) a
JOIN (SELECT state_code, year, CAST(max(n) AS BIGINT) AS max_frost_days_in_month FROM m GROUP BY ALL) b
  ON a.state_code = b.state_code AND a.year = b.year""")
def q_frost_risk(spark, sf_dir):
    """F5 + A31 + W5: frost days, monthly frost counts, last spring / first fall frost, frost-free days."""
    f = FE.frost_risk_features(B.climate_daily(spark, sf_dir))
    return f.groupBy("state_code", "year").agg(
        F.sum("frost_day").cast("bigint").alias("frost_days"),
        F.first("last_spring_frost_day").alias("last_spring_frost_day"),
        F.first("first_fall_frost_day").alias("first_fall_frost_day"),
        F.first("frost_free_days").alias("frost_free_days"),
        F.max("frost_days_in_month").cast("bigint").alias("max_frost_days_in_month"))


# F6 + F7 ----------------------------------------------------------------------
@register("water_balance_daily", "F6,F7,F15,P3", sql=with_views("climate_daily") + """,
x AS (SELECT state_code, year, month, ppt, tmean, tmax - tmin AS tr, CAST(dayofyear(date) AS DOUBLE) AS j,
             radians(40.0) AS lat FROM climate_daily),
r AS (SELECT *, 0.409 * sin(2 * pi() * j / 365 - 1.39) AS decl FROM x),
w AS (SELECT *, acos(-tan(lat) * tan(decl)) AS ws FROM r),
ra AS (SELECT *, 24 * 60 / pi() * 0.082 * (1 + 0.033 * cos(2 * pi() * j / 365))
                 * (cos(lat) * cos(decl) * sin(ws) + ws * sin(lat) * sin(decl)) AS ra FROM w),
p AS (SELECT *, 0.0023 * (tmean + 17.8) * CASE WHEN tr >= 0 THEN sqrt(tr) END * ra * 0.408 AS pet FROM ra)
SELECT state_code, year, month, round(avg(pet), 6) AS mean_pet, round(sum(ppt - pet), 6) AS water_balance
FROM p GROUP BY state_code, year, month""")
def q_water_balance_daily(spark, sf_dir):
    """F6 + F7: Hargreaves PET from extraterrestrial radiation and P - PET, summed per state-month."""
    f = FE.water_balance_features(materialize(B.climate_daily(spark, sf_dir)))
    return f.groupBy("state_code", "year", "month").agg(
        F.avg("pet").alias("mean_pet"), F.sum("water_balance").alias("water_balance"))


# F8 + A21 ---------------------------------------------------------------------
@register("water_balance_monthly", "F8,A21", sql=with_views("climate_monthly") + """,
i AS (SELECT *, sum(CASE WHEN tmean > 0 THEN pow(tmean / 5, 1.514) ELSE 0 END)
                  OVER (PARTITION BY state_code, year) AS hi FROM climate_monthly),
p AS (SELECT *, CASE WHEN hi > 0 AND tmean > 0 THEN
        16 * pow(10 * tmean / hi, 0.49 + 0.01792 * hi - 0.0000771 * hi * hi)
        * (CASE month WHEN 2 THEN 28 WHEN 4 THEN 30 WHEN 6 THEN 30 WHEN 9 THEN 30 WHEN 11 THEN 30 ELSE 31 END)
        * (CASE WHEN month IN (4, 5, 8, 9) THEN 1.0 WHEN month IN (1, 2, 11, 12) THEN 1.1 ELSE 1.2 END)
        ELSE 0 END AS pet FROM i)
SELECT state_code, year, month, round(hi, 6) AS heat_index, round(pet, 6) AS pet,
       round(ppt - pet, 6) AS water_balance FROM p""")
def q_water_balance_monthly(spark, sf_dir):
    """F8 + A21: Thornthwaite PET with the yearly heat index per state, and P - PET."""
    f = FE.water_balance_features(B.climate_monthly(spark, sf_dir))
    return f.select("state_code", "year", "month", "heat_index", "pet", "water_balance")


# F3 ---------------------------------------------------------------------------
@register("climate_indices", "F3", sql=with_views("climate_daily") + """
SELECT state_code, year, month,
       CAST(sum(CASE WHEN tmean > 30 THEN 1 ELSE 0 END) AS BIGINT) AS heat_stress_days,
       CAST(sum(CASE WHEN tmean < 0 THEN 1 ELSE 0 END) AS BIGINT) AS frost_days,
       CAST(sum(CASE WHEN ppt < 1 THEN 1 ELSE 0 END) AS BIGINT) AS dry_days,
       CAST(sum(CASE WHEN ppt > 10 THEN 1 ELSE 0 END) AS BIGINT) AS wet_days,
       round(avg(ppt / (abs(tmean) + 0.1)), 6) AS mean_aridity_index,
       round(sum(greatest(tmean - 10, 0)), 6) AS gdd_base10, round(sum(greatest(tmean - 30, 0)), 6) AS cdd_base30
FROM climate_daily GROUP BY state_code, year, month""")
def q_climate_indices(spark, sf_dir):
    """daily heat/frost/dry/wet flags and aridity / GDD / CDD indices, per state-month."""
    f = temporal.climate_indices(B.climate_daily(spark, sf_dir))
    return f.groupBy("state_code", "year", "month").agg(
        F.sum("heat_stress_day").cast("bigint").alias("heat_stress_days"),
        F.sum("frost_day").cast("bigint").alias("frost_days"),
        F.sum("dry_day").cast("bigint").alias("dry_days"),
        F.sum("wet_day").cast("bigint").alias("wet_days"),
        F.avg("aridity_index").alias("mean_aridity_index"),
        F.sum("gdd_base10").alias("gdd_base10"), F.sum("cdd_base30").alias("cdd_base30"))


# F11 + F12 --------------------------------------------------------------------
@register("crop_interactions", "F11,F12,F13", sql=with_views("season_stats") + """,
th(crop, lo, hi, stress, frost, plo, phi) AS (VALUES ('CORN', 18.0, 32.0, 35.0, 0.0, 500.0, 800.0),
  ('SOYBEANS', 20.0, 30.0, 35.0, 0.0, 450.0, 700.0), ('WHEAT', 15.0, 28.0, 32.0, -5.0, 350.0, 600.0),
  ('COTTON', 20.0, 32.0, 38.0, 5.0, 500.0, 1000.0), ('RICE', 20.0, 35.0, 40.0, 5.0, 1000.0, 2000.0))
SELECT state_code, year, s.crop,
       round(greatest(lo - growing_season_tmean_mean, 0) + greatest(growing_season_tmean_mean - hi, 0), 6)
         AS growing_season_tmean_mean_ideal_deviation,
       round(greatest(growing_season_tmax_max - stress, 0), 6) AS growing_season_tmax_max_heat_stress,
       round(greatest(frost - growing_season_tmin_min, 0), 6) AS growing_season_tmin_min_frost_risk,
       round(greatest(plo - growing_season_ppt_total, 0) + greatest(growing_season_ppt_total - phi, 0), 6)
         AS growing_season_ppt_total_ideal_deviation,
       round(CASE WHEN growing_season_ppt_total > 0 THEN greatest(plo - growing_season_ppt_total, 0) / plo
             ELSE 1.0 END, 6) AS growing_season_ppt_total_drought_risk,
       round(greatest(growing_season_ppt_total - phi, 0) / phi, 6) AS growing_season_ppt_total_excess_risk
FROM season_stats s JOIN th ON s.crop = th.crop""")
def q_crop_interactions(spark, sf_dir):
    """F11 + F12: every crop's thresholds on its season statistics, all crops in one pass."""
    from cropframe.plans.q_climate import season_stats
    s = season_stats(spark, sf_dir).select(
        "state_code", "year", "crop", "growing_season_tmean_mean", "growing_season_tmax_max",
        "growing_season_tmin_min", "growing_season_ppt_total")
    f = FE.climate_crop_interactions(s, crop_col="crop")
    return f.drop("growing_season_tmean_mean", "growing_season_tmax_max", "growing_season_tmin_min",
                  "growing_season_ppt_total")


# Station normals: F1 + W1 -----------------------------------------------------
_GDD_SQL = "greatest(0, (least(tmax, 30) + greatest(tmin, 10)) / 2 - 10)"


@register("station_gdd", "F1,W1,F17,N12", sql=with_views("station_scaled") + f""",
g AS (SELECT "STATION", "YEAR", "DATE", {_GDD_SQL} AS gdd FROM station_scaled),
c AS (SELECT *, sum(gdd) OVER (PARTITION BY "STATION", "YEAR" ORDER BY "DATE" ROWS UNBOUNDED PRECEDING) AS cum FROM g)
SELECT "STATION", "YEAR", count(*) AS n_days, round(sum(gdd), 6) AS gdd_total, round(max(cum), 6) AS cumulative_gdd_end
FROM c GROUP BY "STATION", "YEAR\"""")
def q_station_gdd(spark, sf_dir):
    """F1 + W1: daily GDD (tenths rescaled by global max) and cumulative GDD per station-year."""
    g = FE.growing_degree_days(B.station_normals(spark, sf_dir))
    return g.groupBy("STATION", "YEAR").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("GDD").alias("gdd_total"),
        F.max("CUMULATIVE_GDD").alias("cumulative_gdd_end"))


# W6 ---------------------------------------------------------------------------
@register("station_frost_free", "W6,D11", sql=with_views("station_scaled") + """,
s AS (SELECT "STATION", "DATE", tmin <= 0 AS fr,
             make_date(CAST(min(year("DATE")) OVER (PARTITION BY "STATION") AS BIGINT), 7, 1) AS cut
      FROM station_scaled),
a AS (SELECT "STATION", max(CASE WHEN fr AND "DATE" < cut THEN "DATE" END) AS lsf,
             min(CASE WHEN fr AND "DATE" >= cut THEN "DATE" END) AS fff FROM s GROUP BY "STATION")
SELECT "STATION", strftime(lsf, '%Y-%m-%d') AS "LAST_SPRING_FROST", strftime(fff, '%Y-%m-%d') AS "FIRST_FALL_FROST",
       CAST(datediff('day', lsf, fff) AS INTEGER) AS "FROST_FREE_DAYS" FROM a""")
def q_station_frost_free(spark, sf_dir):
    """Last spring / first fall frost around Jul 1 of each station's first year, and the gap."""
    f = FE.frost_free_period(B.station_normals(spark, sf_dir))
    return f.select("STATION", date_str("LAST_SPRING_FROST").alias("LAST_SPRING_FROST"),
                    date_str("FIRST_FALL_FROST").alias("FIRST_FALL_FROST"), "FROST_FREE_DAYS")


# A6-A9 ------------------------------------------------------------------------
@register("station_monthly_precip", "A6", sql=with_views("station_scaled") + """
SELECT "STATION", "YEAR", "MONTH", CAST(sum(raw_p) AS BIGINT) AS "MONTHLY_PRCP"
FROM station_scaled GROUP BY ALL""")
def q_station_monthly_precip(spark, sf_dir):
    """Monthly precipitation totals per station (unscaled column)."""
    return FE.precipitation_features(B.station_normals(spark, sf_dir))["monthly_precipitation"].withColumn(
        "MONTHLY_PRCP", F.col("MONTHLY_PRCP").cast("bigint"))


@register("station_season_precip", "A7", sql=with_views("station_scaled") + """
SELECT "STATION", "YEAR", CAST(sum(raw_p) AS BIGINT) AS "GROWING_SEASON_PRCP"
FROM station_scaled WHERE "MONTH" BETWEEN 4 AND 9 GROUP BY ALL""")
def q_station_season_precip(spark, sf_dir):
    """Growing-season (Apr-Sep) precipitation per station-year."""
    return FE.precipitation_features(B.station_normals(spark, sf_dir))["growing_season_precipitation"].withColumn(
        "GROWING_SEASON_PRCP", F.col("GROWING_SEASON_PRCP").cast("bigint"))


@register("station_wet_days", "A8", sql=with_views("station_scaled") + """
SELECT "STATION", "YEAR", count(*) FILTER (WHERE p > 1.0) AS "WET_DAYS_COUNT" FROM station_scaled GROUP BY ALL""")
def q_station_wet_days(spark, sf_dir):
    """Days with precipitation > 1 per station-year."""
    return FE.precipitation_features(B.station_normals(spark, sf_dir))["wet_days"]


@register("station_dry_spells", "A9,W4", sql=with_views("station_scaled") + "," + _islands_sql(
    "station_scaled", '"STATION", "YEAR"', '"DATE"', "CASE WHEN p <= 1.0 THEN 1 ELSE 0 END",
    "MAX_CONSECUTIVE_DRY_DAYS").replace("max(len) AS MAX_CONSECUTIVE_DRY_DAYS",
                                        'max(len) AS "MAX_CONSECUTIVE_DRY_DAYS"') + """
SELECT * FROM MAX_CONSECUTIVE_DRY_DAYS""")
def q_station_dry_spells(spark, sf_dir):
    """Longest dry spell (<= 1) per station-year, restarting each year."""
    years = unit_years.station_years(B.station_normals(spark, sf_dir))
    return years.select("STATION", "YEAR", "MAX_CONSECUTIVE_DRY_DAYS").where(F.col("MAX_CONSECUTIVE_DRY_DAYS").isNotNull())


# J5 + A16-A18 + W2 + F16 ------------------------------------------------------
def _station_crop(spark, sf_dir) -> DataFrame:
    """J5 on one read of the normals; written once (a row a crop and year) for the statistics over it."""
    c = B.crop_census(spark, sf_dir).select(F.col("year").alias("YEAR"), F.col("crop").alias("CROP"),
                                           F.col("yield").alias("YIELD"))
    return materialize(unit_years.crop_years(c, unit_years.station_years(B.station_normals(spark, sf_dir))), "station-crop")


_STATION_CROP_SQL = with_views("station_scaled", "crop_census") + f""",
gdd AS (SELECT "YEAR", avg({_GDD_SQL}) AS "AVG_GDD" FROM station_scaled GROUP BY "YEAR"),
sp AS (SELECT "STATION", "YEAR", sum(raw_p) AS gsp FROM station_scaled WHERE "MONTH" BETWEEN 4 AND 9 GROUP BY ALL),
nsp AS (SELECT "YEAR", avg(gsp) AS "GROWING_SEASON_PRCP" FROM sp GROUP BY "YEAR"),
s AS (SELECT "STATION", "DATE", tmin <= 0 AS fr,
             make_date(CAST(min(year("DATE")) OVER (PARTITION BY "STATION") AS BIGINT), 7, 1) AS cut
      FROM station_scaled),
fr AS (SELECT "STATION", datediff('day', max(CASE WHEN fr AND "DATE" < cut THEN "DATE" END),
                                         min(CASE WHEN fr AND "DATE" >= cut THEN "DATE" END)) AS ffd
       FROM s GROUP BY "STATION"),
base AS (
  SELECT c.year AS "YEAR", c.crop AS "CROP", c.yield AS "YIELD", g."AVG_GDD", n."GROWING_SEASON_PRCP",
         (SELECT avg(ffd) FROM fr) AS "AVG_FROST_FREE_DAYS"
  FROM crop_census c LEFT JOIN gdd g ON c.year = g."YEAR" LEFT JOIN nsp n ON c.year = n."YEAR")"""


@register("station_crop_features", "J5,A16,A17,A18", sql=_STATION_CROP_SQL + """
SELECT "YEAR", "CROP", round("YIELD", 6) AS "YIELD", round("AVG_GDD", 6) AS "AVG_GDD",
       round("GROWING_SEASON_PRCP", 6) AS "GROWING_SEASON_PRCP",
       round("AVG_FROST_FREE_DAYS", 6) AS "AVG_FROST_FREE_DAYS" FROM base""")
def q_station_crop_features(spark, sf_dir):
    """J5 + A16-A18: crop yields with annual mean GDD, national season precipitation, mean frost-free days."""
    return _station_crop(spark, sf_dir)


@register("yield_features", "W2,F16,A22,X5", sql=_STATION_CROP_SQL + """,
l AS (SELECT *, lag("YIELD") OVER (PARTITION BY "CROP" ORDER BY "YEAR") AS "PREV_YIELD",
             "AVG_GDD" * "GROWING_SEASON_PRCP" AS "GDD_PRCP_INTERACTION" FROM base)
SELECT "YEAR", "CROP", round("YIELD", 6) AS "YIELD", round("PREV_YIELD", 6) AS "PREV_YIELD",
       round("YIELD" - "PREV_YIELD", 6) AS "YIELD_CHANGE",
       round(("YIELD" - "PREV_YIELD") / "PREV_YIELD" * 100, 6) AS "YIELD_CHANGE_PCT",
       round("GDD_PRCP_INTERACTION", 6) AS "GDD_PRCP_INTERACTION",
       round(("AVG_GDD" - avg("AVG_GDD") OVER ()) / stddev_samp("AVG_GDD") OVER (), 6) AS "AVG_GDD_NORM",
       round(("GROWING_SEASON_PRCP" - avg("GROWING_SEASON_PRCP") OVER ())
             / stddev_samp("GROWING_SEASON_PRCP") OVER (), 6) AS "GROWING_SEASON_PRCP_NORM",
       round(("GDD_PRCP_INTERACTION" - avg("GDD_PRCP_INTERACTION") OVER ())
             / stddev_samp("GDD_PRCP_INTERACTION") OVER (), 6) AS "GDD_PRCP_INTERACTION_NORM"
FROM l""")
def q_yield_features(spark, sf_dir):
    """Lagged yield per crop (W2), GDD x precipitation interaction (F16), z-scores (A22, _NORM)."""
    f = integrate.engineer_yield_features(_station_crop(spark, sf_dir))
    return f.select("YEAR", "CROP", "YIELD", "PREV_YIELD", "YIELD_CHANGE", "YIELD_CHANGE_PCT",
                    "GDD_PRCP_INTERACTION", "AVG_GDD_NORM", "GROWING_SEASON_PRCP_NORM", "GDD_PRCP_INTERACTION_NORM")


# A4 / A5 / A24 / J6 / S7 --------------------------------------------------------
@register("station_monthly_aggregates", "A4", sql=with_views("station_obs") + """
SELECT "STATION", CAST(month("DATE") AS INTEGER) AS "MONTH", "VARIABLE", round(avg("VALUE"), 6) AS "MEAN",
       round(min("VALUE"), 6) AS "MIN", round(max("VALUE"), 6) AS "MAX", round(sum("VALUE"), 6) AS "SUM"
FROM station_obs GROUP BY ALL""")
def q_station_monthly_aggregates(spark, sf_dir):
    """S7 + A4: long station readings -> MEAN/MIN/MAX/SUM per station, month, variable."""
    return FE.station_monthly_aggregates(B.station_observations(spark, sf_dir))


@register("station_seasonal_aggregates", "A5,F14,D6", sql=with_views("station_obs") + """,
m AS (SELECT "STATION", CAST(month("DATE") AS INTEGER) AS "MONTH", "VARIABLE", avg("VALUE") AS mean_v,
             min("VALUE") AS min_v, max("VALUE") AS max_v, sum("VALUE") AS sum_v FROM station_obs GROUP BY ALL)
SELECT "STATION", CASE WHEN "MONTH" IN (12, 1, 2) THEN 'WINTER' WHEN "MONTH" IN (3, 4, 5) THEN 'SPRING'
                       WHEN "MONTH" IN (6, 7, 8) THEN 'SUMMER' ELSE 'FALL' END AS "SEASON", "VARIABLE",
       round(avg(mean_v), 6) AS "MEAN", round(min(min_v), 6) AS "MIN", round(max(max_v), 6) AS "MAX",
       round(sum(sum_v), 6) AS "SUM"
FROM m GROUP BY ALL""")
def q_station_seasonal_aggregates(spark, sf_dir):
    """A5: seasonal roll-up of the monthly aggregates (mean of means, min of mins, ...)."""
    return FE.seasonal_aggregates(FE.station_monthly_aggregates(B.station_observations(spark, sf_dir)))


#: The variables of the given table.
_EVENT_TYPES = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]


@register("station_variable_pivot", "A24,N10", sql=with_views("station_obs") + """
SELECT "STATION", strftime("DATE", '%Y-%m-%d') AS "DATE", """ + ", ".join(
    f"round(avg(CASE WHEN \"VARIABLE\" = '{v}' THEN \"VALUE\" END), 6) AS \"DLY-{v}-NORMAL\"" for v in _EVENT_TYPES)
    + """ FROM station_obs GROUP BY "STATION", "DATE\"""")
def q_station_variable_pivot(spark, sf_dir):
    """Long readings pivoted to one mean column per listed variable."""
    w = integrate.station_variable_pivot(B.station_observations(spark, sf_dir), _EVENT_TYPES)
    return w.withColumn("DATE", date_str("DATE"))


@register("station_variable_map", "A24,N10", sql=with_views("station_obs") + """,
m AS (SELECT "STATION", "DATE", "VARIABLE", avg("VALUE") AS v FROM station_obs WHERE "VARIABLE" IS NOT NULL GROUP BY ALL)
SELECT "STATION", strftime("DATE", '%Y-%m-%d') AS "DATE", CAST(count(*) AS INTEGER) AS n_variables,
       string_agg('DLY-' || "VARIABLE" || '-NORMAL', ',' ORDER BY "VARIABLE") AS variables, round(sum(v), 6) AS total
FROM m GROUP BY "STATION", "DATE\"""")
def q_station_variable_map(spark, sf_dir):
    """A24 with an open set of variables: a map of means per station-day, here its size, names and sum."""
    w = integrate.station_variable_pivot(B.station_observations(spark, sf_dir))
    total = F.aggregate(F.map_values("VALUES"), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return w.select("STATION", date_str("DATE").alias("DATE"), F.size("VALUES").alias("n_variables"),
                    F.array_join(F.map_keys("VALUES"), ",").alias("variables"), total.alias("total"))


@register("station_metadata_join", "J6", sql=with_views("station_normals", "station_metadata") + """
SELECT s."STATION", count(*) AS n_days, max(s."DLY-TMAX-NORMAL") AS max_tmax, m."STATION_NAME",
       round(m."LATITUDE", 6) AS "LATITUDE", round(m."LONGITUDE", 6) AS "LONGITUDE",
       round(m."ELEVATION", 6) AS "ELEVATION"
FROM station_normals s LEFT JOIN station_metadata m ON s."STATION" = m."STATION"
GROUP BY s."STATION", m."STATION_NAME", m."LATITUDE", m."LONGITUDE", m."ELEVATION\"""")
def q_station_metadata_join(spark, sf_dir):
    """Station summaries left-joined with station attributes."""
    st = (B.station_normals(spark, sf_dir).groupBy("STATION")
          .agg(F.count(F.lit(1)).alias("n_days"), F.max("DLY-TMAX-NORMAL").alias("max_tmax")))
    return integrate.attach_station_metadata(st, B.station_metadata(spark, sf_dir))


# X1 -----------------------------------------------------------------------------
@register("station_climate_summary", "X1,F1,W1,W6,A7,A8,A9,F14", sql=with_views("station_scaled") + "," + _islands_sql(
    "station_scaled", '"STATION", "YEAR"', '"DATE"', "CASE WHEN p <= 1.0 THEN 1 ELSE 0 END", "dry") + f""",
gy AS (SELECT "STATION", "YEAR", count(*) AS n_days, sum({_GDD_SQL}) AS gdd_total,
              count(*) FILTER (WHERE p > 1.0) AS "WET_DAYS_COUNT",
              count(DISTINCT CASE WHEN "MONTH" IN (12, 1, 2) THEN 'WINTER' WHEN "MONTH" IN (3, 4, 5) THEN 'SPRING'
                                  WHEN "MONTH" IN (6, 7, 8) THEN 'SUMMER' ELSE 'FALL' END) AS n_seasons
       FROM station_scaled GROUP BY "STATION", "YEAR"),
sp AS (SELECT "STATION", "YEAR", CAST(sum(raw_p) AS BIGINT) AS "GROWING_SEASON_PRCP"
       FROM station_scaled WHERE "MONTH" BETWEEN 4 AND 9 GROUP BY ALL),
fs AS (SELECT "STATION", "DATE", tmin <= 0 AS fr,
              make_date(CAST(min(year("DATE")) OVER (PARTITION BY "STATION") AS BIGINT), 7, 1) AS cut
       FROM station_scaled),
fr AS (SELECT "STATION", CAST(datediff('day', max(CASE WHEN fr AND "DATE" < cut THEN "DATE" END),
                                      min(CASE WHEN fr AND "DATE" >= cut THEN "DATE" END)) AS INTEGER) AS "FROST_FREE_DAYS"
       FROM fs GROUP BY "STATION")
SELECT gy."STATION", gy."YEAR", gy.n_days, round(gy.gdd_total, 6) AS gdd_total, gy.n_seasons,
       sp."GROWING_SEASON_PRCP", gy."WET_DAYS_COUNT", dry.dry AS "MAX_CONSECUTIVE_DRY_DAYS", fr."FROST_FREE_DAYS"
FROM gy LEFT JOIN sp ON gy."STATION" = sp."STATION" AND gy."YEAR" = sp."YEAR"
LEFT JOIN dry ON gy."STATION" = dry."STATION" AND gy."YEAR" = dry."YEAR"
LEFT JOIN fr ON gy."STATION" = fr."STATION\"""")
def q_station_climate_summary(spark, sf_dir):
    """GDD, seasons, frost window and precipitation features per station-year, from one read of the normals."""
    years = unit_years.station_years(B.station_normals(spark, sf_dir))
    return (years.withColumn("GROWING_SEASON_PRCP", F.col("GROWING_SEASON_PRCP").cast("bigint"))
            .join(unit_years.frost_free(years).select("STATION", "FROST_FREE_DAYS"), "STATION", "left")
            .select("STATION", "YEAR", "n_days", "gdd_total", "n_seasons", "GROWING_SEASON_PRCP", "WET_DAYS_COUNT",
                    "MAX_CONSECUTIVE_DRY_DAYS", "FROST_FREE_DAYS"))


# X2 daily chain -----------------------------------------------------------------
_RUNS = """
{n}_a AS (SELECT state_code, year, date, {flag} AS f FROM climate_daily),
{n}_b AS (SELECT *, CASE WHEN f = 1 AND coalesce(lag(f) OVER (PARTITION BY state_code, year ORDER BY date), 0) <> 1
                         THEN 1 ELSE 0 END AS st FROM {n}_a),
{n}_c AS (SELECT *, sum(st) OVER (PARTITION BY state_code, year ORDER BY date ROWS UNBOUNDED PRECEDING) AS grp
          FROM {n}_b),
{n} AS (SELECT state_code, year, max(len) AS len FROM (SELECT state_code, year, count(*) AS len FROM {n}_c
        WHERE f = 1 GROUP BY state_code, year, grp) GROUP BY state_code, year)"""

#: CTE ``chain``: every region-day with its heat, drought, frost and water-balance columns.
CHAIN_SQL = "," + _RUNS.format(n="hot", flag="CASE WHEN tmax > 30 THEN 1 ELSE 0 END") + "," + _RUNS.format(
    n="dry", flag="CASE WHEN ppt < 1.0 THEN 1 ELSE 0 END") + """,
clim AS (SELECT month, avg(ppt) AS m, stddev_samp(ppt) AS s FROM climate_daily GROUP BY month),
fr AS (SELECT *, CASE WHEN tmin <= 0 THEN 1 ELSE 0 END AS f, CAST(dayofyear(date) AS INTEGER) AS doy,
              0.409 * sin(2 * pi() * dayofyear(date) / 365 - 1.39) AS decl, radians(40.0) AS lat FROM climate_daily),
ra AS (SELECT *, acos(-tan(lat) * tan(decl)) AS ws FROM fr),
pe AS (SELECT *, 0.0023 * (tmean + 17.8) * CASE WHEN tmax - tmin >= 0 THEN sqrt(tmax - tmin) END * 0.408
         * 24 * 60 / pi() * 0.082 * (1 + 0.033 * cos(2 * pi() * doy / 365))
         * (cos(lat) * cos(decl) * sin(ws) + ws * sin(lat) * sin(decl)) AS pet FROM ra),
chain AS (SELECT p.month, p.state_code, p.date, p.year, p.day, p.tmean, p.tmin, p.tmax, p.ppt,
  CASE WHEN p.tmax IS NULL THEN 0.0 ELSE greatest(p.tmax - 30, 0) END AS heat_degree_days,
  CASE WHEN p.tmax > 30 THEN 1 ELSE 0 END AS extreme_heat_day,
  CASE WHEN p.tmax > 30 THEN p.tmax - 30 ELSE 0.0 END AS heat_stress_intensity,
  hot.len AS max_consecutive_heat_days, CASE WHEN p.ppt < 1.0 THEN 1 ELSE 0 END AS dry_day,
  dry.len AS max_consecutive_dry_days, CASE WHEN clim.s <> 0 THEN (p.ppt - clim.m) / clim.s END AS standardized_precip,
  p.f AS frost_day, sum(p.f) OVER (PARTITION BY p.state_code, p.year, p.month) AS frost_days_in_month,
  max(CASE WHEN p.f = 1 AND doy < 182 THEN doy END) OVER (PARTITION BY p.state_code, p.year) AS last_spring_frost_day,
  min(CASE WHEN p.f = 1 AND doy >= 182 THEN doy END) OVER (PARTITION BY p.state_code, p.year) AS first_fall_frost_day,
  min(CASE WHEN p.f = 1 AND doy >= 182 THEN doy END) OVER (PARTITION BY p.state_code, p.year)
    - max(CASE WHEN p.f = 1 AND doy < 182 THEN doy END) OVER (PARTITION BY p.state_code, p.year) AS frost_free_days,
  p.pet, p.ppt - p.pet AS water_balance
  FROM pe p LEFT JOIN hot ON p.state_code = hot.state_code AND p.year = hot.year
  LEFT JOIN dry ON p.state_code = dry.state_code AND p.year = dry.year LEFT JOIN clim ON p.month = clim.month)"""

#: Derived columns of the chain, in order.
DERIVED = ["heat_degree_days", "extreme_heat_day", "heat_stress_intensity", "max_consecutive_heat_days", "dry_day",
           "max_consecutive_dry_days", "standardized_precip", "frost_day", "frost_days_in_month",
           "last_spring_frost_day", "first_fall_frost_day", "frost_free_days", "pet", "water_balance"]


_CELL_SQL = """WITH climate_daily AS (
  SELECT 'C' || CAST(o.o_custkey AS VARCHAR) AS state_code, CAST(l.l_shipdate AS DATE) AS date,
         CAST(year(l.l_shipdate) AS INTEGER) AS year, CAST(month(l.l_shipdate) AS INTEGER) AS month,
         CAST(day(l.l_shipdate) AS INTEGER) AS day,
         avg(l.l_quantity) - 10 AS tmean, min(l.l_quantity) - 10 AS tmin, max(l.l_quantity) - 10 AS tmax,
         CAST(0.4 AS DOUBLE) * CAST(sum(CAST(round(l.l_discount * 100) AS INTEGER)) AS DOUBLE) AS ppt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY ALL)"""
_CELL_DOUBLES = ("heat_degree_days", "heat_stress_intensity", "standardized_precip", "pet", "water_balance")


@register("cell_feature_chain", "X2,F2,F4,F5,F7,W3,W4,W5,A20,A31", sql=_CELL_SQL + CHAIN_SQL + """
SELECT state_code AS cell, strftime(date, '%Y-%m-%d') AS date, """ + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c in _CELL_DOUBLES else f"CAST({c} AS BIGINT) AS {c}" for c in DERIVED)
          + " FROM chain")
def q_cell_feature_chain(spark, sf_dir):
    """X2 daily part over grid cells that grow with the data: one cell per customer, one row per cell-day."""
    days = materialize(B.cell_daily(spark, sf_dir)).repartition(B.task_count(spark, sf_dir), "state_code", "year")
    f = composites.climate_features_for_modeling(days)
    return f.select(F.col("state_code").alias("cell"), date_str("date").alias("date"), *DERIVED)


@register("daily_feature_chain", "X2,F2,F4,F5,F7,W3,W4,W5,A20,A31", sql=with_views("climate_daily") + CHAIN_SQL + """
SELECT month, state_code, strftime(date, '%Y-%m-%d') AS date, year, day, """ + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("tmean", "tmin", "tmax", "ppt", "heat_degree_days",
                                                      "heat_stress_intensity", "standardized_precip", "pet",
                                                      "water_balance")) + ", " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" for c in DERIVED if c not in ("heat_degree_days", "heat_stress_intensity",
                                                               "standardized_precip", "pet", "water_balance"))
          + " FROM chain")
def q_daily_feature_chain(spark, sf_dir):
    """X2 daily part: heat, drought, frost and water-balance columns on every region-day."""
    f = composites.climate_features_for_modeling(materialize(B.climate_daily(spark, sf_dir)))
    return f.withColumn("date", date_str("date"))
