"""Registered queries: growing-season and critical-period filters, season statistics, phenology."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropframe.operators import spatial, temporal
from cropframe.plans import composites
from cropframe.plans.q_features import CHAIN_SQL, DERIVED
from cropframe.plans.registry import register
from cropframe.plans.sql_views import with_views
from cropframe.session import materialize
from cropframe.sources import bindings as B

# SQL calendar (independent of the Python calendar code): base season, periods, shifts, state regions.
_CAL_SQL = """,
cal(crop, sm, sd, em, ed) AS (VALUES ('CORN', 4, 15, 9, 30), ('SOYBEANS', 5, 1, 10, 15), ('WHEAT', 9, 1, 7, 15),
  ('COTTON', 4, 1, 10, 31), ('RICE', 3, 15, 9, 15)),
shifts(crop, region, s, e) AS (VALUES
  ('CORN', 'Northern', 15, -10), ('CORN', 'Central', 0, 0), ('CORN', 'Southern', -15, 10),
  ('SOYBEANS', 'Northern', 10, -10), ('SOYBEANS', 'Central', 0, 0), ('SOYBEANS', 'Southern', -10, 5),
  ('WHEAT', 'Northern', 0, 10), ('WHEAT', 'Central', 0, 0), ('WHEAT', 'Southern', 0, -10),
  ('COTTON', 'Northern', 20, -15), ('COTTON', 'Central', 10, -5), ('COTTON', 'Southern', 0, 0),
  ('RICE', 'Northern', 15, -10), ('RICE', 'Central', 5, -5), ('RICE', 'Southern', 0, 0)),
periods(crop, idx, name, sm, sd, em, ed) AS (VALUES
  ('CORN', 0, 'planting', 4, 15, 5, 31), ('CORN', 1, 'vegetative', 6, 1, 7, 15),
  ('CORN', 2, 'reproductive', 7, 16, 8, 31), ('CORN', 3, 'maturation', 9, 1, 9, 30),
  ('SOYBEANS', 0, 'planting', 5, 1, 5, 31), ('SOYBEANS', 1, 'vegetative', 6, 1, 7, 31),
  ('SOYBEANS', 2, 'reproductive', 8, 1, 9, 15), ('SOYBEANS', 3, 'maturation', 9, 16, 10, 15),
  ('WHEAT', 0, 'fall_planting', 9, 1, 10, 31), ('WHEAT', 1, 'winter_dormancy', 11, 1, 2, 28),
  ('WHEAT', 2, 'spring_growth', 3, 1, 5, 31), ('WHEAT', 3, 'grain_fill', 6, 1, 7, 15),
  ('COTTON', 0, 'planting', 4, 1, 5, 15), ('COTTON', 1, 'vegetative', 5, 16, 7, 15),
  ('COTTON', 2, 'flowering', 7, 16, 8, 31), ('COTTON', 3, 'boll_development', 9, 1, 10, 31),
  ('RICE', 0, 'planting', 3, 15, 4, 30), ('RICE', 1, 'vegetative', 5, 1, 6, 30),
  ('RICE', 2, 'reproductive', 7, 1, 8, 15), ('RICE', 3, 'maturation', 8, 16, 9, 15)),
regions(state_code, region) AS (VALUES ('IL', 'Central'), ('IA', 'Central'), ('NE', 'Central'),
  ('IN', 'Central'), ('MN', 'Northern')),
sadj AS (SELECT c.crop, s.region, make_date(2020, c.sm, c.sd) + s.s AS a, make_date(2020, c.em, c.ed) + s.e AS b
         FROM cal c JOIN shifts s ON c.crop = s.crop),
sdays AS (SELECT crop, region, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day
          FROM (SELECT crop, region, unnest(generate_series(
                  make_date(2019, month(a), day(a)),
                  make_date(CASE WHEN month(b) < month(a) THEN 2020 ELSE 2019 END, month(b), day(b)),
                  INTERVAL 1 DAY)) AS d FROM sadj)),
padj AS (SELECT p.crop, s.region, p.idx, p.name,
           make_date(2020, p.sm, p.sd) + CASE WHEN p.name IN ('planting', 'fall_planting') THEN s.s
             WHEN p.name IN ('maturation', 'grain_fill', 'boll_development') THEN CAST(trunc(s.e * 0.5) AS INTEGER)
             ELSE CAST(trunc(s.s * 0.3) AS INTEGER) END AS a,
           make_date(2020, p.em, p.ed) + CASE WHEN p.name IN ('planting', 'fall_planting')
             THEN CAST(trunc(s.s * 0.5) AS INTEGER)
             WHEN p.name IN ('maturation', 'grain_fill', 'boll_development') THEN s.e
             ELSE CAST(trunc(s.e * 0.3) AS INTEGER) END AS b
         FROM periods p JOIN shifts s ON p.crop = s.crop),
pdays AS (SELECT crop, region, idx, name, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day
          FROM (SELECT crop, region, idx, name, unnest(generate_series(
                  make_date(2019, month(a), day(a)),
                  make_date(CASE WHEN month(b) < month(a) THEN 2020 ELSE 2019 END, month(b), day(b)),
                  INTERVAL 1 DAY)) AS d FROM padj))"""


# P4 ---------------------------------------------------------------------------
@register("growing_season_daily", "P4,F9,F10,J12", sql=with_views("climate_daily") + _CAL_SQL + """
SELECT d.state_code, d.year, count(*) AS n_days, round(sum(d.ppt), 6) AS ppt_total, round(avg(d.tmean), 6) AS tmean
FROM climate_daily d JOIN regions r ON d.state_code = r.state_code
JOIN sdays s ON s.crop = 'CORN' AND s.region = r.region AND s.month = d.month AND s.day = d.day
GROUP BY d.state_code, d.year""")
def q_growing_season_daily(spark, sf_dir):
    """Daily rows inside CORN's season adjusted to each row's state region (broadcast semi join)."""
    f = temporal.filter_growing_season(B.climate_daily(spark, sf_dir), "CORN")
    return f.groupBy("state_code", "year").agg(F.count(F.lit(1)).alias("n_days"),
                                               F.sum("ppt").alias("ppt_total"), F.avg("tmean").alias("tmean"))


@register("growing_season_daily_wheat", "P4,F10", sql=with_views("climate_daily") + _CAL_SQL + """
SELECT d.state_code, d.month, count(*) AS n_days
FROM climate_daily d JOIN regions r ON d.state_code = r.state_code
JOIN sdays s ON s.crop = 'WHEAT' AND s.region = r.region AND s.month = d.month AND s.day = d.day
GROUP BY d.state_code, d.month""")
def q_growing_season_daily_wheat(spark, sf_dir):
    """P4 on a year-wrapping season (WHEAT; the wrapped range includes Feb 29)."""
    f = temporal.filter_growing_season(B.climate_daily(spark, sf_dir), "WHEAT")
    return f.groupBy("state_code", "month").agg(F.count(F.lit(1)).alias("n_days"))


# P5 ---------------------------------------------------------------------------
@register("growing_season_monthly", "P5", sql=with_views("climate_monthly") + """
SELECT state_code, year, month, round(tmean, 6) AS tmean, round(ppt, 6) AS ppt
FROM climate_monthly WHERE month >= 9 OR month <= 7""")
def q_growing_season_monthly(spark, sf_dir):
    """P5: monthly rows inside WHEAT's (wrapping) season."""
    f = temporal.filter_growing_season(B.climate_monthly(spark, sf_dir), "WHEAT")
    return f.select("state_code", "year", "month", "tmean", "ppt")


@register("growing_season_crops", "P4,F9,F10,J12", sql=with_views("climate_daily") + _CAL_SQL + """
SELECT s.crop, d.state_code, d.year, count(*) AS n_days, round(sum(d.ppt), 6) AS ppt_total,
       round(avg(d.tmean), 6) AS tmean
FROM climate_daily d JOIN regions r ON d.state_code = r.state_code
JOIN sdays s ON s.region = r.region AND s.month = d.month AND s.day = d.day
GROUP BY s.crop, d.state_code, d.year""")
def q_growing_season_crops(spark, sf_dir):
    """P4 for all five crops in one job: each day counts for every crop whose adjusted season holds it."""
    f = temporal.season_days_by_crop(B.climate_daily(spark, sf_dir))
    return f.groupBy("crop", "state_code", "year").agg(F.count(F.lit(1)).alias("n_days"),
                                                       F.sum("ppt").alias("ppt_total"), F.avg("tmean").alias("tmean"))


@register("critical_period_crops", "P6,F9,F10", sql=with_views("climate_daily") + _CAL_SQL + """
SELECT p.crop, p.name AS period, d.state_code, d.year, count(*) AS n_days, round(avg(d.tmax), 6) AS tmax
FROM climate_daily d JOIN regions r ON d.state_code = r.state_code
JOIN pdays p ON p.region = r.region AND p.month = d.month AND p.day = d.day
GROUP BY p.crop, p.name, d.state_code, d.year""")
def q_critical_period_crops(spark, sf_dir):
    """P6 for all critical periods of all five crops in one job."""
    f = temporal.period_days_by_crop(B.climate_daily(spark, sf_dir))
    return f.groupBy("crop", "period", "state_code", "year").agg(F.count(F.lit(1)).alias("n_days"),
                                                                 F.avg("tmax").alias("tmax"))


# P6 / P7 ----------------------------------------------------------------------
@register("critical_period_daily", "P6,F9", sql=with_views("climate_daily") + _CAL_SQL + """
SELECT d.state_code, d.year, count(*) AS n_days, round(avg(d.tmax), 6) AS tmax
FROM climate_daily d JOIN regions r ON d.state_code = r.state_code
JOIN pdays p ON p.crop = 'CORN' AND p.name = 'reproductive' AND p.region = r.region
  AND p.month = d.month AND p.day = d.day
GROUP BY d.state_code, d.year""")
def q_critical_period_daily(spark, sf_dir):
    """Daily rows inside CORN's adjusted reproductive period."""
    f = temporal.filter_critical_period(B.climate_daily(spark, sf_dir), "CORN", "reproductive")
    return f.groupBy("state_code", "year").agg(F.count(F.lit(1)).alias("n_days"), F.avg("tmax").alias("tmax"))


@register("critical_period_monthly", "P7", sql=with_views("climate_monthly") + """
SELECT state_code, year, month, round(tmin, 6) AS tmin FROM climate_monthly WHERE month IN (11, 12, 1, 2)""")
def q_critical_period_monthly(spark, sf_dir):
    """Months overlapping WHEAT's (unadjusted, wrapping) winter dormancy."""
    f = temporal.filter_critical_period(B.climate_monthly(spark, sf_dir), "WHEAT", "winter_dormancy")
    return f.select("state_code", "year", "month", "tmin")


# A13 + A14 + A35 ----------------------------------------------------------------
_VARS = [("tmean", "temperature_mean"), ("tmin", "temperature_min"), ("tmax", "temperature_max")]
_PERIODS = {"CORN": ("planting", "vegetative", "reproductive", "maturation"),
            "WHEAT": ("fall_planting", "winter_dormancy", "spring_growth", "grain_fill")}


def _a13_sql(crop: str) -> str:
    periods = _PERIODS[crop]
    return (with_views("climate_daily") + _CAL_SQL + f""",
sd AS (SELECT d.* FROM climate_daily d JOIN regions r ON d.state_code = r.state_code
       JOIN sdays s ON s.crop = '{crop}' AND s.region = r.region AND s.month = d.month AND s.day = d.day),
st AS (SELECT state_code, year, """
            + ", ".join(f"avg({c}) AS {n}_mean, min({c}) AS {n}_min, max({c}) AS {n}_max" for c, n in _VARS)
            + f""", coalesce(sum(greatest(tmean - 10, 0)), 0) AS gdd_base10,
       coalesce(sum(greatest(tmin - 10, 0)), 0) AS gdd_base10_temperature_min,
       coalesce(sum(greatest(least(tmax, 30) - 10, 0)), 0) AS gdd_base10_temperature_max,
       coalesce(sum(ppt), 0) AS precipitation_total, max(ppt) AS precipitation_max_daily,
       count(*) FILTER (WHERE ppt > 0) AS days_with_rain
  FROM sd GROUP BY state_code, year),
pd AS (SELECT d.*, p.name FROM climate_daily d JOIN regions r ON d.state_code = r.state_code
       JOIN pdays p ON p.crop = '{crop}' AND p.region = r.region AND p.month = d.month AND p.day = d.day),
ps AS (SELECT state_code, year, """
            + ", ".join(f"avg(CASE WHEN name = '{p}' THEN {c} END) AS {p}_{n}_mean" for p in periods for c, n in _VARS)
            + ", " + ", ".join(
                f"CASE WHEN count(*) FILTER (WHERE name = '{p}') > 0 THEN coalesce(sum(CASE WHEN name = '{p}' "
                f"THEN ppt END), 0) END AS {p}_precipitation_total" for p in periods)
            + """ FROM pd GROUP BY state_code, year)
SELECT st.*, """ + ", ".join(f"ps.{p}_{n}_mean" for p in periods for _, n in _VARS)
            + ", " + ", ".join(f"ps.{p}_precipitation_total" for p in periods)
            + " FROM st LEFT JOIN ps ON st.state_code = ps.state_code AND st.year = ps.year")


def _round_all_sql(sql: str, cols: list[str], keep: list[str]) -> str:
    return ("SELECT " + ", ".join(keep) + ", " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)
            + " FROM (" + sql + ") q")


def _a13_cols(crop: str) -> list[str]:
    return ([f"{n}_{s}" for _, n in _VARS for s in ("mean", "min", "max")]
            + ["gdd_base10", "gdd_base10_temperature_min", "gdd_base10_temperature_max",
               "precipitation_total", "precipitation_max_daily"]
            + [f"{p}_{n}_mean" for p in _PERIODS[crop] for _, n in _VARS]
            + [f"{p}_precipitation_total" for p in _PERIODS[crop]])


@register("season_statistics_daily", "A13,A14,A35,D8",
          sql=_round_all_sql(_a13_sql("CORN"), _a13_cols("CORN"), ["state_code", "year", "days_with_rain"]))
def q_season_statistics_daily(spark, sf_dir):
    """A13 + A14 + A35: season and critical-period statistics of CORN per state-year, one aggregate each."""
    return temporal.season_statistics(B.climate_daily(spark, sf_dir).drop("date"), "CORN",
                                      keys=["state_code", "year"])


@register("season_statistics_daily_wheat", "A13,A14,A35,F10",
          sql=_round_all_sql(_a13_sql("WHEAT"), _a13_cols("WHEAT"), ["state_code", "year", "days_with_rain"]))
def q_season_statistics_daily_wheat(spark, sf_dir):
    """A13 + A14 on a year-wrapping season and period (WHEAT; winter dormancy spans Nov-Feb)."""
    return temporal.season_statistics(B.climate_daily(spark, sf_dir).drop("date"), "WHEAT",
                                      keys=["state_code", "year"])


# X2 with a crop -------------------------------------------------------------------
def _x2_sql(crop: str) -> str:
    """Season and period statistics of the weather and derived columns, and the crop's interactions."""
    lo, hi, stress, frost, plo, phi = (18.0, 32.0, 35.0, 0.0, 500.0, 800.0)
    cols, periods = [*_VARS, *[(c, c) for c in DERIVED]], _PERIODS[crop]
    season = [f"{f}({c}) AS {n}_{s}" for c, n in cols for f, s in (("avg", "mean"), ("min", "min"), ("max", "max"))]
    season += ["coalesce(sum(greatest(tmean - 10, 0)), 0) AS gdd_base10",
               "coalesce(sum(greatest(tmin - 10, 0)), 0) AS gdd_base10_temperature_min",
               "coalesce(sum(greatest(least(tmax, 30) - 10, 0)), 0) AS gdd_base10_temperature_max",
               "coalesce(sum(ppt), 0) AS precipitation_total", "max(ppt) AS precipitation_max_daily",
               "count(*) FILTER (WHERE ppt > 0) AS days_with_rain"]
    period = [f"avg(CASE WHEN name = '{p}' THEN {c} END) AS {p}_{n}_mean" for p in periods for c, n in cols]
    period += [f"CASE WHEN count(*) FILTER (WHERE name = '{p}') > 0 THEN coalesce(sum(CASE WHEN name = '{p}' "
               f"THEN ppt END), 0) END AS {p}_precipitation_total" for p in periods]
    names = [x.rsplit(" AS ", 1)[1] for x in season + period]
    extra = []
    for n in names:
        if "temperature_" in n and not n.startswith("gdd"):
            mean = "temperature_mean" in n
            if not mean and "max" in n:
                extra.append((f"{n}_heat_stress", f"greatest({n} - {stress}, 0)"))
            elif not mean and "min" in n:
                extra.append((f"{n}_frost_risk", f"greatest({frost} - {n}, 0)"))
            else:
                extra.append((f"{n}_ideal_deviation", f"greatest({lo} - {n}, 0) + greatest({n} - {hi}, 0)"))
        elif n.endswith("precipitation_total"):
            extra += [(f"{n}_ideal_deviation", f"greatest({plo} - {n}, 0) + greatest({n} - {phi}, 0)"),
                      (f"{n}_drought_risk", f"CASE WHEN {n} > 0 THEN greatest({plo} - {n}, 0) / {plo} ELSE 1.0 END"),
                      (f"{n}_excess_risk", f"greatest({n} - {phi}, 0) / {phi}")]
    shown = [(n, n) for n in names if n != "days_with_rain"] + extra
    return (with_views("climate_daily") + _CAL_SQL + CHAIN_SQL + f""",
sd AS (SELECT d.* FROM chain d JOIN regions r ON d.state_code = r.state_code
       JOIN sdays s ON s.crop = '{crop}' AND s.region = r.region AND s.month = d.month AND s.day = d.day),
st AS (SELECT state_code, year, {", ".join(season)} FROM sd GROUP BY state_code, year),
pd AS (SELECT d.*, p.name FROM chain d JOIN regions r ON d.state_code = r.state_code
       JOIN pdays p ON p.crop = '{crop}' AND p.region = r.region AND p.month = d.month AND p.day = d.day),
ps AS (SELECT state_code, year, {", ".join(period)} FROM pd GROUP BY state_code, year)
SELECT state_code, year, days_with_rain, """ + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in shown)
            + " FROM st LEFT JOIN ps USING (state_code, year)")


@register("climate_features_for_modeling", "X2,F11,F12,A35", sql=_x2_sql("CORN"))
def q_climate_features_for_modeling(spark, sf_dir):
    """The modelling feature chain for CORN: season/period statistics of weather and derived columns, interactions."""
    f = composites.climate_features_for_modeling(materialize(B.climate_daily(spark, sf_dir)), "CORN")
    return f.select(*[F.col(c) if c in ("state_code", "year", "days_with_rain") else F.col(c).cast("double").alias(c)
                      for c in f.columns])


# A15 --------------------------------------------------------------------------
@register("census_alignment", "A15", sql=with_views("state_month") + """,
routed AS (SELECT s.*, cy.census_year FROM state_month s
           JOIN (VALUES (1997), (2002), (2007), (2012), (2017)) AS cy(census_year)
             ON s.year BETWEEN cy.census_year - 1 AND cy.census_year + 1)
SELECT state_code, variable, CAST(census_year AS INTEGER) AS census_year,
       round(avg(mean_value), 6) AS mean_value, round(avg(min_value), 6) AS min_value,
       round(avg(max_value), 6) AS max_value, round(avg(std_value), 6) AS std_value,
       round(avg(count), 6) AS count
FROM routed GROUP BY state_code, variable, census_year""")
def q_census_alignment(spark, sf_dir):
    """3-year centred means of the state-month statistics for each census year."""
    sm = spatial.state_month_stats(B.climate_points(spark, sf_dir))
    out = temporal.census_alignment(sm)
    return out.withColumn("count", F.col("count").cast("double"))


# W7 / W8 / A34 ------------------------------------------------------------------
@register("phenology_daily", "W7,A34", sql=with_views("climate_daily") + _CAL_SQL + """,
stage AS (SELECT month, day, arg_max(name, idx) AS phenology_stage FROM pdays
          WHERE crop = 'CORN' AND region = 'Central' GROUP BY month, day)
SELECT coalesce(s.phenology_stage, 'outside_growing_season') AS phenology_stage, count(*) AS n_rows
FROM climate_daily d LEFT JOIN stage s ON d.month = s.month AND d.day = s.day GROUP BY 1""")
def q_phenology_daily(spark, sf_dir):
    """W7 + A34: CORN phenology stage of each day (default state Iowa), rows per stage."""
    return temporal.stage_counts(temporal.phenology_stage(B.climate_daily(spark, sf_dir), "CORN"))


@register("phenology_monthly", "W8,A34", sql=with_views("climate_monthly") + _CAL_SQL + """,
cnt AS (SELECT month, name, idx, count(*) AS n FROM pdays WHERE crop = 'WHEAT' AND region = 'Central'
        GROUP BY month, name, idx),
dom AS (SELECT month, arg_min(name, (-n) * 100 + idx) AS phenology_stage FROM cnt GROUP BY month)
SELECT coalesce(d.phenology_stage, 'outside_growing_season') AS phenology_stage, count(*) AS n_rows
FROM climate_monthly m LEFT JOIN dom d ON m.month = d.month GROUP BY 1""")
def q_phenology_monthly(spark, sf_dir):
    """W8 + A34: WHEAT stage with most days in each month (ties -> earlier stage), rows per stage."""
    return temporal.stage_counts(temporal.phenology_stage(B.climate_monthly(spark, sf_dir), "WHEAT"))


# All five crops over grid cells, whose number grows with the data -----------------
@register("season_statistics_cells", "A13,A35,D8", sql=with_views("cell_days") + _CAL_SQL + """
SELECT s.crop, d.cell, d.year, """ + ", ".join(
    f"round(avg({c}), 6) AS {n}_mean, round(min({c}), 6) AS {n}_min, round(max({c}), 6) AS {n}_max" for c, n in _VARS) + """,
       round(sum(greatest(tmean - 10, 0)), 6) AS gdd_base10, round(sum(greatest(tmin - 10, 0)), 6) AS gdd_base10_temperature_min,
       round(sum(greatest(least(tmax, 30) - 10, 0)), 6) AS gdd_base10_temperature_max,
       round(sum(ppt), 6) AS precipitation_total, round(max(ppt), 6) AS precipitation_max_daily,
       count(*) FILTER (WHERE ppt > 0) AS days_with_rain
FROM cell_days d JOIN regions r ON d.state_code = r.state_code
JOIN sdays s ON s.region = r.region AND s.month = d.month AND s.day = d.day GROUP BY s.crop, d.cell, d.year""")
def q_season_statistics_cells(spark, sf_dir):
    """A13 + A35: season statistics of all five crops per grid cell and year."""
    return temporal.season_statistics_by_crop(B.cell_days(spark, sf_dir).drop("date"), ["cell", "year"])


@register("period_statistics_cells", "A14,A35,P6", sql=with_views("cell_days") + _CAL_SQL + """
SELECT p.crop, p.name AS period, d.state_code, d.year, count(*) AS n_days, """ + ", ".join(
    f"round(avg({c}), 6) AS {n}_mean" for c, n in _VARS) + """, round(sum(ppt), 6) AS precipitation_total
FROM cell_days d JOIN regions r ON d.state_code = r.state_code
JOIN pdays p ON p.region = r.region AND p.month = d.month AND p.day = d.day GROUP BY p.crop, p.name, d.state_code, d.year""")
def q_period_statistics_cells(spark, sf_dir):
    """Every critical period of all five crops, statistics over the cell-days of each state and year."""
    return temporal.period_statistics_by_crop(B.cell_days(spark, sf_dir).drop("date", "cell"), ["state_code", "year"])


def cell_months(spark, sf_dir):
    return B.cell_days(spark, sf_dir).groupBy("cell", "state_code", "year", "month").agg(
        F.avg("tmean").alias("tmean"), F.min("tmin").alias("tmin"), F.sum("ppt").alias("ppt"))


@register("growing_season_months_cells", "P5", sql=with_views("cell_months") + _CAL_SQL + """
SELECT c.crop, m.cell, m.year, count(*) AS n_months, round(avg(m.tmean), 6) AS tmean, round(sum(m.ppt), 6) AS ppt
FROM cell_months m JOIN cal c ON (c.sm <= c.em AND m.month BETWEEN c.sm AND c.em)
  OR (c.sm > c.em AND (m.month >= c.sm OR m.month <= c.em)) GROUP BY c.crop, m.cell, m.year""")
def q_growing_season_months_cells(spark, sf_dir):
    """P5: months inside each crop's unadjusted (possibly wrapping) season, per cell and year."""
    f = temporal.season_months_by_crop(cell_months(spark, sf_dir))
    return f.groupBy("crop", "cell", "year").agg(F.count(F.lit(1)).alias("n_months"), F.avg("tmean").alias("tmean"),
                                                 F.sum("ppt").alias("ppt"))


@register("critical_period_months_cells", "P7", sql=with_views("cell_months") + _CAL_SQL + """
SELECT p.crop, p.name AS period, m.state_code, m.year, m.month, count(*) AS n_cells, round(min(m.tmin), 6) AS tmin
FROM cell_months m JOIN periods p ON (p.sm <= p.em AND m.month BETWEEN p.sm AND p.em)
  OR (p.sm > p.em AND (m.month >= p.sm OR m.month <= p.em)) GROUP BY ALL""")
def q_critical_period_months_cells(spark, sf_dir):
    """Months overlapping every unadjusted critical period of all crops, cells and coldest day per state."""
    f = temporal.period_months_by_crop(cell_months(spark, sf_dir))
    return f.groupBy("crop", "period", "state_code", "year", "month").agg(F.count(F.lit(1)).alias("n_cells"),
                                                                          F.min("tmin").alias("tmin"))


@register("phenology_cells", "W7,A34", sql=with_views("cell_days") + _CAL_SQL + """,
stage AS (SELECT crop, region, month, day, arg_max(name, idx) AS phenology_stage FROM pdays GROUP BY crop, region, month, day),
crops AS (SELECT DISTINCT crop FROM cal)
SELECT c.crop, d.state_code, coalesce(s.phenology_stage, 'outside_growing_season') AS phenology_stage, count(*) AS n_rows
FROM cell_days d JOIN regions r ON d.state_code = r.state_code CROSS JOIN crops c
LEFT JOIN stage s ON s.crop = c.crop AND s.region = r.region AND s.month = d.month AND s.day = d.day GROUP BY ALL""")
def q_phenology_cells(spark, sf_dir):
    """W7 + A34: stage of every cell-day for all crops by its own state's calendar; rows per crop, state and stage."""
    f = temporal.phenology_by_crop(B.cell_days(spark, sf_dir))
    return f.groupBy("crop", "state_code", "phenology_stage").agg(F.count(F.lit(1)).alias("n_rows"))


@register("phenology_months_cells", "W8,A34", sql=with_views("cell_months") + _CAL_SQL + """,
cnt AS (SELECT crop, month, name, idx, count(*) AS n FROM pdays WHERE region = 'Central' GROUP BY ALL),
dom AS (SELECT crop, month, arg_min(name, (-n) * 100 + idx) AS phenology_stage FROM cnt GROUP BY crop, month),
crops AS (SELECT DISTINCT crop FROM cal)
SELECT c.crop, coalesce(d.phenology_stage, 'outside_growing_season') AS phenology_stage, count(*) AS n_rows
FROM cell_months m CROSS JOIN crops c LEFT JOIN dom d ON d.crop = c.crop AND m.month = d.month GROUP BY ALL""")
def q_phenology_months_cells(spark, sf_dir):
    """W8 + A34: the stage with most days in each cell-month, all crops; rows per crop and stage."""
    f = temporal.phenology_by_crop(cell_months(spark, sf_dir))
    return f.groupBy("crop", "phenology_stage").agg(F.count(F.lit(1)).alias("n_rows"))
