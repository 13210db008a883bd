"""Registered queries: crop x climate integration and dashboard analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.operators import analysis as AN
from cropframe.operators import integrate
from cropframe.plans import composites
from cropframe.plans.q_climate import _SEASON_COLS, season_stats
from cropframe.plans.registry import register
from cropframe.plans.sql_views import with_views
from cropframe.session import materialize, scratch_path
from cropframe.sources import bindings as B
from cropframe.sources import files


def annual_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state_code, year, tmean (annual mean), ppt (annual total)."""
    d = B.climate_daily(spark, sf_dir)
    return d.groupBy("state_code", "year").agg(F.avg("tmean").alias("tmean"), F.sum("ppt").alias("ppt"))


_ANNUAL_SQL = """,
annual AS (SELECT state_code, year, avg(tmean) AS tmean, sum(ppt) AS ppt FROM climate_daily GROUP BY ALL)"""


# J1 / J2 / J3 / J4 ------------------------------------------------------------
@register("national_merge", "J1,P2", sql=with_views("climate_daily", "crop_census") + _ANNUAL_SQL + """
SELECT c.year, c.crop, round(c.yield, 6) AS yield, c.harvested_acres, c.production,
       round(n.tmean, 6) AS tmean, round(n.ppt, 6) AS ppt
FROM crop_census c JOIN (SELECT year, avg(tmean) AS tmean, avg(ppt) AS ppt FROM annual GROUP BY year) n
  ON c.year = n.year""")
def q_national_merge(spark, sf_dir):
    """Climate averaged over states per year, inner-joined to the crop table on year."""
    return integrate.merge_crop_climate(B.crop_census(spark, sf_dir), annual_climate(spark, sf_dir), "national")


@register("state_merge", "J2", sql=with_views("climate_daily", "state_census") + _ANNUAL_SQL + """
SELECT c.year, c.state_code, c.crop, round(c.yield, 6) AS yield, c.harvested_acres, c.production,
       round(a.tmean, 6) AS tmean, round(a.ppt, 6) AS ppt
FROM state_census c JOIN annual a ON c.year = a.year AND c.state_code = a.state_code""")
def q_state_merge(spark, sf_dir):
    """State-grain crop table joined with state climate on (year, state_code)."""
    return integrate.merge_crop_climate(B.state_census(spark, sf_dir), annual_climate(spark, sf_dir), "state")


@register("county_merge", "J3", sql=with_views("county_census", "climate_counties") + """
SELECT c.year, c.county_fips, c.crop, round(c.yield, 6) AS yield, k.state_code,
       round(k.tmean, 6) AS tmean, round(k.ppt, 6) AS ppt
FROM county_census c JOIN climate_counties k ON c.year = k.year AND c.county_fips = k.county_fips""")
def q_county_merge(spark, sf_dir):
    """County-grain crop table joined with county climate on (year, county_fips)."""
    return integrate.merge_crop_climate(B.county_census(spark, sf_dir), B.climate_counties(spark, sf_dir), "county")


_J4_SQL = with_views("season_stats", "state_census") + """,
j4 AS (SELECT c.year, c.state_code, c.crop, c.yield, c.harvested_acres, c.production, """ + ", ".join(
    f"s.{x}" for x in _SEASON_COLS) + """
  FROM state_census c JOIN season_stats s ON c.year = s.year AND c.state_code = s.state_code AND c.crop = s.crop)"""


@register("crop_specific_merge", "J4,U1", sql=_J4_SQL + """
SELECT year, state_code, crop, round(yield, 6) AS yield, harvested_acres, production, """ + ", ".join(
    f"round({x}, 6) AS {x}" for x in _SEASON_COLS) + " FROM j4")
def q_crop_specific_merge(spark, sf_dir):
    """Crop-aware state join: the crop is part of the key when the climate side has it (one join)."""
    return integrate.crop_specific_merge(B.state_census(spark, sf_dir), season_stats(spark, sf_dir), "state")


_STD_COLS = ["harvested_acres", "production"] + _SEASON_COLS


@register("standardized_dataset", "A22,D9", sql=_J4_SQL + """
SELECT year, state_code, crop, """ + ", ".join(
    f"round(CASE WHEN stddev_samp({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () END, 6)"
    f" AS {x}_std" for x in _STD_COLS) + " FROM j4")
def q_standardized_dataset(spark, sf_dir):
    """Global z-scores (ddof 1) of every numeric feature; the target and identifiers are excluded."""
    j = materialize(integrate.crop_specific_merge(B.state_census(spark, sf_dir), season_stats(spark, sf_dir), "state"))
    z = integrate.standardize(j, exclude=("year", "yield"))
    return z.select("year", "state_code", "crop", *[f"{c}_std" for c in _STD_COLS])


# A23 + P9 + S6 ------------------------------------------------------------------
def census_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long census rows (YEAR, CROP, CATEGORY, VALUE, UNIT, ingest_seq) from the state-grain census;
    ingest order = state order, so several rows compete per category (last one wins)."""
    sc = B.state_census(spark, sf_dir)
    seq = F.array_position(F.array(*[F.lit(s) for s in B.REGION_STATES]), F.col("state_code"))
    return sc.select(F.col("year").alias("YEAR"), F.col("crop").alias("CROP"), seq.alias("ingest_seq"),
                     F.expr("stack(3, 'YIELD', yield, 'BU / ACRE', 'AREA HARVESTED', CAST(harvested_acres AS DOUBLE), "
                            "'ACRES', 'PRODUCTION', CAST(production AS DOUBLE), 'BU') AS (CATEGORY, VALUE, UNIT)"))


@register("crop_category_pivot", "A23,P9", sql=with_views("state_census") + """,
lng AS (
  SELECT year AS "YEAR", crop AS "CROP", CASE state_code WHEN 'IL' THEN 1 WHEN 'IA' THEN 2 WHEN 'NE' THEN 3
           WHEN 'MN' THEN 4 WHEN 'IN' THEN 5 END AS seq, yield AS y, CAST(harvested_acres AS DOUBLE) AS a,
         CAST(production AS DOUBLE) AS p FROM state_census)
SELECT "YEAR", "CROP", round(arg_max(y, seq), 6) AS "YIELD", round(arg_max(a, seq), 6) AS "HARVESTED_ACRES",
       round(arg_max(p, seq), 6) AS "PRODUCTION" FROM lng GROUP BY "YEAR", "CROP\"""")
def q_crop_category_pivot(spark, sf_dir):
    """A23 + P9: category pivot of long census records, last ingested row wins, complete records only."""
    return integrate.crop_category_pivot(census_long(spark, sf_dir))


# Analysis ---------------------------------------------------------------------
@register("crop_year_filter", "P1,X6", sql=with_views("crop_census") + """
SELECT year, crop, round(yield, 6) AS yield, production FROM crop_census
WHERE crop IN ('CORN', 'WHEAT') AND year BETWEEN 1996 AND 2000""")
def q_crop_year_filter(spark, sf_dir):
    """Crop list and year range filter on the census."""
    return AN.filter_crops_years(B.crop_census(spark, sf_dir), ["CORN", "WHEAT"], (1996, 2000)).select(
        "year", "crop", "yield", "production")


@register("production_by_year", "X6", sql=with_views("state_census") + """
SELECT year, crop, CAST(sum(production) AS BIGINT) AS total_production FROM state_census GROUP BY year, crop""")
def q_production_by_year(spark, sf_dir):
    """Production by year and crop (dashboard series)."""
    return AN.production_by_year(B.state_census(spark, sf_dir)).withColumn(
        "total_production", F.col("total_production").cast("bigint"))


_INTEGRATED_SQL = with_views("season_stats", "crop_census") + """,
national AS (SELECT year, crop, avg(growing_season_tmax_mean) AS growing_season_tmax_mean,
                    avg(growing_season_ppt_total) AS growing_season_ppt_total,
                    avg(growing_degree_days_base10) AS growing_degree_days_base10
             FROM season_stats GROUP BY year, crop),
integ AS (SELECT c.year, c.crop, c.yield, n.growing_season_tmax_mean, n.growing_season_ppt_total,
                 n.growing_degree_days_base10
          FROM crop_census c JOIN national n ON c.year = n.year AND c.crop = n.crop)"""

_CORR_COLS = ["yield", "growing_season_tmax_mean", "growing_season_ppt_total", "growing_degree_days_base10"]


def integrated(spark: SparkSession, sf_dir: str, reused: bool = False) -> DataFrame:
    """Crop-year dataset (J10). ``reused``: materialise it once for plans that read it several times."""
    df = integrate.season_with_census(season_stats(spark, sf_dir), B.crop_census(spark, sf_dir)).select(
        "year", "crop", "yield", "growing_season_tmax_mean", "growing_season_ppt_total",
        "growing_degree_days_base10")
    return materialize(df) if reused else df


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS:
            parts.append(f"SELECT crop, '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr "
                         f"FROM integ GROUP BY crop")
    return _INTEGRATED_SQL + "\n" + "\nUNION ALL ".join(parts)


@register("correlation_matrix", "A25", sql=_corr_sql())
def q_correlation_matrix(spark, sf_dir):
    """Pearson matrix (pairwise complete) of yield and season climate per crop, one aggregate."""
    return AN.correlation_matrix(integrated(spark, sf_dir), _CORR_COLS, by=["crop"])


@register("trend_lines", "A26,M8", sql=_INTEGRATED_SQL + """
SELECT crop, round(regr_slope(yield, growing_season_tmax_mean), 6) AS slope,
       round(regr_intercept(yield, growing_season_tmax_mean), 6) AS intercept,
       round(regr_r2(yield, growing_season_tmax_mean), 6) AS r2,
       CAST(regr_count(yield, growing_season_tmax_mean) AS BIGINT) AS n
FROM integ GROUP BY crop""")
def q_trend_lines(spark, sf_dir):
    """Per-crop OLS trend of yield on season mean tmax (slope, intercept, r2, n)."""
    return AN.trend_lines(integrated(spark, sf_dir), "growing_season_tmax_mean", "yield", by=["crop"])


def _ols_residuals(spark, sf_dir) -> DataFrame:
    # read twice (fit, then join-back), and the residuals feed further statistics
    integ = integrated(spark, sf_dir, reused=True)
    tl = AN.trend_lines(integ, "growing_season_tmax_mean", "yield", by=["crop"])
    pred = integ.join(tl, "crop").select(
        "crop", "year", F.col("yield").alias("actual"),
        (F.col("intercept") + F.col("slope") * F.col("growing_season_tmax_mean")).alias("predicted"))
    return AN.residuals(pred)


_RESID_SQL = _INTEGRATED_SQL + """,
tl AS (SELECT crop, regr_slope(yield, growing_season_tmax_mean) AS slope,
              regr_intercept(yield, growing_season_tmax_mean) AS intercept FROM integ GROUP BY crop),
res AS (SELECT i.crop, i.year, i.yield AS actual, tl.intercept + tl.slope * i.growing_season_tmax_mean AS predicted,
               i.yield - (tl.intercept + tl.slope * i.growing_season_tmax_mean) AS error
        FROM integ i JOIN tl ON i.crop = tl.crop),
res2 AS (SELECT *, error / actual * 100 AS pct_error FROM res)"""


@register("ols_residuals", "M8,M12", sql=_RESID_SQL + """
SELECT crop, year, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(error, 6) AS error,
       round(pct_error, 6) AS pct_error FROM res2""")
def q_ols_residuals(spark, sf_dir):
    """M8 (one feature, closed form) + M12: actual, predicted, error and percent error per crop-year."""
    return _ols_residuals(spark, sf_dir)


@register("error_summary", "A27,A30", sql=_RESID_SQL + """
SELECT crop, round(avg(pct_error), 6) AS mean_pct_error, round(median(pct_error), 6) AS median_pct_error,
       round(least(min(actual), min(predicted)), 6) AS lo, round(greatest(max(actual), max(predicted)), 6) AS hi
FROM res2 GROUP BY crop""")
def q_error_summary(spark, sf_dir):
    """A27 + A30: mean / median percent error and the actual-predicted envelope per crop."""
    r = _ols_residuals(spark, sf_dir)
    return AN.error_summary(r, ["crop"]).join(AN.envelope(r, by=["crop"]), "crop")


@register("error_histogram", "A29", sql=_RESID_SQL + """,
b AS (SELECT min(error) AS lo, max(error) AS hi, (max(error) - min(error)) / 30 AS w FROM res2)
SELECT CAST(CASE WHEN b.hi = b.lo THEN 0 ELSE greatest(least(floor((r.error - b.lo) / b.w), 29), 0) END AS INTEGER) AS bin,
       round(any_value(b.lo) + CAST(CASE WHEN b.hi = b.lo THEN 0 ELSE greatest(least(floor((r.error - b.lo) / b.w), 29), 0) END
             AS INTEGER) * any_value(b.w), 6) AS bin_start,
       round(any_value(b.lo) + (CAST(CASE WHEN b.hi = b.lo THEN 0 ELSE greatest(least(floor((r.error - b.lo) / b.w), 29), 0) END
             AS INTEGER) + 1) * any_value(b.w), 6) AS bin_end,
       count(*) AS count
FROM res2 r, b GROUP BY 1""")
def q_error_histogram(spark, sf_dir):
    """30 equal-width bins of the residuals."""
    return AN.error_histogram(_ols_residuals(spark, sf_dir), "error", 30)


@register("top_yield_years", "T1", sql=with_views("crop_census") + """
SELECT crop, year, round(yield, 6) AS yield, rank FROM (
  SELECT crop, year, yield, row_number() OVER (PARTITION BY crop ORDER BY yield DESC) AS rank FROM crop_census)
WHERE rank <= 3""")
def q_top_yield_years(spark, sf_dir):
    """Top-3 years by yield per crop (a top-k report: the limit is the feature)."""
    return AN.top_k(B.crop_census(spark, sf_dir).select("crop", "year", "yield"), 3, "yield", by=["crop"])


@register("yield_climate_series", "J15", sql=with_views("climate_daily", "crop_census") + _ANNUAL_SQL + """
SELECT c.year AS "YEAR", round(c.yield, 6) AS "YIELD", round(a.tmean, 6) AS tmean
FROM crop_census c JOIN (SELECT year, avg(tmean) AS tmean FROM annual GROUP BY year) a ON c.year = a.year
WHERE c.crop = 'CORN'""")
def q_yield_climate_series(spark, sf_dir):
    """One crop's yield series joined to a climate series on differently named keys."""
    crop = B.crop_census(spark, sf_dir).select(F.col("year").alias("YEAR"), F.col("crop").alias("CROP"),
                                              F.col("yield").alias("YIELD"))
    clim = annual_climate(spark, sf_dir).groupBy("year").agg(F.avg("tmean").alias("tmean"))
    return AN.yield_climate_series(crop, clim, "CORN", "tmean")


@register("climate_heatmap", "A28", sql=with_views("climate_daily") + """
SELECT state_code, """ + ", ".join(f"round(avg(CASE WHEN month = {m} THEN tmean END), 6) AS m{m}" for m in range(1, 13))
    + " FROM climate_daily GROUP BY state_code")
def q_climate_heatmap(spark, sf_dir):
    """State x month grid of mean temperature (explicit month list)."""
    h = AN.heatmap(B.climate_daily(spark, sf_dir), "state_code", "month", "tmean", list(range(1, 13)))
    return h.select("state_code", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


@register("lagged_yield", "W2,T2", sql=with_views("crop_census") + """
SELECT year AS "YEAR", crop AS "CROP", round(yield, 6) AS "YIELD",
       round(lag(yield) OVER (PARTITION BY crop ORDER BY year), 6) AS "PREV_YIELD",
       round(yield - lag(yield) OVER (PARTITION BY crop ORDER BY year), 6) AS "YIELD_CHANGE",
       round((yield - lag(yield) OVER (PARTITION BY crop ORDER BY year))
             / lag(yield) OVER (PARTITION BY crop ORDER BY year) * 100, 6) AS "YIELD_CHANGE_PCT"
FROM crop_census""")
def q_lagged_yield(spark, sf_dir):
    """Previous census yield, change and percent change per crop, ordered by year."""
    c = B.crop_census(spark, sf_dir).select(F.col("year").alias("YEAR"), F.col("crop").alias("CROP"),
                                           F.col("yield").alias("YIELD"))
    return integrate.lagged_yield(c)


# P10 + P11 + P12 + P14 + M3 + U2 ----------------------------------------------
_POOLED = ["harvested_acres", "growing_season_ppt_total", "growing_season_tmean_mean", "growing_season_tmax_mean",
           "growing_degree_days_base10"]
_DUMMY_STATES = ["IL", "IN", "MN", "NE"]  # sorted levels of state_code minus the first (IA)


@register("modeling_ready", "P10,P11,P12,P14,M3,U2", sql=_J4_SQL + """
SELECT CAST(year AS INTEGER) AS year, state_code, crop, round(yield, 6) AS yield, harvested_acres, production, """
          + ", ".join(f"round({x}, 6) AS {x}" for x in _SEASON_COLS) + ", "
          + ", ".join(f"CASE WHEN state_code = '{s}' THEN 1 ELSE 0 END AS state_code_{s}" for s in _DUMMY_STATES)
          + " FROM j4")
def q_modeling_ready(spark, sf_dir):
    """Modelling-ready table: checked columns, int year, numeric features, NULL columns dropped, state dummies."""
    j = integrate.crop_specific_merge(B.state_census(spark, sf_dir), season_stats(spark, sf_dir), "state")
    return integrate.modeling_ready(j, "yield", {"state_code": B.REGION_STATES})


#: Crops with a dummy column: the sorted crops but the first.
_DUMMY_CROPS = sorted(B.SEGMENT_CROPS.values())[1:]


@register("modeling_pooled", "M1,P11,M3,A22", sql=_J4_SQL + """
SELECT CAST(year AS INTEGER) AS year, state_code, crop, round(yield, 6) AS yield, """ + ", ".join(
    f"round(CASE WHEN stddev_samp({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () END, 6) AS {x}_std"
    for x in _POOLED) + ", " + ", ".join(f"CASE WHEN crop = '{c}' THEN 1 ELSE 0 END AS crop_{c}" for c in _DUMMY_CROPS)
          + ", CASE WHEN state_code <> 'IA' THEN 'state_code_' || state_code ELSE '' END AS state_dummy FROM j4")
def q_modeling_pooled(spark, sf_dir):
    """M1 pooled + P11: all crops in one frame, standardised features preferred, crop columns, an open map of states."""
    j = integrate.crop_specific_merge(B.state_census(spark, sf_dir), season_stats(spark, sf_dir), "state").select(
        "year", "state_code", "crop", "yield", *_POOLED)
    z = integrate.standardize(materialize(j), exclude=("year", "yield"))
    x = integrate.modeling_ready(z, "yield", {"crop": _DUMMY_CROPS + ["CORN"], "state_code": None}, prefer_standardized=True)
    return x.withColumn("state_dummy", F.array_join(F.map_keys("dummies"), ",")).drop("dummies")


# T4 -----------------------------------------------------------------------------
@register("census_preview", "T4", sql=with_views("crop_census") + """
SELECT year, crop, round(yield, 6) AS yield, harvested_acres, production FROM crop_census
ORDER BY year, crop LIMIT 5""")
def q_census_preview(spark, sf_dir):
    """T4: head preview of the census table (the limit is the feature; a total order makes it stable)."""
    return B.crop_census(spark, sf_dir).orderBy("year", "crop").limit(5)


# A32 ----------------------------------------------------------------------------
@register("distinct_keys", "A32,F20", sql=with_views("state_census", "station_normals") + """
SELECT 'crop' AS key_type, crop AS key_value FROM state_census GROUP BY crop
UNION ALL SELECT 'state', state_code FROM state_census GROUP BY state_code
UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM state_census GROUP BY year
UNION ALL SELECT 'station', lower("STATION") FROM station_normals GROUP BY "STATION"
UNION ALL SELECT 'states', array_to_string(list_sort(list(DISTINCT state_code))[1:3], ', ') FROM state_census""")
def q_distinct_keys(spark, sf_dir):
    """A32 + F20: the distinct crops, states, years and stations, and the first three states joined as a label."""
    # the keys of the census are attributes of its orders, and its rows are small once written
    sc = materialize(B.state_census(spark, sf_dir).select("crop", "state_code", "year"), "census-keys")
    st = B.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("ST"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("STATION"))
    parts = [sc.select(F.lit("crop").alias("key_type"), F.col("crop").alias("key_value")).distinct(),
             sc.select(F.lit("state"), F.col("state_code")).distinct(),
             sc.select(F.lit("year"), F.col("year").cast("string")).distinct(),
             st.select(F.lit("station"), F.lower("STATION")).distinct(),
             # the label needs only the distinct states: a bounded array
             sc.groupBy().agg(F.lit("states"), F.array_join(
                 F.slice(F.array_sort(F.collect_set("state_code")), 1, 3), ", "))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# W2 with the unit in the key, X3, X4 ------------------------------------------------
@register("lagged_yield_states", "W2,T2", sql=with_views("state_census") + """
SELECT year AS "YEAR", state_code, crop AS "CROP", round(yield, 6) AS "YIELD",
       round(lag(yield) OVER w, 6) AS "PREV_YIELD", round(yield - lag(yield) OVER w, 6) AS "YIELD_CHANGE",
       round((yield - lag(yield) OVER w) / lag(yield) OVER w * 100, 6) AS "YIELD_CHANGE_PCT"
FROM state_census WINDOW w AS (PARTITION BY crop, state_code ORDER BY year)""")
def q_lagged_yield_states(spark, sf_dir):
    """W2 per crop and state: a window holds one unit's census years."""
    c = B.state_census(spark, sf_dir).select(F.col("year").alias("YEAR"), "state_code", F.col("crop").alias("CROP"),
                                             F.col("yield").alias("YIELD"))
    return integrate.lagged_yield(c, by=("state_code",))


@register("lagged_yield_counties", "W2,T2", sql=with_views("county_census") + """
SELECT year AS "YEAR", county_fips, crop AS "CROP", round(yield, 6) AS "YIELD", round(lag(yield) OVER w, 6) AS "PREV_YIELD",
       round(yield - lag(yield) OVER w, 6) AS "YIELD_CHANGE",
       round((yield - lag(yield) OVER w) / lag(yield) OVER w * 100, 6) AS "YIELD_CHANGE_PCT"
FROM county_census WINDOW w AS (PARTITION BY crop, county_fips ORDER BY year)""")
def q_lagged_yield_counties(spark, sf_dir):
    """W2 per crop and county."""
    c = B.county_census(spark, sf_dir).select(F.col("year").alias("YEAR"), "county_fips", F.col("crop").alias("CROP"),
                                              F.col("yield").alias("YIELD"))
    return integrate.lagged_yield(c, by=("county_fips",))


@register("integrated_dataset", "X3,J4,A22,S11,S12", sql=_J4_SQL + """
SELECT CAST(year AS INTEGER) AS year, state_code, crop, round(yield, 6) AS yield, harvested_acres, production, """
          + ", ".join(f"round({x}, 6) AS {x}" for x in _SEASON_COLS) + ", " + ", ".join(
    f"round(CASE WHEN stddev_samp({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () END, 6) AS {x}_std"
    for x in _STD_COLS) + ", '20240101' AS ds FROM j4")
def q_integrated_dataset(spark, sf_dir):
    """Crop-aware join, z-scores, one write partitioned by crop (S11), read back as the newest snapshot."""
    root = scratch_path(spark, "integrated")
    composites.integrate_and_write(B.state_census(spark, sf_dir), season_stats(spark, sf_dir), root, ds="20240101")
    return files.latest_snapshot(spark, f"{root}/integrated").select(
        "year", "state_code", "crop", "yield", "harvested_acres", "production", *_SEASON_COLS, *[f"{c}_std" for c in _STD_COLS], "ds")


@register("census_batch", "X4,A10", sql=with_views("season_stats") + """
SELECT state_code, year, crop, """ + ", ".join(f"round({x}, 6) AS {x}" for x in _SEASON_COLS) + """
FROM season_stats WHERE year IN (1992, 1997, 2002)""")
def q_census_batch(spark, sf_dir):
    """Season statistics of the census years that the given dates reach, one job."""
    from cropframe.plans.q_climate import state_month
    return composites.census_batch(state_month(spark, sf_dir), [1992, 1997, 2002])
