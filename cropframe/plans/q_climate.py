"""Registered queries: state-month and growing-season aggregation, spatial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe import dims
from cropframe.operators import integrate, spatial, temporal
from cropframe.plans.registry import register
from cropframe.plans.sql_views import STATE_CASE, with_views
from cropframe.sources import bindings as B

_SEASON_COLS = ["growing_season_ppt_total",
                "growing_season_tmax_mean", "growing_season_tmax_min", "growing_season_tmax_max",
                "growing_season_tmean_mean", "growing_season_tmean_min", "growing_season_tmean_max",
                "growing_season_tmin_mean", "growing_season_tmin_min", "growing_season_tmin_max",
                "growing_degree_days_base10"]


def _rounded(cols, prefix=""):
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in cols)


def state_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.state_month_stats(B.climate_points(spark, sf_dir))


def season_stats(spark: SparkSession, sf_dir: str, wheat_mode: str = "harvest_year") -> DataFrame:
    return temporal.season_stats_monthly(state_month(spark, sf_dir), "monthly", wheat_mode)


# A3 --------------------------------------------------------------------------
@register("state_month_stats", "A3", sql=with_views("state_month") + """
SELECT state_code, year, month, variable, round(mean_value, 6) AS mean_value, round(min_value, 6) AS min_value,
       round(max_value, 6) AS max_value, round(std_value, 6) AS std_value, count
FROM state_month""")
def q_state_month_stats(spark, sf_dir):
    """A3: state x year x month x variable aggregate over all point readings in one scan."""
    return state_month(spark, sf_dir)


# A10 + A11 + A12 ---------------------------------------------------------------
@register("state_month_readings", "A3", sql="""
WITH r AS (SELECT """ + STATE_CASE.format(k="n.n_regionkey") + """ AS state_code,
             CAST(year(l.l_shipdate) AS INTEGER) AS year, CAST(month(l.l_shipdate) AS INTEGER) AS month,
             CAST(l.l_quantity - 10 AS DOUBLE) AS t, CAST(round(l.l_discount * 100) AS DOUBLE) AS p
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
v AS (SELECT state_code, year, month, 'tmean' AS variable, t AS value FROM r
      UNION ALL SELECT state_code, year, month, 'ppt', p FROM r)
SELECT state_code, year, month, variable, round(avg(value), 6) AS mean_value, round(min(value), 6) AS min_value,
       round(max(value), 6) AS max_value, round(stddev_samp(value), 6) AS std_value, count(value) AS count
FROM v GROUP BY state_code, year, month, variable""")
def q_state_month_readings(spark, sf_dir):
    """A3 over raw readings, one per line of lineitem and variable."""
    return spatial.state_month_stats(B.raw_readings(spark, sf_dir))


@register("season_stats", "A10,A11,A12,J9", sql=with_views("season_stats") + f"""
SELECT state_code, year, crop, {_rounded(_SEASON_COLS)} FROM season_stats""")
def q_season_stats(spark, sf_dir):
    """Wide growing-season statistics per state, harvest year and crop."""
    return season_stats(spark, sf_dir)


_CAL_YEAR_SQL = with_views("state_month") + """,
sm_wide AS (
  SELECT state_code, year, month,
    max(CASE WHEN variable = 'ppt' THEN mean_value END) AS ppt_mean,
    max(CASE WHEN variable = 'tmean' THEN mean_value END) AS tmean_mean,
    max(CASE WHEN variable = 'tmax' THEN mean_value END) AS tmax_mean,
    max(CASE WHEN variable = 'tmin' THEN mean_value END) AS tmin_mean,
    max(CASE WHEN variable = 'tmax' THEN max_value END) AS tmax_max
  FROM state_month GROUP BY state_code, year, month)
SELECT w.state_code, w.year, s.crop, round(sum(ppt_mean), 6) AS growing_season_ppt_total,
       round(avg(tmax_mean), 6) AS growing_season_tmax_mean, round(max(tmax_max), 6) AS growing_season_tmax_max,
       round(sum(greatest(coalesce(tmean_mean, (tmin_mean + tmax_mean) / 2) - 10, 0)), 6)
         AS growing_degree_days_base10
FROM sm_wide w JOIN (VALUES ('CORN', 4, 9), ('SOYBEANS', 5, 10), ('WHEAT', 9, 12), ('COTTON', 4, 9), ('RICE', 4, 9))
  AS s(crop, sm, em) ON w.month BETWEEN s.sm AND s.em
GROUP BY 1, 2, 3"""


@register("season_stats_calendar_year", "A10,D7", sql=_CAL_YEAR_SQL)
def q_season_stats_calendar_year(spark, sf_dir):
    """A10 in calendar-year mode: a wrapping season keeps only its planting-year months (9-12)."""
    s = season_stats(spark, sf_dir, "calendar_year")
    return s.select("state_code", "year", "crop", "growing_season_ppt_total", "growing_season_tmax_mean",
                    "growing_season_tmax_max", "growing_degree_days_base10")


@register("season_stats_long", "A10,A11", sql=with_views("season_stats") + """
SELECT state_code, year, crop, metric, round(value, 6) AS value FROM season_stats
UNPIVOT (value FOR metric IN (""" + ", ".join(_SEASON_COLS) + "))")
def q_season_stats_long(spark, sf_dir):
    """A10 long form (state, year, crop, metric, value): the shape before the A11 pivot."""
    return temporal.season_stats_long(state_month(spark, sf_dir))


# J10 -------------------------------------------------------------------------
@register("season_census_join", "J10,J4", sql=with_views("season_stats", "crop_census") + f""",
national AS (
  SELECT year, crop, {", ".join(f"avg({c}) AS {c}" for c in _SEASON_COLS)}
  FROM season_stats GROUP BY year, crop)
SELECT c.year, c.crop, round(c.yield, 6) AS yield, c.harvested_acres, c.production, {_rounded(_SEASON_COLS, "n.")}
FROM crop_census c JOIN national n ON c.year = n.year AND c.crop = n.crop""")
def q_season_census_join(spark, sf_dir):
    """Census rows joined with that year's season stats for the crop, averaged over states."""
    return integrate.season_with_census(season_stats(spark, sf_dir), B.crop_census(spark, sf_dir))


# A1 / J11 / A2 / A19 / A33 / P15 ------------------------------------------------
_STATS = "round(avg(value), 6) AS mean_value, round(min(value), 6) AS min_value, " \
         "round(max(value), 6) AS max_value, round(stddev_samp(value), 6) AS std_value, count(value) AS count"


@register("state_stats", "A1", sql=with_views("grid_points") + f"""
SELECT state_code, {_STATS} FROM grid_points WHERE value IS NOT NULL GROUP BY state_code""")
def q_state_stats(spark, sf_dir):
    """A1 (point table carrying state_code): zonal statistics per state, ddof 1."""
    return spatial.state_stats(B.grid_points(spark, sf_dir))


@register("state_stats_pop", "A1,N3", sql=with_views("grid_points") + """
SELECT state_code, round(avg(value), 6) AS mean_value, round(min(value), 6) AS min_value,
       round(max(value), 6) AS max_value, round(stddev_pop(value), 6) AS std_value, count(value) AS count
FROM grid_points WHERE value IS NOT NULL GROUP BY state_code""")
def q_state_stats_pop(spark, sf_dir):
    """A1 raster-branch statistics: population std (ddof 0)."""
    return spatial.state_stats(B.grid_points(spark, sf_dir), ddof=0)


@register("state_stats_polygon", "J11,A1,S9", sql=with_views("grid_points", "state_rects") + f"""
SELECT r.state_code, {_STATS}
FROM grid_points p JOIN state_rects r
  ON p.longitude > r.lon_min AND p.longitude < r.lon_max AND p.latitude > r.lat_min AND p.latitude < r.lat_max
WHERE value IS NOT NULL GROUP BY r.state_code""")
def q_state_stats_polygon(spark, sf_dir):
    """J11 + A1: points assigned to state polygons by ray casting (cell-keyed broadcast join)."""
    pts = B.grid_points(spark, sf_dir).drop("state_code")
    return spatial.state_stats_by_polygon(pts, dims.state_boundaries(spark))


@register("county_stats_polygon", "J11,A2,S10", sql=with_views("grid_points", "county_rects") + f"""
SELECT r.state_code, r.county_name, r.county_fips, {_STATS}
FROM grid_points p JOIN county_rects r
  ON p.longitude > r.lon_min AND p.longitude < r.lon_max AND p.latitude > r.lat_min AND p.latitude < r.lat_max
WHERE value IS NOT NULL GROUP BY r.state_code, r.county_name, r.county_fips""")
def q_county_stats_polygon(spark, sf_dir):
    """J11 + A2: county zonal statistics with name and FIPS."""
    pts = B.grid_points(spark, sf_dir).drop("state_code", "county_fips")
    return spatial.county_stats_by_polygon(pts, dims.county_boundaries(spark))


_REGION_SQL = """regions(crop, state_code, rnk) AS (VALUES
  ('CORN', 'IL', 0), ('CORN', 'IA', 1), ('CORN', 'NE', 2), ('CORN', 'MN', 3), ('CORN', 'IN', 4), ('CORN', 'OH', 5),
  ('CORN', 'MO', 6), ('SOYBEANS', 'IL', 0), ('SOYBEANS', 'IA', 1), ('SOYBEANS', 'MN', 2), ('SOYBEANS', 'IN', 3),
  ('SOYBEANS', 'NE', 4), ('SOYBEANS', 'OH', 5), ('SOYBEANS', 'MO', 6), ('WHEAT', 'KS', 0), ('WHEAT', 'ND', 1),
  ('WHEAT', 'MT', 2), ('WHEAT', 'WA', 3), ('WHEAT', 'OK', 4), ('WHEAT', 'SD', 5), ('WHEAT', 'TX', 6),
  ('COTTON', 'TX', 0), ('COTTON', 'GA', 1), ('COTTON', 'MS', 2), ('COTTON', 'AR', 3), ('COTTON', 'AL', 4),
  ('COTTON', 'NC', 5), ('COTTON', 'LA', 6), ('RICE', 'AR', 0), ('RICE', 'CA', 1), ('RICE', 'LA', 2),
  ('RICE', 'MS', 3), ('RICE', 'TX', 4), ('RICE', 'MO', 5)),
weights(crop, state_code, w) AS (VALUES
  ('CORN', 'IA', 0.25), ('CORN', 'IL', 0.20), ('CORN', 'NE', 0.15), ('CORN', 'MN', 0.10), ('CORN', 'IN', 0.10),
  ('CORN', 'OH', 0.10), ('CORN', 'MO', 0.05), ('CORN', 'OTHER', 0.05),
  ('SOYBEANS', 'IL', 0.22), ('SOYBEANS', 'IA', 0.20), ('SOYBEANS', 'MN', 0.12), ('SOYBEANS', 'IN', 0.10),
  ('SOYBEANS', 'NE', 0.10), ('SOYBEANS', 'OH', 0.08), ('SOYBEANS', 'MO', 0.08), ('SOYBEANS', 'OTHER', 0.10),
  ('WHEAT', 'KS', 0.25), ('WHEAT', 'ND', 0.18), ('WHEAT', 'MT', 0.12), ('WHEAT', 'WA', 0.10), ('WHEAT', 'OK', 0.08),
  ('WHEAT', 'SD', 0.08), ('WHEAT', 'TX', 0.07), ('WHEAT', 'OTHER', 0.12),
  ('COTTON', 'TX', 0.40), ('COTTON', 'GA', 0.14), ('COTTON', 'MS', 0.10), ('COTTON', 'AR', 0.10),
  ('COTTON', 'AL', 0.08), ('COTTON', 'NC', 0.07), ('COTTON', 'LA', 0.06), ('COTTON', 'OTHER', 0.05),
  ('RICE', 'AR', 0.50), ('RICE', 'CA', 0.20), ('RICE', 'LA', 0.15), ('RICE', 'MS', 0.08), ('RICE', 'TX', 0.04),
  ('RICE', 'MO', 0.03)),
labels AS (SELECT crop, string_agg(state_code, ', ' ORDER BY rnk) FILTER (WHERE rnk < 3) || '...' AS primary_region
           FROM regions GROUP BY crop),
"""


@register("crop_region_climate", "A19,J13", sql=with_views("grid_points") + """,
st AS (SELECT state_code, avg(value) AS v FROM grid_points WHERE value IS NOT NULL GROUP BY state_code),
""" + _REGION_SQL + """agg AS (
  SELECT r.crop, sum(st.v * coalesce(w.w, o.w, 0)) AS ws, sum(coalesce(w.w, o.w, 0)) AS wt, count(*) AS n
  FROM st JOIN regions r ON st.state_code = r.state_code
  LEFT JOIN weights w ON w.crop = r.crop AND w.state_code = r.state_code
  LEFT JOIN weights o ON o.crop = r.crop AND o.state_code = 'OTHER'
  GROUP BY r.crop)
SELECT a.crop, round(CASE WHEN wt > 0 THEN CAST(ws AS DOUBLE) / CAST(wt AS DOUBLE) END, 6) AS climate_value,
       a.n AS states_included, l.primary_region
FROM agg a JOIN labels l ON a.crop = l.crop""")
def q_crop_region_climate(spark, sf_dir):
    """Crop-region weighted mean of state means over the key states present."""
    st = spatial.state_stats(B.grid_points(spark, sf_dir))
    return spatial.crop_region_weighted(st, dims.crop_regions(spark), dims.crop_state_weights(spark))


@register("agricultural_state_weights", "A33,P8", sql=with_views("grid_points") + """
SELECT p.state_code, count(*) AS n_points, round(avg(p.value), 6) AS mean_value, round(CAST(w.w AS DOUBLE), 6) AS weight
FROM grid_points p JOIN (VALUES ('IA', 1.0), ('IL', 1.0), ('NE', 0.9), ('MN', 0.9), ('IN', 0.9)) AS w(state_code, w)
  ON p.state_code = w.state_code
GROUP BY p.state_code, w.w""")
def q_agricultural_state_weights(spark, sf_dir):
    """P8 + A33: points of agricultural states with the state's importance weight."""
    pts = spatial.agricultural_filter(B.grid_points(spark, sf_dir))
    mask = spatial.agricultural_mask(dims.state_boundaries(spark), dims.agricultural_states(spark))
    return (pts.join(F.broadcast(mask.select("state_code", "weight")), "state_code")
            .groupBy("state_code", "weight")
            .agg(F.count(F.lit(1)).alias("n_points"), F.avg("value").alias("mean_value")))


@register("cropland_state_stats", "P15,A1", sql=with_views("grid_points") + f"""
SELECT state_code, {_STATS} FROM grid_points p
WHERE value IS NOT NULL AND p.grid_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)
GROUP BY state_code""")
def q_cropland_state_stats(spark, sf_dir):
    """Restrict points to cropland (semi join on grid id), then A1."""
    cropland = (B.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
                .select(F.col("c_custkey").cast("string").alias("grid_id")))
    return spatial.state_stats(spatial.cropland_filter(B.grid_points(spark, sf_dir), cropland))


@register("crop_region_climate_states", "A19,J13", sql=with_views("nation_points") + """,
st AS (SELECT state_code, avg(value) AS v FROM nation_points WHERE value IS NOT NULL GROUP BY state_code),
""" + _REGION_SQL + """more AS (SELECT * FROM regions UNION ALL SELECT DISTINCT crop, 'WI', 90 FROM regions
         UNION ALL SELECT DISTINCT crop, 'KY', 91 FROM regions),
agg AS (
  SELECT r.crop, sum(st.v * CAST(coalesce(w.w, o.w, 0) AS DOUBLE)) AS ws, CAST(sum(coalesce(w.w, o.w, 0)) AS DOUBLE) AS wt, count(*) AS n
  FROM st JOIN more r ON st.state_code = r.state_code
  LEFT JOIN weights w ON w.crop = r.crop AND w.state_code = r.state_code
  LEFT JOIN weights o ON o.crop = r.crop AND o.state_code = 'OTHER'
  GROUP BY r.crop)
SELECT a.crop, round(CASE WHEN wt > 0 THEN ws / wt END, 6) AS climate_value, a.n AS states_included, l.primary_region
FROM agg a JOIN labels l ON a.crop = l.crop""")
def q_crop_region_climate_states(spark, sf_dir):
    """A19 for all five crops over 25 states; two states outside every crop's list take the weight of OTHER."""
    st = spatial.state_stats(B.nation_points(spark, sf_dir))
    regions = dims.crop_regions(spark)
    more = regions.select("crop").distinct().select("crop", F.explode(F.array(
        F.struct(F.lit("WI").alias("state_code"), F.lit(90).alias("rank")),
        F.struct(F.lit("KY").alias("state_code"), F.lit(91).alias("rank")))).alias("r")).select("crop", "r.*")
    return spatial.crop_region_weighted(st, regions.unionByName(more), dims.crop_state_weights(spark))


@register("agricultural_states", "A33,P8", sql=with_views("nation_points") + """
SELECT p.state_code, round(CAST(w.w AS DOUBLE), 6) AS weight, count(*) AS n_points, round(avg(p.value), 6) AS mean_value
FROM nation_points p JOIN (VALUES """ + ", ".join(
    f"('{s}', {dims.AG_STATE_WEIGHTS.get(s, dims.AG_STATE_DEFAULT_WEIGHT)})" for s in dims.AGRICULTURAL_STATES) + """) AS w(state_code, w)
  ON p.state_code = w.state_code GROUP BY p.state_code, w.w""")
def q_agricultural_states(spark, sf_dir):
    """P8 + A33 over all agricultural states that hold points, with their importance weights (0.5 where none is given)."""
    pts = spatial.agricultural_filter(B.nation_points(spark, sf_dir))
    return (pts.join(F.broadcast(dims.agricultural_states(spark)), "state_code").groupBy("state_code", "weight")
            .agg(F.count(F.lit(1)).alias("n_points"), F.avg("value").alias("mean_value")))


@register("county_stats_orders", "J11,A2,S10", sql=with_views("order_points", "county_rects") + f"""
SELECT r.state_code, r.county_name, r.county_fips, {_STATS}
FROM order_points p JOIN county_rects r
  ON p.longitude > r.lon_min AND p.longitude < r.lon_max AND p.latitude > r.lat_min AND p.latitude < r.lat_max
WHERE value IS NOT NULL GROUP BY r.state_code, r.county_name, r.county_fips""")
def q_county_stats_orders(spark, sf_dir):
    """J11 + A2: all ten counties, points found by the counties' quadtree cover."""
    inside = spatial.points_in_cover(B.order_points(spark, sf_dir), dims.county_boundaries(spark),
                                     ["county_name", "state_code", "county_fips"])
    return spatial.zonal_stats(inside, ["state_code", "county_name", "county_fips"])


#: Three regions of several rings (outer rings, holes, parts), half a thousandth off no point.
REGION_RINGS = {
    "pentagon": [[(-103.0, 37.0), (-96.0, 36.5), (-94.5, 42.0), (-99.0, 47.0), (-104.0, 43.0)],
                 [(-100.0, 39.0), (-97.0, 39.5), (-98.5, 43.0)], [(-92.0, 37.0), (-88.0, 38.2), (-90.5, 41.7)]],
    "ell": [[(-95.0, 43.0), (-86.0, 43.0), (-86.0, 45.0), (-92.0, 45.0), (-92.0, 49.5), (-95.0, 49.5)]],
    "ring": [[(-89.0, 36.2), (-85.0, 36.2), (-84.2, 39.0), (-85.0, 41.5), (-89.0, 41.5), (-89.8, 39.0)],
             [(-88.2, 37.3), (-85.9, 37.3), (-85.9, 40.4), (-88.2, 40.4)], [(-87.5, 38.3), (-86.5, 38.3), (-87.0, 39.6)]],
}


def _edges_sql() -> str:
    rows = [f"('{name}', {x0}, {y0}, {x1}, {y1})" for name, rings in REGION_RINGS.items() for ring in rings
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1])]
    return f"edges(region, x0, y0, x1, y1) AS (SELECT region, x0::DOUBLE, y0::DOUBLE, x1::DOUBLE, y1::DOUBLE FROM (VALUES {', '.join(rows)}) " \
           "AS v(region, x0, y0, x1, y1))"


@register("region_stats_quadtree", "J11,A1", sql=with_views("order_points") + ",\n" + _edges_sql() + f""",
crossings AS (SELECT p.o_orderkey, e.region, any_value(p.value) AS value, count(*) AS n FROM order_points p JOIN edges e
  ON (e.y0 > p.latitude) <> (e.y1 > p.latitude) AND p.longitude < (e.x1 - e.x0) * (p.latitude - e.y0) / (e.y1 - e.y0) + e.x0
  GROUP BY p.o_orderkey, e.region)
SELECT region, {_STATS} FROM crossings WHERE n % 2 = 1 AND value IS NOT NULL GROUP BY region""")
def q_region_stats_quadtree(spark, sf_dir):
    """J11 + A1: regions with slanted edges, holes and parts; inner cells of the cover decide without the ring test."""
    rows = [(n, [[{"x": x, "y": y} for x, y in r] for r in rings], min(x for r in rings for x, _ in r), min(y for r in rings for _, y in r),
             max(x for r in rings for x, _ in r), max(y for r in rings for _, y in r)) for n, rings in REGION_RINGS.items()]
    polygons = spark.createDataFrame(rows, "region string, rings array<array<struct<x:double,y:double>>>, lon_min double, "
                                           "lat_min double, lon_max double, lat_max double")
    return spatial.zonal_stats(spatial.points_in_cover(B.order_points(spark, sf_dir), polygons, ["region"]), ["region"])
