"""DuckDB twins of the driver-table bindings (oracle side of the correctness check).

Each constant is a CTE body (``name AS (...)``) written independently in SQL;
``with_views(...)`` assembles the ones a query needs.
"""

from __future__ import annotations

STATE_CASE = ("CASE {k} WHEN 0 THEN 'IL' WHEN 1 THEN 'IA' WHEN 2 THEN 'NE' "
              "WHEN 3 THEN 'MN' WHEN 4 THEN 'IN' END")
CROP_CASE = ("CASE {s} WHEN 'AUTOMOBILE' THEN 'CORN' WHEN 'BUILDING' THEN 'SOYBEANS' "
             "WHEN 'FURNITURE' THEN 'WHEAT' WHEN 'HOUSEHOLD' THEN 'COTTON' WHEN 'MACHINERY' THEN 'RICE' END")

VIEWS: dict[str, str] = {}

VIEWS["climate_daily"] = f"""climate_daily AS (
  SELECT {STATE_CASE.format(k='g.rk')} AS state_code, g.d AS date,
         CAST(year(g.d) AS INTEGER) AS year, CAST(month(g.d) AS INTEGER) AS month,
         CAST(day(g.d) AS INTEGER) AS day, g.tmean, g.tmin, g.tmax, g.ppt
  FROM (
    SELECT n.n_regionkey AS rk, CAST(l.l_shipdate AS DATE) AS d,
           avg(l.l_quantity) - 10 AS tmean, min(l.l_quantity) - 10 AS tmin, max(l.l_quantity) - 10 AS tmax,
           CAST(0.4 AS DOUBLE) * CAST(sum(CAST(round(l.l_discount * 100) AS INTEGER)) AS DOUBLE) AS ppt
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    GROUP BY n.n_regionkey, CAST(l.l_shipdate AS DATE)) g
)"""

VIEWS["climate_points"] = """climate_points AS (
  SELECT state_code, year, month, date, 'tmean' AS variable, tmean AS value FROM climate_daily
  UNION ALL SELECT state_code, year, month, date, 'tmin', tmin FROM climate_daily
  UNION ALL SELECT state_code, year, month, date, 'tmax', tmax FROM climate_daily
  UNION ALL SELECT state_code, year, month, date, 'ppt', ppt FROM climate_daily
)"""

VIEWS["state_month"] = """state_month AS (
  SELECT state_code, year, month, variable, avg(value) AS mean_value, min(value) AS min_value,
         max(value) AS max_value, stddev_samp(value) AS std_value, count(value) AS count
  FROM climate_points WHERE value IS NOT NULL GROUP BY state_code, year, month, variable
)"""

VIEWS["climate_monthly"] = """climate_monthly AS (
  SELECT state_code, year, month, avg(tmean) AS tmean, avg(tmin) AS tmin, avg(tmax) AS tmax, sum(ppt) AS ppt
  FROM climate_daily GROUP BY state_code, year, month
)"""

VIEWS["season_stats"] = """sm_wide AS (
  SELECT state_code, year, month,
    max(CASE WHEN variable = 'ppt' THEN mean_value END) AS ppt_mean,
    max(CASE WHEN variable = 'tmax' THEN mean_value END) AS tmax_mean,
    max(CASE WHEN variable = 'tmean' THEN mean_value END) AS tmean_mean,
    max(CASE WHEN variable = 'tmin' THEN mean_value END) AS tmin_mean,
    min(CASE WHEN variable = 'tmax' THEN min_value END) AS tmax_min,
    min(CASE WHEN variable = 'tmean' THEN min_value END) AS tmean_min,
    min(CASE WHEN variable = 'tmin' THEN min_value END) AS tmin_min,
    max(CASE WHEN variable = 'tmax' THEN max_value END) AS tmax_max,
    max(CASE WHEN variable = 'tmean' THEN max_value END) AS tmean_max,
    max(CASE WHEN variable = 'tmin' THEN max_value END) AS tmin_max
  FROM state_month GROUP BY state_code, year, month
), season_stats AS (
  SELECT w.state_code, w.year + CASE WHEN s.sm > s.em AND w.month >= s.sm THEN 1 ELSE 0 END AS year, s.crop,
    sum(ppt_mean) AS growing_season_ppt_total,
    avg(tmax_mean) AS growing_season_tmax_mean, min(tmax_min) AS growing_season_tmax_min,
    max(tmax_max) AS growing_season_tmax_max,
    avg(tmean_mean) AS growing_season_tmean_mean, min(tmean_min) AS growing_season_tmean_min,
    max(tmean_max) AS growing_season_tmean_max,
    avg(tmin_mean) AS growing_season_tmin_mean, min(tmin_min) AS growing_season_tmin_min,
    max(tmin_max) AS growing_season_tmin_max,
    sum(CASE WHEN coalesce(tmean_mean, (tmin_mean + tmax_mean) / 2) IS NULL THEN NULL
             ELSE greatest(coalesce(tmean_mean, (tmin_mean + tmax_mean) / 2) - 10, 0) END)
      AS growing_degree_days_base10
  FROM sm_wide w
  JOIN (VALUES ('CORN', 4, 9), ('SOYBEANS', 5, 10), ('WHEAT', 9, 6), ('COTTON', 4, 9), ('RICE', 4, 9))
       AS s(crop, sm, em)
    ON (s.sm <= s.em AND w.month BETWEEN s.sm AND s.em) OR (s.sm > s.em AND (w.month >= s.sm OR w.month <= s.em))
  GROUP BY 1, 2, 3
)"""

VIEWS["order_totals"] = """order_totals AS (
  SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey
)"""

VIEWS["crop_census"] = f"""crop_census AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, {CROP_CASE.format(s='c.c_mktsegment')} AS crop,
         CAST(sum(t.cents) AS DOUBLE) / (sum(t.qty) * CAST(100 AS DOUBLE)) AS yield,
         CAST(sum(t.qty) AS BIGINT) AS harvested_acres,
         CAST(floor(CAST(sum(t.cents) AS DOUBLE) / 100) AS BIGINT) AS production
  FROM order_totals t JOIN orders o ON t.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, c.c_mktsegment
)"""

VIEWS["state_census"] = f"""state_census AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, {STATE_CASE.format(k='n.n_regionkey')} AS state_code,
         {CROP_CASE.format(s='c.c_mktsegment')} AS crop,
         CAST(sum(t.cents) AS DOUBLE) / (sum(t.qty) * CAST(100 AS DOUBLE)) AS yield,
         CAST(sum(t.qty) AS BIGINT) AS harvested_acres,
         CAST(floor(CAST(sum(t.cents) AS DOUBLE) / 100) AS BIGINT) AS production
  FROM order_totals t JOIN orders o ON t.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, n.n_regionkey, c.c_mktsegment
)"""

VIEWS["county_census"] = f"""county_census AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS county_fips,
         {CROP_CASE.format(s='c.c_mktsegment')} AS crop,
         CAST(sum(t.cents) AS DOUBLE) / (sum(t.qty) * CAST(100 AS DOUBLE)) AS yield
  FROM order_totals t JOIN orders o ON t.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, c.c_nationkey, c.c_mktsegment
)"""

VIEWS["climate_counties"] = f"""climate_counties AS (
  SELECT {STATE_CASE.format(k='n.n_regionkey')} AS state_code,
         lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS county_fips,
         CAST(year(l.l_shipdate) AS INTEGER) AS year, avg(l.l_quantity) - 10 AS tmean,
         CAST(0.4 AS DOUBLE) * CAST(sum(CAST(round(l.l_discount * 100) AS INTEGER)) AS DOUBLE) AS ppt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_regionkey, c.c_nationkey, year(l.l_shipdate)
)"""

VIEWS["grid_points"] = f"""grid_points AS (
  SELECT {STATE_CASE.format(k='n.n_regionkey')} AS state_code, CAST(c.c_custkey AS VARCHAR) AS grid_id,
         CAST(36.05 AS DOUBLE) + CAST(c.c_custkey % 140 AS DOUBLE) / 10.0 AS latitude,
         CAST(-105.05 AS DOUBLE) + CAST((c.c_custkey * 37) % 210 AS DOUBLE) / 10.0 AS longitude,
         c.c_acctbal AS value, lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS county_fips
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

VIEWS["cell_days"] = f"""cell_days AS (
  SELECT 'C' || CAST(o.o_custkey AS VARCHAR) AS cell, {STATE_CASE.format(k='n.n_regionkey')} AS state_code,
         CAST(l.l_shipdate AS DATE) AS date, CAST(year(l.l_shipdate) AS INTEGER) AS year,
         CAST(month(l.l_shipdate) AS INTEGER) AS month, CAST(day(l.l_shipdate) AS INTEGER) AS day,
         avg(l.l_quantity) - 10 AS tmean, min(l.l_quantity) - 10 AS tmin, max(l.l_quantity) - 10 AS tmax,
         CAST(0.4 AS DOUBLE) * CAST(sum(CAST(round(l.l_discount * 100) AS INTEGER)) AS DOUBLE) AS ppt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL
)"""

VIEWS["cell_months"] = """cell_months AS (
  SELECT cell, state_code, year, month, avg(tmean) AS tmean, min(tmin) AS tmin, sum(ppt) AS ppt
  FROM cell_days GROUP BY ALL
)"""

VIEWS["nation_points"] = """nation_points AS (
  SELECT o.o_orderkey, o.o_totalprice AS value, ['IL', 'IA', 'NE', 'MN', 'IN', 'OH', 'MO', 'KS', 'ND', 'MT', 'WA', 'OK', 'SD',
         'TX', 'GA', 'MS', 'AR', 'AL', 'NC', 'LA', 'CA', 'WI', 'KY', 'NV', 'ME'][c.c_nationkey + 1] AS state_code
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)"""

VIEWS["order_points"] = """order_points AS (
  SELECT o_orderkey, CAST(36.0005 AS DOUBLE) + CAST((o_orderkey * 7919) % 14000 AS DOUBLE) / 1000 AS latitude,
         CAST(-105.0005 AS DOUBLE) + CAST((o_orderkey * 104729) % 21000 AS DOUBLE) / 1000 AS longitude, o_totalprice AS value
  FROM orders
)"""

VIEWS["state_rects"] = """state_rects AS (
  SELECT * FROM (VALUES ('IL', 'Illinois', -91.5, 37.0, -89.0, 42.5), ('IA', 'Iowa', -96.6, 40.4, -91.0, 43.5),
    ('NE', 'Nebraska', -104.0, 40.0, -95.3, 43.0), ('MN', 'Minnesota', -97.2, 43.5, -91.4, 49.4),
    ('IN', 'Indiana', -88.1, 37.8, -84.8, 41.8))
  AS r(state_code, state_name, lon_min, lat_min, lon_max, lat_max)
)"""

VIEWS["county_rects"] = """county_rects AS (
  SELECT * FROM (VALUES
    ('Champaign', 'IL', '17019', -88.4, 39.9, -87.9, 40.4), ('McLean', 'IL', '17113', -89.2, 40.3, -88.6, 40.8),
    ('Story', 'IA', '19169', -93.8, 41.8, -93.3, 42.2), ('Polk', 'IA', '19153', -93.8, 41.4, -93.3, 41.8),
    ('Lancaster', 'NE', '31109', -96.9, 40.6, -96.5, 41.0), ('Douglas', 'NE', '31055', -96.4, 41.2, -95.9, 41.4),
    ('Hennepin', 'MN', '27053', -93.6, 44.9, -93.2, 45.2), ('Ramsey', 'MN', '27123', -93.2, 44.9, -92.9, 45.1),
    ('Marion', 'IN', '18097', -86.3, 39.6, -85.9, 40.0), ('Hamilton', 'IN', '18057', -86.2, 40.0, -85.8, 40.2))
  AS r(county_name, state_code, county_fips, lon_min, lat_min, lon_max, lat_max)
)"""

VIEWS["station_normals"] = """station_normals AS (
  SELECT 'ST' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS "STATION", CAST(l_shipdate AS DATE) AS "DATE",
         CAST(min(l_quantity) * 10 - 150 AS INTEGER) AS "DLY-TMIN-NORMAL",
         CAST(max(l_quantity) * 10 - 100 AS INTEGER) AS "DLY-TMAX-NORMAL",
         CAST(sum(CAST(round(l_discount * 100) AS INTEGER)) AS INTEGER) AS "DLY-PRCP-NORMAL"
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
)"""

VIEWS["station_scaled"] = """station_scaled AS (
  SELECT "STATION", "DATE", CAST(year("DATE") AS INTEGER) AS "YEAR", CAST(month("DATE") AS INTEGER) AS "MONTH",
         "DLY-PRCP-NORMAL" AS raw_p,
         CASE WHEN (SELECT max("DLY-TMIN-NORMAL") FROM station_normals) > 100
              THEN "DLY-TMIN-NORMAL" / 10.0 ELSE CAST("DLY-TMIN-NORMAL" AS DOUBLE) END AS tmin,
         CASE WHEN (SELECT max("DLY-TMAX-NORMAL") FROM station_normals) > 100
              THEN "DLY-TMAX-NORMAL" / 10.0 ELSE CAST("DLY-TMAX-NORMAL" AS DOUBLE) END AS tmax,
         CASE WHEN (SELECT max("DLY-PRCP-NORMAL") FROM station_normals) > 1000
              THEN "DLY-PRCP-NORMAL" / 10.0 ELSE CAST("DLY-PRCP-NORMAL" AS DOUBLE) END AS p
  FROM station_normals
)"""

VIEWS["station_metadata"] = """station_metadata AS (
  SELECT 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS "STATION", s_name AS "STATION_NAME",
         CAST(36.05 AS DOUBLE) + CAST(s_suppkey % 140 AS DOUBLE) / 10.0 AS "LATITUDE",
         CAST(-105.05 AS DOUBLE) + CAST((s_suppkey * 37) % 210 AS DOUBLE) / 10.0 AS "LONGITUDE",
         s_acctbal / 10.0 AS "ELEVATION"
  FROM supplier
)"""

VIEWS["station_obs"] = """station_obs AS (
  SELECT 'EV' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS "STATION", CAST(ts AS DATE) AS "DATE",
         upper(event_type) AS "VARIABLE", value AS "VALUE", props AS "ATTRIBUTES", event_id
  FROM events
)"""

# Dependencies between views (a view's CTE must follow the ones it reads).
DEPS = {
    "climate_points": ["climate_daily"],
    "state_month": ["climate_points"],
    "climate_monthly": ["climate_daily"],
    "cell_months": ["cell_days"],
    "season_stats": ["state_month"],
    "crop_census": ["order_totals"],
    "state_census": ["order_totals"],
    "county_census": ["order_totals"],
    "station_scaled": ["station_normals"],
}


def with_views(*names: str) -> str:
    """WITH clause holding the named views and everything they depend on, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(VIEWS[n] for n in order)
