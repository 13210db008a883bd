"""Views shaped like the reference's data model, derived from the driver tables.

The driver ships TPC-H-like tables, not agricultural ones, so every registered
query reads them through these bindings. Each binding is a Spark plan over the
whole tables (no sampling, no key subsets), so its work grows with the data.

Join strategy: ``nation`` is the fixed 25-row TPC-H dimension and is broadcast;
the fact joins (lineitem - orders - customer) are left to the planner (sort-merge
by default, AQE may switch to broadcast when a side is small at run time).
``orders`` is joined to ``customer`` first so that the big ``lineitem`` side is
shuffled once, on ``l_orderkey``. The grid cells, about as many rows as ``lineitem``,
are dealt over ``task_count`` tasks: left to itself, adaptive execution makes about
one task a core of them, whose sorts and hash maps grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: region key -> state code, market segment -> crop.
REGION_STATES = ["IL", "IA", "NE", "MN", "IN"]
SEGMENT_CROPS = {
    "AUTOMOBILE": "CORN",
    "BUILDING": "SOYBEANS",
    "FURNITURE": "WHEAT",
    "HOUSEHOLD": "COTTON",
    "MACHINERY": "RICE",
}


#: Rows of ``lineitem`` for each task that grid cells are dealt over.
TASK_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for ``lineitem``-sized work: one per ``TASK_ROWS`` rows (the count reads file footers), at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def region_state(regionkey: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in REGION_STATES]), regionkey + 1)


def segment_crop(segment: Column) -> Column:
    pairs = []
    for k, v in SEGMENT_CROPS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), segment)


def _customer_region(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """c_custkey, c_nationkey, n_regionkey, c_mktsegment (nation broadcast: 25 fixed rows)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", *extra)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_regionkey"))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).drop("n_nationkey")


def order_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_orderdate, c_nationkey, n_regionkey, c_mktsegment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cr = _customer_region(spark, sf_dir)
    return o.join(cr, o.o_custkey == cr.c_custkey).drop("o_custkey", "c_custkey")


def climate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state_code, date, year, month, day, tmean, tmin, tmax, ppt (one row per region-day).

    tmean/tmin/tmax = avg/min/max(l_quantity) - 10 and ppt = 0.4 x sum of
    discount points, grouped by the customer's region and the ship date.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_shipdate")
    oa = order_attributes(spark, sf_dir).select("o_orderkey", "n_regionkey")
    j = li.join(oa, li.l_orderkey == oa.o_orderkey)
    g = (j.groupBy(F.col("n_regionkey"), F.to_date("l_shipdate").alias("date"))
         .agg((F.avg("l_quantity") - 10).alias("tmean"),
              (F.min("l_quantity") - 10).alias("tmin"),
              (F.max("l_quantity") - 10).alias("tmax"),
              (F.lit(0.4) * F.sum(F.round(F.col("l_discount") * 100).cast("int"))).alias("ppt")))
    return g.select(region_state(F.col("n_regionkey")).alias("state_code"), "date",
                    F.year("date").alias("year"), F.month("date").alias("month"),
                    F.dayofmonth("date").alias("day"), "tmean", "tmin", "tmax", "ppt")


def _cell_lines(spark: SparkSession, sf_dir: str, orders: DataFrame, *keys: str) -> DataFrame:
    """cell ('C' and the customer's key), ``keys`` of ``orders``, date, year and readings by line, dealt by cell and year.

    Aggregates and windows by cell and year need no further exchange.
    """
    parts = task_count(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_shipdate")
    j = li.repartition(parts, "l_orderkey").join(orders.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cell"), *keys,
                    F.to_date("l_shipdate").alias("date"), F.year(F.to_date("l_shipdate")).alias("year"),
                    "l_quantity", "l_discount").repartition(parts, "cell", "year")


def _cell_readings() -> list[Column]:
    return [(F.avg("l_quantity") - 10).alias("tmean"), (F.min("l_quantity") - 10).alias("tmin"),
            (F.max("l_quantity") - 10).alias("tmax"),
            (F.lit(0.4) * F.sum(F.round(F.col("l_discount") * 100).cast("int"))).alias("ppt")]


def cell_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``climate_daily`` with one grid cell per customer ('C' and the key), which grows with the data.

    A cell-day holds the customer's lines shipped that day; rows are about as many as lineitem's.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    g = _cell_lines(spark, sf_dir, orders).groupBy("cell", "date", "year").agg(*_cell_readings())
    return g.select(F.col("cell").alias("state_code"), "date", "year", F.month("date").alias("month"),
                    F.dayofmonth("date").alias("day"), "tmean", "tmin", "tmax", "ppt")


def cell_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, state_code, date, year, month, day, tmean, tmin, tmax, ppt: one cell per customer, in its region's state.

    Like ``cell_daily``, with the state that calendars need; grows with the data.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _customer_region(spark, sf_dir).select("c_custkey", "n_regionkey")
    parts = task_count(spark, sf_dir)
    oc = (orders.repartition(parts, "o_custkey").join(customers.repartition(parts, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
          .drop("c_custkey"))
    g = _cell_lines(spark, sf_dir, oc, "n_regionkey").groupBy("cell", "n_regionkey", "date", "year").agg(*_cell_readings())
    return g.select("cell", region_state(F.col("n_regionkey")).alias("state_code"), "date", "year",
                    F.month("date").alias("month"), F.dayofmonth("date").alias("day"), "tmean", "tmin", "tmax", "ppt")


#: Nation key -> state code, for queries over more states than regions.
NATION_STATES = ["IL", "IA", "NE", "MN", "IN", "OH", "MO", "KS", "ND", "MT", "WA", "OK", "SD", "TX", "GA", "MS", "AR", "AL",
                 "NC", "LA", "CA", "WI", "KY", "NV", "ME"]


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_id, state_code, value: one point per order in the state of its customer's nation; value = order total."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    state = F.element_at(F.array(*[F.lit(s) for s in NATION_STATES]), F.col("c_nationkey") + 1)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("grid_id"), state.alias("state_code"), F.col("o_totalprice").alias("value"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_id, latitude, longitude, value: one point per order, spread at a thousandth of a degree by its key.

    Places end on half a thousandth, so none lies on a boundary that is given in hundredths.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    return o.select(k.cast("string").alias("grid_id"), (F.lit(36.0005) + ((k * 7919) % 14000) / 1000.0).alias("latitude"),
                    (F.lit(-105.0005) + ((k * 104729) % 21000) / 1000.0).alias("longitude"),
                    F.col("o_totalprice").alias("value"))


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state_code, year, month, variable, value: every line of lineitem is one reading of two variables."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_shipdate")
    oa = order_attributes(spark, sf_dir).select("o_orderkey", "n_regionkey")
    date = F.to_date("l_shipdate")
    j = li.join(oa, li.l_orderkey == oa.o_orderkey).select(
        region_state(F.col("n_regionkey")).alias("state_code"), F.year(date).alias("year"), F.month(date).alias("month"),
        (F.col("l_quantity") - 10).cast("double").alias("t"), F.round(F.col("l_discount") * 100).cast("double").alias("p"))
    return j.select("state_code", "year", "month", F.expr("stack(2, 'tmean', t, 'ppt', p) as (variable, value)"))


def climate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long point observations: state_code, year, month, variable, value (one per region-day-variable).

    The input of the state-variable-month aggregate (A3): every day of
    ``climate_daily`` stands for one grid reading of each variable.
    """
    d = climate_daily(spark, sf_dir)
    return d.select("state_code", "year", "month", "date",
                    F.expr("stack(4, 'tmean', tmean, 'tmin', tmin, 'tmax', tmax, 'ppt', ppt) as (variable, value)"))


def crop_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, crop, yield, harvested_acres, production: one row per order year and segment.

    lineitem is pre-aggregated per order before the join, so the shuffle carries
    one row per order instead of one per line, and the aggregate's partitioning
    on the order key is reused by the join.
    """
    li = _order_totals(spark, sf_dir)
    oa = order_attributes(spark, sf_dir).select("o_orderkey", "o_orderdate", "c_mktsegment")
    j = li.join(oa, li.l_orderkey == oa.o_orderkey)
    g = (j.groupBy(F.year("o_orderdate").alias("year"), F.col("c_mktsegment"))
         .agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty")))
    return g.select(
        F.col("year").cast("int").alias("year"),
        segment_crop(F.col("c_mktsegment")).alias("crop"),
        (F.col("cents") / (F.col("qty") * 100.0)).alias("yield"),
        F.col("qty").cast("bigint").alias("harvested_acres"),
        F.floor(F.col("cents") / 100).cast("bigint").alias("production"))


def state_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, state_code, crop, yield, harvested_acres, production (state grain: customer region)."""
    li = _order_totals(spark, sf_dir)
    oa = order_attributes(spark, sf_dir).select("o_orderkey", "o_orderdate", "n_regionkey", "c_mktsegment")
    j = li.join(oa, li.l_orderkey == oa.o_orderkey)
    g = (j.groupBy(F.year("o_orderdate").alias("year"), "n_regionkey", "c_mktsegment")
         .agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty")))
    return g.select(
        F.col("year").cast("int").alias("year"),
        region_state(F.col("n_regionkey")).alias("state_code"),
        segment_crop(F.col("c_mktsegment")).alias("crop"),
        (F.col("cents") / (F.col("qty") * 100.0)).alias("yield"),
        F.col("qty").cast("bigint").alias("harvested_acres"),
        F.floor(F.col("cents") / 100).cast("bigint").alias("production"))


def climate_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state_code, year, month, tmean, tmin, tmax (monthly means), ppt (monthly total)."""
    d = climate_daily(spark, sf_dir)
    return (d.groupBy("state_code", "year", "month")
            .agg(F.avg("tmean").alias("tmean"), F.avg("tmin").alias("tmin"),
                 F.avg("tmax").alias("tmax"), F.sum("ppt").alias("ppt")))


def _order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, cents (exact integer sum of extended price in cents), qty."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
                 F.sum("l_quantity").alias("qty")))


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state_code, grid_id, latitude, longitude, value: one point per customer.

    Coordinates are spread over the sample rectangles by arithmetic on the key
    (always at x.x5 degrees, so never on a rectangle edge); value = account balance.
    """
    j = _customer_region(spark, sf_dir, "c_acctbal")
    return j.select(
        region_state(F.col("n_regionkey")).alias("state_code"),
        F.col("c_custkey").cast("string").alias("grid_id"),
        (F.lit(36.05) + (F.col("c_custkey") % 140) / 10.0).alias("latitude"),
        (F.lit(-105.05) + ((F.col("c_custkey") * 37) % 210) / 10.0).alias("longitude"),
        F.col("c_acctbal").alias("value"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("county_fips"))


def station_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide station normals (integer tenths), one row per supplier-day.

    STATION = supplier, DATE = ship date; DLY-TMAX-NORMAL = max(q)*10-100,
    DLY-TMIN-NORMAL = min(q)*10-150, DLY-PRCP-NORMAL = sum of discount points.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    g = (li.groupBy(F.col("l_suppkey"), F.to_date("l_shipdate").alias("DATE"))
         .agg((F.max("l_quantity") * 10 - 100).cast("int").alias("DLY-TMAX-NORMAL"),
              (F.min("l_quantity") * 10 - 150).cast("int").alias("DLY-TMIN-NORMAL"),
              F.sum(F.round(F.col("l_discount") * 100).cast("int")).cast("int").alias("DLY-PRCP-NORMAL")))
    return g.select(F.concat(F.lit("ST"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("STATION"),
                    "DATE", "DLY-TMIN-NORMAL", "DLY-TMAX-NORMAL", "DLY-PRCP-NORMAL")


def station_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STATION, STATION_NAME, LATITUDE, LONGITUDE, ELEVATION from supplier."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("ST"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("STATION"),
        F.col("s_name").alias("STATION_NAME"),
        (F.lit(36.05) + (F.col("s_suppkey") % 140) / 10.0).alias("LATITUDE"),
        (F.lit(-105.05) + ((F.col("s_suppkey") * 37) % 210) / 10.0).alias("LONGITUDE"),
        (F.col("s_acctbal") / 10.0).alias("ELEVATION"))


def station_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long station readings (S7 shape): STATION, DATE, VARIABLE, VALUE, ATTRIBUTES from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("EV"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("STATION"),
                    F.to_date("ts").alias("DATE"), F.upper(F.col("event_type")).alias("VARIABLE"),
                    F.col("value").alias("VALUE"), F.col("props").alias("ATTRIBUTES"),
                    F.col("event_id"))


def climate_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County grain: state_code, county_fips, date, year, ... (nation stands in for county)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_shipdate")
    oa = order_attributes(spark, sf_dir).select("o_orderkey", "c_nationkey", "n_regionkey")
    j = li.join(oa, li.l_orderkey == oa.o_orderkey)
    g = (j.groupBy("n_regionkey", "c_nationkey", F.year("l_shipdate").alias("year"))
         .agg((F.avg("l_quantity") - 10).alias("tmean"),
              (F.lit(0.4) * F.sum(F.round(F.col("l_discount") * 100).cast("int"))).alias("ppt")))
    return g.select(region_state(F.col("n_regionkey")).alias("state_code"),
                    F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("county_fips"),
                    F.col("year").cast("int").alias("year"), "tmean", "ppt")


def county_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County-grain census: year, county_fips, crop, yield (orders by customer nation)."""
    li = _order_totals(spark, sf_dir)
    oa = order_attributes(spark, sf_dir).select("o_orderkey", "o_orderdate", "c_nationkey", "c_mktsegment")
    j = li.join(oa, li.l_orderkey == oa.o_orderkey)
    g = (j.groupBy(F.year("o_orderdate").alias("year"), "c_nationkey", "c_mktsegment")
         .agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty")))
    return g.select(F.col("year").cast("int").alias("year"),
                    F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("county_fips"),
                    segment_crop(F.col("c_mktsegment")).alias("crop"),
                    (F.col("cents") / (F.col("qty") * 100.0)).alias("yield"))
