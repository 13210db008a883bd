"""Chains and small operators that no registered query calls: P2, U1, S1, S8, A28 / S21, X3, X4."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from cropframe.operators import integrate, scenario
from cropframe.plans import composites
from cropframe.schema import add_lowercase_aliases
from cropframe.sources import files


def _tmp():
    return tempfile.mkdtemp(prefix="cropframe-test-", dir="/tmp")


def test_lowercase_aliases_and_union(spark):
    a = spark.createDataFrame([(1, "x", 2)], "YEAR int, Crop string, crop_id int")
    assert add_lowercase_aliases(a).columns == ["YEAR", "Crop", "crop_id", "year", "crop"]
    b = spark.createDataFrame([(2, 5.0)], "YEAR int, extra double")
    rows = integrate.union_all([a, b]).orderBy("YEAR").collect()
    assert [(r.YEAR, r.Crop, r.extra) for r in rows] == [(1, "x", None), (2, None, 5.0)]


def test_census_and_station_metadata_readers(spark):
    root = _tmp()
    with open(f"{root}/crop.csv", "w") as fh:
        fh.write("YEAR,CROP,YIELD\n2017,CORN,180.5\n")
    assert files.read_crop_census(spark, f"{root}/crop.csv").count() == 1
    with open(f"{root}/meta.json", "w") as fh:
        fh.write(json.dumps({"id": "S1", "name": None, "latitude": 41.5}) + "\n")
    r = files.read_station_metadata(spark, f"{root}/meta.json").first()
    assert (r.STATION, r.STATION_NAME, r.LATITUDE, r.ELEVATION) == ("S1", "Unknown", 41.5, 0.0)


def test_grid_table_is_wide(spark):
    pred = spark.createDataFrame([(-1.0, 0.0, 1.0), (-1.0, 10.0, 2.0), (2.0, 0.0, 3.0), (2.0, 10.0, 4.0)],
                                 "temp_change double, precip_change double, predicted_yield double")
    rows = scenario.grid_table(pred).collect()
    assert [(r["temperature_change"], r["+0.0%"], r["+10.0%"]) for r in rows] == [
        ("-1.0 degC", 1.0, 2.0), ("+2.0 degC", 3.0, 4.0)]


def test_census_years_batch_and_integrated_dataset(spark):
    months = [("IA", y, m, v, float(y % 10 + m)) for y in (2011, 2012, 2017) for m in range(1, 13)
              for v in ("ppt", "tmean", "tmax", "tmin")]
    sm = spark.createDataFrame(months, "state_code string, year int, month int, variable string, mean_value double")
    for c in ("min_value", "max_value", "std_value"):
        sm = sm.withColumn(c, F.col("mean_value"))
    stats = composites.census_batch(sm.withColumn("count", F.lit(30).cast("bigint")))
    assert {r.year for r in stats.select("year").collect()} == {2012, 2017}
    census = spark.createDataFrame([(y, "IA", c, 100.0 + y) for y in (2012, 2017) for c in ("CORN", "WHEAT")],
                                   "year int, state_code string, crop string, yield double")
    root = _tmp()
    composites.integrate_and_write(census, stats, root, ds="20240101")
    back = files.latest_snapshot(spark, os.path.join(root, "integrated"))
    assert back.count() == 4 and {r.crop for r in back.select("crop").distinct().collect()} == {"CORN", "WHEAT"}
