"""Sources and sinks: path-dated grid files, JSON flattening with bad values, snapshot read-back."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from cropframe.operators import integrate, spatial
from cropframe.sources import files, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="cropframe-test-", dir="/tmp")


def test_grid_files_dates_from_path_and_state_month(spark):
    root = _tmp()
    for var, ym, vals in (("ppt", "201701", [10.0, 20.0]), ("ppt", "201702", [30.0, 50.0]), ("tmax", "201701", [1.0, 3.0])):
        os.makedirs(f"{root}/{var}", exist_ok=True)
        with open(f"{root}/{var}/{var}_{ym}_sample.csv", "w") as fh:
            fh.write("state,state_code,grid_id,latitude,longitude,value\n")
            for i, v in enumerate(vals):
                fh.write(f"Iowa,IA,g{i},40.0,-90.0,{v}\n")
    os.makedirs(f"{root}/ppt", exist_ok=True)
    with open(f"{root}/ppt/ppt_nodate.csv", "w") as fh:  # no date: skipped
        fh.write("state,state_code,grid_id,latitude,longitude,value\nIowa,IA,g0,40.0,-90.0,999\n")
    pts = files.read_grid_points(spark, root)
    sm = {(r.variable, r.year, r.month): r for r in spatial.state_month_stats(pts).collect()}
    assert set(sm) == {("ppt", 2017, 1), ("ppt", 2017, 2), ("tmax", 2017, 1)}
    assert sm[("ppt", 2017, 2)].mean_value == 40.0
    only = files.read_grid_points(spark, root, variable="ppt", year=2017, month=1).count()
    assert only == 2  # S3 pruning by path


def test_crop_json_drops_unparseable_values(spark):
    root = _tmp()
    data = {"data": [
        {"year": "2017", "commodity_desc": "CORN", "statisticcat_desc": "YIELD", "Value": "176.6", "unit_desc": "BU"},
        {"year": "2017", "commodity_desc": "CORN", "statisticcat_desc": "AREA HARVESTED", "Value": "(D)",
         "unit_desc": "ACRES"},
        {"year": "2017", "commodity_desc": "CORN", "statisticcat_desc": "PRODUCTION", "Value": "1,234",
         "unit_desc": "BU"},
        {"year": "2017", "commodity_desc": "CORN", "statisticcat_desc": "YIELD", "Value": "180.0", "unit_desc": "BU"}]}
    with open(f"{root}/corn.json", "w") as fh:
        json.dump(data, fh)
    long = files.read_crop_json(spark, f"{root}/corn.json")
    assert long.count() == 2
    assert files.read_crop_json(spark, f"{root}/corn.json", strip_commas=True).count() == 3
    piv = integrate.crop_category_pivot(long, require_complete=False).first()
    assert piv.YIELD == 180.0 and piv.HARVESTED_ACRES is None  # last row wins


def test_station_json(spark):
    root = _tmp()
    with open(f"{root}/st.json", "w") as fh:
        json.dump({"results": [{"station": "S1", "date": "2010-01-01T00:00:00", "value": -33, "attributes": "C"}]}, fh)
    r = files.read_station_json(spark, f"{root}/st.json", "DLY-TMIN-NORMAL").first()
    assert r.STATION == "S1" and str(r.DATE) == "2010-01-01" and r.VALUE == -33.0


def test_write_and_latest_snapshot(spark):
    root = _tmp()
    df = spark.createDataFrame([(2000 + i, "CORN", 100.0 + i) for i in range(25)], "year int, crop string, yield double")
    sinks.write_dataset(df, root, "census", ds="20240101")
    sinks.write_dataset(df.withColumn("yield", F.col("yield") + 1), root, "census", ds="20240202")
    back = files.latest_snapshot(spark, f"{root}/census")
    assert back.count() == 25 and back.select("ds").distinct().first()[0] == "20240202"


def test_crop_json_last_row_wins_across_files(spark):
    root = _tmp()
    for name, value in (("a.json", "1.0"), ("b.json", "2.0")):
        row = {"year": "2017", "commodity_desc": "CORN", "statisticcat_desc": "YIELD", "Value": value, "unit_desc": "BU"}
        pad = [dict(row, year="2016")] if name == "a.json" else []
        with open(f"{root}/{name}", "w") as fh:
            json.dump({"data": [*pad, row]}, fh)
    piv = integrate.crop_category_pivot(files.read_crop_json(spark, root), require_complete=False)
    assert {r.YEAR: r.YIELD for r in piv.collect()} == {2016: 1.0, 2017: 2.0}
