"""Choice of input files by listing, bucketed tables, grid export."""

import glob
import os
import random
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F

from cropframe.operators import analysis as AN
from cropframe.operators import integrate
from cropframe.sources import files, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="cropframe-test-", dir="/tmp")


def _file(path, text, time):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    os.utime(path, (time, time))


def test_newest_climate_table_is_read_alone(spark):
    root = _tmp()
    for name, value, time in (("prism_monthly_a.csv", 1.0, 1000), ("prism_monthly_b.csv", 2.0, 3000),
                              ("prism_monthly_c.csv", 3.0, 2000), ("prism_state_z.csv", 9.0, 9000)):
        _file(f"{root}/prism/{name}", f"year,crop,state_code,tmean\n2017,CORN,IA,{value}\n", time)
    path = files.climate_file(spark, root, "monthly")
    df = files.read_climate_table(spark, path)
    assert path.endswith("prism_monthly_b.csv") and [os.path.basename(f) for f in df.inputFiles()] == ["prism_monthly_b.csv"]
    assert dict(df.dtypes) == {"year": "int", "crop": "string", "state_code": "string", "tmean": "double"}
    assert df.first().tmean == 2.0
    _file(f"{root}/prism/prism_monthly_d.csv", "year\n1\n", 3000)  # a tie: the last name
    assert files.climate_file(spark, root, "monthly").endswith("prism_monthly_d.csv")
    _file(f"{root}/prism/prism_monthly_sample.csv", "year\n1\n", 10)  # the sample comes first, however old
    assert files.climate_file(spark, root, "monthly").endswith("prism_monthly_sample.csv")
    assert files.climate_file(spark, root, "other").endswith("prism_state_z.csv")


def test_census_search_order_and_empty_folders(spark):
    root = _tmp()
    raw, processed = f"{root}/raw", f"{root}/processed"
    with pytest.raises(FileNotFoundError):
        files.census_file(spark, raw, processed)
    os.makedirs(processed)
    with pytest.raises(FileNotFoundError):
        files.census_file(spark, raw, processed)
    assert files.newest_file(spark, processed) is None and files.found_files(spark, f"{raw}/*.csv").count() == 0
    for path in (f"{processed}/my_USDA_table.csv", f"{processed}/usda_crop_data_processed.csv", f"{raw}/sample/usda_crop_data_sample.csv"):
        _file(path, "YEAR,CROP,YIELD,HARVESTED_ACRES,PRODUCTION\n2017,CORN,180.5,1,2\n", 100)
        assert files.census_file(spark, raw, processed).endswith(path)
        assert files.read_crop_census(spark, files.census_file(spark, raw, processed)).count() == 1


def test_bucketed_tables_merge_without_a_shuffle(spark):
    root = _tmp()
    keys = [(y, s, c) for y in range(2000, 2008) for s in ("IA", "IL", "NE") for c in ("CORN", "RICE")]
    census = spark.createDataFrame([(*k, float(i)) for i, k in enumerate(keys)], "year int, state_code string, crop string, yield double")
    climate = spark.createDataFrame([(*k, i * 0.5) for i, k in enumerate(keys[4:])], "year int, state_code string, crop string, tmean double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = sinks.write_bucketed(census, "bucketed_census", f"{root}/a", buckets=4)
        b = sinks.write_bucketed(climate, "bucketed_climate", f"{root}/b", buckets=4)
        merged = integrate.crop_specific_merge(a, b, "state")
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        want = integrate.crop_specific_merge(census, climate, "state")
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.select(*merged.columns).collect()))
        assert len(glob.glob(f"{root}/a/*.parquet")) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in ("bucketed_census", "bucketed_climate"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_grids_are_exported_by_crop(spark):
    root = _tmp()
    grid = spark.createDataFrame([(c, f"+{i}.0 degC", float(i)) for c in ("CORN", "RICE") for i in range(8)],
                                 "crop string, label string, a double")
    sinks.export_grid_csv(grid, f"{root}/grid")
    for c in ("CORN", "RICE"):
        parts = glob.glob(f"{root}/grid/crop={c}/*.csv")
        assert len(parts) == 1 and len(open(parts[0]).read().splitlines()) == 9


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rnd = random.Random(7)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [1.0] * 500 + [2.0] * 501, "wide": [rnd.gauss(0, 1) * 10 ** rnd.randint(-9, 9)
              for _ in range(3001)], "flat": [5.0] * 40}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("null", None), ("one", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for accuracy in (20, 10_000):
        got = {r.g: r.quantile for r in AN.exact_quantile(df, "v", q, ["g"], accuracy=accuracy).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            vs = sorted(vs)
            at = (len(vs) - 1) * q
            lo, hi = vs[int(at)], vs[min(len(vs) - 1, -int(-at // 1))]
            assert got[g] == pytest.approx(lo + (hi - lo) * (at - int(at)), rel=1e-12), (g, accuracy)


def test_error_summary_median(spark):
    vs = [float(x * x % 37) for x in range(101)]
    df = spark.createDataFrame([("a", v) for v in vs], "crop string, pct_error double")
    assert AN.error_summary(df).first().median_pct_error == statistics.median(vs)
    assert AN.error_summary(df, ["crop"]).first().median_pct_error == statistics.median(vs)
    plan = AN.error_summary(df, ["crop"])._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan
