"""Sinks and model persistence (S2, S3, S19-S21) and the modelling-ready table."""

import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cropframe.operators import integrate, modeling
from cropframe.schema import MissingColumnsError
from cropframe.sources import files, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="cropframe-test-", dir="/tmp")


def _frame(spark):
    rows = [(2000 + i % 7, ["IA", "IL", "NE"][i % 3], "CORN", 100.0 + i, 10.0 + (i * 7) % 5, 500.0 + i * 3,
             None if i == 4 else 1.0)
            for i in range(30)]
    return spark.createDataFrame(rows, "year long, state_code string, crop string, yield double, tmean double, "
                                       "ppt double, sparse double")


def test_modeling_ready_dummies_nulls_and_casts(spark):
    out = integrate.modeling_ready(_frame(spark), "yield", {"state_code": ["IA", "IL", "NE"]})
    assert dict(out.dtypes)["year"] == "int"
    # the column holding a NULL is dropped; the first level (IA) has no dummy
    assert "sparse" not in out.columns
    assert [c for c in out.columns if c.startswith("state_code_")] == ["state_code_IL", "state_code_NE"]
    rows = out.select("state_code", "state_code_IL", "state_code_NE").distinct().collect()
    for r in rows:
        assert r.state_code_IL == int(r.state_code == "IL") and r.state_code_NE == int(r.state_code == "NE")
    assert out.count() == 30


def test_open_levels_are_a_map(spark):
    df = spark.range(700).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("k"), F.lit(1.0).alias("yield"))
    got = {r.k: r.dummies for r in integrate.dummies(df, {"k": None}).collect()}
    assert got == {f"{i:03}": {f"k_{i:03}": 1} if i else {} for i in range(700)}
    assert integrate.dummies(df, {"k": None}, drop_first=False).where("size(dummies) = 1").count() == 700
    null = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    assert [r.dummies for r in integrate.dummies(null, {"k": None}).collect()] == [{}, {}, {"k_b": 1}]


def test_pooled_frame_prefers_standardised_features(spark):
    z = integrate.standardize(_frame(spark).drop("sparse"))
    out = integrate.modeling_ready(z, "yield", {"crop": ["CORN", "RICE"], "state_code": None}, prefer_standardized=True)
    assert out.columns == ["year", "state_code", "crop", "yield", "tmean_std", "ppt_std", "crop_RICE", "dummies"]


def test_modeling_ready_requires_columns(spark):
    with pytest.raises(MissingColumnsError):
        integrate.modeling_ready(_frame(spark).drop("crop"), "yield")


def test_model_save_load_roundtrip(spark):
    df = _frame(spark).drop("sparse")
    framed, feats, stages = modeling.modeling_frame(df, "yield", ["tmean", "ppt"])
    model = modeling.build_pipeline(stages, "linear").fit(framed)
    path = os.path.join(_tmp(), "corn_linear")
    modeling.save_model(model, path)
    loaded = modeling.load_model(path)
    a = model.transform(framed).select("prediction").collect()
    b = loaded.transform(framed).select("prediction").collect()
    assert [round(r[0], 9) for r in a] == [round(r[0], 9) for r in b]


def test_metrics_json_and_grid_csv(spark):
    root = _tmp()
    metrics = spark.createDataFrame([("CORN", "linear", 0.5, 0.1)], "crop string, model_type string, r2 double, mse double")
    sinks.write_metrics(metrics, f"{root}/metrics")
    lines = [json.loads(x) for p in glob.glob(f"{root}/metrics/*.json") for x in open(p) if x.strip()]
    assert lines == [{"crop": "CORN", "model_type": "linear", "r2": 0.5, "mse": 0.1}]
    grid = spark.createDataFrame([("+1.0 degC", 1.0, 2.0), ("+2.0 degC", 3.0, 4.0)], "label string, a double, b double")
    sinks.export_grid_csv(grid, f"{root}/grid")
    parts = glob.glob(f"{root}/grid/*.csv")
    assert len(parts) == 1
    text = open(parts[0]).read().splitlines()
    assert text[0] == "label,a,b" and len(text) == 3


def test_climate_table_filters_and_glob(spark):
    root = _tmp()
    path = f"{root}/growing_season.csv"
    with open(path, "w") as f:
        f.write("year,crop,state_code,value\n2017,CORN,IA,1.5\n2017,WHEAT,IA,2.5\n2018,CORN,IL,3.5\n")
    df = files.read_climate_table(spark, path, crop="CORN", year=2017)
    assert [tuple(r) for r in df.collect()] == [(2017, "CORN", "IA", 1.5)]
    assert files.grid_glob("/d", "ppt", 2017, 3) == "/d/ppt/ppt_201703*.csv"
    assert files.grid_glob("/d", "ppt") == "/d/ppt/ppt_[0-9][0-9][0-9][0-9][0-9][0-9]*.csv"
