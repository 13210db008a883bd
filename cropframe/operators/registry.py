"""Model registry (S19, C5): fitted linear models as rows of one versioned table, newest by crop and model type.

The table is a folder of Parquet files partitioned by ``version``. Saving writes one
new version folder and touches no other one; a version is the time of saving in
microseconds, so versions rise and a later save is a newer model. Looking up reads the
version folders' names first and then the newest rows of each key.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.operators import linear_models

COLUMNS = ["model_type", "alpha", "l1_ratio", "n", "features", "means", "scales", "weights", "intercept"]


def save(models: DataFrame, features: list[str], root: str, by: tuple[str, ...] = ("crop",), version: int | None = None) -> int:
    """Write fitted models as one new version; returns the version."""
    version = time.time_ns() // 1000 if version is None else version
    rows = models.withColumn("features", F.array(*[F.lit(f) for f in features])).select(*by, *COLUMNS)
    rows.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/version={version}")
    return version


def latest(spark: SparkSession, root: str, by: tuple[str, ...] = ("crop",), as_of: int | None = None) -> DataFrame:
    """The newest model of every key and model type (not newer than ``as_of``).

    A key that only older versions hold keeps its old model; keys that never were
    saved are absent. Several models of one key and type in one version: the one
    with the smallest penalty.
    """
    rows = spark.read.option("basePath", root).parquet(root)
    if as_of is not None:
        rows = rows.where(F.col("version") <= as_of)
    newest = F.struct(F.col("version"), -F.col("alpha"), -F.col("l1_ratio"))
    row = F.struct("version", *[c for c in COLUMNS if c != "model_type"])
    return rows.groupBy(*by, "model_type").agg(F.max_by(row, newest).alias("m")).select(*by, "model_type", "m.*")


def predict_latest(rows: DataFrame, root: str, features: list[str], by: tuple[str, ...] = ("crop",),
                   model_type: str = "linear", as_of: int | None = None) -> DataFrame:
    """``rows`` with predicted_yield by the newest model of their crop; without a model it is null.

    A model that was trained on other features than ``features`` fails the query.
    """
    m = latest(rows.sparkSession, root, by, as_of).where(F.col("model_type") == model_type)
    same = F.col("features") == F.array(*[F.lit(f) for f in features])
    weights = F.when(same, linear_models.slopes()).otherwise(F.raise_error(F.lit("the model was trained on other features")))
    m = m.select(*by, F.col("version").alias("model_version"), F.col("intercept").alias("_i"), F.col("means").alias("_m"),
                 weights.alias("_b"))
    total = F.col("_i")
    for i, c in enumerate(features):
        total = total + F.get("_b", F.lit(i)) * (F.col(f"`{c}`") - F.get("_m", F.lit(i)))
    return rows.join(m, list(by), "left").withColumn("predicted_yield", total).drop("_i", "_m", "_b")
