"""Incremental (file-stream) form of the gridded-climate aggregation.

The reference has no streaming layer; its climate pipeline re-reads every
monthly grid file in batch. Where files land month by month, the same S5 + A3
operator runs as a Structured Streaming query over the landing folder: new files
are picked up incrementally and the state-variable-month aggregate is kept in
the streaming state store (checkpointed in the cluster's shared checkpoint
folder, so a lost executor or driver restart resumes where it stopped).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cropframe.schema import GRID_POINTS
from cropframe.session import checkpoint_root, materialize


def grid_point_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 100) -> DataFrame:
    """S4 + S5 as a stream: grid-point CSVs under ``root/<variable>/`` with year/month from the file name."""
    df = (spark.readStream.schema(GRID_POINTS).option("header", True)
          .option("maxFilesPerTrigger", max_files_per_trigger)
          .option("recursiveFileLookup", True).csv(root))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    ym = F.regexp_extract(name, r"(\d{4})(\d{2})_", 0)
    return (df.select("*", F.regexp_extract(name, r"^([a-z]+)_", 1).alias("variable"),
                      F.substring(ym, 1, 4).try_cast("int").alias("year"),
                      F.substring(ym, 5, 2).try_cast("int").alias("month"))
            .filter(F.col("year").isNotNull() & F.col("value").isNotNull()))


def state_month_stream(points: DataFrame) -> DataFrame:
    """A3 over a stream (mean / min / max / sample std / count per state, year, month, variable)."""
    return (points.groupBy("state_code", "year", "month", "variable")
            .agg(F.avg("value").alias("mean_value"), F.min("value").alias("min_value"),
                 F.max("value").alias("max_value"), F.stddev_samp("value").alias("std_value"),
                 F.count("value").alias("count")))


def start_state_month(spark: SparkSession, root: str, sink: str, name: str = "state_month",
                      available_now: bool = True, checkpoint_location: str | None = None) -> StreamingQuery:
    """Keep the incremental aggregate as Parquet under ``sink``, one folder per year and month.

    Update mode: a trigger brings the groups that changed; the month folders they
    belong to are rewritten with the other rows kept, so a repeated trigger gives
    the same files. ``sink="memory"`` is for tests. The checkpoint defaults to
    ``<spark.checkpoint.dir>/streaming/<name>``: stable across driver restarts.
    """
    ckpt = checkpoint_location or f"{checkpoint_root(spark)}/streaming/{name}"
    agg = state_month_stream(grid_point_stream(spark, root))
    w = agg.writeStream.option("checkpointLocation", ckpt).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    if sink == "memory":
        return w.outputMode("complete").format("memory").start()

    def rewrite(changed: DataFrame, _epoch: int) -> None:
        changed = materialize(changed)
        months = changed.select("year", "month").distinct()
        try:
            old = changed.sparkSession.read.schema(changed.schema).parquet(sink)
        except AnalysisException:
            old = changed.limit(0)
        kept = old.join(F.broadcast(months), ["year", "month"], "left_semi").join(
            changed, ["state_code", "year", "month", "variable"], "left_anti")
        merged = materialize(kept.unionByName(changed))  # read before the folders it came from are replaced
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("year", "month").parquet(sink))

    return w.outputMode("update").foreachBatch(rewrite).start()
