"""Sinks (S11, S20, S21): partitioned dataset writes, metrics and grid exports (S19 model persistence: modeling.py)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame


def write_dataset(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ("crop",),
                  ds: str | None = None, fmt: str = "parquet") -> str:
    """``<root>/<name>/ds=<YYYYMMDD>/<partition>=...``; overwrite of that snapshot only.

    One job writes every crop (the reference writes one file per crop in a loop).
    """
    ds = ds or _dt.date.today().strftime("%Y%m%d")
    path = f"{root}/{name}/ds={ds}"
    w = df.write.mode("overwrite")
    cols = [c for c in partition_by if c in df.columns]
    if cols:
        w = w.partitionBy(*cols)
    w.format(fmt).save(path)
    return path


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Result summary (crop, model_type, metrics) as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def export_grid_csv(grid: DataFrame, path: str, partition_by: tuple[str, ...] = ("crop",)) -> None:
    """Labelled scenario grids as CSV with headers, one folder per value of ``partition_by`` where present.

    Rows are dealt by those columns, so each grid is one file and different grids are
    written by different tasks; a grid without them is one small file.
    """
    cols = [c for c in partition_by if c in grid.columns]
    rows = grid.repartition(*cols) if cols else grid.repartition(1)
    w = rows.write.mode("overwrite").option("header", True)
    (w.partitionBy(*cols) if cols else w).csv(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: tuple[str, ...] = ("year", "state_code", "crop"),
                   buckets: int = 200) -> DataFrame:
    """An external table bucketed and sorted by ``keys``.

    Tables with the same keys and number of buckets join, merge and aggregate on these
    keys without a shuffle of either side. Rows are dealt by the keys first, so a
    bucket is one file. ``buckets`` fixes the parallelism of later joins; choose it for
    the largest table.
    """
    (df.repartition(buckets, *keys).write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
     .saveAsTable(table))
    return df.sparkSession.table(table)
