"""Helpers the ten operators share: table access, shared-folder tables, size-checked broadcast."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.session import checkpoint_root, scratch_path

#: Rows of a join side that are broadcast at most; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000


def importable(spark: SparkSession) -> None:
    """Let Python workers that see this package's folder import it, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder driver and executors share."""
    return f"{checkpoint_root(spark)}/llm/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, path: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    ``batch_rows`` bounds the rows that Python functions in ``df`` hold at once, for this write only.

    Without a ``path`` of its own the table is deleted when the driver process ends.
    Cuts the lineage: a lost executor costs tasks of the reading stage, not the
    stages before it, and several readers share one computation.
    """
    path = path or scratch_path(df.sparkSession, f"llm-{tag}")
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if batch_rows:
        conf.set(key, str(batch_rows))
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose counted ``rows`` are within ``limit``; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def doc_rows(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of any documents-like table; a missing column reads as null."""
    have = set(docs.columns)
    return docs.select(
        (F.col("doc_id").cast("long") if "doc_id" in have else F.lit(None).cast("long")).alias("doc_id"),
        (F.col("text").cast("string") if "text" in have else F.lit(None).cast("string")).alias("text"))


def label_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``: the fold a contract names."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
