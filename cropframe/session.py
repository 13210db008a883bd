"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cropframe") -> SparkSession:
    """Create (or return) a session with AQE on, the UI off and UTC time.

    ``shuffle_partitions`` defaults to the number of local cores; on a cluster
    leave it unset and let AQE coalesce from the cluster default.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local") or spark.conf.get("spark.checkpoint.dir", None):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; without one, see ``checkpoint_root``.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    target = checkpoint_root(spark, fallback)
    spark.sparkContext.setCheckpointDir(target)
    return spark.sparkContext.getCheckpointDir() or target


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The stable shared folder named by ``spark.checkpoint.dir`` (fallback only when unset, as in tests).

    ``SparkContext.setCheckpointDir`` appends a per-application UUID folder, so
    anything that must be found again after a driver restart (streaming
    checkpoints) is rooted here, not at ``getCheckpointDir()``.
    """
    target = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if target:
        return target.rstrip("/")
    return _local_root(spark.sparkContext.master)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="cropframe-")


def _local_root(master: str) -> str:
    """A temporary folder of this process for a local master; on a cluster, executors would not see it."""
    if not master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is unset: set it to a folder the driver and all executors share")
    return _own_folder()


_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when this driver process ends."""
    path = f"{checkpoint_root(spark)}/frames/{tag}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_drop_scratch)
    _SCRATCH[path] = spark
    return path


def _drop_scratch() -> None:
    """Best effort: a driver that was killed leaves its folders, named by tag, to the cluster's clean-up."""
    for path, spark in _SCRATCH.items():
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def materialize(df: DataFrame, tag: str = "frame") -> DataFrame:
    """Write an expensive intermediate once, as Parquet in the shared checkpoint folder, and read it back.

    Later references (join-backs, scalar statistics, model passes) read the columns they
    need from the written rows, with their statistics, instead of going back to the fact
    tables; a lost executor costs tasks of the reading stage only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
