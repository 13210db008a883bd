"""The streaming state-month aggregate equals the batch one on the same files."""

import os
import tempfile

import pytest

from cropframe import streaming
from cropframe.operators import spatial
from cropframe.sources import files


def test_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="cropframe-stream-", dir="/tmp")
    for var, ym, vals in (("ppt", "201701", [10.0, 20.0, 40.0]), ("tmax", "201702", [1.0, 3.0])):
        os.makedirs(f"{root}/{var}", exist_ok=True)
        with open(f"{root}/{var}/{var}_{ym}_sample.csv", "w") as fh:
            fh.write("state,state_code,grid_id,latitude,longitude,value\n")
            for i, v in enumerate(vals):
                fh.write(f"Iowa,IA,g{i},40.0,-90.0,{v}\n")
    ckpt = tempfile.mkdtemp(prefix="cropframe-stream-ckpt-", dir="/tmp")
    q = streaming.start_state_month(spark, root, "memory", name="state_month_test", checkpoint_location=ckpt)
    q.awaitTermination(120)
    got = {(r.variable, r.month): (r.mean_value, r["count"]) for r in spark.table("state_month_test").collect()}
    batch = {(r.variable, r.month): (r.mean_value, r["count"])
             for r in spatial.state_month_stats(files.read_grid_points(spark, root)).collect()}
    assert got == batch and got[("ppt", 1)] == (70.0 / 3, 3)


def test_stream_keeps_a_table_up_to_date(spark):
    root, sink, ckpt = (tempfile.mkdtemp(prefix="cropframe-stream-", dir="/tmp") for _ in range(3))
    os.makedirs(f"{root}/ppt")

    def land(name, month, values):
        with open(f"{root}/ppt/ppt_2017{month}_{name}.csv", "w") as fh:
            fh.write("state,state_code,grid_id,latitude,longitude,value\n")
            fh.writelines(f"Iowa,IA,g{i},40.0,-90.0,{v}\n" for i, v in enumerate(values))
        q = streaming.start_state_month(spark, root, f"{sink}/t", name=f"s{name}", checkpoint_location=ckpt)
        q.awaitTermination(120)
        assert q.exception() is None

    land("a", "01", [10.0, 20.0])
    land("b", "02", [5.0])
    land("c", "01", [60.0])
    got = {(r.month, r.mean_value, r["count"]) for r in spark.read.parquet(f"{sink}/t").collect()}
    assert got == {(1, 30.0, 3), (2, 5.0, 1)}


def test_no_machine_local_checkpoint_on_a_cluster():
    from cropframe.session import _local_root
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            _local_root(master)
    assert os.path.isdir(_local_root("local[4]"))


def test_stream_checkpoint_is_stable_across_applications(spark):
    from cropframe.session import checkpoint_root
    # the context's checkpoint dir ends in a per-application UUID; the streaming root must not contain it
    app_dir = os.path.basename(spark.sparkContext.getCheckpointDir().rstrip("/"))
    assert app_dir and app_dir not in checkpoint_root(spark)
