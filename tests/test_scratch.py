"""Stored tables: where they are, how long they stay, settings that threads share."""

import os
import threading

import pytest

from loomstrand import scratch
from loomstrand.scratch import Scratch, setting, shared_folder


class Cluster:
    """A session of a cluster that names no shared folder."""

    def __init__(self, spark, master):
        self.spark, self.master = spark, master
        self.conf = self.sparkContext = self._jsc = self

    def get(self, *_):
        return None

    def getConf(self):
        return self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isEmpty(self):
        return True


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_no_local_folder_on_a_cluster(spark, master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster(spark, master))


def test_tables_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_ROOTS", {})
    kept = Scratch(spark, "test")
    table = kept.write(spark.range(10), "a")
    assert table.count() == 10
    local = kept.root.removeprefix("file:")
    assert os.path.exists(f"{local}/a")
    scratch.clear()
    assert not os.path.exists(local)


def test_setting_is_restored_after_overlapping_blocks(spark):
    name, before = "spark.sql.codegen.wholeStage", spark.conf.get("spark.sql.codegen.wholeStage")
    inside, leave = threading.Event(), threading.Event()

    def other():
        with setting(spark, name, "false"):
            inside.set()
            leave.wait(10)

    thread = threading.Thread(target=other)
    with setting(spark, name, "false"):
        thread.start()
        inside.wait(10)
    assert spark.conf.get(name) == "false"
    leave.set()
    thread.join()
    assert spark.conf.get(name) == before


def test_listed_hot_join_marks_no_rows(spark, tmp_path):
    """Hot keys are parted off by a list: no join hands on every row, and the result is that of a plain join."""
    from pyspark.sql import functions as F

    from loomstrand.joins import hot_join

    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, -7).when(F.col("id") % 3 > 0, F.col("id") % 50).alias("k"), "id")
    rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 1").write.parquet(f"{tmp_path}/groups")
    groups = spark.read.parquet(f"{tmp_path}/groups")
    for how in ("inner", "left"):
        joined = hot_join(rows, groups, ["k"], "n", 6000, how, listed=True)
        assert sorted(map(str, joined.collect())) == sorted(map(str, rows.join(groups, ["k"], how).collect()))
    plan = hot_join(rows, groups, ["k"], "n", 6000, listed=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("Join Inner") == 2
