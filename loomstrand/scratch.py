"""Tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is written, at most.
BATCH_ROWS = 1000

#: Files of a small table, at most.
FEW = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and all of Spark is one process (tests,
    one machine) is a temporary folder of our own set; a cluster without the
    setting is an error, as its executors could not read each other's tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="loomstrand-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(f"file://{own}")
    return context._jsc.sc().getCheckpointDir().get()


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Folders that this process has made, with the session of each.
_ROOTS: dict[str, SparkSession] = {}


def clear() -> None:
    """Delete all tables that this process has written; results not read yet are lost. Runs at exit."""
    while _ROOTS:
        root, spark = _ROOTS.popitem()
        with contextlib.suppress(Exception):  # the gateway may be gone
            _deleted(spark, root)


atexit.register(clear)


_HELD: dict[str, list] = {}
_LOCK = threading.Lock()


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value):
    """The session's ``name`` is ``value`` in this block; blocks of several threads may overlap."""
    with _LOCK:
        held = _HELD.setdefault(name, [0, spark.conf.get(name)])
        held[0] += 1
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(name, _HELD.pop(name)[1])


def interpreted(spark: SparkSession):
    """Plans started in this block run without whole-stage code.

    For loops that start many different plans over tables of clusters, bins and
    links, with all work on sequences in numpy: compiling each plan costs more
    time and native memory of the executors than it saves.
    """
    return setting(spark, "spark.sql.codegen.wholeStage", "false")


class Scratch:
    """Parquet tables of one run below the shared folder.

    A written table cuts lineage like a checkpoint, outlives lost executors and
    can be read again without computing it again. ``drop`` frees a table that
    no later plan reads; what a lazy result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch/{name}-{uuid.uuid4().hex}"
        _ROOTS[self.root] = spark

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def write(self, df: DataFrame, tag: str, *partition: str, small: bool = False) -> DataFrame:
        """Store ``df``, if it is known to be ``small`` in FEW files. Rows go to
        Python workers BATCH_ROWS at a time, as some are long."""
        df = df.coalesce(FEW) if small else df
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        most = int(self.spark.conf.get(name))
        with setting(self.spark, name, min(most, BATCH_ROWS) if most > 0 else BATCH_ROWS):
            return self._written(df, tag, *partition)

    def _written(self, df: DataFrame, tag: str, *partition: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition:
            writer = writer.partitionBy(*partition)
        writer.parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        """Delete these tables; then let Spark's cleaner see the shuffles that only they needed."""
        for tag in tags:
            _deleted(self.spark, self.path(tag))
        gc.collect()
        self.spark._jvm.System.gc()
