"""Session defaults and the few cluster-level helpers that operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that make results independent of where the job runs and let AQE pick partition counts and split skewed partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "claimloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; ``conf`` keys are given with ``__`` in place of dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: the one the cluster names in ``spark.checkpoint.dir``.

    Only where neither that setting nor a directory of the context exists and the master is local does it make a
    temporary one; on a cluster without the setting it refuses, as a machine-local folder would be lost with its machine.
    """
    ctx = spark.sparkContext
    named = ctx.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not ctx.master.startswith("local[") and ctx.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="claimloom-checkpoint-")
    if not ctx.getCheckpointDir():
        ctx.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read from there.

    Later branches read only the columns they need, and a lost executor costs no rerun of what came before. The tables of
    a session go when it ends, as results that read them may be used until then.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark)
    folder = f"{root.rstrip('/')}/claimloom-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone already; the folder stays for whoever empties the shared one
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a directory or a single file."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its scan has less than half as many (a single small file).

    Reads the number of partitions of the plan only; large inputs, whose scans are split already, keep theirs without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() * 2 <= want else df


def bind(df: DataFrame, name: str, expr) -> DataFrame:
    """``df`` with ``name`` evaluated once per row.

    A generator of one element is a barrier that the optimizer doesn't inline through. With ``withColumn``, a filter on a
    column at the end of a chain of steps is pushed through all of them, each reference replaced by the whole expression
    behind it, and a chain of five steps with ten references each is no longer a plan that anyone can compile.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def null_if_blank(c):
    """The column, trimmed of white space, or null where nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)
