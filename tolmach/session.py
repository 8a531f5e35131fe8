"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere, adaptive plans, Arrow transfer.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session with the engine's settings; a cluster brings its own session."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more
    spark = SparkSession.builder.master(master).appName("tolmach").config(map=conf).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that workers find it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_tolmach_sent", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "tolmach.zip")  # read by the driver only, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tolmach", os.path.relpath(path, package)))
    context.addPyFile(archive)
    context._tolmach_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one is set only where there is none."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"tolmach-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as a Parquet table in the shared folder and read it again.

    This cuts the lineage: what follows survives a lost executor without
    repeating what came before, and columns that are not needed later are not read.
    The tables go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
