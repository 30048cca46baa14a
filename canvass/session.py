"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


# Folders with intermediate tables, and the session that made each.
_folders: dict[str, SparkSession] = {}


def build_session(app: str = "canvass", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the library expects; cluster sizing stays with the caller.

    Adaptive execution sizes shuffle partitions, turns joins with small sides into broadcast joins
    after it has measured them, and splits skewed join partitions. The library sets no join hints.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in local mode without the setting, one below the warehouse.

    On a cluster the setting must name a folder that the driver and all executors see. A machine-local
    folder is never used there: it would vanish with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/") if path else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's folder in the shared folder."""
    if not _folders:
        atexit.register(clean_all)
    folder = f"{shared_dir(spark)}/canvass-{spark.sparkContext.applicationId}"
    _folders[folder] = spark
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it when its results have been written.

    Results are lazy and still read these tables, so the library cannot delete them earlier by itself.
    What is left is deleted when the driver's Python ends.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in [f for f, owner in _folders.items() if owner is spark]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        del _folders[folder]


def clean_all() -> None:
    """Clean up at the end of the driver's Python, as far as its sessions still run."""
    for spark in {id(s): s for s in _folders.values()}.values():
        with contextlib.suppress(Exception):
            clean(spark)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a point that survives the loss of executors, fixes values that a second
    evaluation could change (partition ids), and keeps column pruning and file statistics for
    whatever reads it next.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
