"""Session settings and the durable cut of a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffle partitions, splits skewed join partitions and
# switches to a broadcast join when a side proves small at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "rostrum", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; `conf` keys use `__` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that outlive a job: `spark.checkpoint.dir`, which all
    executors see. Only `local` and `local[...]` sessions get a scratch folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rostrum-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        until_exit(spark, folder)
    return folder.rstrip("/")


def landing(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Call `until_exit` once something is there."""
    return f"{shared_folder(spark)}/rostrum/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def until_exit(spark: SparkSession, path: str) -> None:
    """Have the JVM remove what is at `path` when it ends, however the program ended the
    session before."""
    system, where = file_system(spark, path)
    system.deleteOnExit(where)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back from there.

    For tables that many later jobs read: a lost executor costs a re-read, not a
    recomputation, and readers take only the columns they need. The table goes when
    the program ends, or with `discard`.
    """
    path = landing(df.sparkSession, name)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._landed_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `durable` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_landed_at", None)
        if path:
            system, where = file_system(df.sparkSession, path)
            system.delete(where, True)
