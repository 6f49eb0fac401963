"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local one that is set once, if all of Spark runs in this machine's one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='confluo-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a re-run, and forgets the partitioning, so
    that adaptive execution can split hot keys of a later join. Shuffle files of what was written are deleted at once, the table
    itself by ``release`` or at the application's end. buckets: a number and a column; joins on that column then need no shuffle
    of the table.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/confluo/{name}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        if buckets:
            writer.bucketBy(*buckets).format("parquet").option("path", path).saveAsTable(f"confluo_{name}")
        else:
            writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    folder, system = _folder(spark, path)
    system.deleteOnExit(folder)
    out = spark.table(f"confluo_{name}") if buckets else spark.read.schema(df.schema).parquet(path)
    out._confluo_path = path
    return out


def spread(df: DataFrame, *key: str, rows: int = 5_000) -> DataFrame:
    """Deal a frame to tasks of about so many rows by the key's hash, however few files hold it: what a task makes of its rows stays the same on any input.

    Counts the frame, which for written tables reads only their footers.
    """
    return df.repartition(df.count() // rows + 1, *key)


def release(*frames: DataFrame) -> None:
    """Delete the tables of materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_confluo_path", None)
        if path:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS confluo_{path.rsplit('/', 1)[1]}")
            folder, system = _folder(df.sparkSession, path)
            system.delete(folder, True)


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())
