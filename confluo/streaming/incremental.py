"""Consolidation of records that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from confluo.plans.merge import merge


def consolidate_stream(partials: DataFrame, records: str, canonical: str, checkpoint: str) -> StreamingQuery:
    """Append each batch of partial records to the folder ``records`` and write the canonical records of all so far below ``canonical``.

    A batch and its result are written under its number, so that one that is repeated after a failure replaces itself alone, and readers
    of earlier results are not disturbed (see ``latest``).
    """

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{records}/batch={number}")
        everything = df.sparkSession.read.parquet(records).where(f"batch <= {number}").drop("batch")
        merge(everything).write.mode("overwrite").parquet(f"{canonical}/batch={number}")

    return partials.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, canonical: str) -> DataFrame:
    """The canonical records of the last batch that has been written whole."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{canonical}/batch=*/_SUCCESS")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
    last = max(int(f.getPath().getParent().getName().split("=")[1]) for f in found)
    return spark.read.parquet(f"{canonical}/batch={last}")
