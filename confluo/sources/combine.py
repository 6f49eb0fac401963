"""The contract of sources and their union."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.sources.recruiter_csv import empty_partials


class Source(Protocol):
    """Reads partial records; does not normalize, merge or validate them."""

    def read(self, spark: SparkSession) -> DataFrame: ...


def combine(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """All records, the frames' one after the other: record numbers of later frames are shifted beyond those of earlier ones."""
    out, shift = None, 0
    for i, df in enumerate(frames):
        moved = df.withColumn("record_idx", F.col("record_idx") + F.lit(shift))
        out = moved if out is None else out.unionByName(moved)
        if i + 1 < len(frames):
            shift += (df.agg(F.max("record_idx")).first()[0] or 0) + 1
    return empty_partials(spark) if out is None else out
