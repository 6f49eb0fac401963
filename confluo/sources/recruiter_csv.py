"""Recruiter tables in CSV: one partial record per row."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions.text import blank_to_null, strip
from confluo.schema import PARTIAL_FIELDS, S, carrier, complete, ddl

SOURCE, CONFIDENCE, METHOD = "recruiter_csv", 0.9, "structured"
COLUMNS = ("name", "email", "phone", "current_company", "title")


def empty_partials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ddl(PARTIAL_FIELDS))


def cell(c: Column) -> Column:
    """Trimmed cell; blank says nothing."""
    return blank_to_null(strip(c))


def from_rows(rows: DataFrame, record_idx: Column, source: str = SOURCE) -> DataFrame:
    """Partial records of a frame with any of COLUMNS, matched by exact name; absent columns say nothing."""
    values = {c: carrier(cell(F.col(f"`{c}`").cast("string")) if c in rows.columns else F.lit(None).cast("string"), source, CONFIDENCE, METHOD) for c in COLUMNS}
    job = F.struct(values["current_company"].alias("company"), values["title"].alias("title"), F.lit(None).cast(S).alias("date_range"), F.lit(None).cast(S).alias("summary"))
    worked = values["current_company"].isNotNull() | values["title"].isNotNull()
    return rows.select(
        *complete(
            {
                "record_idx": record_idx,
                "source": F.lit(source),
                "full_name": values["name"],
                "emails": F.array_compact(F.array(values["email"])),
                "phones": F.array_compact(F.array(values["phone"])),
                "experience": F.array_compact(F.array(F.when(worked, job))),
            }
        )
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows in file order; a missing or empty file gives no records.

    Columns are bound by header name, so their order is free; of repeated headers the last one counts. Short rows
    are padded, extra cells ignored, blank lines skipped; quotes, line breaks in quotes, a byte-order mark and bytes that are no
    UTF-8 are read.
    """
    reader = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    try:
        header = reader.csv(path).first()
    except AnalysisException:
        return empty_partials(spark)
    if header is None:
        return empty_partials(spark)
    # Spark renames repeated headers, so columns are found by their place in the header as it is written
    place = {(name or "").lstrip("\ufeff"): i for i, name in enumerate(header)}
    raw = reader.option("header", True).csv(path)
    named = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))]).select(*[F.col(f"c{place[c]}").alias(c) for c in COLUMNS if c in place], F.monotonically_increasing_id().alias("_idx"))
    return from_rows(named, F.col("_idx"))
