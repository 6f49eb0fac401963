from pyspark.sql import functions as F

from confluo.schema import PARTIAL_FIELDS, ddl
from confluo.sources.recruiter_csv import from_rows
from confluo.streaming.incremental import consolidate_stream, latest


def test_batches_that_arrive(spark, tmp_path):
    """People whose records arrive in several batches are one record after the last."""
    inbox, folders = str(tmp_path / "in"), [str(tmp_path / n) for n in ("records", "canonical", "checkpoint")]

    def arrive(rows):
        frame = spark.createDataFrame(rows, "i long, name string, email string, phone string")
        from_rows(frame, F.col("i")).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(ddl(PARTIAL_FIELDS)).parquet(inbox)
        consolidate_stream(stream, *folders).awaitTermination()
        return latest(spark, folders[1])

    first = arrive([(0, "Ilka Stolma", "ilka@a.test", None), (1, "Nuno Grauski", "nuno@a.test", None)])
    assert first.count() == 2
    second = arrive([(2, "I. Stolma", "ilka@a.test", "+91 98123 45678"), (3, "Odile Felsova", None, None)])
    assert first.count() == 2  # the earlier result stays readable
    got = {r.full_name.value: [p.value for p in r.phones] for r in second.collect()}
    assert len(got) == 3 and ["+919812345678"] in got.values()
