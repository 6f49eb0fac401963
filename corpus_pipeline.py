"""A training corpus in five stages, each of which reads what the one before has written.

Each function of STAGES takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Null and empty texts are scored alike by the
first stage, pass the others as empty texts, are near copies of nothing, and end as no ids. Repeated rows are kept or dropped together. An empty
table gives an empty result; columns besides those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm.decontaminate import find_benchmark
from confluo.llm.line_dedup import line_dedup
from confluo.llm.quality import score_quality, train_quality
from confluo.llm.sentencepiece_lattice import default_model, encode
from confluo.llm.simhash import near_duplicates
from confluo.storage import materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is 0.7 or more; the labels of the training folds teach the classifier."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return score_quality(docs, model).where("score >= 0.7").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines of 20 characters or more that three documents hold stay in the last of them only."""
    kept = line_dedup(docs, min_chars=20, min_docs=3)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts with SimHash fingerprints within 3 bits, as op3 links them, or with 0.8 of their five-word shingles in common."""
    return near_duplicates(docs, shingle=5, similarity=0.8, radius=3).where(F.col("component") == F.col("document_key")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item."""
    return find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ngram=10).where(~F.col("contaminated")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: SentencePiece ids of each document."""
    return encode(docs.select("doc_id", "text"), default_model(spark)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("pieces", pieces)]

#: SQL expresses neither the classifier nor the near copies in reasonable time; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(before)
    return docs
