"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm._base import document_key, free_name, longs
from confluo.storage import materialize

_SPACE = b" \t\n\x0b\x0c\r"


def _line_keys(min_chars: int):
    """Exploded lines: one row for each document and distinct key, with the places of its lines."""

    def run(batches):
        for batch in batches:
            rows, keys, places = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                seen: dict[bytes, list[int]] = {}
                for at, line in enumerate((text or "").encode().split(b"\n")):
                    key = line.strip(_SPACE).lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        seen.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(at)
                rows += [i] * len(seen)
                keys += seen
                places += seen.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rk").take(at), batch.column("doc_id").take(at), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["rk", "doc_id", "key", "places"])

    return run


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop each line that at least ``min_docs`` documents hold, but for the largest doc_id holding it.

    docs: ``doc_id, text`` and any other columns. Returns the columns of docs with ``text`` reassembled, and
    ``n_lines`` (before dropping) and ``n_dropped``.

    A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case;
    keys of fewer than ``min_chars`` code points are never dropped. Keys travel as 128-bit hashes, counted with
    partial aggregation; the frequent ones are written out, so that the join that follows can split a hot key.

    Null or empty text: one empty line, which stays; null text comes back as an empty one. Null doc_ids count as
    one document below all others. Repeated rows of one doc_id count once and each gets its own result. No rows:
    no rows. Columns named like the two results are replaced.
    """
    key = document_key(docs)
    unique = docs.select(key.alias("rk")).dtypes[0][1] == "bigint"
    rows = docs.select(key.alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rk = rows.schema["rk"].dataType.simpleString()
    lines = rows.mapInArrow(_line_keys(min_chars), f"rk {rk}, doc_id long, key binary, places array<int>")
    n = F.count("*") if unique else F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    often = materialize(lines.groupBy("key").agg(n.alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"))
    drop = lines.join(often, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("rk").agg(F.flatten(F.collect_set("places")).alias("places"))

    @arrow_udf("struct<text string, n_lines bigint, n_dropped bigint>")
    def reassemble(text: pa.Array, drop: pa.Array) -> pa.Array:
        out, lines, dropped = [], [], []
        for t, d in zip(text.to_pylist(), drop.to_pylist(), strict=True):
            parts = (t or "").split("\n")
            gone = set(d or ())
            out.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else t or "")
            lines.append(len(parts))
            dropped.append(len(gone))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), longs(np.array(lines, np.int64)), longs(np.array(dropped, np.int64))], names=["text", "n_lines", "n_dropped"])

    return _with_result(docs, key, drop, reassemble, ["text", "n_lines", "n_dropped"])


def _with_result(docs: DataFrame, key, found: DataFrame, make, names: list[str]) -> DataFrame:
    """docs with the fields of a result in place of columns of these names. found: ``rk`` and what was found there; make: the result from the text and that.

    A merge join at every size: what was found is compressed on disk, so that its size there says little about a broadcast.
    """
    rk, out, hit = (free_name(docs, c) for c in ("_rk", "_out", "_found"))
    found = found.select(F.col("rk").alias(rk), F.col(next(c for c in found.columns if c != "rk")).alias(hit))
    joined = docs.withColumn(rk, key).join(found.hint("merge"), rk, "left").withColumn(out, make(F.col("text"), F.col(hit)))
    kept = [F.col(f"{out}.{c}").alias(c) if c in names else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, *[F.col(f"{out}.{c}").alias(c) for c in names if c not in docs.columns])
