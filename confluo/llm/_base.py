"""What the operators share: document keys, Arrow text buffers and vectorised hashing of words and bytes."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_B, _BINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Texts go to Python in batches of about this many bytes, and of 1,000 rows, at most.

    Frames are planned when they are read, after an operator has returned, so the two settings of the session stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or most + 1)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def document_key(docs: DataFrame) -> Column:
    """A column that tells documents apart and sorts them by doc_id.

    doc_id itself where no two rows share one and none is null. Else rows with the same doc_id and text are one
    document, and rows of one doc_id with different texts are documents ordered by a hash of the text; null
    doc_ids sort first.
    """
    bound_batches(docs.sparkSession)
    n, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == distinct:
        return F.col("doc_id").cast("long")
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or with more underscores, as no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return freed memory to the system, which a worker would else keep while it idles beside the JVM and the other workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, end to end, and the offsets of the texts; null is empty."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry at the end)."""
    ws = space[data]
    before, after = np.empty_like(ws), np.empty_like(ws)
    if len(ws):
        before[0], before[1:] = True, ws[:-1]
        after[-1], after[:-1] = True, ws[1:]
        inner = off[(off > 0) & (off < len(ws))]
        before[inner] = True
        after[inner - 1] = True
    starts = np.flatnonzero(~ws & before)
    return starts, np.flatnonzero(~ws & after) + 1, np.searchsorted(starts, off)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = 1 << max(n - 1, 1 << 18).bit_length()
        for name, base in (("p", _B), ("i", _BINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[name] = np.cumprod(x, dtype=np.uint64)
    return _tables["p"][:n], _tables["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads any span out of it."""
    p, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:-1], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): equal contents give equal hashes wherever they are."""
    _, inv = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def rolling_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position that has so many to its right (whatever text they belong to)."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(values)
    _, inv = _powers(len(prefix))
    return mix((prefix[k:] - prefix[:-k]) * inv[: len(prefix) - k])


def sliding(values: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) over each w neighbouring values, by doubling."""
    out, span = values, 1
    while span < w:
        step = min(span, w - span)
        out = op(out[: len(out) - step], out[step:])
        span += step
    return out


def minimizers(grams: np.ndarray, w: int, off: np.ndarray, size: int, k: int) -> np.ndarray:
    """Positions whose k-gram hash is the least of some w neighbours that lie, with their k values, in one text.

    Any ``w + k - 1`` values in a row hold one at least, and equal runs have theirs at the same places.
    off: offsets of the texts, size: number of values.
    """
    if size < w + k - 1 or len(grams) < w:
        return np.zeros(0, np.int64)
    low = sliding(grams, w, np.minimum)
    starts = np.arange(len(low))
    text = np.searchsorted(off, starts, "right") - 1
    low = np.where(starts + (w + k - 1) <= off[text + 1], low, np.uint64(0))
    padded = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(low)] = low
    best = sliding(padded, w, np.maximum)
    return np.flatnonzero((best == grams) & (grams > 0))


def union_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, in order, that cover the same places; touching spans become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
