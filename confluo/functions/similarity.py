"""Ratcliff-Obershelp similarity, which no built-in function gives."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    """Of an ordered pair: the ratio is not symmetric."""
    return SequenceMatcher(None, a, b).ratio()


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that the lengths allow."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def similarity(a: Column, b: Column) -> Column:
    """Ratio of two keys: 0 where one is null, 1 where equal."""

    @arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else ratio(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(run(F.when(a != b, a), F.when(a != b, b)))


def ratios(asks: Column) -> Column:
    """The ratio of each pair ``x, y`` of an array, null for a null pair. Equal pairs of a batch are compared once."""

    @arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        flat = col.flatten()
        x, y = (pc.struct_field(flat, c).dictionary_encode() for c in ("x", "y"))
        there = np.flatnonzero(pc.and_(x.is_valid(), y.is_valid()).to_numpy(zero_copy_only=False))
        i, j = (c.indices.fill_null(0).to_numpy()[there].astype(np.int64) for c in (x, y))
        codes, inverse = np.unique(i * max(len(y.dictionary), 1) + j, return_inverse=True)
        n = max(len(y.dictionary), 1)
        made = np.array([ratio(x.dictionary[c // n].as_py(), y.dictionary[c % n].as_py()) for c in codes.tolist()], np.float64)
        out = np.full(len(flat), np.nan)
        out[there] = made[inverse]
        offsets = np.append(0, np.cumsum(col.value_lengths().fill_null(0).to_numpy())).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, from_pandas=True))

    return run(asks)
