"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm._base import bound_batches, text_bytes

SPACE = 1 << 18
_BASE3 = 256 + 65536


def _indicators(data: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Numbers of the byte n-grams (1 to 3) of one text; pairs have their own number, triples a hashed one. seen: scratch, all false."""
    x = data.astype(np.uint32)
    seen[x] = True
    if len(x) > 1:
        pair = x[:-1] * np.uint32(256) + x[1:]
        seen[pair + np.uint32(256)] = True
        if len(x) > 2:
            triple = (pair[:-1] * np.uint32(256) + x[2:]) * np.uint32(2654435761)
            seen[_BASE3 + (triple >> np.uint32(8)) % np.uint32(SPACE - _BASE3)] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


@dataclass
class NBSVM:
    """``gain`` and ``square`` by n-gram: a text's margin is sum(gain) / sqrt(sum(square)) + bias; a, b: logistic calibration."""

    gain: np.ndarray
    square: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.array([self.gain[x].sum() / max(np.sqrt(self.square[x].sum()), 1e-9) + self.bias for x in texts])

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -500, 500)))


def fit(texts: list[np.ndarray], y: np.ndarray, c: float = 1.0, alpha: float = 1.0, epochs: int = 15, seed: int = 7) -> NBSVM:
    """Log-count ratios, then a linear hinge-loss model by dual coordinate descent on the scaled indicators.

    A fifth of the rows is kept for the calibration of margins to probabilities. One class only, or no rows: a
    constant, the smoothed share of label 1.
    """
    zero = np.zeros(SPACE, np.float64)
    if len(set(y.tolist())) < 2 or len(y) < 10:
        p = (y.sum() + 1) / (len(y) + 2)
        return NBSVM(zero, zero, 0.0, 0.0, float(np.log(p / (1 - p))))
    held = np.arange(len(y)) % 5 == 4
    for cls in (0, 1):  # every class on both sides
        if not (y[~held] == cls).any() or not (y[held] == cls).any():
            held = np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    pos, neg = np.full(SPACE, alpha), np.full(SPACE, alpha)
    for i in train:
        (pos if y[i] else neg)[texts[i]] += 1
    r = np.log((pos / (alpha + (y[train] == 1).sum())) / (neg / (alpha + (y[train] == 0).sum())))
    square = r * r
    x = {i: r[texts[i]] / max(np.sqrt(square[texts[i]].sum()), 1e-9) for i in train}
    w, bias = np.zeros(SPACE), 0.0
    dual, sign = np.zeros(len(y)), np.where(y == 1, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train):
            g = sign[i] * (w[texts[i]] @ x[i] + bias) - 1
            new = min(max(dual[i] - g / 2.0, 0.0), c)  # a scaled row with its bias has squared length 2
            if new != dual[i]:
                d = (new - dual[i]) * sign[i]
                w[texts[i]] += d * x[i]
                bias += d
                moved = max(moved, abs(d))
                dual[i] = new
        if moved < 1e-3:
            break
    model = NBSVM(w * r, square, bias, 1.0, 0.0)
    on = np.flatnonzero(held) if held.any() else train
    m, t = model.margins([texts[i] for i in on]), y[on].astype(float)
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * m).sum(), g.sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.a, model.b = float(a), float(b)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 8000, held_out: int = 2, folds: int = 4) -> NBSVM:
    """Fit on at most ``sample`` labelled rows, those least by a hash of doc_id, outside the held-out fold (crc32 of doc_id as text).

    The sample's size is the bound of what reaches the driver: its n-gram numbers. Rows with a null doc_id or a label that is
    not 0 or 1 don't count. The chosen ids are few enough to be sent to the tasks, so texts aren't shuffled.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    bound_batches(docs.sparkSession)
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("_cf_y")).where(F.col("_cf_y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != held_out))
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_cf_y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_cf_y", F.coalesce("text", F.lit("")).alias("text"))

    def features(batches):
        seen = np.zeros(SPACE, bool)
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            out = [_indicators(data[a:b], seen).astype(np.int32).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_cf_y"), pa.array(out, pa.binary())], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("x", "ascending")])
    order = np.random.default_rng(1).permutation(got.num_rows)
    return fit([np.frombuffer(got["x"][i].as_py(), np.int32) for i in order.tolist()], got["y"].to_numpy()[order])


def score_quality(docs: DataFrame, model: NBSVM) -> DataFrame:
    """The columns of docs with ``score``: the probability of label 1, from the text alone.

    Whole texts are read, whatever their length; null and empty ones get the score of a text without n-grams. A column named score is replaced.
    """

    @arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        seen = np.zeros(SPACE, bool)
        data, off = text_bytes(col)
        return pa.array(model.score(model.margins([_indicators(data[a:b], seen) for a, b in zip(off[:-1], off[1:], strict=True)])), pa.float64())

    return docs.withColumn("score", run(F.coalesce(F.col("text"), F.lit(""))))
