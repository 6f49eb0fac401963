"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm._base import LOWER, bound_batches, free_name, slices, text_bytes, union_length, word_spans

#: Bytes that end a word, once A-Z are in lower case: all below 0x80 but 0-9 and a-z.
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False
_LANE = 512
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _spaced(data: np.ndarray, off: np.ndarray):
    """The words of all texts in a buffer: each text is a zero, a space, and its words with a space after each.

    Returns the buffer, where each word's leading space is, where its trailing space is, and the first word of each text.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, _BREAK)
    size = ends - starts
    text = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    at = np.cumsum(size + 1) - size + 2 * text + 1
    out = np.full(int(at[-1] + size[-1] + 1) if len(at) else 0, 32, np.uint8)
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts] = 1
    mask[ends] -= 1
    edge = np.zeros(len(out) + 1, np.int8)
    edge[at] = 1
    edge[at + size] -= 1
    out[np.cumsum(edge[:-1]).astype(bool)] = data[np.cumsum(mask[:-1]).astype(bool)]
    heads = first[:-1][np.diff(first) > 0]
    out[at[heads] - 2] = 0
    return out, at - 1, at + size, first


class WuManber:
    """Shift table, suffix-hash buckets and direct comparison for a set of byte strings."""

    def __init__(self, patterns: list[bytes], block: int = 8):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.b = b = min(block, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        flat = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        self.bits = bits = int(np.clip(np.ceil(np.log2(len(patterns) * (m - b + 1))) + 4, 12, 24))
        self.shift = np.full(1 << bits, min(m - b + 1, 255), np.uint8)
        for j in range(m - b + 1):
            # nearer to the end later, so that the least shift of a block stays
            self.shift[self._slot(self._blocks(flat, j))] = min(m - b - j, 255)
        suffix = self._blocks(flat, m - b)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, self.first = np.unique(suffix[self.order], return_index=True)
        self.last = np.append(self.first[1:], len(patterns))
        self.head = self._blocks(flat, 0)

    def _blocks(self, flat: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros(len(flat), np.uint64)
        for i in range(self.b):
            out |= flat[:, j + i].astype(np.uint64) << np.uint64(8 * i)
        return out

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * _MUL) >> np.uint64(64 - self.bits)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and pattern numbers of all occurrences; many stretches of the text are scanned side by side."""
        n, m, b = len(text), self.m, self.b
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.concatenate([text, np.zeros(8, np.uint8)])
        lane = np.ndarray(n + 1, "<u8", raw, strides=(1,))
        at = np.arange(0, n - m + 1, _LANE)
        stop = np.minimum(at + _LANE, n - m + 1)
        found = []
        while len(at):
            step = self.shift[self._slot(lane[at + (m - b)] & self.mask)]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        end = lane[at + (m - b)] & self.mask
        i = np.minimum(np.searchsorted(self.suffix, end), len(self.suffix) - 1)
        same = self.suffix[i] == end
        at, i = at[same], i[same]
        n_each = self.last[i] - self.first[i]
        where = np.repeat(at, n_each)
        which = self.order[np.repeat(self.first[i], n_each) + np.arange(len(where)) - np.repeat(np.cumsum(n_each) - n_each, n_each)]
        near = (lane[where] & self.mask) == self.head[which]
        where, which = where[near], which[near]
        whole = text.tobytes()
        true = np.fromiter((whole.startswith(self.patterns[p], w) for w, p in zip(where.tolist(), which.tolist(), strict=True)), bool, len(where))
        return where[true], which[true]


def _windows(rows: list, ngram: int) -> dict[bytes, set[str]]:
    """Windows of the items as `` w1 w2 ... `` with the ids of their items."""
    out: dict[bytes, set[str]] = {}
    for item, text in rows:
        low = text.encode().translate(LOWER.tobytes())
        words = bytes(32 if _BREAK[c] else c for c in low).split(b" ")
        words = [w for w in words if w]
        size = min(ngram, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            out.setdefault(b" " + b" ".join(words[i : i + size]) + b" ", set()).add("" if item is None else str(item))
    return out


_built: dict[str, list[tuple[WuManber, list[list[str]]]]] = {}


def _machines(name: str, rows: list, ngram: int) -> list[tuple[WuManber, list[list[str]]]]:
    """The tables of a block, with the items of each pattern: made once in a process, which keeps those of its latest search."""
    if name not in _built:
        for other in [n for n in _built if n.split("/")[0] != name.split("/")[0]]:
            del _built[other]
        windows = _windows(rows, ngram)
        groups = [w for w in windows if w.count(b" ") == ngram + 1], [w for w in windows if w.count(b" ") <= ngram]
        _built[name] = [(WuManber(g), [sorted(windows[w]) for w in g]) for g in groups if g]
    return _built[name]


def _search(sent: Broadcast, name: str, ngram: int):
    """A column function: words, spans of hit words (flat pairs), and ids of the items found. sent: the items of a block."""

    @arrow_udf("struct<n_words bigint, spans array<int>, items array<string>>")
    def run(col: pa.Array) -> pa.Array:
        machines = _machines(name, sent.value, ngram)
        parts = []
        for batch in slices([pa.RecordBatch.from_arrays([col], names=["text"])]):
            data, off = text_bytes(batch.column(0))
            buf, lead, trail, first = _spaced(data, off)
            docs, a, b, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
            for machine, ids in machines:
                where, which = machine.find(buf)
                size = np.array([len(p) for p in machine.patterns])[which]
                s, e = np.searchsorted(lead, where), np.searchsorted(trail, where + size - 1) + 1
                d = np.searchsorted(first, s, "right") - 1
                docs.append(d)
                a.append(s)
                b.append(e)
                for x, p in zip(d.tolist(), which.tolist(), strict=True):
                    found.setdefault(x, set()).update(ids[p])
            s, e = union_length(np.concatenate(a), np.concatenate(b))
            # spans of neighbouring texts may touch and must not become one
            cut = first[1:-1]
            inner = cut[np.searchsorted(s, cut, "left") > 0] if len(s) else cut[:0]
            inner = inner[(inner > s[np.searchsorted(s, inner, "left") - 1]) & (inner < e[np.searchsorted(s, inner, "left") - 1])]
            s, e = np.sort(np.append(s, inner)), np.sort(np.append(e, inner))
            d = np.searchsorted(first, s, "right") - 1
            pairs = (np.stack([s, e], 1) - first[d][:, None]).astype(np.int32)
            n = np.bincount(d, minlength=len(batch)) * 2
            ends = np.zeros(len(batch) + 1, np.int32)
            np.cumsum(n, out=ends[1:])
            parts.append(pa.StructArray.from_arrays([pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs.ravel())), pa.array([sorted(found.get(i, ())) for i in range(len(batch))], pa.list_(pa.string()))], names=["n_words", "spans", "items"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

    return run


def _merge(spans: Column) -> Column:
    """Flat pairs of spans as disjoint spans in order."""

    @arrow_udf("array<int>")
    def run(col: pa.Array) -> pa.Array:
        out = []
        for x in col.to_pylist():
            a = np.array(x or [], np.int64).reshape(-1, 2)
            out.append(np.stack(union_length(a[:, 0], a[:, 1]), 1).ravel().tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return run(spans)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, ngram: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """The columns of docs with ``n_words, spans, items, contaminated``: which words occur in windows of the benchmark.

    docs: ``text`` and any other columns. benchmark: ``item_id, text``. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are in
    lower case. A window is ``ngram`` consecutive words of an item; an item of fewer, but not none, is one window.
    spans: start and end of each run of hit words, one after the other; items: ids of the items with occurring
    windows, sorted as strings.

    The benchmark is broadcast in blocks of at most ``block_bytes`` of its text, whose tables each process builds once; one of more than
    that gives a search for each block within the same pass over docs.

    Null texts have no words; null item ids are listed as an empty string; repeated items count once. An empty
    benchmark hits nothing. Columns named like the results are replaced.
    """
    bound_batches(docs.sparkSession)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out, names, search = docs, [], uuid.uuid4().hex
    for i in range(blocks):
        rows = benchmark.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)).select("item_id", "text").collect()
        sent = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])
        names.append(free_name(docs, f"_hit{i}"))
        out = out.withColumn(names[-1], _search(sent, f"{search}/{i}", ngram)(F.col("text")))
    spans = F.col(f"{names[0]}.spans") if blocks == 1 else _merge(F.flatten(F.array(*[F.col(f"{n}.spans") for n in names])))
    results = {
        "n_words": F.col(f"{names[0]}.n_words"),
        "spans": spans,
        "items": F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names])))),
        "contaminated": F.size(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.spans") for n in names])))) > 0,
    }
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], *[c.alias(n) for n, c in results.items()])
