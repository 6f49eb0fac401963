"""Where a corpus repeats itself: sampled anchors, and the segments of text around those that recur.

A window is ``size`` values in a row of one document; values are words or bytes. An anchor is the least-hashed run
of ``k`` values of a window, so equal windows have equal anchors and about two in ``size - k`` places
are anchors. Only windows whose anchor occurs at two places or more can recur. They are dealt out by
``home``, a hash of the smallest document that holds their anchor: all places of a window share it, and neighbouring
anchors of copied text mostly do, so that text travels once and not once for each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm._base import longs, minimizers, rolling_hash, slices, sliding, text_bytes, word_hashes, word_spans
from confluo.storage import materialize, release


def values_of(batch: pa.RecordBatch, unit: str):
    """The values to hash, the offsets of the texts in them, and for words the buffer with their starts and ends."""
    data, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
    if unit == "bytes":
        return data, off, (data, None, None)
    starts, ends, first = word_spans(data, off)
    return word_hashes(data, starts, ends), first, (data, starts, ends)


def _anchors(unit: str, size: int, k: int):
    def run(batches):
        for batch in slices(batches, limit=1 << 18 if unit == "bytes" else 1 << 20):
            values, off, _ = values_of(batch, unit)
            grams = rolling_hash(values, k)
            at = minimizers(grams, size - k + 1, off, len(values), k)
            doc = np.searchsorted(off, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("rk").take(pa.array(doc)), pa.array((at - off[doc]).astype(np.int32)), longs(grams[at])], names=["rk", "at", "anchor"])

    return run


def _segments(unit: str, size: int, k: int):
    w = size - k + 1

    def run(batches):
        for batch in slices(batches, limit=1 << 18 if unit == "bytes" else 1 << 20):
            values, off, (data, starts, ends) = values_of(batch, unit)
            grams = rolling_hash(values, k)
            if len(grams) < w:
                continue
            hits = batch.column(batch.schema.get_field_index("hits"))
            n = np.diff(np.array(hits.offsets))
            flat = hits.flatten()
            where = flat.field("at").to_numpy() + np.repeat(off[:-1], n)
            home = flat.field("home")
            # the anchor of each window: the leftmost of its least grams
            low = sliding(grams, w, np.minimum)
            s = np.arange(len(low))
            text = np.searchsorted(off, s, "right") - 1
            inside = s + size <= off[text + 1]
            hit = np.full(len(values), -1, np.int64)
            hit[where] = np.arange(len(where))
            least = np.flatnonzero(np.append(hit[: len(grams)] >= 0, False))
            if not len(least):
                continue
            # the first place, at or after a window's start, that is an anchor and has the window's least hash
            of = np.full(len(low), -1, np.int64)
            slot = np.searchsorted(least, s)
            todo = np.flatnonzero(inside & (slot < len(least)))
            while len(todo):
                p = least[slot[todo]]
                near = p < todo + w
                todo, p = todo[near], p[near]
                same = grams[p] == low[todo]
                of[todo[same]] = hit[p[same]]
                todo = todo[~same]
                slot[todo] += 1
                todo = todo[slot[todo] < len(least)]
            s = np.flatnonzero(of >= 0)
            if not len(s):
                continue
            # runs of windows of one document with one home, as segments that don't overlap within (document, home)
            code = np.asarray(home.dictionary_encode().indices)[of[s]]
            order = np.lexsort((s, code, text[s]))
            s, code = s[order], code[order]
            d, who = text[s], of[s]
            new = np.append(True, (d[1:] != d[:-1]) | (code[1:] != code[:-1]) | (s[1:] > s[:-1] + size))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(s)) - 1
            a, b = s[first], s[last] + size
            # runs of window starts within each segment, as flat pairs relative to it
            brk = new | np.append(True, s[1:] != s[:-1] + 1)
            r0 = np.flatnonzero(brk)
            r1 = np.append(r0[1:], len(s)) - 1
            seg = np.cumsum(new) - 1
            runs = np.stack([s[r0] - a[seg[r0]], s[r1] + 1 - a[seg[r0]]], 1).astype(np.int32)
            runs_off = np.zeros(len(first) + 1, np.int32)
            np.cumsum(np.bincount(seg[r0], minlength=len(first)) * 2, out=runs_off[1:])
            if unit == "bytes":
                raw = data.tobytes()
                parts = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            else:
                raw = data.tobytes()
                parts = [b" ".join(raw[starts[x] : ends[y - 1]].split()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [home.take(pa.array(who[first])), batch.column("rk").take(pa.array(d[first])), pa.array((a - off[d[first]]).astype(np.int32)), pa.array(parts, pa.binary()), pa.ListArray.from_arrays(pa.array(runs_off), pa.array(runs.ravel()))],
                names=["home", "rk", "start", "content", "runs"],
            )

    return run


def recurring_segments(rows: DataFrame, unit: str, size: int, k: int) -> DataFrame:
    """``home, rk, start, content, runs``: the text of windows that may recur; rows: ``rk, text``, one for each document.

    runs, for words only: flat pairs, the windows' starts relative to the segment. Written to the shared folder.
    """
    rk = rows.schema["rk"].dataType.simpleString()
    anchors = rows.where("text is not null").mapInArrow(_anchors(unit, size, k), f"rk {rk}, at int, anchor long")
    often = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("rk").alias("low")).where("n > 1").select("anchor", F.hash("low").alias("home")))
    hits = anchors.join(often.hint("shuffle_hash"), "anchor").groupBy("rk").agg(F.collect_list(F.struct("at", "home")).alias("hits"))
    out = rows.join(hits, "rk").mapInArrow(_segments(unit, size, k), f"home int, rk {rk}, start int, content binary, runs array<int>")
    out = materialize(out.drop("runs") if unit == "bytes" else out)
    release(often)
    return out
