"""Suffix-array dedup: a run-length index of the repetitive parts of the corpus, matching statistics, long matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm._base import document_key, longs, prefix_hash, span_hash, union_length
from confluo.llm._repeats import recurring_segments
from confluo.llm.line_dedup import _with_result
from confluo.storage import materialize, release


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; only places that still share their rank are sorted again."""
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    s = symbols[sa]
    head = np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = head, -1
    slots, h = np.arange(n), 1
    while True:
        # slots, in order, of the suffixes that share their rank
        r = rank[sa[slots]]
        same = np.append(r[1:] == r[:-1], False)
        slots = slots[same | np.append(False, same[:-1])]
        if not len(slots):
            return sa
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(at)), 0))]
        h *= 2


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform with the suffixes sampled at both ends of its runs.

    For each run: ``heads``, the row where it begins; ``chars``, its symbol; ``base``, the row that its first step to the left leads to; ``first`` and ``last``, the
    places of the suffixes at its ends. Symbols are kept as well, as matches are decided by them.
    """

    def __init__(self, symbols: np.ndarray):
        self.text = symbols
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        self.heads = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        ends = np.append(self.heads[1:], len(bwt)) - 1
        self.chars = bwt[self.heads]
        self.first, self.last = sa[self.heads], sa[ends]
        runs = len(self.heads)
        order = np.argsort(self.chars, kind="stable")
        size = ends - self.heads + 1
        self.base = np.empty(runs, np.int64)
        self.base[order] = np.cumsum(size[order]) - size[order]
        self.keys = self.chars[order] * runs + order

    def repeats(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the strings of ``least`` symbols or more that also start elsewhere in the indexed text.

        The longest match of the first suffix of a run with the suffix above it, the last of the run before, is taken at each such sample. Between
        samples, in text order, the match at p + 1 is that at p, one shorter, so these are the matching statistics of all places.
        """
        at, above = self.first[1:], self.last[:-1]
        prefix = prefix_hash(self.text)
        high = len(self.text) - np.maximum(at, above)
        fits = high >= least
        at, above, high = at[fits], above[fits], high[fits]
        # hashes rule out: most pairs differ early
        near = span_hash(prefix, at, at + least) == span_hash(prefix, above, above + least)
        at, above, high = at[near], above[near], high[near]
        low = np.full(len(at), least, np.int64)
        while (open_ := low < high).any():
            i = np.flatnonzero(open_)
            mid = (low[i] + high[i] + 1) // 2
            same = span_hash(prefix, at[i], at[i] + mid) == span_hash(prefix, above[i], above[i] + mid)
            low[i] = np.where(same, mid, low[i])
            high[i] = np.where(same, high[i], mid - 1)
        # symbols confirm: equal hashes of unlike strings make a length too large, never too small
        for i, (p, q, n) in enumerate(zip(at.tolist(), above.tolist(), low.tolist(), strict=True)):
            unlike = self.text[p : p + n] != self.text[q : q + n]
            if unlike.any():
                low[i] = int(np.argmax(unlike))
        long = low >= least
        at, above, low = at[long], above[long], low[long]
        return union_length(np.concatenate([at, above]), np.concatenate([at + low, above + low]))

    def _common(self, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """How many symbols from p and from q are equal, up to ``most``."""
        n = np.zeros(len(p), np.int64)
        live = np.arange(len(p))
        edge = len(self.text) - 1  # a symbol that no other place has
        step = np.arange(16)
        while len(live):
            x, y = p[live] + n[live], q[live] + n[live]
            same = self.text[np.minimum(x[:, None] + step, edge)] == self.text[np.minimum(y[:, None] + step, edge)]
            same &= (np.maximum(x, y)[:, None] + step) <= edge
            whole = same.all(axis=1)
            n[live] += np.where(whole, 16, np.argmin(same, axis=1))
            live = live[whole & (n[live] < most)]
        return np.minimum(n, most)

    def stream(self, texts: list[bytes], least: int, lane: int = 4096) -> list[list[int]]:
        """For each text, the spans (flat pairs) covered by strings of ``least`` bytes that the indexed text holds.

        Matching statistics, from right to left, of many stretches side by side: where the run of the current row has the next byte, the match grows by it; else
        it goes on at the end of the nearest run above or below that has it, whichever suffix agrees longer with the
        current one. Stretches overlap by ``least`` - 1 bytes, and lengths count up to ``least`` at least.
        """
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        off = np.cumsum(size) - size
        cuts = [np.arange(0, max(n - least + 1, 0), lane) for n in size.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        begin = np.concatenate(cuts).astype(np.int64) if cuts else np.zeros(0, np.int64)
        span = np.minimum(size[owner] - begin, lane + least - 1)
        order = np.argsort(-span, kind="stable")
        owner, begin, span = owner[order], begin[order], span[order]
        end = off[owner] + begin + span - 1
        live = np.searchsorted(-span, -np.arange(int(span[0]) if len(span) else 0), "left")  # how many stretches are longer than t
        row, place, length = (np.zeros(len(span), np.int64) for _ in range(3))
        place[:] = self.first[0]
        runs, found = len(self.heads), []
        for t, n in enumerate(live.tolist()):
            c, q = flat[end[:n] - t], row[:n]
            j = np.searchsorted(self.heads, q, "right") - 1
            grows = self.chars[j] == c
            row_, place_, length_ = self.base[j] + q - self.heads[j], place[:n] - 1, length[:n] + 1
            bad = np.flatnonzero(~grows)
            if len(bad):
                key = c[bad] * runs
                k = np.searchsorted(self.keys, key + j[bad])
                above, below = self.keys[k - 1] - key, self.keys[np.minimum(k, runs - 1)] - key
                none = np.full(len(bad), -1, np.int64)
                lcp = []
                for run, at in ((above, self.last), (below, self.first)):
                    ok = (run >= 0) & (run < runs)
                    got = none.copy()
                    got[ok] = self._common(place[bad[ok]], at[run[ok]], least)
                    lcp.append(got)
                up = lcp[0] >= lcp[1]
                run = np.where(up, above, below)
                lost = np.maximum(*lcp) < 0
                run[lost] = 0
                to = self.base[run] + np.where(up, np.append(self.heads[1:], len(self.text))[run] - 1 - self.heads[run], 0)
                row_[bad] = np.where(lost, 0, to)
                place_[bad] = np.where(lost, self.first[0], np.where(up, self.last[run], self.first[run]) - 1)
                length_[bad] = np.where(lost, 0, np.minimum(length[bad], np.maximum(*lcp)) + 1)
            row[:n], place[:n], length[:n] = row_, place_, length_
            hit = np.flatnonzero(length_ >= least)
            if len(hit):
                found.append(end[hit] - t)
        out: list[list[int]] = [[] for _ in texts]
        if found:
            s = np.concatenate(found)
            who = np.searchsorted(off, s, "right") - 1
            gap = who * (least + 1)  # spans of neighbouring texts must not touch
            a, b = union_length(s + gap, s + gap + least)
            who = np.searchsorted(off + np.arange(len(off)) * (least + 1), a, "right") - 1
            shift = off[who] + who * (least + 1)
            for i, x, y in zip(who.tolist(), (a - shift).tolist(), (b - shift).tolist(), strict=True):
                out[i] += (x, y)
        return out


def index_of(contents: list[bytes], groups: list[int]) -> tuple[RunLengthIndex, np.ndarray]:
    """The index of texts, and where each begins in it. Texts of different groups have no symbol in common."""
    size = np.array([len(c) for c in contents], np.int64)
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=off[1:])
    symbols = np.frombuffer(b"\n".join([*contents, b""]), np.uint8).astype(np.int64)
    colour = np.unique(np.array(groups), return_inverse=True)[1]
    symbols += np.repeat(colour * 256, size + 1)
    symbols[off[1:] - 1] = (int(colour.max()) + 1) * 256 + np.arange(len(size))  # ends differ from all else
    return RunLengthIndex(symbols), off


def long_matches(index: RunLengthIndex, off: np.ndarray, least: int) -> list[list[int]]:
    """For each indexed text, the spans (flat pairs) that lie in strings of ``least`` bytes with another place among the texts of its group."""
    a, b = index.repeats(least)
    out: list[list[int]] = [[] for _ in off[1:]]
    which = np.searchsorted(off, a, "right") - 1
    for i, x, y in zip(which.tolist(), (a - off[which]).tolist(), (b - off[which]).tolist(), strict=True):
        out[i] += (x, y)
    return out


def _index(least: int, batch_bytes: int):
    """Rows come sorted by ``home_id, part, other``: a part's own texts are indexed, those of the other parts stream through after.

    Homes of one part are indexed together, up to ``batch_bytes``, and never matched with each other.
    """

    def answer(homes, digests, spans):
        return pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(digests, pa.binary()), pa.array(spans, pa.list_(pa.int32()))], names=["home_id", "digest", "spans"])

    def run(batches):
        own: list[tuple] = []
        rest: list[tuple] = []
        held, passing, last, index = 0, 0, None, None

        def flush():
            nonlocal index
            if own:
                index, off = index_of([r[3] for r in own], [r[0] for r in own])
                spans = long_matches(index, off, least)
                yield answer([r[0] for r in own], [r[1] for r in own], [[0, len(r[3])] if r[2] else s for r, s in zip(own, spans, strict=True)])

        def through():
            if rest and index is not None:
                spans = index.stream([r[3] for r in rest], least)
                yield answer([r[0] for r in rest], [r[1] for r in rest], spans)

        for batch in batches:
            for home, part, other, *row in zip(*(batch.column(c).to_pylist() for c in ("home_id", "part", "other", "digest", "again", "content")), strict=True):
                new = (home, part) != last
                if other and own:
                    yield from flush()
                    own, held = [], 0
                if new and rest:
                    yield from through()
                    rest, passing = [], 0
                if new:
                    index = None
                    if part > 0 or held > batch_bytes:
                        yield from flush()
                        own, held, index = [], 0, None
                last = (home, part)
                if other:
                    rest.append((home, *row))
                    passing += len(row[2])
                    if passing > batch_bytes:
                        yield from through()
                        rest, passing = [], 0
                else:
                    own.append((home, *row))
                    held += len(row[2])
        yield from flush()
        yield from through()

    return run


def repeated_bytes(rows: DataFrame, least: int = 400, k: int = 64, part_bytes: int = 4 << 20, batch_bytes: int = 1 << 20) -> DataFrame:
    """``rk, spans``: byte spans covered by strings of ``least`` bytes that start at two places or more; rows: ``rk, text``.

    Segments around recurring anchors are gathered by home (see ``_repeats``); equal segments of a home are one row with a flag
    that says all of it recurs. A home of more than ``part_bytes`` is dealt to several parts. Each part is indexed by itself, and the
    segments of the home's other parts stream through its index, so a task holds one part, whatever the home's size.
    """
    rk = rows.schema["rk"].dataType.simpleString()
    segments = recurring_segments(rows, "bytes", least, k)
    marked = segments.select(F.col("home").cast("long").alias("home_id"), F.unhex(F.md5("content")).alias("digest"), "rk", "start", "content")
    counts = marked.groupBy("home_id", "digest").agg(F.count("*").alias("n"), F.min(F.struct("rk", "start")).alias("first"), F.max(F.length("content")).alias("size"))
    counts = materialize(counts.select("home_id", "digest", (F.col("n") > 1).alias("again"), F.col("first.rk").alias("rk"), F.col("first.start").alias("start"), "size"))
    large = counts.groupBy("home_id").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > part_bytes)
    large = materialize(large.select("home_id", F.ceil(F.col("bytes") / part_bytes).cast("int").alias("parts")))
    distinct = counts.join(marked.select("home_id", "rk", "start", "content"), ["home_id", "rk", "start"]).join(large, "home_id", "left")
    own = F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("digest"), F.col("parts"))).cast("int")
    every = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("again"), F.array("own")).otherwise(F.sequence(F.lit(1), F.col("parts")))
    dealt = distinct.withColumn("own", own).withColumn("part", F.explode(every)).withColumn("other", F.col("part") != F.col("own"))
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select("home_id", "part", "other", "digest", "again", "content").repartition(tasks, "home_id", "part").sortWithinPartitions("home_id", "part", "other")
    spans = materialize(dealt.mapInArrow(_index(least, batch_bytes), "home_id long, digest binary, spans array<int>").where(F.size("spans") > 0))
    every_ = marked.select("home_id", "digest", "rk", "start").join(spans, ["home_id", "digest"])
    found = materialize(every_.groupBy("rk").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("start")))).alias("spans")))
    release(segments, counts, large, spans)
    return found


def suffix_dedup(docs: DataFrame, least: int = 400) -> DataFrame:
    """Remove each byte covered by a string of ``least`` bytes that also starts anywhere else, in the same document or another.

    docs: ``doc_id, text`` and any other columns. Texts are UTF-8 bytes; matches never cross documents; strings may
    overlap and are judged on the input. Returns the columns of docs but text, and ``kept`` (the remaining bytes, binary, as a cut may fall
    within a character), ``n_bytes, n_removed, n_spans, spans`` (start and end of each maximal removed run, one after the other).

    Null text counts as empty. Rows of one doc_id with different texts are documents of their own; fully repeated rows
    are one document with one result each. No rows: no rows. Columns named like the results are replaced.
    """
    key = document_key(docs)
    rows = docs.select(key.alias("rk"), "text").dropDuplicates(["rk"]) if docs.select(key.alias("rk")).dtypes[0][1] != "bigint" else docs.select(key.alias("rk"), "text")
    found = repeated_bytes(rows, least)

    @arrow_udf("struct<kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<int>>")
    def keep(text: pa.Array, spans: pa.Array) -> pa.Array:
        out, total, removed, n, gone = [], [], [], [], []
        for t, x in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            raw = (t or "").encode()
            total.append(len(raw))
            pairs = np.array(x or [], np.int64).reshape(-1, 2)
            a, b = union_length(pairs[:, 0], pairs[:, 1])
            if len(a):
                raw = b"".join(raw[s:e] for s, e in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
            out.append(raw)
            removed.append(total[-1] - len(raw))
            n.append(len(a))
            gone.append(np.stack([a, b], 1).ravel().tolist())
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), *(longs(np.array(c, np.int64)) for c in (total, removed, n)), pa.array(gone, pa.list_(pa.int32()))], names=["kept", "n_bytes", "n_removed", "n_spans", "spans"])

    out = _with_result(docs, key, found, keep, ["kept", "n_bytes", "n_removed", "n_spans", "spans"])
    return out.drop("text")
