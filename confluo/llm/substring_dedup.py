"""Substring dedup: recurring passages, sharded Aho-Corasick automata, every occurrence."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm._base import document_key, longs, prefix_hash, span_hash, union_length, word_hashes
from confluo.llm._repeats import recurring_segments
from confluo.llm.line_dedup import _with_result
from confluo.storage import materialize, release


def _windows(size: int):
    """A hash of each window of the segments that may recur."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                content = part.column("content")
                off = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
                data = np.frombuffer(content.buffers()[2], np.uint8)[off[0] : off[-1]]
                off = off - off[0]
                # words are one space apart; segments end where the next begins
                gap = np.flatnonzero(data == 32)
                starts = np.sort(np.concatenate([off[:-1], gap + 1]))
                ends = np.sort(np.concatenate([off[1:], gap]))
                first = np.searchsorted(starts, off)
                prefix = prefix_hash(word_hashes(data, starts, ends))
                runs = part.column("runs")
                pairs = runs.flatten().to_numpy().reshape(-1, 2).astype(np.int64)
                seg = np.repeat(np.arange(len(part)), np.diff(np.array(runs.offsets)) // 2)
                n = pairs[:, 1] - pairs[:, 0]
                at = np.repeat(pairs[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                seg = np.repeat(seg, n)
                h = span_hash(prefix, first[seg] + at, first[seg] + at + size)
                take = pa.array(seg)
                yield pa.RecordBatch.from_arrays([longs(h), part.column("home").take(take), part.column("rk").take(take)], names=["h", "home", "rk"])

    return run


def _first_places(content: bytes, hashes: list[int], size: int) -> list[int]:
    """Places of the windows of a segment that have one of the hashes."""
    data = np.frombuffer(content, np.uint8)
    gap = np.flatnonzero(data == 32)
    prefix = prefix_hash(word_hashes(data, np.append(0, gap + 1), np.append(gap, len(data))))
    at = np.arange(max(len(prefix) - size, 0))
    return np.flatnonzero(np.isin(span_hash(prefix, at, at + size), np.array(hashes, np.int64).view(np.uint64))).tolist()


def _locate(size: int):
    """Rows come sorted by ``shard``, passages (with ``firsts``) before the segments to search."""

    def run(batches):
        shard, ids, machine, places = None, {}, None, []
        for batch in batches:
            gids, kinds = batch.column("shard").to_pylist(), batch.column("kind").to_pylist()
            content, starts, keys, firsts = (batch.column(c).to_pylist() for c in ("content", "start", "key", "firsts"))
            rows, spans = [], []
            for i, g in enumerate(gids):
                if g != shard:
                    shard, ids, machine, places = g, {}, ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), []
                words = content[i].split(b" ")
                if not kinds[i]:
                    numbers = [ids.setdefault(w, len(ids) + 1) for w in words]
                    for x in _first_places(content[i], firsts[i], size):
                        window = tuple(numbers[x : x + size])
                        if not machine.exists(window):  # rows come by document and place: the first one stays
                            machine.add_word(window, len(places))
                            places.append((keys[i], starts[i] + x))
                    continue
                if not places:
                    continue
                if machine.kind != ahocorasick.AHOCORASICK:
                    machine.make_automaton()
                get = ids.get
                found, end = [], -1
                for e, p in machine.iter(tuple([get(w, 0) for w in words])):
                    s = starts[i] + e - size + 1
                    if places[p] != (keys[i], s):
                        if s <= end:
                            found[-1] = s + size
                        else:
                            found += (s, s + size)
                        end = s + size
                if found:
                    rows.append(i)
                    spans.append(found)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("rk").take(pa.array(rows)), pa.array(spans, pa.list_(pa.int32()))], names=["rk", "spans"])

    return run


def repeated_spans(rows: DataFrame, size: int = 20, k: int = 10, shard_bytes: int = 4 << 20, shard_passages: int = 50_000) -> DataFrame:
    """``rk, spans``: word spans (flat pairs) covered by windows that also start earlier; rows: ``rk, text``.

    1. Anchors that recur pick out the segments of text that may repeat (see ``_repeats``).
    2. A grouped count over the hashes of their windows confirms those that recur and finds the first document of each.
    3. Passages go to shards by home. A home with more than ``shard_passages`` passages is dealt to several shards, each of which
       sees all its segments; one with more than ``shard_bytes`` of segments has several shards with the same passages.
    4. Each shard compiles its passages, as sequences of word numbers, into an automaton and streams its segments
       through. A match is exact, whatever the hashes did; all but the first place are covered.
    """
    segments = recurring_segments(rows, "words", size, k)
    rk = rows.schema["rk"].dataType.simpleString()
    windows = segments.mapInArrow(_windows(size), f"h long, home int, rk {rk}")
    first = materialize(windows.groupBy("h", "home").agg(F.count("*").alias("n"), F.min("rk").alias("rk")).where("n > 1").select("h", "home", "rk"))
    big = segments.groupBy("home").agg(F.sum(F.length("content")).alias("bytes")).where(F.col("bytes") > shard_bytes)
    big = big.select("home", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("copies"))
    many = first.groupBy("home").count().where(F.col("count") > shard_passages).select("home", F.ceil(F.col("count") / shard_passages).cast("int").alias("parts"))
    split = materialize(big.join(many, "home", "full_outer").select("home", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("parts", F.lit(1)).alias("parts")))

    def dealt(df: DataFrame, part, copy) -> DataFrame:
        df = df.join(split, "home", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).withColumn("parts", F.coalesce("parts", F.lit(1)))
        df = df.withColumn("part", part).withColumn("copy", copy)
        return df.withColumn("shard", F.xxhash64("home", "part", "copy"))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    passages = dealt(first, F.pmod(F.col("h"), F.col("parts")).cast("int"), every("copies"))
    passages = passages.groupBy("home", "rk", "part", "copy", "shard").agg(F.collect_list("h").alias("firsts"))
    columns = ["shard", "kind", "rk", F.xxhash64("rk").alias("key"), "start", "content", "firsts"]
    passages = passages.join(segments.select("home", "rk", "start", "content"), ["home", "rk"]).withColumn("kind", F.lit(0)).select(*columns)
    searched = dealt(segments, every("parts"), F.pmod(F.xxhash64("rk", "start"), F.col("copies")).cast("int"))
    searched = searched.withColumn("kind", F.lit(1)).withColumn("firsts", F.lit(None).cast("array<long>")).select(*columns)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = passages.unionByName(searched).repartition(parts, "shard").sortWithinPartitions("shard", "kind", "rk", "start")
    found = both.mapInArrow(_locate(size), f"rk {rk}, spans array<int>")
    found = materialize(found.groupBy("rk").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    release(segments, first, split)
    return found


def substring_dedup(docs: DataFrame, size: int = 20) -> DataFrame:
    """Remove each word covered by a window of ``size`` words whose word sequence also starts earlier.

    docs: ``doc_id, text`` and any other columns. Earlier: in a document of smaller doc_id, or at an earlier word of the same
    document. Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are; windows are judged on the input. Returns the
    columns of docs with ``text`` (kept words, joined by one space), and ``n_words, n_removed, spans`` (start and end
    of each removed run, one after the other).

    Null and empty texts have no words and come back empty. Null doc_ids are earliest. Rows of one doc_id with different
    texts are documents of their own, ordered by a hash; fully repeated rows are one document with one result
    each. No rows: no rows. Columns named like the results are replaced.
    """
    key = document_key(docs)
    rows = docs.select(key.alias("rk"), "text").dropDuplicates(["rk"]) if docs.select(key.alias("rk")).dtypes[0][1] != "bigint" else docs.select(key.alias("rk"), "text")
    found = repeated_spans(rows, size)

    @arrow_udf("struct<text string, n_words bigint, n_removed bigint, spans array<int>>")
    def keep(text: pa.Array, spans: pa.Array) -> pa.Array:
        out, total, removed, gone = [], [], [], []
        for t, x in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            words = (t or "").encode().split()
            total.append(len(words))
            if x:
                pairs = np.array(x, np.int64).reshape(-1, 2)
                a, b = union_length(pairs[:, 0], pairs[:, 1])
                words = [w for s, e in zip([0, *b.tolist()], [*a.tolist(), len(words)], strict=True) for w in words[s:e]]
                x = np.stack([a, b], 1).ravel().tolist()
            removed.append(total[-1] - len(words))
            out.append(b" ".join(words))
            gone.append(x or [])
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), longs(np.array(total, np.int64)), longs(np.array(removed, np.int64)), pa.array(gone, pa.list_(pa.int32()))], names=["text", "n_words", "n_removed", "spans"])

    return _with_result(docs, key, found, keep, ["text", "n_words", "n_removed", "spans"])
