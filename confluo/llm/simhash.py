"""SimHash near-dedup: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm._base import LOWER, document_key, free_name, longs, mix, prefix_hash, slices, span_hash, text_bytes, word_hashes, word_spans
from confluo.operators.components import connected_components
from confluo.storage import materialize, release

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the spans of a buffer: those under 32 bytes a column at a time, longer ones one by one."""
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    lane8 = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))
    lane4 = np.ndarray(len(data) + 1, "<u4", raw, strides=(1,))
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 65536 else size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    whole = data.tobytes() if len(lengths) and lengths[-1] >= 32 else b""
    for n, a, b in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        at = order[a:b]
        p = starts[at]
        if n >= 32:
            out[at] = [xxhash.xxh64_intdigest(whole[x : x + n], seed) for x in p.tolist()]
            continue
        h = np.full(len(at), (seed + int(_P5) + n) & (2**64 - 1), np.uint64)
        done = 0
        while n - done >= 8:
            k = _rot(lane8[p + done] * _P2, 31) * _P1
            h = _rot(h ^ k, 27) * _P1 + _P4
            done += 8
        if n - done >= 4:
            h = _rot(h ^ (lane4[p + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
            done += 4
        while done < n:
            h = _rot(h ^ (data[p + done].astype(np.uint64) * _P5), 11) * _P1
            done += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        out[at] = h ^ (h >> np.uint64(32))
    return out


def _plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of the words in lower case, one space after each; their starts, ends, and first words of the texts."""
    starts, ends, first = word_spans(data, off)
    size = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=to[1:])
    out = np.full(to[-1], 32, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts] = 1
    mask[ends] -= 1
    out[inside] = LOWER[data[np.cumsum(mask[:-1]).astype(bool)]]
    return out, to[:-1], to[1:] - 1, first


def fingerprints(text: pa.Array, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each text of a column."""
    data, off = text_bytes(text)
    data, starts, ends, first = _plain(data, off)
    words = np.diff(first)
    n = np.where(words >= shingle, words - shingle + 1, (words > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    doc = np.repeat(np.arange(len(n)), n)
    a = np.arange(at[-1]) - at[doc] + first[doc]
    b = np.minimum(a + shingle, first[doc + 1]) - 1
    h = _xxh64(data, starts[a], ends[b])
    out = np.zeros(len(n), np.uint64)
    for i in range(0, len(h), 1 << 15):
        # bits of a block of shingles, summed for each of its texts
        block, owner = h[i : i + (1 << 15)], doc[i : i + (1 << 15)]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sums = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        if i == 0:
            total = np.zeros((len(n), 64), np.int32)
        np.add.at(total, owner[cut], sums)
    if len(h):
        out = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        out[n == 0] = 0
    return out


def simhash(text: Column, shingle: int = 3) -> Column:
    """64-bit SimHash of a text: XXH64 (seed 42) of its word shingles, repeats included; a bit is set where over half have it."""

    @arrow_udf("bigint")
    def run(col: pa.Array) -> pa.Array:
        parts = [longs(fingerprints(b.column(0), shingle)) for b in slices([pa.RecordBatch.from_arrays([col], names=["text"])], limit=1 << 19)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())

    return run(text)


def _spanning(v: np.ndarray, radius: int, tile: int, joined):
    """Pairs (p, q) that connect all fingerprints within the radius for which joined(p, q) holds; v is sorted by population count.

    Tiles are compared whole; tile pairs whose counts differ beyond the radius are skipped, and so are pairs that are connected already.
    """
    pop = np.bitwise_count(v)
    label = np.arange(len(v))
    for i in range(0, len(v), tile):
        for j in range(i, len(v), tile):
            if int(pop[j]) - int(pop[min(i + tile, len(v)) - 1]) > radius:
                break
            near = np.bitwise_count(v[i : i + tile, None] ^ v[None, j : j + tile]) <= radius
            if i == j:
                near = np.triu(near, 1)
            for p in (np.flatnonzero(near.any(axis=1)) + i).tolist():
                others = np.flatnonzero(near[p - i]) + j
                others = others[label[others] != label[p]]
                while len(others):
                    q, others = int(others[0]), others[1:]
                    if joined(p, q):
                        label[label == label[q]] = label[p]
                        yield p, q
                        others = others[label[others] != label[p]]


def _links(radius: int, tile: int):
    """Spanning links of each bucket: rows come sorted by ``bucket``; tiles of sorted population counts are compared."""

    def edges(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
        pairs = np.array(list(_spanning(v, radius, tile, lambda p, q: True)), np.int64).reshape(-1, 2)
        return v[pairs[:, 0]], v[pairs[:, 1]]

    def run(batches):
        held: list[np.ndarray] = []
        last = None

        def flush():
            fp = np.unique(np.concatenate(held))
            a, b = edges(fp)
            if len(a):
                yield pa.RecordBatch.from_arrays([longs(a), longs(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.stack([batch.column("bucket").to_numpy(), batch.column("pair").to_numpy()])
            fp = batch.column("fp").to_numpy().view(np.uint64)
            cut = np.append(np.flatnonzero(np.append(True, (bucket[:, 1:] != bucket[:, :-1]).any(axis=0))), len(fp))
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                now = (int(bucket[0, x]), int(bucket[1, x]))
                if last is not None and now != last:
                    if sum(map(len, held)) > 1:
                        yield from flush()
                    held = []
                last = now
                held.append(fp[x:y])
        if sum(map(len, held)) > 1:
            yield from flush()

    return run


def near_links(prints: DataFrame, radius: int = 3, tile: int = 1024, hot: int = 8192) -> DataFrame:
    """Links ``a, b`` that join all of the distinct ``fp`` (long) that differ in ``radius`` bits or fewer, directly or by others.

    The 64 bits are cut into blocks; two fingerprints within the radius agree in all blocks but ``radius``, so each
    choice of the others makes a bucket, and every close pair meets in one. The number of blocks follows the number of fingerprints, so that
    buckets of unlike texts stay small. Buckets of over ``hot`` fingerprints are dealt out by pairs of
    parts, so no task holds more than two parts of one.
    """
    n = prints.count()
    blocks, wide = radius + 1, math.log2(max(n, 2)) - 6
    while 64 * (blocks - radius) // blocks < wide and blocks < radius + 4:
        blocks += 1
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edge[i + 1]) - (1 << edge[i])) for i in chosen)
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    large = materialize(rows.groupBy("bucket").count().where(F.col("count") > hot).select("bucket", F.ceil(2 * F.col("count") / hot).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = rows.withColumn("pair", F.lit(0).cast("long"))
    else:
        # a bucket's part i meets part j in the pair (i, j)
        part, other = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"), F.col("other")
        pairs = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda o: F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.least(part, o) * 65536 + F.greatest(part, o)).cast("long"))
        dealt = rows.join(large, "bucket", "left").select("fp", "bucket", F.explode(pairs).alias("pair"))
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(_links(radius, tile), "a long, b long")


def simhash_dedup(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of docs (``doc_id, text``).

    fingerprint: 16 hexadecimal digits of ``simhash``. Fingerprints link at ``radius`` or fewer differing bits;
    component_id is the smallest doc_id that a chain of links reaches, itself included. Equal fingerprints are
    compared once, whatever their number.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any other. Rows with a
    null doc_id take part; a component of nothing else has a null id. Repeated rows each get their result. No
    rows: no rows. Other columns are left out.
    """
    marked = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash(F.col("text"), shingle).alias("fp")))
    by = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    links = near_links(by.select("fp"), radius)
    found = connected_components(links, "a", "b")
    joined = by.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = materialize(joined.groupBy("component").agg(F.min("low").alias("component_id")).join(joined.select("fp", "component"), "component").select("fp", "component_id"))
    return marked.join(low, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_MINIMA = 6


def _shingle_sets(text: pa.Array, shingle: int):
    """Row and sorted shingle hashes, each once, of each text with words."""
    data, off = text_bytes(text)
    data = LOWER[data]
    starts, ends, first = word_spans(data, off)
    prefix = prefix_hash(word_hashes(data, starts, ends))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if a < b:
            at = np.arange(a, max(b - shingle, a) + 1)
            yield i, np.unique(span_hash(prefix, at, np.minimum(at + shingle, b)))


def _marks(shingle: int, words: int):
    """Fingerprint over shingles of ``words`` words, minima of several hashes (the buckets), and size and digest of the shingle set of each text."""

    def run(batches):
        for batch in slices(batches, limit=1 << 19):
            rows, buckets, sizes, same = [], [], [], []
            for i, h in _shingle_sets(batch.column("text"), shingle):
                rows.append(i)
                buckets.append([int(mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))).min().astype(np.int64)) for j in range(_MINIMA)])
                sizes.append(len(h))
                same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            take = pa.array(rows, pa.int64())
            fp = longs(fingerprints(batch.column("text"), words)).take(take)
            yield pa.RecordBatch.from_arrays([batch.column("rk").take(take), fp, pa.array(buckets, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(same, pa.binary())], names=["rk", "fp", "minima", "size", "same"])

    return run


def _whole_sets(shingle: int):
    """The whole shingle set of each text."""

    def run(batches):
        for batch in slices(batches, limit=1 << 19):
            rows, sets = [], []
            for i, h in _shingle_sets(batch.column("text"), shingle):
                rows.append(i)
                sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rk").take(pa.array(rows, pa.int64())), pa.array(sets, pa.binary())], names=["rk", "shingles"])

    return run


def _similar(sets: list[np.ndarray], similarity: float):
    """Pairs (p, q) that connect all sets whose Jaccard similarity is ``similarity`` or more.

    Such sets differ in size by that factor at most, and share one of the first ``n - ceil(similarity * n) + 1`` members of each, in any order that all
    sets have; rare members come first here. Pairs that pass both, and are not connected already, are counted in full.
    """
    size = np.array([len(s) for s in sets])
    off = np.append(0, np.cumsum(size))
    _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    often = np.sort(count) > 1
    member, owner = rank[inv], np.repeat(np.arange(len(sets)), size)
    member = member[np.lexsort((member, owner))]
    lead = (np.arange(len(member)) - off[owner] < (size - np.ceil(similarity * size - 1e-9) + 1)[owner]) & often[member]
    order = np.lexsort((owner[lead], member[lead]))
    cut = np.flatnonzero(np.append(True, np.diff(member[lead][order]) > 0)) if len(order) else np.zeros(0, np.int64)
    lists = dict(zip(member[lead][order][cut].tolist(), np.split(owner[lead][order], cut[1:]), strict=True)) if len(order) else {}
    label, mark = np.arange(len(sets)), np.zeros(len(count), bool)
    for p in range(len(sets)):
        mine, near = member[off[p] : off[p + 1]], []
        for x in mine[lead[off[p] : off[p + 1]]].tolist():
            if x in lists:
                others = lists[x][label[lists[x]] != label[p]]
                if len(others):
                    near.append(others[others > p])
                else:
                    del lists[x]  # all of it is connected
        if not near:
            continue
        others = np.unique(np.concatenate(near))
        small, large = np.minimum(size[others], size[p]), np.maximum(size[others], size[p])
        others = others[small >= similarity * large - 1e-9]
        mark[mine] = True
        for i in range(0, len(others), 1024):
            some = others[i : i + 1024]
            some = some[label[some] != label[p]]
            if not len(some):
                continue
            at = np.append(0, np.cumsum(size[some]))
            both = np.add.reduceat(mark[member[np.arange(at[-1]) + np.repeat(off[some] - at[:-1], size[some])]], at[:-1], dtype=np.int64)
            for q in some[both / (size[p] + size[some] - both) >= similarity].tolist():
                if label[q] != label[p]:
                    label[label == label[q]] = label[p]
                    yield p, q
        mark[mine] = False


def _verified(similarity: float):
    """Rows come sorted by bucket: links that join all texts of a bucket of enough similarity."""

    def run(batches):
        last, keys, sets, kind = None, [], [], None

        def flush():
            if len(keys) > 1:
                pairs = list(_similar([np.frombuffer(x, np.uint64) for x in sets], similarity))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[p] for p, _ in pairs], kind), pa.array([keys[q] for _, q in pairs], kind)], names=["a", "b"])

        for batch in batches:
            kind = batch.column("rk").type
            for b, rk, x in zip(batch.column("bucket").to_pylist(), batch.column("rk").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if b != last:
                    yield from flush()
                    last, keys, sets = b, [], []
                keys.append(rk)
                sets.append(x)
        yield from flush()

    return run


def _fingerprint_links(marked: DataFrame, first: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between the texts of ``first`` that join all whose fingerprints, or those of texts of an equal set, differ in ``radius`` bits or fewer."""
    prints = materialize(marked.select("same", "fp").distinct().join(first, "same").select("rk", "fp"))
    by = materialize(prints.groupBy("fp").agg(F.min("rk").alias("low")))
    close = near_links(by.select("fp"), radius)
    ends = [by.select(F.col("fp").alias(x), F.col("low").alias(f"low_{x}")) for x in "ab"]
    close = close.join(ends[0], "a").join(ends[1], "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    out = materialize(close.unionByName(prints.join(by, "fp").where("rk <> low").select(F.col("rk").alias("a"), F.col("low").alias("b"))))
    release(prints, by)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, part: int = 4096, part_bytes: int = 8 << 20, radius: int | None = None, words: int = 3) -> DataFrame:
    """The columns of docs with ``component``: the key of the first document of its group of near duplicates.

    docs: ``doc_id, text`` and any other columns. Two texts are near duplicates where the Jaccard similarity of their word shingles (A-Z in
    lower case; of fewer words, all of them) is ``similarity`` or more. Texts that share the minimum of one of six hashes over their
    shingles are compared by their whole sets of shingle hashes (64 bits), which are made again for the texts of shared
    buckets only. A pair at the threshold shares none of the six with a chance of 0.2^6. Texts of equal sets are compared once. Buckets of over
    ``part`` texts or ``part_bytes`` of hashes are dealt out by pairs of their parts.

    radius: texts whose fingerprints (``simhash`` of ``words``-word shingles) differ in this many bits or fewer are near duplicates too, as in
    ``simhash_dedup``: all pairs of distinct fingerprints are found by ``near_links``. None: fingerprints link nothing.

    Texts without words are their own group each. The key is doc_id where it is unique and not null, else (doc_id, hash of the text). Columns named component or document_key are replaced.
    """
    key = document_key(docs)
    rows = docs.select(key.alias("rk"), F.coalesce("text", F.lit("")).alias("text"))
    rk = rows.schema["rk"].dataType.simpleString()
    marked = materialize(rows.mapInArrow(_marks(shingle, words), f"rk {rk}, fp long, minima array<long>, size int, same binary"))
    first = materialize(marked.groupBy("same").agg(F.min("rk").alias("rk")))
    reps = marked.join(first.select("rk"), "rk", "left_semi").dropDuplicates(["rk"]) if rk != "bigint" else marked.join(first.select("rk"), "rk", "left_semi")
    dealt = materialize(reps.select("rk", "size", F.posexplode("minima").alias("t", "m")).withColumn("bucket", F.xxhash64("t", "m")).drop("t", "m"))
    # buckets of the same texts, which two sums of hashes of their keys tell, are compared once
    members = [F.sum(F.xxhash64("rk", F.lit(i)).cast("decimal(38,0)")).alias(f"m{i}") for i in range(2)]
    buckets = dealt.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("size").alias("total"), *members).where("count > 1")
    parts = F.ceil(F.greatest(F.col("count") / part, 8 * F.col("total") / part_bytes)).cast("int")
    sizes = materialize(buckets.groupBy("count", "total", "m0", "m1").agg(F.min("bucket").alias("bucket")).select("bucket", parts.alias("parts")))
    own, other = F.pmod(F.xxhash64("rk"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    split = dealt.join(sizes.hint("merge"), "bucket").withColumn("bucket", F.explode(F.transform(other, lambda o: F.xxhash64("bucket", F.least(own, o), F.greatest(own, o)))))
    split = materialize(split.select("bucket", "rk"))
    # whole sets are made for the texts of shared buckets only; merge joins at every size, as tables are compressed on disk
    shared = rows.join(split.select("rk").distinct().hint("merge"), "rk", "left_semi")
    sets = materialize((shared if rk == "bigint" else shared.dropDuplicates(["rk"])).mapInArrow(_whole_sets(shingle), f"rk {rk}, shingles binary"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    links = split.join(sets.hint("merge"), "rk").select("bucket", "rk", "shingles").repartition(n, "bucket").sortWithinPartitions("bucket", "rk").mapInArrow(_verified(similarity), f"a {rk}, b {rk}")
    if radius is not None:
        alike = _fingerprint_links(marked, first, radius)
        links = links.unionByName(alike)
    found = connected_components(links, "a", "b")
    if radius is not None:
        release(alike)
    groups = first.join(found.withColumnRenamed("node", "rk"), "rk", "left").select("same", F.coalesce("component", "rk").alias("component"))
    rk_, group = free_name(docs, "_rk"), free_name(docs, "_group")
    component = materialize(marked.select("rk", "same").distinct().join(groups, "same").select(F.col("rk").alias(rk_), F.col("component").alias(group)))
    release(marked, first, dealt, sizes, split, sets)
    out = docs.withColumn(rk_, key).join(component.hint("merge"), rk_, "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("component", "document_key")], F.coalesce(group, rk_).alias("component"), F.col(rk_).alias("document_key"))
