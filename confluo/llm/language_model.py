"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, beside add-one unigrams."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm._base import LOWER, document_key, longs, mix, slices, text_bytes, word_hashes, word_spans
from confluo.storage import materialize

#: Head classes hold the most frequent tokens, SIDE in each; tail classes hold the rest, by a hash of their last two bytes.
HEADS, SIDE, TAILS = 16, 16, 16
CLASSES = HEADS + TAILS
ROWS = 1 << 14  # row numbers fit in 16 bits
#: Changes that one task sums in each step.
FAN = 8
#: Tokens whose logits are held at once: they stay in the processor's cache.
BLOCK = 2048
_LOW = np.uint64(63)
_END, _START = np.uint64(0x5EED << 6), np.uint64(0xB0A7 << 6)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all texts of a column, each text's end among them, and the texts' offsets.

    A number is a 58-bit hash of the word with A-Z in lower case; its low 6 bits are the word's tail class.
    """
    data, off = text_bytes(col)
    data = LOWER[data]
    starts, ends, first = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    last = data[ends - 1].astype(np.uint64) if len(ends) else h
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else h
    tail = mix(last * np.uint64(257) + before) % np.uint64(TAILS)
    n = len(off) - 1
    out = np.full(len(h) + n, _END, np.uint64)
    doc = np.searchsorted(first, np.arange(len(h)), "right") - 1
    out[np.arange(len(h)) + doc] = (h & ~_LOW) | tail
    return out, first + np.arange(n + 1)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _counts(buckets: int, flush: int = 4_000_000):
    """Counts of the tokens of many texts, one row for each bucket of token numbers."""

    def run(batches):
        ids, n, held = [], [], 0

        def out():
            u, inv = np.unique(np.concatenate(ids), return_inverse=True)
            c = np.bincount(inv, weights=np.concatenate(n)).astype(np.int64)
            b = (mix(u.copy()) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            keep = [i for i in range(buckets) if cut[i] < cut[i + 1]]
            parts = [order[cut[i] : cut[i + 1]] for i in keep]
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([_blob(u[p]) for p in parts], pa.binary()), pa.array([_blob(c[p]) for p in parts], pa.binary())], names=["bucket", "ids", "counts"])

        for batch in slices(batches):
            t, _ = tokens(batch.column("text"))
            u, c = np.unique(t, return_counts=True)
            ids.append(u)
            n.append(c)
            held += len(u)
            if held > flush:
                yield out()
                ids, n, held = [], [], 0
        if held:
            yield out()

    return run


def _sum_counts(top: int):
    """Rows come sorted by bucket: one row for each, with its most frequent tokens and its sums."""

    def merged(bucket, ids, counts):
        u, inv = np.unique(np.concatenate(ids), return_inverse=True)
        c = np.bincount(inv, weights=np.concatenate(counts)).astype(np.int64)
        best = np.lexsort((u, -c))[:top]
        tail = np.bincount((u & _LOW).astype(np.int64), weights=c, minlength=64)
        kinds = np.bincount((u & _LOW).astype(np.int64), minlength=64)
        return pa.RecordBatch.from_pylist([{"bucket": bucket, "ids": _blob(u), "counts": _blob(c), "n": int(c.sum()), "v": len(u), "top_ids": u[best].view(np.int64).tolist(), "top_counts": c[best].tolist(), "tail": tail.astype(np.int64).tolist(), "kinds": kinds.tolist()}], schema=_COUNTED)

    def run(batches):
        last, ids, counts = None, [], []
        for batch in batches:
            for b, i, c in zip(batch.column("bucket").to_pylist(), batch.column("ids").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if last is not None and b != last:
                    yield merged(last, ids, counts)
                    ids, counts = [], []
                last = b
                ids.append(np.frombuffer(i, np.uint64))
                counts.append(np.frombuffer(c, np.int64))
        if ids:
            yield merged(last, ids, counts)

    return run


_COUNTED = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("top_ids", pa.list_(pa.int64())), ("top_counts", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64()))])


@dataclass
class Model:
    """Fixed in size, whatever the corpus: the frequent tokens, the class totals and two weight tables."""

    n: int
    v: int
    hot: np.ndarray  #: frequent tokens, sorted
    hot_count: np.ndarray
    hot_rank: np.ndarray  #: 0 for the most frequent
    tail_norm: np.ndarray  #: log10 of total + kinds + 1 of each tail class, without the head tokens
    prior: np.ndarray  #: natural log of each class's share
    inner: np.ndarray  #: natural log of each head token's share of its class
    w1: np.ndarray
    w2: np.ndarray

    def classify(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, place in a head class (or -1), and count of a frequent token (or -1)."""
        if not len(self.hot):
            return HEADS + (t & _LOW).astype(np.int64) % TAILS, np.full(len(t), -1), np.full(len(t), -1)
        i = np.minimum(np.searchsorted(self.hot, t), len(self.hot) - 1)
        found = self.hot[i] == t
        rank = np.where(found, self.hot_rank[i], 1 << 30)
        head = rank < HEADS * SIDE
        return np.where(head, rank // SIDE, HEADS + (t & _LOW).astype(np.int64) % TAILS), np.where(head, rank % SIDE, -1), np.where(found, self.hot_count[i], -1)

    def features(self, t: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Hashes of each token's contexts, one row for each kind: the token before, the two before, and the second before alone (a skip)."""
        p1, p2 = np.append(_START, t[:-1]), np.append([_START, _START], t[:-2])[: len(t)]
        first = off[:-1][off[:-1] < off[1:]]
        p1[first] = _START
        second = np.concatenate([first, first[first + 1 < len(t)] + 1])
        p2[second] = _START
        return np.stack([mix(p1 * _C[0]), mix(p1 * _C[1] + p2 * _C[2]), mix(p2 * _C[3] + np.uint64(1))])


def _rows(h: np.ndarray, c: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of weights that each token's contexts use; which are head tokens, and the rows of these in the second table."""
    head = np.flatnonzero(place >= 0)
    r2 = mix(h[:, head] + (c[head].astype(np.uint64) + np.uint64(1)) * _C[2]) % np.uint64(ROWS)
    return (h % np.uint64(ROWS)).astype(np.int64), head, r2.astype(np.int64)


def _softmax(w: np.ndarray, rows: np.ndarray, base: np.ndarray):
    """For each block of tokens: its slice, and with one row for each outcome the shifted logits, their exponentials, and the sums of these."""
    for i in range(0, rows.shape[1], BLOCK):
        s = slice(i, i + BLOCK)
        x = w.take(rows[0, s], 0)
        for r in rows[1:, s]:
            x += w.take(r, 0)
        x += base if base.ndim == 1 else base[s]
        z = np.ascontiguousarray(x.T)
        z -= z.max(axis=0)
        e = np.exp(z)
        yield s, z, e, e.sum(axis=0)


def _errors(w: np.ndarray, rows: np.ndarray, base: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gradient of the negative log probability by the logits, one row for each outcome."""
    err = np.empty((w.shape[1], rows.shape[1]), np.float32)
    for s, _, e, total in _softmax(w, rows, base):
        np.divide(e, total, out=err[:, s])
    err[own, np.arange(len(own))] -= 1
    return err


def _log_own(w: np.ndarray, rows: np.ndarray, base: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = np.empty(len(own))
    for s, z, _, total in _softmax(w, rows, base):
        out[s] = z[own[s], np.arange(z.shape[1])] - np.log(total)
    return out


def _descend(w: np.ndarray, g2: np.ndarray, used: np.ndarray, rows: np.ndarray, err: np.ndarray, rate: float) -> None:
    """AdaGrad on the rows of one minibatch; the gradient is summed by row first, over all contexts. used counts the contexts of each row."""
    n = np.bincount(rows.ravel(), minlength=ROWS)
    used += n
    at = np.flatnonzero(n)
    number = np.zeros(ROWS, np.int64)
    number[at] = np.arange(len(at))
    rows = number[rows]
    g = np.empty((len(err), len(at)), np.float32)
    for k in range(len(err)):
        e = err[k].astype(np.float64)
        g[k] = sum(np.bincount(r, e, len(at)) for r in rows)
    g = np.ascontiguousarray(g.T)
    g2[at] += g * g
    w[at] -= rate * g / np.sqrt(10 + g2[at])


def _train(model: Model, rate: float, minibatch: int, groups: int):
    """Local gradient steps from the shared weights; one row with the change, each row of weights times the contexts that used it, and their numbers."""

    def run(batches):
        m = Model(**{**model.__dict__, "w1": model.w1.copy(), "w2": model.w2.copy()})
        g1, g2, seen = np.zeros_like(m.w1), np.zeros_like(m.w2), 0
        n1, n2 = np.zeros(ROWS), np.zeros(ROWS)
        for batch in slices(batches):
            t, off = tokens(batch.column("text"))
            c, place, _ = m.classify(t)
            h = m.features(t, off)
            for i in range(0, len(t), minibatch):
                part = slice(i, i + minibatch)
                r1, head, r2 = _rows(h[:, part], c[part], place[part])
                _descend(m.w1, g1, n1, r1, _errors(m.w1, r1, m.prior, c[part]), rate)
                if len(head):
                    _descend(m.w2, g2, n2, r2, _errors(m.w2, r2, m.inner[c[part][head]], place[part][head]), rate)
            seen += len(t)
        if seen:
            change = np.concatenate([((m.w1 - model.w1) * n1[:, None]).ravel(), ((m.w2 - model.w2) * n2[:, None]).ravel(), n1, n2])
            group = int(hashlib.blake2b(_blob(change[:4096]), digest_size=4).hexdigest(), 16) % groups
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([seen], pa.int64()), pa.array([_blob(change.astype(np.float32))], pa.binary())], names=["g", "seen", "change"])

    return run


def _sum_changes(batches):
    """Rows come sorted by group: one row for each, for the next step's group."""
    total, seen, group = None, 0, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([group // FAN], pa.int32()), pa.array([seen], pa.int64()), pa.array([_blob(total.astype(np.float32))], pa.binary())], names=["g", "seen", "change"])

    for batch in batches:
        for g, n, x in zip(batch.column("g").to_pylist(), batch.column("seen").to_pylist(), batch.column("change").to_pylist(), strict=True):
            if total is not None and g != group:
                yield out()
                total, seen = None, 0
            x = np.frombuffer(x, np.float32)
            total = x.astype(np.float64) if total is None else total + x
            seen, group = seen + n, g
    if total is not None:
        yield out()


def train_lm(texts: DataFrame, hot: int = 4096, rounds: int = 2, rate: float = 0.3, minibatch: int = 65536) -> tuple[Model, DataFrame]:
    """The model and the table of all token counts, from every row of texts (``text``).

    Counts are packed by bucket of token numbers before they are shuffled, and stay in the shared folder. The weights are learned in ``rounds``,
    each over its share of the texts, all texts once: every task descends from the shared weights on its own part, changes are summed in steps
    of a few each and averaged, each row by the contexts that used it: a row that one task alone moves keeps its change. The driver holds the model and at most FAN changes of its size.
    """
    spark = texts.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    packed = texts.mapInArrow(_counts(buckets), "bucket int, ids binary, counts binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counted = materialize(packed.mapInArrow(_sum_counts(hot), "bucket int, ids binary, counts binary, n long, v long, top_ids array<long>, top_counts array<long>, tail array<long>, kinds array<long>"))
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    best = counted.select(F.explode(F.arrays_zip("top_ids", "top_counts")).alias("x")).select("x.top_ids", "x.top_counts").orderBy(F.desc("top_counts"), "top_ids").limit(hot).collect()
    sums = counted.select(F.posexplode("tail").alias("k", "total"), "kinds").groupBy("k").agg(F.sum("total").alias("total"), F.sum(F.expr("kinds[k]")).alias("kinds")).collect()
    ids = np.array([r[0] for r in best], np.int64).view(np.uint64)
    count = np.array([r[1] for r in best], np.int64)
    total, kinds = np.zeros(64), np.zeros(64)
    for r in sums:
        total[r["k"] % TAILS] += r["total"]
        kinds[r["k"] % TAILS] += r["kinds"]
    head = HEADS * SIDE
    tail = (ids[:head] & _LOW).astype(np.int64) % TAILS
    total -= np.bincount(tail, weights=count[:head], minlength=64)
    kinds -= np.bincount(tail, minlength=64)
    inner = np.zeros(head)
    inner[: len(count[:head])] = count[:head]
    inner = inner.reshape(HEADS, SIDE) + 1e-9
    share = np.concatenate([inner.sum(axis=1), total[:TAILS] + 1]) + 1e-6
    order = np.argsort(ids, kind="stable")
    model = Model(n, v, ids[order], count[order], order, np.log10(total[:TAILS] + kinds[:TAILS] + 1), np.log(share / share.sum()).astype(np.float32), np.log(inner / inner.sum(axis=1, keepdims=True)).astype(np.float32), np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, SIDE), np.float32))
    size, both = model.w1.size, model.w1.size + model.w2.size
    for i in range(rounds):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == i)
        tasks = max(1, part.rdd.getNumPartitions())
        groups = -(-tasks // FAN)
        summed, schema = part.mapInArrow(_train(model, rate, minibatch, groups), "g int, seen long, change binary"), "g int, seen long, change binary"
        while True:
            summed = summed.repartition(groups, "g").sortWithinPartitions("g").mapInArrow(_sum_changes, schema)
            if groups <= FAN:
                break
            groups = -(-groups // FAN)
        changes = summed.collect()
        seen = sum(r["seen"] for r in changes)
        if seen:
            change = sum(np.frombuffer(r["change"], np.float32).astype(np.float64) for r in changes)
            n1, n2 = np.maximum(change[both:].reshape(2, ROWS, 1), 1)
            model = Model(**{**model.__dict__, "w1": model.w1 + (change[:size].reshape(ROWS, CLASSES) / n1).astype(np.float32), "w2": model.w2 + (change[size:both].reshape(ROWS, SIDE) / n2).astype(np.float32)})
    return model, counted


def _local(model: Model, t: np.ndarray, off: np.ndarray, minibatch: int) -> tuple[np.ndarray, np.ndarray]:
    """What the model alone gives: for each text its tokens, their log10 probability, and the log10 counts and number of known ones, all but the counts of its rarer tokens. Which tokens are rarer."""
    c, place, count = model.classify(t)
    h = model.features(t, off)
    lp = np.empty(len(t))
    for i in range(0, len(t), minibatch):
        part = slice(i, i + minibatch)
        r1, head, r2 = _rows(h[:, part], c[part], place[part])
        own = _log_own(model.w1, r1, model.prior, c[part])
        own[head] += _log_own(model.w2, r2, model.inner[c[part][head]], place[part][head])
        lp[part] = own
    lp /= np.log(10)
    tail = place < 0
    lp[tail] -= model.tail_norm[c[tail] - HEADS]
    known = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
    sums = [np.add.reduceat(x, off[:-1]) if len(off) > 1 else np.zeros(0) for x in (lp + np.where(tail, known, 0.0), known, (count >= 0).astype(np.float64))]
    return np.stack([np.diff(off).astype(np.float64), *sums]), count < 0


def _ask(model: Model, minibatch: int, buckets: int, flush: int = 4_000_000):
    """For each bucket, the rarer tokens of many texts: (token, text) pairs with their counts, packed. One bucket's row also takes along the texts' keys and what the model alone gives."""

    def run(batches):
        pairs, keys, local, held, base = [], [], [], 0, 0

        def out():
            rk = pa.concat_arrays(keys)
            part = int.from_bytes(hashlib.blake2b(repr(rk.to_pylist()).encode(), digest_size=8).digest(), "little", signed=True)
            home = part % buckets
            t, d, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
            b = (mix(t.copy()) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            cut = np.searchsorted(b[order], np.arange(buckets + 1))
            rows = [(i, order[cut[i] : cut[i + 1]]) for i in range(buckets) if cut[i] < cut[i + 1] or i == home]
            names = pa.array([rk.to_pylist() if i == home else None for i, _ in rows], pa.list_(rk.type))
            given = pa.array([_blob(np.concatenate(local, axis=1)) if i == home else None for i, _ in rows], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int64()), names, given, pa.array([_blob(t[p]) for _, p in rows], pa.binary()), pa.array([_blob(d[p].astype(np.int32)) for _, p in rows], pa.binary()), pa.array([_blob(n[p].astype(np.int32)) for _, p in rows], pa.binary()), pa.array([len(rk)] * len(rows), pa.int32())],
                names=["bucket", "kind", "part", "names", "local", "ids", "docs", "counts", "size"],
            )

        for batch in slices(batches):
            t, off = tokens(batch.column("text"))
            given, rare = _local(model, t, off, minibatch)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            t, doc = t[rare], doc[rare]
            cut = np.searchsorted(doc, np.arange(len(off)))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                t[i:j].sort()
            first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (doc[1:] != doc[:-1]))) if len(t) else np.zeros(0, np.int64)
            pairs.append((t[first], doc[first] + base, np.diff(np.append(first, len(t)))))
            keys.append(batch.column("rk"))
            local.append(given)
            base += len(batch)
            held += len(first)
            if held > flush:
                yield out()
                pairs, keys, local, held, base = [], [], [], 0, 0
        if base:
            yield out()

    return run


def _answer(batches):
    """Rows come sorted by bucket, its counts first: for each text of a part, the sum of log10(count + 1) and the number of known tokens."""
    bucket, ids, logs = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                bucket, ids = row["bucket"], np.frombuffer(row["ids"], np.uint64)
                logs = np.log10(np.frombuffer(row["counts"], np.int64) + 1.0)
                continue
            t, d, n = np.frombuffer(row["ids"], np.uint64), np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int32)
            if bucket != row["bucket"] or not len(ids):
                found, value = np.zeros(len(t), bool), np.zeros(len(t))
            else:
                i = np.minimum(np.searchsorted(ids, t), len(ids) - 1)
                found = ids[i] == t
                value = np.where(found, logs[i], 0.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]], pa.int64()), pa.array([row["bucket"]], pa.int32()), pa.array([row["names"]], batch.schema.field("names").type), pa.array([row["local"]], pa.binary()), pa.array([_blob(np.bincount(d, weights=value * n, minlength=row["size"]))], pa.binary()), pa.array([_blob(np.bincount(d, weights=found * n, minlength=row["size"]).astype(np.int32))], pa.binary())],
                names=["part", "bucket", "names", "local", "logs", "known"],
            )


def _gather(batches):
    """Rows come sorted by part and bucket: the sums over all buckets beside what the model alone gives, one row for each text."""
    part, names, local, logs, known, kind = None, None, None, 0, 0, None

    def out():
        n, score, counts, mine = local
        return pa.RecordBatch.from_arrays([pa.array(names, kind.value_type), pa.array(n.astype(np.int64)), pa.array((mine + known).astype(np.int64)), pa.array(counts + logs), pa.array(score + logs)], names=["rk", "n_tokens", "n_known", "counts", "score"])

    for batch in batches:
        kind = batch.schema.field("names").type
        for row in batch.to_pylist():
            if row["part"] != part:
                if part is not None:
                    yield out()
                part, logs, known = row["part"], 0, 0
            if row["names"] is not None:
                names, local = row["names"], np.frombuffer(row["local"]).reshape(4, -1)
            logs = logs + np.frombuffer(row["logs"], np.float64)
            known = known + np.frombuffer(row["known"], np.int32)
    if part is not None:
        yield out()


def lm_score(docs: DataFrame, learn: Column, minibatch: int = 65536, rounds: int = 2) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row of docs (``doc_id, text``).

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and one end. The rows where ``learn`` is true give the counts
    and train the model. base_score: log10 of the text's probability under add-one unigrams. score: under the
    model, P(class | context) times P(token | class): of head classes by context too, of tail classes by add-one counts. The contexts are the token before, the
    two before, the one before that, and their classes.

    Both need the counts of rare tokens, which are too many to send around: tokens of each text are packed by bucket and meet the counts of
    their bucket, and what the model alone gives of a text goes along. Tokens of the ``hot`` most frequent are scored where they are, so no bucket holds a token of more than a small share of
    the corpus.

    Null texts count as empty (one token, the end). Null values of learn count as false. Repeated rows each get their result; null
    doc_ids too. Nothing to learn from: all tokens are unknown. No rows: no rows.
    """
    key = document_key(docs)
    rows = docs.select(key.alias("rk"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    rk = rows.schema["rk"].dataType.simpleString()
    model, counted = train_lm(rows.where("learn").select("text"), rounds=rounds)
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = rows.select("rk", "text") if rk == "bigint" else rows.select("rk", "text").dropDuplicates(["rk"])
    asked = texts.mapInArrow(_ask(model, minibatch, buckets), f"bucket int, kind int, part long, names array<{rk}>, local binary, ids binary, docs binary, counts binary, size int")
    counts = counted.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(None).cast(f"array<{rk}>").alias("names"), F.lit(None).cast("binary").alias("local"), "ids", F.lit(None).cast("binary").alias("docs"), "counts", F.lit(0).alias("size"))
    answers = asked.unionByName(counts).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "part").mapInArrow(_answer, f"part long, bucket int, names array<{rk}>, local binary, logs binary, known binary")
    both = answers.repartition(buckets, "part").sortWithinPartitions("part", "bucket").mapInArrow(_gather, f"rk {rk}, n_tokens long, n_known long, counts double, score double")
    norm = float(np.log10(model.n + model.v + 1.0))
    if rk != "bigint":
        both = docs.select(key.alias("rk"), "doc_id").join(both, "rk")
    return both.select(
        (F.col("rk") if rk == "bigint" else F.col("doc_id")).alias("doc_id"),
        "n_tokens",
        "n_known",
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("counts") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )
