"""Exact top-k inner products: ball-tree branch and bound in each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.storage import materialize

_MAX_ID = np.iinfo(np.int64).max


class BallTree:
    """Vectors of whole numbers split by halves along their widest axis; each node has a centre and a radius."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, leaf: int):
        self.order = np.arange(len(v))
        self.v, self.nodes = v, []
        self._build(0, len(v), leaf)
        self.v, self.ids = v[self.order], ids[self.order]
        self.centre = np.array([n[4] for n in self.nodes])
        self.radius = np.array([n[5] for n in self.nodes])
        self.reach = np.sqrt((self.centre**2).sum(axis=1)) + self.radius
        self.widest = float(np.abs(v).max(initial=0.0))

    def _build(self, a: int, b: int, leaf: int) -> int:
        x = self.v[self.order[a:b]]
        centre = x.mean(axis=0)
        me = len(self.nodes)
        self.nodes.append([a, b, -1, -1, centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))])
        if b - a > leaf and np.ptp(x, axis=0).max() > 0:
            axis = int(np.argmax(np.ptp(x, axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(x[:, axis], mid)]
            self.nodes[me][2] = self._build(a, a + mid, leaf)
            self.nodes[me][3] = self._build(a + mid, b, leaf)
        return me

    def search(self, q: np.ndarray, own: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of each query, as whole numbers; the id of a missing one is the largest of all.

        low: a kth score known already (-inf: none), which fillers stand for: they lose every tie. Nodes are taken by upper bound, the child that promises more
        first; a query leaves a node whose bound is below its kth score. Bounds are doubles with room for their rounding;
        scores are doubles where no sum can pass 2^53, else 64-bit integers where none can pass 2^63, else integers of any size.
        """
        most = q.shape[1] * float(np.abs(q).max(initial=0.0)) * self.widest
        kind = np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object
        exact = (lambda x: np.array([[int(c) for c in r] for r in x.tolist()], object).reshape(x.shape)) if kind is object else (lambda x: x.astype(kind))
        least = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min, object: -(1 << 4096)}[kind]
        best = np.empty((len(q), k), kind)
        best[:] = np.array([least if x == -np.inf else kind(x) if kind is not object else int(x) for x in low.tolist()], kind)[:, None]
        best_id = np.full((len(q), k), _MAX_ID)
        floor = low.copy()  # the kth scores as doubles, rounded down a little
        norm = np.sqrt((q * q).sum(axis=1))
        whole, held = exact(q), self.v if kind is np.float64 else None

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            return q[rows] @ self.centre[node] + norm[rows] * self.radius[node] + 1e-9 * (1 + norm[rows] * self.reach[node])

        def visit(node: int, rows: np.ndarray, upper: np.ndarray) -> None:
            rows = rows[upper >= floor[rows]]
            if not len(rows):
                return
            a, b, left, right = self.nodes[node][:4]
            if left >= 0:
                both = sorted(((bound(x, rows), x) for x in (left, right)), key=lambda p: -p[0].mean())
                for upper_, child in both:
                    visit(child, rows, upper_)
                return
            score = whole[rows] @ (held[a:b] if held is not None else exact(self.v[a:b])).T
            other = self.ids[a:b][None, :] != own[rows][:, None]
            r, c = np.nonzero((score >= best[rows, -1][:, None]) & other)
            if not len(r):
                return
            who, inverse = np.unique(r, return_inverse=True)
            rr = np.concatenate([np.repeat(np.arange(len(who)), k), inverse])
            ss = np.concatenate([best[rows[who]].ravel(), score[r, c]])
            ii = np.concatenate([best_id[rows[who]].ravel(), self.ids[a:b][c]])
            if kind is object:
                by = np.array(sorted(range(len(rr)), key=lambda i: (rr[i], -ss[i], ii[i])))
            else:
                by = np.lexsort((ii, -ss if kind is np.float64 else ~ss, rr))
            first = np.searchsorted(rr[by], np.arange(len(who)))
            take = by[first[:, None] + np.arange(k)]
            best[rows[who]], best_id[rows[who]] = ss[take], ii[take]
            kth = np.array([-np.inf if x == least else float(x) for x in best[rows[who], -1].tolist()])
            floor[rows[who]] = kth - np.where(np.isfinite(kth), 1e-15 * np.abs(kth), 0)

        everyone = np.arange(len(q))
        visit(0, everyone, bound(0, everyone))
        return best, best_id


def _search(k: int, leaf: int, block: int):
    """Rows come sorted by shard and length of the vectors, candidates before queries."""

    def run(batches):
        shard, parts, tree = None, [], None
        for batch in batches:
            at = batch.column("shard").to_numpy()
            kind = batch.column("kind").to_numpy()
            dim = batch.column("dim").to_numpy()
            key = np.stack([at, dim, kind])
            cut = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))), len(at)) if len(at) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                piece = batch.slice(int(a), int(b - a))
                ids = piece.column("vec_id").to_numpy()
                v = piece.column("v").flatten().to_numpy().reshape(len(ids), -1)
                if shard != (at[a], dim[a]):
                    shard, parts, tree = (at[a], dim[a]), [], None
                if kind[a] == 0:
                    parts.append((v, ids))
                    continue
                if tree is None and parts:
                    tree = BallTree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), leaf)
                    parts = []
                if tree is None:
                    continue
                tag = piece.column("tag").to_numpy()
                low = piece.column("low").to_numpy(zero_copy_only=False)
                for i in range(0, len(ids), block):
                    q, own, t = v[i : i + block], ids[i : i + block], tag[i : i + block]
                    best, best_id = tree.search(q, own, low[i : i + block].astype(np.float64), k)
                    r, c = np.nonzero(best_id != _MAX_ID)
                    score = [min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in best[r, c].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(t[r]), pa.array(best_id[r, c]), pa.array(score, pa.int64())], names=["query_id", "tag", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 16384, bands: int = 8, leaf: int = 64, block: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k other rows of highest integer inner product, ties to the smaller vec_id.

    vectors: ``vec_id, embedding`` (array of numbers) and any other columns. Each component x counts as floor(256 * x). Candidates are
    dealt to bands by their norms, and within a band to shards of about ``shard_rows`` by a hash of vec_id; each shard builds a ball tree. Of equal vectors the k + 1 smallest ids
    are candidates: no query can need more. Each query goes through one shard of the band of the largest norms first. Its kth score there is shared with all
    other shards, as the score to beat, and bands where the product of the norms can't reach it are left out.

    Vectors that are null or hold a null or non-finite component, and rows without a vec_id, take no part. Only vectors of equal length
    are compared. Equal rows count once; of an id with several vectors each is a candidate and, for the query, a
    list of its own. A query with fewer candidates than k gets all of them. Scores are exact; one that passes a long's range
    is given as the end of that range. No rows: no rows.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(~bad)

    def whole(x: Column) -> Column:
        y = 256 * x.cast("double")  # beyond 2^53 all doubles are whole numbers
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"), is_query.alias("q")).where(F.size("v") > 0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.select("*", F.xxhash64("v").alias("tag"), F.size("v").alias("dim"), norm.alias("norm"))
    held = rows.dropDuplicates(["vec_id", "tag"]).withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    asked = rows.where("q").dropDuplicates(["vec_id", "tag"])
    edges = rows.agg(F.percentile_approx("norm", [i / bands for i in range(1, bands)], 1000)).first()[0] or []
    band = sum((F.col("norm") > e).cast("int") for e in sorted(set(edges))) if edges else F.lit(0)
    # a row for each band
    sizes = {r.band: (r.n, r.most) for r in rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, begin = {}, 0
    for b in sorted(sizes, reverse=True):
        shards[b] = (begin, -(-sizes[b][0] // shard_rows))
        begin += shards[b][1]
    top = max(sizes)
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    where = F.coalesce(*[F.when(band == b, at + spread(n)) for b, (at, n) in shards.items()])
    home = F.lit(shards[top][0]) + spread(shards[top][1])
    columns = ["shard", "kind", "dim", "vec_id", "tag", "v", "low"]
    none = F.lit(float("-inf"))
    held = held.select(where.alias("shard"), F.lit(0).alias("kind"), "dim", "vec_id", "tag", "v", none.alias("low"))
    parts = max(1, min(begin, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def searched(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        dealt = candidates.unionByName(queries.withColumn("kind", F.lit(1)).select(*columns)).repartition(parts, "shard").sortWithinPartitions("shard", "dim", "kind", "vec_id")
        return dealt.mapInArrow(_search(k, leaf, block), "query_id long, tag long, vec_id long, score long")

    first = materialize(searched(asked.withColumn("shard", home).withColumn("low", none), held.where(F.col("shard") < shards[top][0] + shards[top][1])))
    if begin == 1:
        found = first
    else:
        kth = first.groupBy(F.col("query_id").alias("vec_id"), "tag").agg(F.min("score").cast("double").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
        again = asked.join(kth, ["vec_id", "tag"], "left").withColumn("low", F.coalesce("low", none))
        reach = [F.when(F.col("norm") * most * (1 + 1e-9) + 1 >= F.col("low"), F.sequence(F.lit(shards[b][0]), F.lit(shards[b][0] + shards[b][1] - 1))).otherwise(F.array().cast("array<int>")) for b, (_, most) in sizes.items()]
        again = again.withColumn("shard", F.explode(F.flatten(F.array(*reach)))).where(F.col("shard") != home)
        found = first.unionByName(searched(again, held))
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
