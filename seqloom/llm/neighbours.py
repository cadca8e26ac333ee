"""Approximate nearest neighbours by largest inner product with collision-counting hashing.

Vectors get one more component so that all have the largest norm, and queries are scaled to it: then the largest inner
product is the least distance. The rows are dealt over shards. A shard projects its vectors on `projections` orthogonal
directions and keeps a sorted array for each. A query opens a window around its own place in every array and counts in
how many windows each vector lies. The collision threshold is the highest that at least `verify` of the shard's rows (and
`floor` of them) reach; while it is below `low` of the projections the windows widen (virtual rehashing) and only their new ends are counted.
The vectors that reach the threshold are verified with the exact product, the shards' best are merged.

All rows are indexed and every query meets every shard; nothing is cut off but by the threshold. Recall at 20 against
brute force is measured in the tests.

Defined results: null or zero vectors and vectors that hold null or non-finite components take no part; vectors are held against
those of their own length; rows that repeat a vec_id are vectors of their own, equal rows each have a rank, and a row that asks
leaves out only itself; a query with fewer candidates than k gets all; ties go to the smaller id, null last; an empty
table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.sources import read_table, stage

#: Stands for a null id in tasks: after all others.
NO_ID = (1 << 63) - 1


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles), times: the finite vectors that are not zero, equal rows as one."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    return stage(rows.groupBy("vec_id", "v").agg(F.count("*").alias("times")))


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray, norm: float, directions: np.ndarray, width: float) -> None:
        self.ids, self.times, self.vectors, self.directions, self.norm = ids, times, vectors, directions, norm
        last = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
        self.shift = last.mean()  # the same for all distances; windows stay short
        p = np.column_stack((vectors, last - self.shift)) @ directions
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.values = np.sort(p, axis=0).T.copy()
        self.step = width * norm / np.sqrt(len(directions))

    def windows(self, q: np.ndarray, half: float) -> tuple[list[int], list[int]]:
        pairs = [(row.searchsorted(x - half), row.searchsorted(x + half, "right")) for row, x in zip(self.values, q)]
        return [a for a, _ in pairs], [b for _, b in pairs]

    def nearest(self, own: int, query: np.ndarray, k: int, verify: float, low: float, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, scores, times) of the k best verified rows; all rows if they are no more than k. The asking row is one time less."""
        n, m = len(self.ids), len(self.order)
        near = np.arange(n)
        if n > k + 1:
            scaled = np.append(query * (self.norm / np.linalg.norm(query)), -self.shift)
            q, half, least = scaled @ self.directions, self.step, min(n, max(k + 1, floor, int(verify * n)))
            lo, hi = self.windows(q, half)
            counts = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, lo, hi)]), minlength=n)
            while True:
                reach = np.cumsum(np.bincount(counts, minlength=m + 1)[::-1])[::-1]  # rows with at least so many collisions
                threshold = int(np.flatnonzero(reach >= least)[-1])
                if threshold >= low * m:
                    break
                half *= 1.5
                new_lo, new_hi = self.windows(q, half)
                ends = [o[a:b] for o, a, b in zip(self.order, new_lo, lo)] + [o[a:b] for o, a, b in zip(self.order, hi, new_hi)]
                counts += np.bincount(np.concatenate(ends), minlength=n)
                lo, hi = new_lo, new_hi
            near = np.flatnonzero(counts >= threshold)
        scores, times = self.vectors[near] @ query, self.times[near].copy()
        if len(near) > k + 1:  # with a margin, as the product's last bits depend on a row's place
            least = np.partition(scores, len(near) - k - 1)[len(near) - k - 1]
            keep = scores >= least - 1e-9 * abs(least) - 1e-12 * self.norm * np.linalg.norm(query)
            near, times = near[keep], times[keep]
        scores = (self.vectors[near] * query).sum(axis=1)  # each row in the same order
        times -= (self.ids[near] == own) & (self.vectors[near] == query).all(axis=1)
        near, scores, times = near[times > 0], scores[times > 0], times[times > 0]
        best = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near[best]], scores[best], times[best]


def rotation(dims: int, projections: int, seed: int = 7) -> np.ndarray:
    """dims x projections: columns of random rotations, orthogonal within each."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-projections // dims))]
    return np.concatenate(turns, axis=1)[:, :projections]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = 64, verify: float = 0.12, width: float = 1.4, low: float = 0.5, floor: int = 1024, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: vec_id, v, times, as from usable(). width: in mean deviations of a projection."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = vectors.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(length).alias("norm")).withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int"))
    sizes = stage(sizes.withColumn("first", F.sum("shards").over(Window.orderBy("dims")).cast("int") - F.col("shards")))  # a row a length of vectors
    shards = max(1, sizes.agg(F.sum("shards")).first()[0] or 1)
    last = F.col("first") + F.col("shards") - 1
    columns = ("shard", "asks", "vec_id", "times", "norm", "v")
    rows = vectors.withColumn("dims", F.size("v")).join(F.broadcast(sizes), "dims")
    rows = rows.withColumns({"shard": F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int"), "asks": F.lit(0)}).select(*columns)
    asked = queries.withColumn("dims", F.size("v")).join(F.broadcast(sizes), "dims")
    asked = asked.withColumns({"shard": F.explode(F.sequence("first", last)), "asks": F.lit(1)}).select(*columns)
    dealt = rows.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", F.asc_nulls_last("vec_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = -1, [], None
        for b in batches:
            if not b.num_rows:
                continue
            shard, asks, times, norm = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            vec_id = pc.fill_null(b.column(2), NO_ID).to_numpy(zero_copy_only=False)
            values, sizes = b.column(5).flatten().to_numpy(zero_copy_only=False), pc.list_value_length(b.column(5)).to_numpy()
            start = np.cumsum(sizes) - sizes
            cuts = np.flatnonzero(np.diff(shard * 2 + asks)) + 1
            found: list[tuple] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(vec_id)]):
                if shard[lo] != at:
                    at, held, built = shard[lo], [], None
                v = values[start[lo] : start[hi - 1] + sizes[lo]].reshape(hi - lo, -1)
                if not asks[lo]:
                    held.append((vec_id[lo:hi], times[lo:hi], v))
                    continue
                if not held:
                    continue
                built = built or Shard(*[np.concatenate([h[j] for h in held]) for j in range(3)], norm[lo], rotation(v.shape[1] + 1, projections), width)
                for i, q in zip(vec_id[lo:hi].tolist(), v):
                    found.append((i, xxhash.xxh3_64_intdigest(q.tobytes()) - (1 << 63), *built.nearest(i, q, k, verify, low, floor)))
            if found:
                sizes = [len(f[2]) for f in found]
                query, name = (np.repeat(np.array([f[j] for f in found], np.int64), sizes) for j in (0, 1))
                ids, scores, count = (np.concatenate([f[j] for f in found]) for j in (2, 3, 4))
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(name), pa.array(ids, mask=ids == NO_ID), pa.array(scores), pa.array(np.minimum(count, k))], ["query_id", "name", "vec_id", "score", "n"])

    best = dealt.mapInArrow(run, "query_id long, name long, vec_id long, score double, n long")
    own = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    # equal rows: each of them has a rank
    upto = F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("upto", upto.cast("int"))
    ranked = ranked.withColumn("rank", F.explode(F.sequence((F.col("upto") - F.col("n") + 1).cast("int"), "upto"))).filter(F.col("rank") <= k)
    out = ranked.select("query_id", "rank", "vec_id", "score", "name")
    # and each of equal rows that ask has the answer
    repeated = stage(queries.filter("times > 1").select(F.col("vec_id").alias("query_id"), "v", "times"))
    if repeated.isEmpty():
        return out.drop("name")
    named = repeated.mapInArrow(name_queries, "query_id long, name long, times long")
    out = out.join(named, ["query_id", "name"], "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    return out.select("query_id", "rank", "vec_id", "score")


def name_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        name = [xxhash.xxh3_64_intdigest(np.array(v, np.float64).tobytes()) - (1 << 63) for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.int64()), b.column(2)], ["query_id", "name", "times"])


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    vectors = usable(read_table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
