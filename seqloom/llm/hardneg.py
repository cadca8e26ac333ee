"""Hard negatives of anchors by Strassen products of integer tiles.

Components become integers, floor(scale * x), and a score is an exact integer inner product. Anchors are dealt into groups, all
rows into chunks; each pair of a group and a chunk is one task's work, which holds the group and streams the chunk in
tiles. A tile of scores is a matrix product on 64-bit integers by Strassen's recursion: odd sides are padded with
zeros, seven products of halves replace eight, and only additions join them. (Sums wrap around and back: the product is exact
whenever the score itself fits in 64 bits.) Two passes follow: heaps of each anchor's best rows of the same label, then
for each anchor and positive heaps of the best rows of other labels whose score lies in the positive's window. Heaps of different tiles and
chunks merge by score and id.

Every anchor meets every row of its length, in blocks; nothing is cut off but by the heaps.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; a component beyond 64 bits after
scaling counts as the nearest number of 64 bits; rows meet rows of their own length only; rows that repeat a vec_id are rows of
their own, and an anchor leaves out only itself; a null vec_id is no anchor, is not relabelled and comes after all other ids at ties;
an empty table gives an empty result. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources import read_table, stage

#: Rows of a chunk and anchors of a group (a task's work), and the tiles in which they are multiplied.
CHUNK, GROUP, TILE, ANCHORS = 8192, 32_768, 2048, 256
#: Stands for a null id in tasks: after all others.
NO_ID = (1 << 63) - 1


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 16) -> np.ndarray:
    """The product of two integer matrices; blocks with a side of at most `leaf` are multiplied directly."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
        return strassen(a, b, leaf)[:n, :m]
    r, s, t = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    out = np.empty((n, m), np.int64)
    out[:r, t:] = m3 + m5
    out[r:, :t] = m2 + m4
    out[r:, t:] = m1 - m2 + m3 + strassen(a21 - a11, b11 + b12, leaf)
    out[:r, :t] = m1 + m4 - m5 + strassen(a12 - a22, b21 + b22, leaf)
    return out


class Heaps:
    """The first `k` (score falling, id rising) of each of `n` lists; `last` is the score to reach."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.last = np.full(n, np.iinfo(np.int64).min)
        self.owner, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def merge(self, owner: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, id_ = (np.concatenate(p) for p in ((self.owner, owner), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, ~score, owner))  # ~ turns the order round and fits every number
        owner, score, id_ = owner[order], score[order], id_[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        kept = place < self.k
        self.owner, self.score, self.id = owner[kept], score[kept], id_[kept]
        full = place == self.k - 1
        self.last[owner[full]] = score[full]


def usable(vectors: DataFrame, scale: int, every: int, kinds: int) -> DataFrame:
    """uid, vec_id, label (moved on by one of `kinds` where vec_id is divisible by `every`), dim, v (array of long) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("label IS NOT NULL AND v IS NOT NULL").filter(~bad)
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % kinds).otherwise(F.col("label"))
    limit = float(2**63)
    whole = F.transform("v", lambda x: F.when(x * scale >= limit, NO_ID).when(x * scale <= -limit, -NO_ID - 1).otherwise(F.floor(x * scale)).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", moved.alias("label"), F.size("v").alias("dim"), whole.alias("v"))


def in_cells(anchors: DataFrame, rows: DataFrame, groups: int, chunks: int) -> DataFrame:
    """cell, kind (0: anchors, 1: rows) and the columns of both: every group of anchors with every chunk of rows."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n)).cast("int")
    left = anchors.withColumn("group", own(groups, 1)).withColumn("chunk", spread(chunks)).withColumn("kind", F.lit(0))
    right = rows.withColumn("chunk", own(chunks, 2)).withColumn("group", spread(groups)).withColumn("kind", F.lit(1))
    cell = F.struct("dim", "group", "chunk")
    both = left.unionByName(right, allowMissingColumns=True).withColumn("cell", F.xxhash64(cell))
    return both.repartition(min(groups * chunks, 10_000), "cell").sortWithinPartitions("cell", "kind").select("cell", "kind", "uid", "vec_id", "label", "dim", "v", *[c for c in anchors.columns if c not in rows.columns])


class Block:
    """Columns of some rows of one cell."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        self.uid, self.label = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        self.id = batch.column(3).fill_null(NO_ID).to_numpy()
        self.v = batch.column(6).flatten().to_numpy().reshape(n, -1) if n and len(batch.column(6).flatten()) else np.zeros((n, 0), np.int64)
        self.windows = batch.column(7) if batch.num_columns > 7 else None

    @staticmethod
    def joined(blocks: list[Block]) -> Block:
        out = object.__new__(Block)
        for name in ("uid", "label", "id", "v"):
            setattr(out, name, np.concatenate([getattr(b, name) for b in blocks]))
        out.windows = pa.concat_arrays([b.windows for b in blocks]) if blocks[0].windows is not None else None
        return out


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Block]]:
    """cell, kind, block for each run of rows of one cell and kind in each batch, tiles at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)])
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            for at in range(lo, hi, TILE):
                yield int(key[0, lo]), int(key[1, lo]), Block(batch.slice(at, min(TILE, hi - at)))


def searched(batches: Iterator[pa.RecordBatch], begin, tile, end) -> Iterator[pa.RecordBatch]:
    """For each cell: begin(anchors) gives a state, tile(state, anchors, lo, rows, scores) sees all tiles, end(state, anchors) gives a batch."""
    cell, parts, anchors, state = None, [], None, None
    for now, kind, block in cells_of(batches):
        if now != cell:
            if state is not None:
                yield end(state, anchors)
            cell, parts, anchors, state = now, [], None, None
        if kind == 0:
            parts.append(block)
            continue
        if anchors is None:
            if not parts:
                continue  # a chunk that no anchor of its length meets
            anchors = Block.joined(parts)
            state = begin(anchors)
        across = np.ascontiguousarray(block.v.T)
        for lo in range(0, len(anchors.uid), ANCHORS):
            tile(state, anchors, lo, block, strassen(anchors.v[lo : lo + ANCHORS], across))
    if state is not None:
        yield end(state, anchors)


def positives(cells: DataFrame, most: int) -> DataFrame:
    """anchor (uid), anchor_id, score, id: each cell's first rows of the anchor's label."""

    def tile(heaps: Heaps, anchors: Block, lo: int, rows: Block, scores: np.ndarray) -> None:
        part = slice(lo, lo + len(scores))
        fits = (anchors.label[part, None] == rows.label) & (anchors.uid[part, None] != rows.uid) & (scores >= heaps.last[part, None])
        a, b = np.nonzero(fits)
        heaps.merge(a + lo, scores[a, b], rows.id[b])

    def end(heaps: Heaps, anchors: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.uid[heaps.owner], anchors.id[heaps.owner], heaps.score, heaps.id)], ["anchor", "anchor_id", "score", "id"])

    return cells.mapInArrow(lambda batches: searched(batches, lambda a: Heaps(len(a.uid), most), tile, end), "anchor long, anchor_id long, score long, id long")


def window_bounds(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole number from 3/10 to 9/10 of each score, without products that overflow."""
    up, down = score // 10 * 9 + score % 10 * 9 // 10, -score // 10 * 3 + -score % 10 * 3 // 10
    return -down, up


def negatives(cells: DataFrame, most: int) -> DataFrame:
    """anchor (uid), place (of the positive), score, id: each cell's first rows of other labels in each positive's window."""

    def begin(anchors: Block) -> dict:
        found = anchors.windows  # scores of the positives, best first
        counts = np.diff(found.offsets.to_numpy())
        score = found.flatten().to_numpy()
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        low, high = window_bounds(score)
        return {"owner": owner, "place": place, "low": low, "high": high, "heaps": Heaps(len(owner), most)}

    def tile(state: dict, anchors: Block, lo: int, rows: Block, scores: np.ndarray) -> None:
        first, last = np.searchsorted(state["owner"], (lo, lo + len(scores)))
        part, heaps = slice(first, last), state["heaps"]
        own = state["owner"][part] - lo
        s = scores[own]
        fits = (anchors.label[lo + own, None] != rows.label) & (s >= np.maximum(state["low"][part], heaps.last[part])[:, None]) & (s <= state["high"][part, None])
        a, b = np.nonzero(fits)
        heaps.merge(a + first, s[a, b], rows.id[b])

    def end(state: dict, anchors: Block) -> pa.RecordBatch:
        heaps = state["heaps"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.uid[state["owner"][heaps.owner]], state["place"][heaps.owner], heaps.score, heaps.id)], ["anchor", "place", "score", "id"])

    return cells.mapInArrow(lambda batches: searched(batches, begin, tile, end), "anchor long, place long, score long, id long")


def ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The heaps of all cells merged: `at` from 1 to `most`, in each list of its own."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)


def hard_negatives(vectors: DataFrame, every: int = 100, positive: int = 5, negative: int = 10, scale: int = 256, relabelled: int = 7, kinds: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors (vec_id divisible by `every`)."""
    rows = stage(usable(vectors, scale, relabelled, kinds))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    groups, chunks = (max(1, -(-n // size)) for n, size in ((anchors.count(), GROUP), (rows.count(), CHUNK)))
    best = stage(ranked(positives(in_cells(anchors, rows, groups, chunks), positive), ["anchor"], positive))
    scores = F.array_sort(F.collect_list(F.struct("at", "score")))
    windows = best.groupBy("anchor").agg(F.transform(scores, lambda p: p["score"]).alias("windows"))  # at most `positive` an anchor
    asked = anchors.join(windows.withColumnRenamed("anchor", "uid"), "uid").select(*rows.columns, "windows")
    found = ranked(negatives(in_cells(asked, rows, groups, chunks), negative), ["anchor", "place"], negative)
    named = best.select("anchor", (F.col("at") - 1).cast("long").alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    out = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["anchor", "place"])
    return out.select("anchor_id", known("positive_id"), F.col("at").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    """The contract's columns."""
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


OP12_SQL = """WITH v AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u AS au, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.u <> c.u AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY au ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.au, p.k ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.au = p.au AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
