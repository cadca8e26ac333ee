"""MinHash near-duplicates by fast similarity sketching.

A set is placed into `bins` coordinates in rounds: in round i every element goes to one hashed bin with a hashed value, and
the least value of the earliest round stays. A set ends with the round that fills its last bin; round bins + j, should it
be needed, places all elements in bin j, so every coordinate fills. Two sets agree in a coordinate with the chance of their
Jaccard index, and the number of agreements is as concentrated as that of independent draws, at a cost of
O(bins log bins + elements). Coordinates are banded: sets that share a band's key are candidates.

Sets are known by 128 bits, so copies are one node whatever their number. Candidates are decided in two steps. First each
node is held against the least node of each of its buckets (one pair a node and bucket at most). Buckets that these links leave in
more than one component are compared as wholes: their members' texts meet in cells of bounded size, intersections are counted
over an inverted index, and only a spanning forest of the links leaves a cell. No pair that shares a bucket is left undecided.
All links are exact: 64-bit hashes of all distinct shingles of both sets.

With 32 bands of 6 coordinates two sets of similarity 0.85 share no bucket with a chance of 3e-7 (0.9: 5e-11).

Defined results: null and empty texts and texts without a word have an empty set, linked with nothing; fewer words than a
shingle are one shingle; rows that repeat a doc_id each get a row; a null doc_id takes part but names a component only if all its
members are null, and is kept then; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.arrow import blocks, ragged, text_bytes
from seqloom.llm.components import Forest, components
from seqloom.llm.neardup import shingle_set
from seqloom.llm.rows import join_names
from seqloom.sources import discard, read_table, stage

BANDS, ROWS = 32, 6
#: A cell of a bucket's comparison holds at most about so many members and bytes of text on each side.
CELL_ROWS, CELL_BYTES = 1000, 4 << 20
EMPTY = np.uint64((1 << 64) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of `bins` coordinates for each set: round in the upper half, hashed value in the lower one. Empty sets stay unfilled."""
    out = np.full((len(sets), bins), EMPTY)
    flat, at = out.reshape(-1), np.flatnonzero([len(s) for s in sets])
    if not len(at):
        return out
    elements = np.concatenate([sets[i] for i in at]).view(np.uint64)
    owner = np.repeat(at, [len(sets[i]) for i in at])
    for turn in range(2 * bins):
        h = _mixed(elements + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32) if turn < bins else np.full(len(h), turn - bins, np.uint64)
        np.minimum.at(flat, owner * bins + place.astype(np.int64), np.uint64(turn << 32) | (h & np.uint64(0xFFFFFFFF)))
        open_sets = (out == EMPTY).any(axis=1)
        if not open_sets[at].any():
            break
        goes_on = open_sets[owner]
        if not goes_on.all():
            elements, owner = elements[goes_on], owner[goes_on]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band's coordinates and number."""
    parts = sketch.reshape(len(sketch), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), 1))
    for k in range(parts.shape[2]):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def sets_of(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (128 bits of the set, null if it is empty), n (its size), keys (of the bands), body (the compressed text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in blocks(batches, size=1 << 20):
            texts = text_bytes(batch).to_pylist()
            sets = [shingle_set(t, words) for t in texts]
            keys = band_keys(sketches(sets, bands * rows), bands)
            filled = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, filled)], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k if f else None for k, f in zip(keys, filled)], pa.list_(pa.int64())),
                pa.array([zip_.compress(t) if f else None for t, f in zip(texts, filled)], pa.binary()),
            ], ["doc_id", "node", "n", "keys", "body"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node binary, n long, keys array<long>, body binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 times the shared elements are at least `percent` times all of them."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def star_links(pairs: DataFrame, bodies: DataFrame, words: int, percent: int, block: int = 512) -> DataFrame:
    """The pairs a, b (ids) whose whole sets are similar. The text of `a` is sent once for each block of its partners."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.count("*").over(Window.partitionBy("a")) / block)))
    heads = pairs.select("a", "salt").distinct().join(bodies.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "body")
    rows = heads.unionByName(pairs.join(bodies.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, head = zstandard.ZstdDecompressor(), None
        for batch in batches:
            found = []
            for a, b, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                own = shingle_set(unzip.decompress(body.as_py()), words)
                if b is None:  # nulls come first
                    head = own
                elif similar(head, own, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "b").mapInArrow(run, "a long, b long")


def cell_links(ids: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components (roots) of a cell's members: all pairs of one side, or of the two sides, count."""
    sizes = np.array([len(s) for s in sets])
    elements, which = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(which, kind="stable")
    member = np.repeat(np.arange(len(sets)), sizes)[order]
    start = np.searchsorted(which[order], np.arange(len(elements)))
    length = np.diff(np.append(start, len(which)))
    ends = np.cumsum(sizes)
    forest, found = Forest(), []
    label = np.unique(roots, return_inverse=True)[1]
    two = len(np.unique(sides)) > 1
    for x in range(len(sets)):
        if not (label != label[0]).any():
            break
        mine = which[ends[x] - sizes[x] : ends[x]]
        shared = np.bincount(member[ragged(start[mine], length[mine])], minlength=len(sets))
        near = (label != label[x]) & (100 * shared >= percent * (sizes + sizes[x] - shared))
        if two:
            near &= sides != sides[x]
        for y in np.flatnonzero(near).tolist():
            if forest.joins(int(label[x]), int(label[y])):
                found.append((int(ids[x]), int(ids[y])))
        if near.any():
            label = np.array([forest.root(v) for v in label.tolist()])
    return found


def open_links(members: DataFrame, labels: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """Links a, b between the different components (labels: node, root) of each bucket of members (key, id, size, bytes)."""
    rows = members.filter("size > 2").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("last")).filter("least <> last").select("key")
    rows = rows.join(mixed, "key", "left_semi")
    parts = F.greatest(F.ceil(F.col("size") / CELL_ROWS), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell")
    rows = rows.select(cell, "id", "root", F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("side")).join(bodies, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, held, cell = zstandard.ZstdDecompressor(), [], None

        def decided() -> pa.RecordBatch:
            ids, roots, sides = (np.array([h[k] for h in held]) for k in range(3))
            found = cell_links(ids, roots, sides, [h[3] for h in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            for c, i, root, side, body in zip(*[x.to_pylist() for x in batch.columns[:4]], batch.column(4)):
                if c != cell and held:
                    yield decided()
                    held = []
                cell = c
                held.append((i, root, side, shingle_set(unzip.decompress(body.as_py()), words)))
        if held:
            yield decided()

    return rows.select("cell", "id", "root", "side", "body").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that is reachable), kept of every row of `docs`."""
    every = stage(sets_of(docs, words, bands, rows))
    nodes = every.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.max(F.octet_length("body")).alias("bytes"), F.count("*").alias("times"))
    nodes = stage(nodes.withColumn("id", F.monotonically_increasing_id()))  # written once, so the ids stay
    keyed = nodes.select("id", "bytes", F.explode("keys").alias("key"))
    buckets = stage(keyed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.sum("bytes").alias("bytes")).filter("size > 1"))
    members = stage(keyed.drop("bytes").join(buckets, "key"))
    pairs = stage(members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    wanted = members.select("id").distinct().join(nodes.select("id", "node"), "id")
    bodies = stage(every.select("node", "body").join(wanted, "node").groupBy("id").agg(F.first("body").alias("body")))
    links = stage(star_links(pairs, bodies, words, percent))
    labels = components(links)
    more = stage(open_links(members, labels, bodies, words, percent))
    labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    for t in (buckets, members, pairs, bodies):
        discard(t)
    own = nodes.select("id", "node", "first", "times").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    names = stage(own.join(least, "root").select("node", "component_id", "times"))
    rows_of = every.select("doc_id", "node", "n")
    out = join_names(rows_of.filter("node IS NOT NULL"), names, "node")
    out = out.unionByName(rows_of.filter("node IS NULL").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark, sf_dir) -> DataFrame:
    """The contract's columns for every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


# the whole sets of all documents meet through their shingles; components by closure over the links
OP13_SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT id, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT id, doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.id <> b.id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT id AS a, id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS id, min(w.doc_id) AS component_id FROM r JOIN w ON w.id = r.b GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w JOIN c USING (id) LEFT JOIN n USING (id)"""
