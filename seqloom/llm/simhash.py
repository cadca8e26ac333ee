"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect (23, 12, 7) Golay code gives each segment one or
six keys, the indices of the codewords at a distance of at most four, so that segments with two or fewer differing bits
share a key. Of four errors over three segments some two segments hold at most two together, hence two linked
fingerprints meet under the key pair of some two segments. Candidates that meet are verified on all 64 bits.
Equal fingerprints are joined as one first; what leaves a bucket is a spanning forest of its verified links, so
large groups of copies give no pairs of all their rows.

Defined results: null and empty texts and texts without a word have fingerprint zero; fewer words than a shingle are
one shingle; a null doc_id takes part but never names a component unless all its members are null; rows that repeat
a doc_id each get a row; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.arrow import blocks, text_bytes
from seqloom.llm.components import Forest, components
from seqloom.llm.golay import segment_keys
from seqloom.llm.neardup import near_deduplicated  # noqa: F401
from seqloom.llm.rows import join_names
from seqloom.sources import read_table, stage

# fixed values: the cut of a fingerprint into (shift, bits)
SEGMENTS = ((41, 23), (18, 23), (0, 18))
SEED = 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the shingles of a UTF-8 text as an unsigned number."""
    found = text.lower().split()  # A-Z only, and the white space of ASCII
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    counts = bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            fps = np.array([fingerprint(t, words) for t in text_bytes(batch).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key pair of every fingerprint."""
    keys = [segment_keys((fps.view(np.uint64) >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)) for shift, bits in SEGMENTS]
    rows, out = [], []
    for kind, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = keys[i][:, :, None], keys[j][:, None, :]
        row, *_ = np.nonzero((a >= 0) & (b >= 0))
        rows.append(row)
        out.append(((kind << 24) | (a << 12) | b)[(a >= 0) & (b >= 0)])
    return np.concatenate(rows), np.concatenate(out)


def bucketed(distinct: DataFrame) -> DataFrame:
    """fp of all distinct fingerprints to key, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                fps = batch.column(0).slice(lo, 2000).to_numpy(zero_copy_only=False)
                rows, keys = bucket_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def run_links(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one large bucket: every fingerprint is compared with all that are not reached yet."""
    left = fps.copy()
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                found = left[near]
                yield np.full(len(found), x), found
                queue.extend(found)
                left = left[~near]


def links(buckets: DataFrame, most: int, small: int = 12) -> DataFrame:
    """Links a, b between distinct fingerprints with at most `most` differing bits: a spanning forest for each task."""

    def bucket_pairs(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
            yield from run_links(fps[s : s + n], most)
        part = np.repeat(sizes, sizes)
        keys, fps = keys[(part > 1) & (part <= small)], fps[(part > 1) & (part <= small)]
        for lag in range(1, small):
            if len(keys) <= lag:
                break
            near = (keys[lag:] == keys[:-lag]) & (np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= most)
            yield fps[:-lag][near], fps[lag:][near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, keys, fps = Forest(), np.empty(0, np.int64), np.empty(0, np.uint64)

        def emit(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            pairs = [(x, y) for a, b in bucket_pairs(keys, fps) for x, y in zip(a.tolist(), b.tolist()) if forest.joins(x, y)]
            a, b = (np.array([p[k] for p in pairs], np.uint64).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(keys) and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                yield emit(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield emit(keys, fps)

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fp, component_id (least doc_id that is reachable) for every row of `docs`."""
    fps = stage(fingerprints(docs, words))
    first = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")))
    # a fingerprint becomes some eighty keys, so they are dealt over all tasks however few bytes they are
    dealt = first.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    parts = components(links(bucketed(dealt), most))
    return named(fps, first, parts).select("doc_id", "fp", "component_id")


def named(fps: DataFrame, first: DataFrame, parts: DataFrame) -> DataFrame:
    """fps with component_id, the least doc_id of the linked fingerprints (node, root) or else of the fingerprint itself."""
    linked = parts.join(first, F.col("node") == F.col("fp")).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    names = first.join(linked.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "fp", "left")
    return join_names(fps, stage(names.select("fp", F.coalesce("component_id", "first").alias("component_id"), "times")), "fp")


def op9_simhash(spark, sf_dir) -> DataFrame:
    """The contract's columns for every document."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
