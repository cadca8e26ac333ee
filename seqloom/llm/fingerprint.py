"""Document fingerprints from Lempel-Ziv phrases, and how they change under an edit.

A text is parsed into dictionary phrases: each is the shortest string from its position that was no phrase before. The
set of phrases is hashed, and the least hash in each of `bins` equal parts of the hash range, cut to 16 bits, makes the signature (0:
no phrase in that part). The likeness of two signatures is the share of equal parts among those that either fills: an estimate of the
Jaccard index of the phrase sets, which like a compressor sees what two texts have in common.

Defined results: a null text is empty; empty texts have an all-zero fingerprint, like only one another (1.0); the text
after the last is the first; rows that repeat a doc_id are ordered by their text's hash; null doc_ids come first; an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.arrow import blocks, text_bytes
from seqloom.llm.ordered import part_before, range_bounds, range_parts
from seqloom.sources import read_table

BASE = 0x9E3779B97F4A7C15
BINS = 128


def parse(text: str, at: int, seen: set[str], typical: int = 5) -> tuple[int, list[int]]:
    """Add the phrases of text[at:] to `seen`; where the last one ends, and the start of each. What is left is a known phrase.

    Every prefix of a phrase is a phrase, so the search for a phrase's length starts at the length of the one before.
    """
    n, starts, size = len(text), [], typical
    add, note = seen.add, starts.append
    while at < n:
        piece = text[at : at + size]
        if piece in seen:
            while piece in seen and at + size < n:
                size += 1
                piece = text[at : at + size]
            if piece in seen:
                break
        else:
            size = len(piece)
            while size > 1 and (less := text[at : at + size - 1]) not in seen:
                piece, size = less, size - 1
        add(piece)
        note(at)
        at += size
    return at, starts


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0..n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 16, 2 * n)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            _POWERS[k:] = [np.cumprod(row, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def phrase_hashes(text: str, starts: list[int], end: int) -> np.ndarray:
    """A 64-bit hash of each phrase from its own code points: the same wherever it stands."""
    if not starts:
        return np.empty(0, np.uint64)
    low = starts[0]
    codes = np.frombuffer(text[low:end].encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    up, down = powers(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)))
    at = np.append(np.array(starts, np.int64), end) - low
    h = (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least hash of each of `bins` parts of the range, as 16 bits that are not 0; 0 where there is none."""
    out = np.zeros(bins, np.uint16)
    if len(hashes):
        part = np.sort(hashes)
        width = 64 - (bins.bit_length() - 1)
        at = np.searchsorted(part, np.arange(bins, dtype=np.uint64) << np.uint64(width))
        least = part[np.minimum(at, len(part) - 1)]
        full = (at < len(part)) & (least >> np.uint64(width) == np.arange(bins, dtype=np.uint64))
        out[full] = np.maximum(least[full] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = int(np.count_nonzero(a | b))
    return float(np.count_nonzero((a == b) & (a != 0)) / filled) if filled else 1.0


class Parsed:
    """A text's signature, and the parse of what stays of it when its last quarter is replaced."""

    def __init__(self, text: str) -> None:
        self.text, seen = text, set()
        self.stays = len(text) - len(text) // 4
        self.at, starts = parse(text[: self.stays], 0, seen)
        self.seen = seen.copy()
        self.hashes = phrase_hashes(text, starts, self.at)
        end, starts = parse(text, self.at, seen)
        self.signature = signature(np.concatenate((self.hashes, phrase_hashes(text, starts, end))))

    def edited(self, follower: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by the start of another, and that text's signature."""
        text = self.text[: self.stays] + follower[: len(self.text) // 4]
        end, starts = parse(text, self.at, self.seen)
        return text, signature(np.concatenate((self.hashes, phrase_hashes(text, starts, end))))


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    """Four hex digits for each part of the signature."""
    return hexed(Parsed(text).signature)


def packed(docs: DataFrame) -> DataFrame:
    """The rows with `text` replaced by `body`, its compressed UTF-8, for a smaller shuffle."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in blocks(batches):
            body = pa.array([press.compress(t) for t in text_bytes(b).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], body], [*rest, "body"])

    return docs.mapInArrow(run, docs.select(*rest, F.lit(b"").alias("body")).schema)


def with_followers(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, part, order, tie, body. Rows with the id that opens a part are also sent to the part before it, with order 1.

    Sorted by part, order, doc_id and tie, the row after a row of order 0 is its follower, and the one after the last row is the first.
    """
    bounds = range_bounds(docs.select("doc_id"), "doc_id", parts)
    before = part_before(docs, "doc_id", bounds)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in blocks(batches):
            body = pa.array([press.compress(t) for t in text_bytes(b).to_pylist()], pa.binary())
            n, part = b.num_rows, range_parts(b.column(0), bounds)
            sent = [(i, before[v]) for i, v in enumerate(b.column(0).to_pylist()) if v in before]
            take = pa.array([*range(n), *[i for i, _ in sent]], pa.int64())
            part = np.concatenate((part, np.array([p for _, p in sent], np.int32)))
            order = np.repeat(np.array([0, 1], np.int32), [n, len(sent)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(part), pa.array(order), b.column(2).take(take), body.take(take)], ["doc_id", "part", "order", "tie", "body"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, f"doc_id {kind}, part int, order int, tie long, body binary")


def edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of `docs`."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_followers(docs, parts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "order", F.asc_nulls_first("doc_id"), "tie")
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, unpack = None, zstandard.ZstdDecompressor()
        before: tuple | None = None
        for big in batches:
            schema = schema or pa.schema([(n, t) for n, t in zip(names, (big.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))])
            for b in blocks([big], "body", 1 << 20):
                out = []
                for i, body, order in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "body", "order")]):
                    if before is None and order:
                        continue  # a second row with the opening id
                    now = Parsed(unpack.decompress(body).decode())
                    if before is not None:
                        old_id, old = before
                        text, sig = old.edited(now.text)
                        out.append((old_id, len(old.text), hashlib.sha256(text.encode()).hexdigest(), hexed(old.signature), hexed(sig), likeness(old.signature, sig), likeness(old.signature, now.signature)))
                    before = None if order else (i, now)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return edits(read_table(spark, sf_dir, "documents"))
