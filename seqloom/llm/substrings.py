"""Removal of repeated 200-byte strings by column-wise multi-document construction of a collection's BWT.

1. Every window of `length` bytes is named by its least `gram`-byte hash, the leftmost of equal ones (its anchor). Neighbouring windows
   with one anchor make a segment, which is cut out with all its bytes: equal windows lie in segments with equal anchors, at
   equal distances from them. Segments whose anchor occurs once can't hold a repeat and end here.
2. The segments of an anchor are a collection of short documents, aligned at the anchor. The construction goes over the
   columns from the right and inserts one symbol of every segment each round: the round's order is a stable
   partition of the last one by the inserted symbols, which are the BWT column of the last round, and the common prefixes
   are one more than the least in between, or 0. Each round's BWT column, order and common prefixes are appended to sequential files, of
   which the next round reads the end. Because of the alignment only suffixes of one round can share a window, so rounds are not
   merged with each other. At the end the files are read once: a window is a repeat if its suffix shares `length` bytes with a
   neighbour in its round's order. Of segments with equal 128-bit hashes two, of different places, are inserted; what the
   construction finds for these holds for all.
3. An anchor with more than `most` different segments is dealt out: its segments are cut into slices of fewer windows, which
   meet where the bytes that all windows of a slice share are equal, at last into single windows. The construction decides about these in the same way.
4. Repeated windows become byte spans of their documents, which are cut out of the texts.

Defined results: a null text is empty; texts shorter than `length` lose nothing; rows that repeat a doc_id are texts of their own;
an empty table gives an empty result. Cut texts are decoded with U+FFFD for bytes that are no longer UTF-8. Other columns pass through in deduplicated().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.arrow import blocks, ragged, text_bytes
from seqloom.llm.held import release
from seqloom.llm.rows import keeps_columns
from seqloom.sources import discard, read_table, stage

LENGTH, GRAM = 200, 32
#: at << 18 | windows << 9 | distance of the anchor from the start
PLACE = 9


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


BYTE_HASH = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the bytes at each position; gram is a power of two."""
    h, size = BYTE_HASH[data], 1
    while size < gram:
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + h[size:]
        size *= 2
    return _mix(h)


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` neighbours, the leftmost of equal ones, from running minima of blocks of that width."""
    n = len(keys) - width + 1
    full = np.concatenate((keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    start = np.arange(len(full))[:, None] * width
    column = np.arange(width)
    ahead = np.minimum.accumulate(full, axis=1)
    new = np.ones(full.shape, bool)
    new[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, column, 0), axis=1) + start
    turned = full[:, ::-1]
    back = np.minimum.accumulate(turned, axis=1)
    new = turned == back  # going left, an equal one is taken instead
    back_at = width - 1 - np.maximum.accumulate(np.where(new, column, 0), axis=1)[:, ::-1] + start
    back, ahead, back_at, ahead_at = back[:, ::-1].ravel()[:n], ahead.ravel()[width - 1 :][:n], back_at.ravel()[:n], ahead_at.ravel()[width - 1 :][:n]
    return np.where(back <= ahead, back_at, ahead_at)


def segments(raw: bytes, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of the documents that lie one after the other in `raw`: document, start, windows, anchor's distance, anchor's hash."""
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    least = least_in_windows(h, length - gram + 1)
    fits = sizes >= length
    owner = np.repeat(np.flatnonzero(fits), (sizes - length + 1)[fits])
    at = ragged(starts[fits], (sizes - length + 1)[fits])
    anchor = least[at]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))) if len(at) else none
    count = np.diff(np.append(first, len(at)))
    return owner[first], at[first], count, anchor[first] - at[first], h[anchor[first]]


def tag(text: bytes) -> bytes:
    """128 bits that tell apart texts that share a doc_id."""
    return xxhash.xxh3_128_digest(text)


def cut(docs: DataFrame, length: int, gram: int, chunk: int) -> DataFrame:
    """anchor, content (hashes), doc_id, tag, place of every segment of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(raw: bytes, starts: np.ndarray, sizes: np.ndarray, shift: int) -> tuple[np.ndarray, list]:
        owner, at, n, d, h = segments(raw, starts, sizes, length, gram)
        digest = xxhash.xxh3_128_digest
        content = pa.array([digest(raw[a:z]) for a, z in zip(at.tolist(), (at + n + length - 1).tolist())], pa.binary())
        place = ((at - starts[owner] + shift) << 2 * PLACE) | (n << PLACE) | d
        return owner, [pa.array(h.view(np.int64)), content, pa.array(place)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in blocks(batches, size=1 << 20):
            texts = text_bytes(b).to_pylist()
            tags = pa.array([tag(t) for t in texts], pa.binary())
            long = [i for i, t in enumerate(texts) if len(t) > chunk]
            sizes = np.array([0 if len(t) > chunk else len(t) for t in texts], np.int64)
            raw = b"".join(t for t in texts if len(t) <= chunk)
            found = [rows(raw, np.cumsum(sizes) - sizes, sizes, 0)]
            for i in long:  # in pieces that share length - 1 bytes
                for lo in range(0, len(texts[i]) - length + 1, chunk):
                    piece = texts[i][lo : lo + chunk + length - 1]
                    owner, cols = rows(piece, np.zeros(1, np.int64), np.array([len(piece)]), lo)
                    found.append((np.full(len(owner), i), cols))
            for owner, (h, content, place) in found:
                yield pa.RecordBatch.from_arrays([h, content, b.column(0).take(pa.array(owner)), tags.take(pa.array(owner)), place], ["anchor", "content", "doc_id", "tag", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, f"anchor long, content binary, doc_id {kind}, tag binary, place long")


class Columns:
    """Arrays of one round after the other in a sequential file of the task's own folder."""

    def __init__(self, kind: str) -> None:
        self.kind, self.file, self.size = np.dtype(kind), TemporaryFile(buffering=0), 0

    def write(self, values: np.ndarray) -> None:
        self.size = self.file.write(np.ascontiguousarray(values, self.kind).data)

    def last(self) -> np.ndarray:
        self.file.seek(-self.size, 2)
        return np.frombuffer(self.file.read(self.size), self.kind)

    def rounds(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while values := self.file.read(self.size):
            yield np.frombuffer(values, self.kind)

    def close(self) -> None:
        self.file.close()


def repeated_windows(group: np.ndarray, before: np.ndarray, windows: np.ndarray, bodies: list[bytes], length: int, width: int) -> np.ndarray:
    """Which windows repeat in the segments of the same group: a row of flags for each segment, by distance from the anchor.

    group: rising; before: bytes before the anchor, below `width`. Flag j of a row is the window that starts width - 1 - j bytes before it.
    """
    m = len(bodies)
    sizes = np.fromiter(map(len, bodies), np.int64, m)
    total = width - 1 + length
    table = np.full((total, m), 256, np.uint16)  # 256: outside of the segment
    column = ragged(width - 1 - before, sizes)
    table[column, np.repeat(np.arange(m), sizes)] = np.frombuffer(b"".join(bodies), np.uint8)
    group = group.astype(np.uint16 if m < 1 << 16 else np.int64)
    flags = np.zeros((m, width), bool)
    bwt, order, common = Columns("u2"), Columns("i4"), Columns("u2")
    try:
        bwt.write(table[total - 1])
        order.write(np.arange(m))
        common.write(np.zeros(m))
        for at in range(total - 1, -1, -1):
            symbols, old, shared = bwt.last(), order.last(), common.last()
            turn = np.argsort(symbols, kind="stable")
            turn = turn[np.argsort(group[old[turn]], kind="stable")]
            now, symbols = old[turn], symbols[turn]
            same = (symbols[1:] == symbols[:-1]) & (group[now[1:]] == group[now[:-1]]) & (symbols[1:] < 256)
            fresh = np.zeros(m, np.uint16)
            if same.any():
                ends = np.column_stack((turn[:-1][same] + 1, turn[1:][same] + 1)).ravel()
                fresh[1:][same] = np.minimum(np.minimum.reduceat(np.append(shared, 0).astype(np.uint16), ends)[::2], np.uint16(length)) + 1
            bwt.write(table[at - 1][now] if at else np.full(m, 256))
            order.write(now)
            common.write(fresh)
        for k, (now, shared) in enumerate(zip(order.rounds(), common.rounds())):
            at = total - k  # round 0 is the empty suffixes
            if at < width:
                full = shared >= length
                full[:-1] |= full[1:]
                start = width - 1 - at  # bytes before the anchor at which this column's windows start
                flags[now, at] = full & (before[now] >= start) & (start > before[now] - windows[now])
    finally:
        for f in (bwt, order, common):
            f.close()
    return flags


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of every run of set flags."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(edge == 1)
    return row, lo, np.nonzero(edge == -1)[1] - 1


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The columns of `wanted` (anchor, content, times, doc_id, tag, place) with before, windows and body (the segment's bytes) for its place."""
    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "content", "times", "place")).alias("parts"))
    lists = lists.select(F.col("doc_id").alias("i"), F.col("tag").alias("t"), "parts")
    # a text that stands twice under one doc_id is fetched once
    texts = tagged(docs).dropDuplicates(["doc_id", "tag"])
    joined = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t"))).select("body", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in blocks(batches, "body", 1 << 19):
            parts = b.column(1)
            flat, owner = parts.flatten(), np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(parts).to_numpy())
            place = flat.field("place").to_numpy()
            at, n = place >> 2 * PLACE, place >> PLACE & 511
            texts, bodies = {}, []
            for i, a, z in zip(owner.tolist(), at.tolist(), (at + n + length - 1).tolist()):
                if i not in texts:
                    texts = {i: unzip.decompress(b.column(0)[i].as_py())}
                bodies.append(texts[i][a:z])
            columns = [flat.field("anchor"), flat.field("content"), flat.field("times"), pa.array(place & 511), pa.array(n), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "times", "before", "windows", "body"])

    return joined.mapInArrow(run, "anchor long, content binary, times long, before long, windows long, body binary")


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag, body (the compressed text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in blocks(batches):
            texts = text_bytes(b).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tag(t) for t in texts], pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())], ["doc_id", "tag", "body"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tag binary, body binary")


def by_construction(segs: DataFrame, length: int, width: int, batch: int = 6000) -> DataFrame:
    """anchor, content, runs (lo, hi after lo, hi: bytes of the segment under repeated windows) of segments that have any, anchor by anchor.

    segs: anchor, content, before, windows, body; of each content one row, or two if it occurs more than once.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        anchor, content = table.column("anchor").to_numpy(), table.column("content").combine_chunks()
        group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
        before, windows = table.column("before").to_numpy(), table.column("windows").to_numpy()
        flags = repeated_windows(group, before, windows, table.column("body").to_pylist(), length, width)
        one = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | pa.compute.not_equal(content[1:], content[:-1]).to_numpy(zero_copy_only=False)))
        rows = np.flatnonzero(one)
        row, lo, hi = runs_of(flags[rows])
        zero = before[rows[row]] - (width - 1)  # byte of the first column
        cells = np.column_stack((zero + lo, zero + hi + length)).ravel().astype(np.int32)
        has, n = np.unique(row, return_counts=True)
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * n))), pa.int32()), pa.array(cells))
        return pa.RecordBatch.from_arrays([pa.array(anchor[rows[has]]), content.take(pa.array(rows[has])), runs], ["anchor", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                held.append(b.slice(lo, batch))
                rows += held[-1].num_rows
                last = held[-1].column(0)[-1].as_py()
                if rows >= batch and held[0].column(0)[0].as_py() != last:
                    table = pa.Table.from_batches(held)
                    n = int(np.searchsorted(table.column("anchor").to_numpy(), last))  # the last anchor may go on
                    yield solve(table.slice(0, n))
                    held = table.slice(n).to_batches()
                    rows -= n
        if rows:
            yield solve(pa.Table.from_batches(held))

    rows = segs.select("anchor", "content", "before", "windows", "body").repartition("anchor").sortWithinPartitions("anchor", "content")
    return rows.mapInArrow(run, "anchor long, content binary, runs array<int>")


def slices(segs: DataFrame, length: int, width: int) -> DataFrame:
    """The segments cut into slices of at most `width` windows: owner_anchor, owner_content, shift (bytes from the owner's start), and the columns of a
    segment, its anchor being a hash of the bytes that all windows of the slice share."""

    names = ["owner_anchor", "owner_content", "shift", "anchor", "content", "times", "before", "windows", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "body", 1 << 17):
            out: list[tuple] = []
            for i, (shift, anchor, before, windows, body) in enumerate(zip(*[b.column(c).to_pylist() for c in (2, 3, 6, 7, 8)])):
                for q in range((before - windows + 1) // width, before // width + 1):
                    far, near = min(before, (q + 1) * width - 1), max(before - windows + 1, q * width)
                    at, core = before - far, body[before - q * width : before - (q + 1) * width + 1 + length]
                    piece = body[at : before - near + length]
                    name = xxhash.xxh3_64_intdigest(core, (anchor * 31 + q) & ((1 << 64) - 1)) - (1 << 63)
                    out.append((i, shift + at, name, xxhash.xxh3_128_digest(piece), far - q * width, far - near + 1, piece))
            rows = pa.array([o[0] for o in out], pa.int64())
            made = [pa.array([o[k] for o in out], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()), (4, pa.int64()), (5, pa.int64()), (6, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *made[:3], b.column(5).take(rows), *made[3:]], names)

    kinds = "owner_anchor long, owner_content binary, shift long, anchor long, content binary, times long, before long, windows long, body binary"
    return segs.select(*names).mapInArrow(run, kinds)


def met(segs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The slices whose anchor occurs more than once, and the anchors (anchor) with more than `most` different slices."""
    names = segs.groupBy("anchor", "content").agg(F.sum("times").alias("times")).groupBy("anchor").agg(F.sum("times").alias("n"), F.count("*").alias("kinds"))
    names = stage(names.filter("n > 1"))
    return stage(segs.join(names.select("anchor"), "anchor", "left_semi")), names.filter(F.col("kinds") > most).select("anchor")


def pairs_of(segs: DataFrame) -> DataFrame:
    """One row of each content, two of those that occur more than once."""
    some = segs.groupBy("anchor", "content").agg(F.sum("times").alias("times"), F.min("before").alias("before"), F.min("windows").alias("windows"), F.min("body").alias("b0"), F.max("body").alias("b1"))
    return some.withColumn("body", F.explode(F.when(F.col("times") > 1, F.array("b0", "b1")).otherwise(F.array("b0")))).drop("b0", "b1", "times")


def dealt_out(hot: DataFrame, length: int, most: int, slice_windows: int) -> DataFrame:
    """by_construction for segments of anchors with very many of them, by slices and, where these are as many, by single windows."""
    own = hot.withColumns({"owner_anchor": F.col("anchor"), "owner_content": F.col("content"), "shift": F.lit(0).cast("long")})
    parts, large = met(slices(own, length, slice_windows), most)
    single, _ = met(slices(parts.join(large, "anchor", "left_semi"), length, 1), most)
    out = None
    for segs, width in ((parts.join(large, "anchor", "left_anti"), slice_windows), (single, 1)):
        runs = by_construction(pairs_of(segs), length, width)
        moved = F.transform("runs", lambda x: x + F.col("shift").cast("int"))
        rows = segs.select("owner_anchor", "owner_content", "shift", "anchor", "content").join(runs, ["anchor", "content"]).select(F.col("owner_anchor").alias("anchor"), F.col("owner_content").alias("content"), moved.alias("runs"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("anchor", "content").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # at most two numbers a window


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = 2000, chunk: int = 8 << 20, slice_windows: int = 16) -> DataFrame:
    """doc_id, tag, spans (lo, hi after lo, hi: bytes of the text that are covered by repeated windows) of each segment; spans may overlap."""
    all_segments = stage(cut(docs, length, gram, chunk))
    # a table of its own, so that a common anchor's rows can be split in the join
    anchors = stage(all_segments.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    found = stage(all_segments.join(anchors.select("anchor"), "anchor"))
    discard(all_segments)
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tag", "place")
    contents = stage(found.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(place).alias("r"), F.max(place).alias("z")))
    large = stage(contents.groupBy("anchor").count().filter(F.col("count") > most).select("anchor"))
    wanted = contents.withColumn("r", F.explode(F.when(F.col("times") > 1, F.array("r", "z")).otherwise(F.array("r"))))
    fetched = fetch(docs, wanted.select("anchor", "content", "times", "r.doc_id", "r.tag", "r.place"), length)
    if large.isEmpty():
        runs = by_construction(fetched, length, length - gram + 1)
    else:
        fetched = stage(fetched)
        hot = fetched.join(large, "anchor", "left_semi").dropDuplicates(["anchor", "content"])
        runs = by_construction(fetched.join(large, "anchor", "left_anti"), length, length - gram + 1).union(dealt_out(hot, length, most, slice_windows))
    runs = stage(runs)
    shifted = F.transform("runs", lambda x: F.shiftright("place", 2 * PLACE) + x)
    out = stage(found.join(runs, ["anchor", "content"]).select("doc_id", "tag", shifted.alias("spans")))
    discard(found)
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as rising spans that don't touch."""
    turn = np.argsort(lo, kind="stable")
    lo, hi = lo[turn], np.maximum.accumulate(hi[turn])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def kept(text: bytes, packed: list[int] | None) -> tuple[bytes, int, int]:
    """What is left of a text without its spans (lo, hi after lo, hi), the bytes that go and the number of runs."""
    if not packed:
        return text, 0, 0
    lo, hi = merged(np.array(packed[::2], np.int64), np.array(packed[1::2], np.int64))
    pieces = [text[a:z] for a, z in zip([0, *hi.tolist()], [*lo.tolist(), len(text)])]
    return b"".join(pieces), int((hi - lo).sum()), len(lo)


def span_lists(docs: DataFrame, **options) -> DataFrame:
    """_cut_id, _cut_tag, _cut_spans: the spans of each text in one list, as long as its text at most: rows of equal doc_id and text have equal spans, which count once."""
    lists = spans(docs, **options).groupBy("doc_id", "tag").agg(F.flatten(F.collect_set("spans")).alias("_cut_spans"))
    return lists.select(F.col("doc_id").alias("_cut_id"), F.col("tag").alias("_cut_tag"), "_cut_spans")


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`."""
    lists = span_lists(docs, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = tagged(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("_cut_id")) & (F.col("tag") == F.col("_cut_tag")), "left").select("doc_id", "body", "_cut_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in blocks(batches, "body", 1 << 19):
            out = []
            for body, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = unzip.decompress(body)
                left, removed, n = kept(text, packed)
                out.append((len(text), removed, n, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@keeps_columns
def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with repeated bytes cut out of their texts; null texts stay null."""
    lists, names = span_lists(docs, **options), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            at = b.schema.get_field_index("text")
            texts = [t if t is None or not s else kept(t.encode(), s)[0].decode("utf-8", "replace") for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names)

    rows = docs.mapInArrow(_tag_rows, docs.select("*", F.lit(b"").alias("_own_tag")).schema)
    rows = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_cut_id")) & (F.col("_own_tag") == F.col("_cut_tag")), "left").select(*names, "_cut_spans")
    return rows.mapInArrow(run, docs.schema)


def _tag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([tag(t) for t in text_bytes(b).to_pylist()], pa.binary())], [*b.schema.names, "_own_tag"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return digests(read_table(spark, sf_dir, "documents"))
