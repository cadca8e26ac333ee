"""Token files: frequency-ranked ids in byte-aligned coding with separate control bytes, in ascending doc_id order.

Ids are replaced by their frequency rank over the whole corpus and stored in one byte or more; a control stream holds
each one's length. A control byte speaks for eight values where two bytes are the most, else for four. It is decoded
by one look-up of all its lengths, and the values are gathered with numpy.

The corpus goes through one shuffle, by ranges of doc_id, then is encoded range by range; the ids are kept in the shared folder while
frequencies are summed, and are then written as one file a range. A file is written under a name of its attempt, and only the
manifest of the tasks that succeeded says which files count, so lost executors and repeated tasks leave no trace.

File: blocks one after the other, each of a little-endian header (magic, documents, tokens, bytes of data; four uint64),
then doc_id int64 and null flag byte and token count uint32 of each document, control bytes, data bytes. The rank table (id by rank,
uint32) is a file beside them.

Defined results: a null or empty text has only the end id; rows that repeat a doc_id stand in the order of their text's hash; null
doc_ids come first; an empty table gives no file and an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.arrow import blocks, text_bytes
from seqloom.llm.bytebpe import byte_chars, default_path, simple
from seqloom.llm.held import held
from seqloom.llm.ordered import range_bounds, range_parts
from seqloom.sources import read_table, stage, work_dir

MAGIC = int.from_bytes(b"SLTOKEN1", "little")
BLOCK = 1 << 20


class Kept:
    """key -> ids, in two generations of about `most` entries: what is still in use moves to the newer one."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def find(self, keys: pa.Array, compute: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """The ids of each key, null for null; `compute` is asked for the distinct ones that aren't kept."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        keys = keys.dictionary_encode()
        names, new, old = keys.dictionary.to_pylist(), self.new, self.old
        lacking = []
        for k in names:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    lacking.append(k)
        new.update(zip(lacking, compute(lacking)))
        return pa.array([new[k] for k in names], pa.large_binary()).take(keys.indices)


class Library:
    """The tokenizers library over whole texts, with the results of distinct words and pieces kept.

    A text is cut at single spaces and line feeds between other characters, where the pre-tokenizer always cuts, and a piece of letters and
    punctuation between the two. These words and marks are pre-tokens and go to the library's model, which is less work than a
    call for a text; other new pieces are encoded by the whole tokenizer in lines of many, with a line feed between them, which it makes a token of its own.
    Arrow cuts the texts of a batch, tells their pieces apart and puts the ids together, so that only distinct words of a batch are looked up one by one.
    """

    #: fixed values: letters and punctuation between which the pre-tokenizer always cuts, after a line feed or a space that was cut off
    PARTS = r"\A\n?(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-/:-@\[-`{-~]*)\z"

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        [self.line] = self.tok.encode("\n", add_special_tokens=False).ids
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.chars = {b: c for c, b in byte_chars().items()}
        self.words, self.others = Kept(most), Kept(most // 4)

    def ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def in_lines(self, pieces: list[str], line: int = 1000) -> list[bytes]:
        """Ids of pieces without a line feed, each as after one."""
        lines = [pieces[i : i + line] for i in range(0, len(pieces), line)]
        found = self.tok.encode_batch_fast(["\n".join([*x, ""]) for x in lines], add_special_tokens=False)
        out: list[bytes] = []
        for words, enc in zip(lines, found):
            ids = np.array(enc.ids, self.kind)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(words):
                raise ValueError("a piece was not cut from its line")
            raw, step = ids.tobytes(), self.kind.itemsize
            ends = (ends * step).tolist()
            out += [raw[a:z] for a, z in zip([0, *[e + step for e in ends[:-1]]], ends)]
        return out

    def pre_tokens(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens without a line feed, by the model alone."""
        if not words:
            return []
        tokenize, ids, ends = self.tok.model.tokenize, array("HI"[self.kind.itemsize // 4]), [0]
        for w in "\n".join(words).encode().decode("latin-1").translate(self.chars).split(self.chars[10]):
            ids.extend([t.id for t in tokenize(w)])
            ends.append(len(ids))
        raw, step = ids.tobytes(), self.kind.itemsize
        return [raw[a * step : z * step] for a, z in zip(ends, ends[1:])]

    def pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces: one that starts with a line feed as it is, others after a space."""
        parts = pc.extract_regex(pieces, self.PARTS)
        word, mark = (pc.struct_field(parts, k) for k in ("word", "mark"))
        text, raw = pa.large_string(), pa.large_binary()
        lined = pc.starts_with(pieces, "\n")
        line = pa.scalar(np.array([self.line], self.kind).tobytes(), raw)
        before = pc.if_else(lined, line, pa.scalar(b"", raw))
        spaced = pc.binary_join_element_wise(pc.if_else(lined, pa.scalar("", text), pa.scalar(" ", text)), word, pa.scalar("", text))
        found = [before, self.words.find(spaced, self.pre_tokens), self.words.find(mark, self.pre_tokens)]
        whole = pc.binary_join_element_wise(*found, pa.scalar(b"", raw))
        other = pc.is_null(whole)
        if not pc.any(other).as_py():
            return whole
        rest = pieces.filter(other)
        ids = self.others.find(rest, lambda new: self.in_lines([p[1:] if p[0] == "\n" else " " + p for p in new]))
        return pc.replace_with_mask(whole, other, pc.binary_join_element_wise(before.filter(other), ids, pa.scalar(b"", raw)))

    def cuts(self, text: str) -> bool:
        """Whether all white space of a text is so simple that it can be cut there."""
        return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and "\n\n" not in text and simple(text) and not any(s in text for s in self.special)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [i for i, t in enumerate(texts) if self.cuts(t)]
        out = [None] * len(texts)
        if cut:
            # as after a line feed, whose id goes again
            cells = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in cut], pa.large_string()), " ")
            pieces = cells.values.dictionary_encode()
            raw = self.pieces(pieces.dictionary).take(pieces.indices)
            starts, step = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1), self.kind.itemsize
            flat, ends = np.frombuffer(raw.buffers()[2], self.kind), (starts[cells.offsets.to_numpy()] // step).tolist()
            for i, a, z in zip(cut, ends, ends[1:]):
                out[i] = flat[a + 1 : z]
        return [np.frombuffer(self.ids(t), self.kind) if o is None else o for o, t in zip(out, texts)]


def load(path: str) -> Library:
    return held(("token_files", path), lambda: Library(path))


def control_table(bits: int) -> np.ndarray:
    """For every control byte the lengths of the values that it speaks for."""
    return (np.arange(256)[:, None] >> (np.arange(8 // bits) * bits) & ((1 << bits) - 1)) + 1


def control_bits(vocabulary: int) -> int:
    return 1 if vocabulary <= 1 << 16 else 2


def pack(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control and data bytes of the values."""
    values = ranks.astype(np.uint32)
    sizes = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    per = 8 // bits
    lengths = np.zeros(-(-len(values) // per) * per, np.uint8)
    lengths[: len(values)] = sizes - 1
    control = (lengths.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * np.uint8(bits))).sum(axis=1).astype(np.uint8)
    at = np.cumsum(sizes) - sizes
    data = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > k
        data[at[has] + k] = (values[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The n values of a block."""
    sizes = control_table(bits)[control].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    out = np.zeros(n, np.uint32)
    for k in range(int(sizes.max()) if n else 0):
        has = sizes > k
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encoded_ranges(docs: DataFrame, path: str, end_id: int, parts: int) -> DataFrame:
    """part, at (place in the part), doc_id, ids (compressed), kept in the shared folder in the order of doc_id."""
    bounds = range_bounds(docs.select("doc_id"), "doc_id", parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in blocks(batches):
            body = pa.array([press.compress(t) for t in text_bytes(b).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range_parts(b.column(0), bounds)), b.column(2), body], ["doc_id", "part", "tie", "body"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).mapInArrow(deal, "doc_id long, part int, tie long, body binary")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "tie").select("part", "doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, unzip, press = load(path), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        part, at = None, 0
        for b in blocks(batches, "body", 3 << 20):
            places = []
            for p in b.column(0).to_pylist():
                part, at = p, at + 1 if p == part else 0
                places.append(at)
            texts = [unzip.decompress(t).decode() for t in b.column(2).to_pylist()]
            ids = [press.compress(np.append(i, lib.kind.type(end_id)).tobytes()) for i in lib.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int64()), b.column(1), pa.array(ids, pa.binary())], ["part", "at", "doc_id", "ids"])

    return stage(rows.mapInArrow(run, "part int, at long, doc_id long, ids binary"), "uncompressed")


def rank_table(kept: DataFrame, kind: np.dtype, vocabulary: int) -> np.ndarray:
    """Ids by falling frequency, ties by id; one row an id at most reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, unzip, held, size = np.zeros(vocabulary, np.int64), zstandard.ZstdDecompressor(), [], 0
        for b in batches:
            for ids in b.column(0).to_pylist():
                held.append(unzip.decompress(ids))
                size += len(held[-1])
                if size > BLOCK:  # a count costs as much as the vocabulary is long, so not for every document
                    n += np.bincount(np.frombuffer(b"".join(held), kind), minlength=vocabulary)
                    held, size = [], 0
        n += np.bincount(np.frombuffer(b"".join(held), kind), minlength=vocabulary)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["id", "n"])

    found = kept.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return np.lexsort((np.arange(vocabulary), -counts)).astype(np.uint32)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Write the token files of `docs` into `folder`. Manifest: number, file, documents, tokens, start (tokens before it)."""
    spark = docs.sparkSession
    path = path or default_path()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = encoded_ranges(docs, path, end_id, parts)
    lib = load(path)
    vocabulary = max(lib.tok.get_vocab_size(), end_id + 1)
    table, kind = rank_table(kept, lib.kind, vocabulary), lib.kind
    store, place = filesystem(folder)
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/ranks") as out:
        out.write(table.astype("<u4").tobytes())
    bits = control_bits(vocabulary)
    rank = np.empty(vocabulary, np.uint32)
    rank[table] = np.arange(vocabulary, dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        unzip = zstandard.ZstdDecompressor()
        part, following, first, name, out, rows, held = None, 0, 0, "", None, [], []
        documents = tokens = size = 0

        def flush() -> None:
            nonlocal documents, tokens
            if held:
                flat = np.concatenate([h[1] for h in held])
                control, data = pack(sent.value[flat], bits)
                out.write(np.array([MAGIC, len(held), len(flat), len(data)], "<u8").tobytes())
                out.write(np.array([h[0] or 0 for h in held], "<i8").tobytes() + bytes(h[0] is None for h in held) + np.array([len(h[1]) for h in held], "<u4").tobytes())
                out.write(control)
                out.write(data)
                documents, tokens = documents + len(held), tokens + len(flat)
                held.clear()

        def close() -> None:
            nonlocal documents, tokens
            if out:
                flush()
                out.close()
                rows.append((part, first, name, documents, tokens))
                documents = tokens = 0

        for b in batches:
            for p, at, doc_id, ids in zip(*[c.to_pylist() for c in b.columns]):
                if (p, at) != (part, following):  # a task may get several parts, or some of one
                    close()
                    part, first, name, size = p, at, f"part-{p:05d}-{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(f"{place}/{name}")
                following = at + 1
                held.append((doc_id, np.frombuffer(unzip.decompress(ids), kind)))
                size += len(held[-1][1])
                if size >= BLOCK:
                    flush()
                    size = 0
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "first", "file", "documents", "tokens"])

    manifest = kept.mapInArrow(run, "part int, first long, file string, documents long, tokens long").collect()  # one row a file
    start, rows = 0, []
    for r in sorted(manifest, key=lambda r: (r["part"], r["first"])):
        rows.append((len(rows), r["file"], r["documents"], r["tokens"], start))
        start += r["tokens"]
    return spark.createDataFrame(rows, "number int, file string, documents long, tokens long, start long")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        with store.open_input_stream(f"{place}/ranks") as f:
            table = np.frombuffer(f.read(), "<u4")
        bits = control_bits(len(table))
        for b in batches:
            for name, start in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "start")]):
                with store.open_input_stream(f"{place}/{name}") as f:
                    while head := f.read(32):
                        magic, documents, tokens, size = np.frombuffer(head, "<u8").tolist()
                        if magic != MAGIC:
                            raise ValueError(f"{name} is not a token file")
                        doc_ids, missing = np.frombuffer(f.read(8 * documents), "<i8"), np.frombuffer(f.read(documents), np.uint8)
                        lengths = np.frombuffer(f.read(4 * documents), "<u4").astype(np.int64)
                        control = np.frombuffer(f.read(-(-tokens * bits // 8)), np.uint8)
                        ids = table[unpack(control, np.frombuffer(f.read(size), np.uint8), tokens, bits)]
                        ends = np.cumsum(lengths)
                        crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip((ends - lengths).tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=missing.astype(bool)), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += tokens

    return manifest.repartitionById(max(1, manifest.count()), F.col("number")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, read back from the files."""
    folder = work_dir(spark)
    return read(spark, folder, write(read_table(spark, sf_dir, "documents"), folder))
