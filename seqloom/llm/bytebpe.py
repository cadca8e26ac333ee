"""Byte-level BPE: pre-tokens, a backtracking encoder that is exact in linear time, and a decoder by offset table.

The encoder takes the longest token at a position (Aho-Corasick), keeps it if it is compatible with the token before
and falls back to shorter tokens, then to earlier positions; a position that was left is not tried again. Two tokens
are compatible if the merges would produce just them from their joined bytes; the answers make a pair table.

Texts are cut at single spaces between other characters, where no pre-token can span, and each distinct piece is encoded once per worker while it stays
in a bounded cache. Python workers share nothing else, so a lost executor only loses its cache.

Defined results: a null or empty text has no tokens; special strings in a text are one token, as the library has it;
rows that repeat are encoded alike; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.arrow import blocks, ragged, text_bytes
from seqloom.llm.held import held
from seqloom.sources import read_table

# fixed values: the white space of the pre-tokenizer and its pattern
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def simple(text: str) -> bool:
    """No space of the text stands beside another white-space character."""
    return not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACE))


class Cached(dict):
    """piece -> value, two generations of at most `most` entries; `find` computes what neither has."""

    def __init__(self, find: Callable[[str], bytes], most: int = 200_000) -> None:
        super().__init__()
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.find(piece)
        self.put(piece, value)
        return value

    def put(self, piece: str, value: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = value


def byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(chars.__getitem__, token)) if all(c in chars for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.split_special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        plain = {i: b for i, b in enumerate(self.bytes) if b and i not in self.special.values()}
        self.ids = {b: i for i, b in plain.items()}
        self.born, self.halves, self.rank = [-1] * size, [(i, i) for i in range(size)], {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = r
            if self.born[whole] < 0:
                self.born[whole], self.halves[whole] = r, (a, b)
        self.find = ahocorasick.Automaton()
        for i, b in plain.items():
            self.find.add_word(b.decode("latin-1"), i)
        self.find.make_automaton()
        self.shorter, self.under = [-1] * size, {}  # the longest token that starts a token, or a state of the automaton's trie
        for b, i in self.ids.items():
            text, last = b.decode("latin-1"), -1
            for n in range(1, len(b)):
                last = self.ids.get(b[:n], last)
                self.under[text[:n]] = last
            self.shorter[i], self.under[text] = last, i
        self.fits: dict[int, bool] = {}
        self.cache = Cached(lambda piece: self.pieces(" " + piece))
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.lengths, self.offsets = lengths, np.cumsum(lengths) - lengths
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.decimal = np.array([b"%d," % i for i in range(size)])

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of two tokens: their merges are undone, the latest first, and at each
        state of the border its pair must not have merged before the part that was undone last came to be."""
        known = self.fits.get(a << 32 | b)
        if known is not None:
            return known
        x, y, before, out = a, b, len(self.rank), True
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < before:
                out = False
                break
            if self.born[x] > self.born[y]:  # x came last; a pair of the same rank to its right would come later
                before, x = self.born[x], self.halves[x][1]
            elif self.born[y] >= 0:  # y came last, or after an equal pair on its left
                before, y = self.born[y] + 1, self.halves[y][0]
            else:
                break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a << 32 | b] = out
        return out

    def word(self, word: bytes) -> list[int]:
        """Token ids of one pre-token. The look-ups stand in the loop itself, which is nearly all work of new words, and the automaton is asked only at places that a token starts at."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        sizes, n, known, shorter = self.lengths_list, len(word), self.fits.get, self.shorter
        text, reach, under = word.decode("latin-1"), self.find.longest_prefix, self.under
        out: list[int] = []
        left = bytearray(n + 1)
        at, token, before = 0, under[text[: reach(text)]], -1
        while True:
            end = at + sizes[token]
            if left[end]:
                fits = False
            elif before < 0:
                fits = True
            elif (fits := known(before << 32 | token)) is None:
                fits = self.compatible(before, token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, before, rest = end, token, text[end:]
                token = under[rest[: reach(rest)]]
            else:
                less = shorter[token]
                if less >= 0:
                    token = less
                else:
                    left[at] = 1
                    token = out.pop()
                    before = out[-1] if out else -1
                    at -= sizes[token]

    @property
    def lengths_list(self) -> list[int]:
        if not hasattr(self, "_lengths"):
            self._lengths = self.lengths.tolist()
        return self._lengths

    def pieces(self, text: str) -> bytes:
        """Ids of a text without special strings, as raw numbers of self.kind."""
        ids, whole = [], self.ids.get
        for p in PIECES.findall(text):
            p = p.encode()
            if (i := whole(p)) is None:
                ids += self.word(p)
            else:
                ids.append(i)
        return array(self.kind.char, ids).tobytes()

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if not simple(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        return self.pieces(first) + b"".join(map(self.cache.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if any(s in text for s in self.special):
            parts = self.split_special.split(text)
            raw = b"".join(np.array([self.special[p]], self.kind).tobytes() if p in self.special else self.plain(p) for p in parts if p)
        else:
            raw = self.plain(text)
        return np.frombuffer(raw, self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' bytes, taken from one table by offset and length."""
        return self.joined[ragged(self.offsets[ids], self.lengths[ids])].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        return self.decimal[ids].tobytes().translate(None, b"\0")[:-1]


def load(path: str) -> Bpe:
    """The tables of a file, once a worker while no other step needs it."""
    return held(("bytebpe", path), lambda: Bpe(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), exact (the decoded ids give the text) for every row."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in blocks(batches, size=1 << 20):
            texts = text_bytes(b).to_pylist()
            ids = [bpe.encode(t.decode()) for t in texts]
            sizes = np.array([len(i) for i in ids], np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            exact = pa.array([bpe.decode(i) == t for i, t in zip(ids, texts)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32))), exact], ["doc_id", "n_tokens", "ids", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, exact boolean")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digest of encoded(), taken where the ids are made."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in blocks(batches, size=1 << 20):
            rows = []
            for t in text_bytes(b).to_pylist():
                ids = bpe.encode(t.decode())
                text = bpe.decode(ids).decode("utf-8", "replace").encode()
                rows.append((len(ids), hashlib.sha256(bpe.decimals(ids)).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return round_trip(read_table(spark, sf_dir, "documents"))
