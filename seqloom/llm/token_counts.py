"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens that no piece of the vocabulary spans. The distinct pre-tokens of a batch lie one
after the other in one array of symbols. In each round every pre-token finds its pair of lowest rank, the leftmost of
equal ones, and all pre-tokens merge theirs at once; ranks are looked up again only beside the merged symbols. A
pre-token that has no pair left is counted: a symbol is one token, an unknown character one for each of its bytes.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings in a text are ordinary text, as the
library has it; rows that repeat are counted alike; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.arrow import blocks, text_bytes
from seqloom.llm.held import held
from seqloom.sources import read_table

GAP = "▁"
NONE = np.int64(1) << 40


class Merges:
    """Symbols and pair ranks of a sentence-piece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback, a leading space and no other normalisation are counted")
        # 1: ordinary pieces; those of other types never come from merges
        score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(re.search(f"[^{GAP}]{GAP}", p) for p in score):
            raise ValueError("a piece spans the start of a word")
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.known = {p: i for i, p in enumerate(score)}
        self.single: dict[str, int] = {c: i for c, i in self.known.items() if len(c) == 1}
        for c in sorted({c for p in score for c in p} - set(self.single)):  # only inside pieces
            self.single[c] = len(self.known) + len(self.single)
        symbol = self.single | self.known
        self.size = max(symbol.values()) + 2  # the last symbol: unknown
        pairs = sorted((symbol[p[:k]] * self.size + symbol[p[k:]], levels[s], self.known[p]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.keys, self.ranks, self.merged = (np.array([p[k] for p in pairs], np.int64) for k in range(3))
        self.counts: dict[str, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it does not merge) and its place in the table."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE), at

    def count(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token (none is empty)."""
        flat = "".join(words)
        chars = {c: self.single.get(c, self.size - 1) for c in set(flat)}
        weight = {c: 1 if c in self.known else len(c.encode()) for c in chars}
        codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        uniq, inverse = np.unique(codes, return_inverse=True)
        sym = np.array([chars[chr(c)] for c in uniq], np.int64)[inverse]
        cost = np.array([weight[chr(c)] for c in uniq], np.int64)[inverse]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        out = np.zeros(len(words), np.int64)
        # rank of the pair that starts at each symbol; the last symbol of a pre-token starts none
        ranks = np.full(len(sym), NONE)
        if len(sym) > 1:
            inner = owner[1:] == owner[:-1]
            ranks[:-1][inner] = self.rank(sym[:-1][inner], sym[1:][inner])[0]
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            width = len(sym).bit_length()
            best = np.minimum.reduceat(ranks << width | np.arange(len(sym)), starts)
            open_ = best >> width < NONE
            at = (best & ((1 << width) - 1))[open_]
            if not open_.all():  # these are merged to the end
                sizes = np.diff(np.append(starts, len(sym)))
                out[owner[starts[~open_]]] = np.add.reduceat(cost, starts)[~open_]
                stays = np.repeat(open_, sizes)
                at = (np.cumsum(stays) - 1)[at]
                sym, cost, owner, ranks = sym[stays], cost[stays], owner[stays], ranks[stays]
            if not len(at):
                break
            sym[at] = self.merged[self.rank(sym[at], sym[at + 1])[1]]
            cost[at] = 1
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # one symbol has gone in every pre-token before
            sym, cost, owner, ranks = sym[stays], cost[stays], owner[stays], ranks[stays]
            for first in (at, at[at > 0] - 1):
                first = first[first + 1 < len(sym)]
                inner = owner[first] == owner[first + 1]
                ranks[first[~inner]] = NONE
                first = first[inner]
                ranks[first] = self.rank(sym[first], sym[first + 1])[0]
            ranks[at[at + 1 == len(sym)]] = NONE
        return out


def pre_tokens(text: str) -> list[str]:
    """The words of a text, each with the spaces before it, and what spaces are left."""
    return re.findall(f"{GAP}*[^{GAP}]+|{GAP}+", GAP + text.replace(" ", GAP)) if text else []


def split(text: str) -> tuple[bool, list[str]]:
    """Pre-tokens of a text; True if all of them lack the one space that starts them."""
    if not text:
        return False, []
    if "  " in text or text[0] == " " or text[-1] == " " or GAP in text:
        return False, pre_tokens(text)
    return True, text.split(" ")


def batch_counts(texts: list[str], merges: Merges, most: int = 500_000) -> list[int]:
    """Tokens of each text; counts of pre-tokens are kept for the next batches, at most `most` of them."""
    known = merges.counts
    # a pre-token that lacks its space is kept under its own name, others under a name that starts with a space
    named = [words if bare else [" " + w for w in words] for bare, words in map(split, texts)]
    new = [w for w in dict.fromkeys(w for words in named for w in words) if w not in known]
    if len(known) + len(new) > most:
        known.clear()
        new = list(dict.fromkeys(w for words in named for w in words))
    for lo in range(0, len(new), 20_000):
        some = new[lo : lo + 20_000]
        known.update(zip(some, merges.count([w[1:] if w[0] == " " else GAP + w for w in some]).tolist()))
    return [sum(map(known.__getitem__, words)) for words in named]


def load(path: str) -> Merges:
    return held(("token_counts", path), lambda: Merges(path))


def counted(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(path)
        for b in blocks(batches):
            raw = text_bytes(b)
            n = pa.array(batch_counts(raw.cast(pa.large_string()).to_pylist(), merges), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(raw), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return counted(read_table(spark, sf_dir, "documents"))
