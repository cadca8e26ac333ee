"""Language of words and documents with a linear-chain conditional random field.

A word's features are its affixes and inner n-grams (hashed) and its place in a lexicon of frequent words of the
labelled sample. Transitions between the languages of neighbouring words are learned with them. Words are labelled by
forward-backward over runs of at most `span` words, so code-switched text gets a language for each word; a document's
language is the one with the most posterior words, its score the share of these words.

The field is fitted on a bounded sample of labelled documents: `per_label` of each label in expectation, drawn by a hash of
the id and the text, and twice as many at most. Half of them are cut into pieces that are joined across languages, so the
transitions learn switches. Gradients are summed over Spark partitions in every step. Prediction covers all words of all texts.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled row all are `und`;
ties go to the label that sorts first; repeated rows are judged alike; an empty table gives an empty result. Other
columns pass through; the columns that are added take the names given.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.arrow import blocks, ragged
from seqloom.llm.held import held
from seqloom.llm.rows import keeps_columns
from seqloom.sources import read_table, stage

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass
class Field:
    """Weights of the field: emissions by feature and label, transitions between labels."""

    labels: list[str]
    lexicon: dict[str, int]
    buckets: int
    emit: np.ndarray
    move: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def word_features(words: list[str], lexicon: dict[str, int], buckets: int, sizes=(1, 2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs: n-grams of ^word$, those at its ends being affixes, and the lexicon entry."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(codes))
    rows, feats, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in sizes:
            fits = room[: len(h)] >= n
            mixed = h[fits] ^ (h[fits] >> np.uint64(29))
            rows.append(owner[: len(h)][fits])
            feats.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % buckets)
    known = [(i, buckets + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    rows.append(np.array([i for i, _ in known], np.int64))
    feats.append(np.array([x for _, x in known], np.int64))
    return np.concatenate(rows), np.concatenate(feats)


def emissions(words: list[str], model: Field) -> np.ndarray:
    """One row of label scores a word."""
    rows, feats = word_features(words, model.lexicon, model.buckets)
    w = model.emit[feats]
    return np.stack([np.bincount(rows, w[:, k], len(words)) for k in range(len(model.labels))], axis=1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior labels of every word and the summed posterior of label pairs.

    scores: words x labels, the runs one after the other; all runs take a step at once, the longest first.
    """
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    trans = np.exp(move)
    steps = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)]  # runs longer than t
    alpha, beta, pairs = np.zeros_like(p), np.zeros_like(p), np.zeros((k, k))
    for t in range(steps):
        at = starts[: active[t]] + t
        a = p[at] if not t else p[at] * (alpha[at - 1] @ trans)
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        at = starts[: active[t]] + t
        n = active[t + 1] if t + 1 < steps else 0
        b = np.ones((len(at), k))
        if n:
            ahead = p[at[:n] + 1] * beta[at[:n] + 1]
            b[:n] = ahead @ trans.T
            norm = (alpha[at[:n]] * b[:n]).sum(axis=1, keepdims=True)
            pairs += trans * ((alpha[at[:n]] / norm).T @ ahead)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), pairs


def runs(counts: np.ndarray, span: int) -> np.ndarray:
    """Lengths of the runs of at most `span` words into which documents of so many words are cut."""
    full, rest = counts // span, counts % span
    out = np.full(int((full + (rest > 0)).sum()), span, np.int64)
    last = np.cumsum(full + (rest > 0))[rest > 0] - 1
    out[last] = rest[rest > 0]
    return out


def joined_runs(counts: np.ndarray, span: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the words of some documents and the lengths of the runs in it: every other document is cut into runs as it
    is, the pieces of the others follow each other in a mixed order."""
    starts = np.cumsum(counts) - counts
    whole, other = np.arange(0, len(counts), 2), np.arange(1, len(counts), 2)
    sizes = runs(counts[other], piece)
    first = np.repeat(starts[other], -(-counts[other] // piece))
    own = np.arange(len(sizes)) - np.repeat(np.cumsum(-(-counts[other] // piece)) - -(-counts[other] // piece), -(-counts[other] // piece))
    mixed = np.random.default_rng(len(sizes)).permutation(len(sizes))
    order = np.concatenate((ragged(starts[whole], counts[whole]), ragged((first + own * piece)[mixed], sizes[mixed])))
    return order, np.concatenate((runs(counts[whole], span), runs(np.array([sizes.sum()]), span)))


def sample(docs: DataFrame, text: str, label: str, per_label: int) -> DataFrame:
    """About `per_label` labelled documents of each label, twice as many at most, the same on every run: t (text), y (label)."""
    known = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").alias("i"), F.col(label).alias("y"), F.col(text).alias("t"))
    counts = known.groupBy("y").count().collect()  # a row a label, like the field itself
    if not counts:
        return known.select("t", "y").limit(0)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["y"], min(1.0, per_label / r["count"]))])
    known = known.withColumn("h", F.xxhash64("i", "t"))  # rows without an id are told apart by their texts
    drawn = known.filter((F.pmod("h", F.lit(1 << 30)) + 0.5) / (1 << 30) < F.element_at(share, F.col("y")))
    # equal rows are drawn together, so their number has a bound of its own
    place = F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))
    return drawn.withColumn("place", place).filter(F.col("place") <= 2 * per_label).select("t", "y")


def fit(train: DataFrame, buckets: int = 1 << 14, steps: int = 10, rate: float = 0.5, decay: float = 1e-4, words: int = 400, span: int = 64, piece: int = 12, tasks: int = 6) -> Field | None:
    """Full-batch adaptive gradient steps over whole texts and over pieces of `piece` words of different texts joined to one, from which the field learns switches. `words`: lexicon entries of each label. None if nothing is labelled."""
    spark = train.sparkSession
    train = stage(train.repartition(tasks))
    labels = sorted(r[0] for r in train.select("y").distinct().collect())
    if not labels:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in blocks(batches, "t"):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(y, Counter()).update(LETTERS.findall(t.lower()))
        rows = [(y, w, n) for y, c in found.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["y", "w", "n"])

    counted = train.select("t", "y").mapInArrow(count, "y string, w string, n long").groupBy("y", "w").agg(F.sum("n").alias("n"))
    lexicon: dict[str, int] = {}
    for y in labels:
        for r in counted.filter(F.col("y") == y).orderBy(F.desc("n"), "w").limit(words).collect():
            lexicon.setdefault(r["w"], len(lexicon))
    k = len(labels)
    model = Field(labels, lexicon, buckets, np.zeros((buckets + len(lexicon), k), np.float64), np.zeros((k, k)))
    squares = [np.full_like(model.emit, 1e-8), np.full_like(model.move, 1e-8)]
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(model)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            emit, move = np.zeros_like(m.emit), np.zeros_like(m.move)
            for b in blocks(batches, "t", 256 << 10):
                split = [LETTERS.findall(t.lower()) for t in b.column(0).to_pylist()]
                counts = np.array([len(s) for s in split], np.int64)
                if not counts.sum():
                    continue
                flat = [w for s in split for w in s]
                uniq = {w: i for i, w in enumerate(dict.fromkeys(flat))}
                at = np.array([uniq[w] for w in flat], np.int64)
                rows, feats = word_features(list(uniq), m.lexicon, m.buckets)
                w = m.emit[feats]
                e = np.stack([np.bincount(rows, w[:, j], len(uniq)) for j in range(k)], axis=1)
                gold = np.repeat(np.array([m.labels.index(y) for y in b.column(1).to_pylist()]), counts)
                order, lengths = joined_runs(counts, span, piece)
                at, gold = at[order], gold[order]
                post, pairs = forward_backward(e[at], lengths, m.move)
                post[np.arange(len(gold)), gold] -= 1
                by_word = np.stack([np.bincount(at, post[:, j], len(uniq)) for j in range(k)], axis=1)
                emit -= np.stack([np.bincount(feats, by_word[rows, j], len(m.emit)) for j in range(k)], axis=1)
                inner = np.ones(len(gold), bool)
                inner[np.cumsum(lengths) - 1] = False  # the last word of a run leads nowhere
                step = np.flatnonzero(inner)
                move += np.bincount(gold[step] * k + gold[step + 1], minlength=k * k).reshape(k, k) - pairs
            yield pa.RecordBatch.from_arrays([pa.array([emit.tobytes()], pa.binary()), pa.array([move.tobytes()], pa.binary())], ["emit", "move"])

        parts = train.select("t", "y").mapInArrow(gradient, "emit binary, move binary").collect()  # one row a task, of the field's size
        total = max(1.0, float(len(parts)))
        for j, (w, size) in enumerate(((model.emit, "emit"), (model.move, "move"))):
            g = sum(np.frombuffer(p[size], np.float64).reshape(w.shape) for p in parts) / total - decay * w
            squares[j] += g * g
            w += rate * g / np.sqrt(squares[j])
        sent.unpersist()
    return model


def word_scores(words: list[str], model: Field, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, label scores by row); rows are kept for the next batches of this worker. Row 0: no letter."""
    rows, parts = held(("langid", model.key), lambda: ({}, [np.zeros((1, len(model.labels)))]))
    if len(rows) > most:
        rows.clear()
        parts[:] = [parts[0][:1].copy()]
    new = [w for w in dict.fromkeys(words) if w not in rows]
    if new:
        at = sum(map(len, parts))
        parts.append(emissions(new, model))
        parts[:] = [np.concatenate(parts)] if len(parts) > 64 else parts
        rows.update((w, at + i if any(map(str.isalpha, w)) else 0) for i, w in enumerate(new))
    return np.fromiter(map(rows.__getitem__, words), np.int64, len(words)), np.concatenate(parts) if len(parts) > 1 else parts[0]


def document_labels(texts: list[str | None], model: Field, span: int = 64) -> tuple[list[str], list[float]]:
    split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    flat = [w for s in split for w in s]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    at, scores = word_scores(flat, model)
    owner, at = owner[at > 0], at[at > 0]
    counts = np.bincount(owner, minlength=len(texts))
    post, _ = forward_backward(scores[at], runs(counts, span), model.move)
    mass = np.stack([np.bincount(owner, post[:, j], len(texts)) for j in range(len(model.labels))], axis=1)
    best = mass.argmax(axis=1)
    share = mass[np.arange(len(texts)), best] / np.maximum(counts, 1)
    return [model.labels[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist())], np.clip(share, 0, 1).tolist()


def predict(docs: DataFrame, model: Field | None, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of `docs` and the predicted language and its share of the words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias(to[0]), F.lit(0.0).alias(to[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, 512 << 10):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            found = document_labels(texts, sent.value) if sent.value else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], [*b.schema.names, *to])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fitted(docs: DataFrame, per_label: int = 300) -> Field | None:
    """The field learned from the texts and languages of the documents that are not held out."""
    return fit(sample(docs.filter(~held_out(F.col("doc_id"))), "text", "lang", per_label))


@keeps_columns
def identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The documents whose language is known: not `und`, and with at least that share of their words in one language."""
    out = predict(docs, fitted(docs), to=("_lang", "_share"))
    return out.filter((F.col("_lang") != UNKNOWN) & (F.col("_share") >= least)).drop("_lang", "_share")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fitted(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
