"""Near-duplicates by Golay-code fuzzy hashing of wide SimHash fingerprints, verified by the Jaccard index of shingle sets.

At a similarity of 0.8 two 64-bit fingerprints differ in about 10 bits, too many for the four of simhash.near_duplicates. So
a set gets `spread` fingerprints of 64 bits, taken over its distinct shingles. Two 23-bit segments of each are decoded to
the indices of nearby Golay codewords, and each pair of indices is a key: two sets of similarity 0.8 share a key of one
fingerprint with a chance of 0.36, hence some key of ten with one of 0.99 (0.998 at 0.82). Sets that share a key are
candidates if the fingerprints' bits allow it; candidates are verified on whole shingle sets, and only verified links join.

Copies by the thousand are joined first: under the keys of one fingerprint each set is held against the least of its bucket, and sets that verified links
have joined give no pair any more under all keys. Of what is left small buckets give all their pairs. A larger bucket gives first the pairs of its least member (of each set
the nearest few) and the members that have a candidate in it, and after these are verified all their pairs that no verified link has joined yet, dealt in blocks: no
pair is left out. Rows of keys hold three fingerprints, by which most chance meetings end in the bucket. A set is known by a 128-bit hash.

Defined results: null and empty texts and texts without a word are one empty set; fewer words than a shingle are one
shingle; rows are told apart by doc_id and text, a null doc_id included; the row that names a component is the one with the least
doc_id, null after all others, then the least hash of its text. An empty table gives an empty result. Other columns come through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.arrow import blocks, text_bytes
from seqloom.llm.components import components
from seqloom.llm.fingerprint import packed
from seqloom.llm.golay import segment_keys
from seqloom.llm.held import release
from seqloom.llm.rows import keeps_columns, row_digest
from seqloom.sources import discard, stage

SEED, SPREAD, SLACK = 42, 10, 1e-9
#: The shifts of a fingerprint's two segments of 23 bits.
SEGMENTS = (41, 18)
#: Candidates differ in at most this many bits of one fingerprint, and this share of the bits of all (and 0.2 over the size, as small sets tie more
#: often): four deviations beyond what a similarity of 0.8 gives.
MOST_BITS, MOST_SHARE = 22, 0.21
#: Where keys meet, MORE fingerprints beside the first are compared: in all they differ in at most this share, 4.7 deviations beyond.
MORE, MOST_SHARE_MET = 2, 0.28
#: Words of the parities of a set: how many of its hashes end in each number, odd or even. Sets differ in no fewer shingles than parities.
PARITIES = 8


def row_hash(text: str = "text") -> Column:
    """128 bits of the whole text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def shingle_digests(text: bytes, words: int) -> bytes:
    """XXH64 of each shingle, big-endian, one after the other."""
    found = text.lower().split()
    if len(found) <= words:
        return xxhash.xxh64_digest(b" ".join(found), SEED) if found else b""
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())])


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(np.frombuffer(shingle_digests(text, words), ">u8").astype(np.int64))


def wide_fingerprint(shingles: np.ndarray, spread: int) -> np.ndarray:
    """`spread` SimHash words of a set: a bit is set if it is in more than half of the shingles' hashes."""
    factors = np.arange(1, 2 * spread, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = shingles.view(np.uint64)
    h = h ^ (h >> np.uint64(32))
    counts = np.zeros(64 * spread, np.int64)
    for lo in range(0, len(h), 255):  # sums of so many bits fit in a byte
        m = h[lo : lo + 255, None] * factors
        m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
        counts += np.unpackbits(m.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount(shingles & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1).view(np.int64)


def may_link(m: np.ndarray, n: np.ndarray, differ: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sizes of pairs of sets and their numbers of differing bits, word by word (fingerprints, then parities), allow the similarity."""
    spread = max(differ.shape[1] - PARITIES, 0)
    bits, odd = (d.sum(axis=1, dtype=np.int64) for d in (differ[:, :spread], differ[:, spread:]))
    shared = (m + n - odd) / 2  # at most
    return (shared >= similarity * (m + n - shared) - SLACK) & (bits <= (MOST_SHARE + 0.2 / np.maximum(m, n)) * 64 * spread)


def sets_of(docs: DataFrame, words: int, spread: int) -> DataFrame:
    """doc_id, row, node (hash of the shingle set), n (its size), wide (fingerprints, then parities) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in blocks(batches):
            sets = [shingle_set(t, words) for t in text_bytes(batch).to_pylist()]
            node = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            wide = [np.concatenate((wide_fingerprint(s, spread), parities(s))) for s in sets]
            columns = [pa.array(node, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(wide, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "row", "node", "n", "wide"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_hash().alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row binary, node binary, n int, wide array<long>")


def keyed(nodes: DataFrame, spread: int, first: int | None = None) -> DataFrame:
    """at, bs, id, sig (one fingerprint other than the key's), n, even, odd (128 parities), root, more (MORE further fingerprints) of every set (id, root, n, wide) that
    isn't empty: `at` is a fingerprint's number and an index of its first segment, `bs` has all indices of the second one. Keys are those of the `first` fingerprints, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, wide, n = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1), part.column(2).to_numpy()
                roots = part.column(3).to_numpy()
                even, odd = (np.bitwise_xor.reduce(wide[:, spread + k :: 2], axis=1) for k in range(2))
                for w in range(first or spread):
                    left, right = (segment_keys((wide[:, w] >> s) & ((1 << 23) - 1)) for s in SEGMENTS)
                    row = np.nonzero(left >= 0)[0]
                    fits = right[row] >= 0
                    ends = np.concatenate(([0], np.cumsum(fits.sum(axis=1)))).astype(np.int32)
                    bs = pa.ListArray.from_arrays(pa.array(ends), pa.array(right[row][fits].astype(np.int16)))
                    sig = wide[:, (w + 1) % spread]
                    columns = [(w << 12) | left[left >= 0], *[c[row] for c in (ids, sig, n, even, odd, roots)]]
                    columns = [pa.array(c) for c in columns]
                    further = wide[:, [(w + 2 + k) % spread for k in range(MORE)]][row].reshape(-1)
                    more = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * MORE), pa.array(further))
                    yield pa.RecordBatch.from_arrays([columns[0], bs, *columns[1:], more], ["at", "bs", "id", "sig", "n", "even", "odd", "root", "more"])

    kind = "at long, bs array<smallint>, id long, sig long, n int, even long, odd long, root long, more array<long>"
    return nodes.filter("n > 0").select("id", "wide", "n", "root").mapInArrow(run, kind)


def keys_of(rows: DataFrame) -> DataFrame:
    """key, id and the other columns: a row for each pair of indices of keyed()'s rows."""
    others = [c for c in rows.columns if c not in ("at", "bs")]
    return rows.select("at", F.explode("bs").alias("b"), *others).select((F.col("at") * 4096 + F.col("b")).alias("key"), *others)


def all_keys(nodes: DataFrame, spread: int) -> DataFrame:
    """id, root, n, wide, keys (all that keys_of gives for the set) of nodes: one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                wide = part.column(3).flatten().to_numpy().reshape(part.num_rows, -1)
                keys = np.full((part.num_rows, spread, 6, 6), -1)
                for w in range(spread):
                    left, right = (segment_keys((wide[:, w] >> s) & ((1 << 23) - 1)) for s in SEGMENTS)
                    key = (((w << 12) | left[:, :, None]) << 12) + right[:, None, :]
                    keys[:, w] = np.where((left[:, :, None] >= 0) & (right[:, None, :] >= 0), key, -1)
                keys = keys.reshape(part.num_rows, -1)
                ends = np.concatenate(([0], np.cumsum((keys >= 0).sum(axis=1)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[keys >= 0]))], ["id", "root", "n", "wide", "keys"])

    return nodes.filter("n > 0").select("id", "root", "n", "wide").mapInArrow(run, "id long, root long, n int, wide array<long>, keys array<long>")


def meeting(keys: DataFrame, similarity: float = 0.8, small: int = 8, hold: int = 100_000, most: int = 2000, stars: bool = False) -> DataFrame:
    """key, a, b of keyed()'s rows: candidates, which are pairs of different roots whose sizes, parities and fingerprints allow the similarity, each once for the rows that are held at a time.
    Key -1: a pair of ids. Key 0: a (id) has a candidate in a bucket of more than `small` rows; if more than `most` are held of it, whether or not it has one. Below -1: the pair of
    such a bucket's least id and another, which differ in -2 - key bits. `stars`: only the last kind, of all buckets. Rows without root and more are held to have roots of their own and no more bits."""
    small = 1 if stars else small

    def near(x: list[np.ndarray], y: list[np.ndarray], bits: int = 64) -> np.ndarray:
        """Of sig, n, even, odd, root. Sets of sizes m and n that have the similarity s differ in (m + n)(1 - s)/(1 + s) shingles at most."""
        sig, even, odd = (np.bitwise_count((p ^ q).view(np.uint64)).astype(np.int64) for p, q in ((x[i], y[i]) for i in (0, 2, 3)))
        size = np.minimum(x[1], y[1]) >= similarity * np.maximum(x[1], y[1]) - SLACK
        return size & (sig <= bits) & (even + odd <= (x[1] + y[1]) * ((1 - similarity) / (1 + similarity)) + SLACK) & (x[4] != y[4])

    def candidates(i: np.ndarray, j: np.ndarray, seen: list[np.ndarray], more: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows are candidates by all fingerprints that the rows hold."""
        most_bits = (MOST_SHARE_MET + 0.2 / np.maximum(seen[1][i], seen[1][j])) * 64 * (1 + more.shape[1])
        return (differing(i, j, seen, more) <= most_bits) | (more.shape[1] == 0)

    def differing(i: np.ndarray, j: np.ndarray, seen: list[np.ndarray], more: np.ndarray) -> np.ndarray:
        """Bits in which pairs of rows differ."""
        return np.bitwise_count((seen[0][i] ^ seen[0][j]).view(np.uint64)).astype(np.int64) + np.bitwise_count(more[i] ^ more[j]).sum(axis=1, dtype=np.int64)

    def paired(seen: list[np.ndarray], more: np.ndarray) -> np.ndarray:
        """Which rows of a bucket have a candidate in it."""
        found, step = np.zeros(len(more), bool), max(1, 100_000 // len(more))
        for lo in range(0, len(more), step):
            i, j = np.nonzero(near([c[lo : lo + step, None] for c in seen], [c[None, lo:] for c in seen]))
            i, j = i[i < j] + lo, j[i < j] + lo
            fits = candidates(i, j, seen, more)
            found[i[fits]] = found[j[fits]] = True
        return found

    def pairs(keys: np.ndarray, ids: np.ndarray, *seen: np.ndarray, forced: bool) -> pa.RecordBatch:
        """Candidates and members of whole buckets; `forced`: the first one is large, whatever is here of it."""
        *seen, more = seen
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        large = sizes > small
        large[0] |= forced
        first = np.repeat(starts, sizes)
        star = np.flatnonzero(np.repeat(large, sizes) & (first != np.arange(len(keys))))
        star = star[near([c[star] for c in seen], [c[first[star]] for c in seen], MOST_BITS)]
        star = star[candidates(first[star], star, seen, more)]
        apart = differing(star, first[star], seen, more)
        out = [(-2 - apart, ids[first[star]], ids[star])]
        few = np.flatnonzero(np.repeat(~large & (sizes > 1), sizes))
        k, s = keys[few], [c[few] for c in seen]
        for lag in range(1, small):
            if len(k) <= lag:
                break
            hit = np.flatnonzero((k[lag:] == k[:-lag]) & near([c[lag:] for c in s], [c[:-lag] for c in s], MOST_BITS))
            hit = hit[candidates(few[hit], few[hit + lag], seen, more)]
            out.append((np.full(len(hit), -1), ids[few[hit]], ids[few[hit + lag]]))
        for at, size in () if stars else zip(starts[large].tolist(), sizes[large].tolist()):
            rows = slice(at, at + size)
            if forced and not at or size > most:
                found = ids[rows]
            else:
                found = ids[rows][paired([c[rows] for c in seen], more[rows])]
            out.append((np.zeros(len(found), np.int64), found, found))
        once = np.unique(np.stack([np.concatenate([o[j] for o in out]).astype(np.int64) for j in range(3)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in once], ["key", "a", "b"])

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        found = [c.to_numpy() for c in batch.columns[:7]]
        if len(found) < 7:
            found.append(found[1])
        more = batch.column(7).flatten().to_numpy() if batch.num_columns > 7 else np.empty(0, np.int64)
        return [*found, more.reshape(batch.num_rows, -1).view(np.uint64)]

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """The columns of some tens of thousands of rows at a time, as a row that repeats in them is given once."""
        some = []
        for batch in batches:
            if batch.num_rows:
                some.append(columns(batch))
            if sum(len(c[0]) for c in some) >= min(hold, 50_000):
                yield [np.concatenate(p) for p in zip(*some)]
                some = []
        if some:
            yield [np.concatenate(p) for p in zip(*some)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, forced = None, False
        for now in parts_of(batches):
            held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on in the next part
            if cut:
                yield pairs(*[h[:cut] for h in held], forced=forced)
                held, forced = [h[cut:] for h in held], False
            if len(held[0]) > hold:  # a large bucket goes on with its least member
                yield pairs(*held, forced=True)
                held, forced = [h[:1] for h in held], True
        if held is not None:
            yield pairs(*held, forced=forced)

    # the rows are dealt before they become keys, five times as many; a count of its own, as their bytes say little of those of the keys
    dealt = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at")
    return keys_of(dealt).sortWithinPartitions("key", "id").mapInArrow(run, "key long, a long, b long")


def allowed(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b (nodes), bits (that differ) of the candidates (ids) whose sizes and fingerprints allow the similarity."""
    a = nodes.select(F.col("id").alias("a"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("wide").alias("wx"))
    b = nodes.select(F.col("id").alias("b"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("wide").alias("wy"))
    differ = F.zip_with("wx", "wy", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    spread = F.size("wx") - PARITIES
    bits, odd = (F.aggregate(F.slice(differ, lo, n), F.lit(0), lambda s, v: s + v) for lo, n in ((F.lit(1), spread), (spread + 1, F.lit(PARITIES))))
    both = pairs.join(a, "a").filter("a <> b").join(b, "b").filter(F.least("nx", "ny") >= similarity * F.greatest("nx", "ny") - SLACK)
    both = both.withColumns({"bits": bits, "shared": (F.col("nx") + F.col("ny") - odd) / 2}).filter(F.col("bits") <= (MOST_SHARE + 0.2 / F.greatest("nx", "ny")) * 64 * spread)
    both = both.filter(F.col("shared") >= similarity * (F.col("nx") + F.col("ny") - F.col("shared")) - SLACK)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "bits").distinct()


def bodies_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, body (a compressed text that has this set) of the wanted nodes (node)."""
    named = nodes.join(wanted, "node", "left_semi").select("node", F.col("named.doc_id").alias("_id"), F.col("named.row").alias("_row"))
    texts = packed(docs.select("doc_id", row_hash().alias("row"), "text"))
    found = texts.join(named, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "body")
    return found.dropDuplicates(["node"])


def verified(pairs: DataFrame, bodies: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b whose whole shingle sets have the similarity."""
    a, b = (bodies.select(F.col("node").alias(c), F.col("body").alias(f"body_{c}")) for c in "ab")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        unzip, kept, size = zstandard.ZstdDecompressor(), {}, 0

        def shingles(node: bytes, body: pa.Scalar) -> np.ndarray:
            nonlocal size
            if node not in kept:
                if size > 16 << 20:
                    kept.clear()
                    size = 0
                kept[node] = shingle_set(unzip.decompress(body.as_py()), words)
                size += kept[node].nbytes
            return kept[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = np.zeros(len(a), bool)
            for i, (m, n) in enumerate(zip(a, b)):
                x, y = shingles(m, batch.column(2)[i]), shingles(n, batch.column(3)[i])
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = shared >= similarity * (len(x) + len(y) - shared) - SLACK
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked)) for c in batch.columns[:2]], ["a", "b"])

    return stage(both.mapInArrow(run, "a binary, b binary"))


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components (node, root)."""
    out = pairs
    for c in "ab":
        out = out.join(joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return out.filter("root_a <> root_b").select(*pairs.columns)


def rooted(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """nodes with root, a hash of what names their component (node, root)."""
    return nodes.join(joined, "node", "left").withColumn("root", F.xxhash64(F.coalesce("root", "node")))


def open_pairs(members: DataFrame, nodes: DataFrame, joined: DataFrame, similarity: float, spread: int, most: int = 2000) -> DataFrame:
    """a, b (ids): all pairs of different components in the buckets of the members (id); buckets of over `most` are dealt as pairs of blocks."""
    roots = rooted(nodes.join(members, "id", "left_semi"), joined)
    bucket = Window.partitionBy("key")
    rows = all_keys(roots, spread).select("id", "root", "n", "wide", F.explode("keys").alias("key"))
    rows = rows.withColumns({"least": F.min("root").over(bucket), "last": F.max("root").over(bucket), "size": F.count("*").over(bucket)}).filter("least <> last")
    rows = rows.withColumn("parts", F.ceil(F.col("size") / most).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # inside a block all rows meet (-1); in a pair of blocks only rows of different ones
    block = F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("block")
    rows = rows.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), block, "id", "root", "n", "wide")

    def meet(size: np.ndarray, block: np.ndarray, ids: np.ndarray, root: np.ndarray, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        upto = np.searchsorted(size, size / similarity + SLACK, "right")
        for i in range(len(size)):
            j = np.arange(i + 1, upto[i])
            j = j[(root[j] != root[i]) & ((block[j] != block[i]) | (block[j] < 0))]
            j = j[may_link(size[i], size[j], np.bitwise_count(wide[j] ^ wide[i]), similarity)]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), ids[i])), pa.array(ids[j])], ["a", "b"])

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        wide = batch.column(5).flatten().to_numpy().view(np.uint64)
        return [*[c.to_numpy() for c in batch.columns[:5]], wide.reshape(batch.num_rows, -1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
            while len(held[0]) and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][0], "right"))
                yield from meet(*[h[:cut] for h in held[1:]])
                held = [h[cut:] for h in held]
        if held is not None and len(held[0]):
            yield from meet(*[h for h in held[1:]])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "n").select("cell", "n", "block", "id", "root", "wide")
    found = dealt.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined_by(joined: DataFrame, links: DataFrame) -> DataFrame:
    """node, root: the components with further links (a, b)."""
    return components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def settled(left: DataFrame, joined: DataFrame, bodies: DataFrame, words: int, similarity: float, turns: int = 2) -> tuple[DataFrame, DataFrame]:
    """The components and the candidates (a, b, bits) that are still open after some turns, in each of which every set is held against the one
    whose fingerprint is nearest among those that nothing has joined to it: copies by the thousand are mostly joined so."""
    for _ in range(turns):
        if left.isEmpty():
            break
        ends = left.select(F.col("a").alias("end"), "a", "b", "bits").union(left.select("b", "a", "b", "bits"))
        one = ends.groupBy("end").agg(F.min(F.struct("bits", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        one = stage(one)
        joined = joined_by(joined, verified(one, bodies, words, similarity))
        left = stage(apart(left.join(one, ["a", "b"], "left_anti"), joined))
    return joined, left


def similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, spread: int = SPREAD, small: int = 8) -> DataFrame:
    """doc_id, row (hash of the text), named (doc_id and row that name the component) of every row of `docs`."""
    rows = stage(sets_of(docs, words, spread))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = rows.groupBy("node").agg(F.min(name).alias("named"), F.first("n").alias("n"), F.first("wide").alias("wide"))
    nodes = stage(nodes.withColumn("id", F.xxhash64("node")))
    wide, rows = rows, stage(rows.select("doc_id", "row", "node"))
    discard(wide)
    none = nodes.select("node", F.col("node").alias("root")).limit(0)
    early = stage(allowed(stage(meeting(keyed(rooted(nodes, none), spread, 1), similarity, stars=True)).select("a", "b"), nodes, similarity))
    joined = none
    if not early.isEmpty():
        bodies = stage(bodies_of(docs, nodes, early.select(F.col("a").alias("node")).union(early.select("b")).distinct()))
        joined = components(verified(early.select("a", "b"), bodies, words, similarity))
        discard(bodies)
    met = stage(meeting(keyed(rooted(nodes, joined), spread), similarity, small))
    # of the pairs in large buckets the four nearest of each set come first, the others come with the buckets' open pairs
    own = Window.partitionBy("b").orderBy(F.desc("key"), "a")
    first = met.filter("key < -1").groupBy("a", "b").agg(F.max("key").alias("key")).withColumn("at", F.row_number().over(own)).filter("at <= 4")
    left = stage(allowed(met.filter("key = -1").select("a", "b").union(first.select("a", "b")).distinct(), nodes, similarity))
    members = stage(met.filter("key >= 0").select(F.col("a").alias("id")).distinct())
    some = left.select(F.col("a").alias("node")).union(left.select("b")).union(members.join(nodes, "id").select("node")).distinct()
    bodies = stage(bodies_of(docs, nodes, some))
    joined, left = settled(left, joined, bodies, words, similarity)
    more = allowed(open_pairs(members, nodes, joined, similarity, spread), nodes, similarity)
    joined, left = settled(stage(left.union(more).distinct()), joined, bodies, words, similarity, 1)
    if not left.isEmpty():
        joined = joined_by(joined, verified(left, bodies, words, similarity))
    for t in (met, bodies):
        discard(t)
    linked = nodes.select("node", "named").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = linked.join(linked.groupBy("root").agg(F.min("named").alias("least")), "root").select("node", F.col("least").alias("named"))
    return rows.select("doc_id", "row", "node").join(names, "node").select("doc_id", "row", F.struct("named.doc_id", "named.row").alias("named"))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: documents linked by a Jaccard index of their shingle sets of at least `similarity`."""
    return similar_rows(docs, words, similarity).select("doc_id", F.col("named.doc_id").alias("component_id"))


@keeps_columns
def near_deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component one row stays, with the doc_id and text that name it."""
    names = (F.col("row") == F.col("named.row")) & F.col("doc_id").eqNullSafe(F.col("named.doc_id"))
    found = similar_rows(docs, words, similarity).groupBy("doc_id", "row").agg(F.max(names).alias("stays"), F.count("*").alias("times"))
    found = stage(found.filter("NOT stays OR times > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "stays"))
    keyed = docs.withColumn("_key", row_hash())
    same = (F.col("_key") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = keyed.join(found, same, "left_anti").select(docs.columns)
    if found.filter("stays").isEmpty():
        return kept
    # rows of one doc_id and text: the least hash of the whole row stays, the same one in each run
    repeated = keyed.join(found.filter("stays"), same, "left_semi")
    least = F.min_by(F.struct(*docs.columns), row_digest(docs.columns)).alias("_whole")
    return kept.unionByName(repeated.groupBy("doc_id", "_key").agg(least).select("_whole.*"))
