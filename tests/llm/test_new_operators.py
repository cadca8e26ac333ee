"""The prefix trie, hard negatives and MinHash near-duplicates against brute force, on odd rows too."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import components, hardneg, minhash, trie
from seqloom.llm.queries import QUERIES

ROWS_OF = "doc_id long, text string, node string, keys string, body int, id int"


# ---------------------------------------------------------------- 13
def shingles(text: str | None) -> set[str]:
    found = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))} if found else set()


def brute_components(rows: list[tuple]) -> list:
    """component_id of each row (doc_id, text)."""
    sets, forest = [shingles(t) for _, t in rows], components.Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                forest.joins(i, j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[forest.root(i)] += [doc_id] if doc_id is not None else []
    return [min(least[forest.root(i)], default=None) for i in range(len(rows))]


def held(spark, rows: list[tuple]) -> None:
    docs = spark.createDataFrame([(d, t, "clash", None, 1, 2) for d, t in rows], ROWS_OF).repartition(3)
    got = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    want = Counter((d, len(shingles(t)), c, d == c) for (d, t), c in zip(rows, brute_components(rows)))
    assert got == want


def words(r: random.Random, n: int) -> list[str]:
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def test_minhash_odd_rows(spark):
    r = random.Random(1)
    long = words(r, 30_000)
    edited = [*long[:29_000], *words(r, 900)]
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (7, "two one"), (8, "one two"), (8, "other text of one id"), (8, "other text of one id"), (None, "no id at all"), (None, "NO id\nat all"),
        (None, "one two"), (9, " ".join(long)), (10, " ".join(edited)), (11, "É é x"), (12, "é é x"), (13, "a b c " * 2000), (14, "a b c a b"), (None, None), (-5, "two one"),
    ]
    held(spark, rows)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_families(spark):
    """A family whose pairs lie on both sides of the limit, and chains of small edits, by the thousand copies too."""
    r = random.Random(2)
    base, rows = words(r, 150), []
    for _ in range(250):
        text = list(base)
        for at in r.sample(range(150), 4):
            text[at] = words(r, 1)[0]
        rows.append(" ".join(text))
    chain = words(r, 200)
    for k in range(60):
        chain = list(chain)
        chain[3 * k % 200] = words(r, 1)[0]
        rows.append(" ".join(chain))
    rows += [" ".join(base)] * 500 + [" ".join(words(r, r.randrange(1, 40))) for _ in range(50)]
    r.shuffle(rows)
    held(spark, list(enumerate(rows)))


def test_cells_of_parts(spark, monkeypatch):
    """Buckets that are cut into cells lose no link."""
    monkeypatch.setattr(minhash, "CELL_ROWS", 20)
    test_minhash_families(spark)


def test_sketch_fills_and_estimates():
    """Every coordinate of a set that isn't empty fills, and the share of equal ones is the Jaccard index."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for n in (1, 2, 5, 50, 1000)]
    s = minhash.sketches([*sets, np.empty(0, np.int64)], 192)
    assert (s[:-1] != minhash.EMPTY).all() and (s[-1] == minhash.EMPTY).all()
    agree = []
    for _ in range(60):
        whole = rng.integers(-(1 << 62), 1 << 62, 300)
        a, b = minhash.sketches([np.unique(whole[:240]), np.unique(whole[30:])], 192)  # 210 of 300
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 0.7) < 0.015 and np.std(agree) < 0.05


def test_components_of_many_edges(spark):
    """Rounds of stars and a last task give the same components."""
    r = random.Random(4)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(1300)] + [(i, i + 1) for i in range(4000, 4200)] + [(5000, i) for i in range(5001, 5300)]
    forest = components.Forest()
    for a, b in edges:
        forest.joins(a, b)
    want = {n: forest.root(n) for e in edges for n in e if e[0] != e[1]}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for few in (0, 10**6):
        found = components.components(df, few).collect()
        assert dict(found) == want and len(found) == len(want)
    assert components.components(df.limit(0)).count() == 0


def test_op13_rows(spark, data):
    rows = [tuple(x) for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op13_minhash"](spark, data).collect()))
    assert got == sorted((d, len(shingles(t)), c, d == c) for (d, t), c in zip(rows, brute_components(rows)))


# ---------------------------------------------------------------- 12
def brute_negatives(rows: list[tuple]) -> list[tuple]:
    kept = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [int(np.floor(256 * float(x))) for x in v], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    out = []
    for i, (anchor, v, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), (j is None, j or 0), k, own) for k, (j, w, own) in enumerate(kept) if k != i and len(w) == len(v)]
        for p, pid, _, _ in sorted(s for s in scored if s[3] == label)[:5]:
            fits = sorted(s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(anchor, None if pid[0] else pid[1], at, None if n[1][0] else n[1][1], -p, -n[0]) for at, n in enumerate(fits, 1)]
    return out


def odd_vectors() -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0], 6)], int(rng.integers(0, 4))) for i in range(0, 900, 3)]
    rows += [(7, None, 1), (100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (200, [float("nan")] * 6, 1), (300, [float("inf")] * 6, 2), (400, [0.5] * 6, None), (None, [1.0] * 6, 1), (None, [0.5] * 6, 2), (500, [], 1), (501, [], 2)]
    rows += [(600, [0.75] * 6, 1), (600, [0.75] * 6, 1), (600, [0.5] * 6, 2), (700, [1.0, 2.0], 3), (704, [1.0, 1.0], 3), (705, [0.5, 0.5], 2), (800, [0.0] * 6, 1), (-100, [1.0] * 6, 0)]
    return rows


def test_hard_negatives(spark, monkeypatch):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, cell string").repartition(3)
    want = Counter(brute_negatives(rows))
    assert len(want) > 100
    assert Counter(map(tuple, hardneg.hard_negatives(df).collect())) == want
    for name, size in (("CHUNK", 40), ("GROUP", 2), ("TILE", 7), ("ANCHORS", 3)):
        monkeypatch.setattr(hardneg, name, size)
    assert Counter(map(tuple, hardneg.hard_negatives(df).collect())) == want  # heaps of many tiles and cells merge
    assert hardneg.hard_negatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", [(1, 1, 1), (16, 16, 16), (17, 33, 21), (40, 64, 100), (130, 7, 65), (64, 64, 64), (3, 0, 5)])
def test_strassen(shape):
    rng = np.random.default_rng(6)
    n, k, m = shape
    a, b = rng.integers(-(1 << 20), 1 << 20, (n, k)), rng.integers(-(1 << 20), 1 << 20, (k, m))
    for leaf in (1, 4, 16):
        assert (hardneg.strassen(a, b, leaf) == a @ b).all()
    big = rng.integers(-(1 << 62), 1 << 62, (20, 20))
    assert (hardneg.strassen(big, np.eye(20, dtype=np.int64), 2) == big).all()  # intermediate sums wrap round


def test_window_bounds():
    for s in (*range(-50, 51), 10**18, -(10**18), (1 << 63) - 1):
        low, high = (int(x[0]) for x in hardneg.window_bounds(np.array([s])))
        assert low == -(-30 * s // 100) and high == 90 * s // 100


# ---------------------------------------------------------------- 11
def brute_trie(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        line = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(line) + 1):
            members[tuple(line[:d])].append((c, d == len(line)))
    kids, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(found) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, last in found if last))
        parent = min(members[node[:-1]])[0] if node else None
        out.append((min(found)[0], len(node), parent, len(found), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def held_trie(spark, rows: list[tuple]) -> None:
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, parent string").repartition(3)
    c = F.col("conv_id")
    got = trie.prefix_trie(df, c - c % 5, F.crc32(c.cast("string")) % 9)
    assert Counter(map(tuple, got.collect())) == Counter(brute_trie(rows))


def test_trie_odd_rows(spark):
    r = random.Random(7)
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, 1, "user", "é"), (3, 1, "user", "é"), (3, 1, "tool", "b"), (7, 0, "user", ""), (7, 1, "", "user"), (1000, 5, "user", "only one")]
    for c in range(10, 60):
        rows += [(c, t, r.choice(["user", "tool"]), r.choice(["a", "bb", None])) for t in range(r.randrange(1, 14))]
    held_trie(spark, rows)
    c = F.col("conv_id")
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), c - c % 5, F.crc32(c.cast("string")) % 9).count() == 0


def test_trie_long_conversation(spark, monkeypatch):
    """A conversation of many turns lies in several parts of the sort and several blocks; copies of it branch late."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, t, "user", f"t{t}" if t < 60 * (c % 4) else f"own {c} {t}") for c in range(20, 26) for t in range(300 if c == 22 else 150)]
    rows += [(40, 0, "user", "long " * 40_000), (41, 0, "user", "long " * 40_000)]
    held_trie(spark, rows)


def test_op11_rows(spark, data):
    rows = [tuple(x) for x in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, QUERIES["op11_prefix_trie"](spark, data).collect())) == Counter(brute_trie(rows))


# ---------------------------------------------------------------- stages on odd tables
CLASHING = ["_id", "_row", "_key", "_lang", "_share", "_own_tag", "_cut_id", "_cut_tag", "_cut_spans", "_mix_name", "_mix_key", "_mix_h", "_mix_n", "named", "node", "row", "body", "others", "c0", "a.b`c"]


def test_stages_keep_clashing_columns(spark):
    """Columns with names of the stages' own, and a map, come through every stage unchanged; repeated rows too."""
    import corpus_pipeline

    r = random.Random(8)
    texts = [" ".join(r.choices(["the", "of", "and", "house", "river", "le", "la", "maison"], k=80)) for _ in range(12)]
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}") for i, t in enumerate(texts)] * 2 + [(None, texts[0], "en", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    for name, stage_of in corpus_pipeline.STAGES[:-1]:
        out = stage_of(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found, name
        for row in found:
            own = "none" if row["doc_id"] is None else str(row["doc_id"])
            assert all(row[c] == c + own for c in CLASHING) and row["m"] == {"k": row["doc_id"]}, name


def test_texts_without_ids_are_told_apart(spark):
    """Only the text that repeats elsewhere loses bytes, whatever ids its rows have; equal rows count their spans once."""
    from seqloom.llm import substrings

    r = random.Random(9)
    one, two, three = (" ".join(words(r, 40)) for _ in range(3))
    rows = [(None, one), (None, two), (5, "x " + one)] + [(None, three)] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, substrings.digests(docs).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter({
        (None, len(one), len(one), 1, sha("")): 1, (None, len(two), 0, 0, sha(two)): 1, (5, len(one) + 2, len(one), 1, sha("x ")): 1, (None, len(three), len(three), 1, sha("")): 2000,
    })
    assert got == want
    lists = substrings.span_lists(docs).collect()
    assert len(lists) == 3 and max(len(x["_cut_spans"]) for x in lists) <= 2 * len(three)


def test_language_sample_has_a_bound(spark):
    """Rows without ids are drawn by their texts, equal rows up to twice the bound."""
    from seqloom.llm import langid

    r = random.Random(10)
    rows = [(None, " ".join(words(r, 5)), "a") for _ in range(1000)] + [(None, "same", "b")] * 1000 + [(i, "text", "c") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = Counter(x["y"] for x in langid.sample(docs, "text", "lang", 10).collect())
    assert 1 <= drawn["a"] <= 20 and drawn["b"] in (0, 20) and 1 <= drawn["c"] <= 20


def test_switches_are_learned(spark):
    """Words of mixed texts are labelled by their own language: runs of pieces teach the field to switch."""
    from seqloom.llm import langid

    r = random.Random(11)
    lexica = {"x": [f"{a}{b}an" for a in "bdfg" for b in "aeiou"], "y": [f"{a}{b}ur" for a in "klmn" for b in "aeiou"]}
    train = [(i, " ".join(r.choices(lexica[y], k=60)), y) for i, y in enumerate("xy" * 60)]
    field = langid.fit(langid.sample(spark.createDataFrame(train, "doc_id long, text string, lang string"), "text", "lang", 100))
    hits = total = 0
    for _ in range(30):
        gold = [y for y in r.choices("xy", k=6) for _ in range(5)]
        text = [r.choice(lexica[y]) for y in gold]
        at, scores = langid.word_scores(text, field)
        post, _ = langid.forward_backward(scores[at], np.array([len(text)]), field.move)
        hits += sum(field.labels[p] == y for p, y in zip(post.argmax(axis=1), gold))
        total += len(text)
    assert hits > 0.97 * total


def test_join_names_of_hot_keys(spark):
    """Hot keys and others each get their names once; rows whose key has none are left out."""
    from seqloom.llm.rows import join_names

    rows = spark.createDataFrame([(k, i) for k, n in (("hot", 300), ("warm", 40), ("cold", 1)) for i in range(n)] + [("none", 0)], "k string, i int").repartition(3)
    names = spark.createDataFrame([("hot", "H", 300), ("warm", "W", 40), ("cold", "C", 1)], "k string, name string, times long")
    for least in (10, 100, 1000):
        got = Counter((r["k"], r["name"]) for r in join_names(rows, names, "k", least, 10**6).collect())
        assert got == {("hot", "H"): 300, ("warm", "W"): 40, ("cold", "C"): 1}
    assert join_names(rows, names.limit(0), "k").count() == 0
