"""The near-duplicate stage against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from seqloom.llm import neardup, simhash


def shingles(text: str | None, words: int = 5) -> set[str]:
    found = (text or "").lower().split()
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(texts: list[str | None], similarity: float = 0.8) -> list[int]:
    """The component of each text, named by its first index."""
    sets, forest = [shingles(t) for t in texts], simhash.Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            shared, longest = len(a & sets[j]), max(len(a), len(sets[j]))
            if a == sets[j] or shared >= similarity * longest and shared >= similarity * len(a | sets[j]):
                forest.joins(i, j)
    return [forest.root(i) for i in range(len(texts))]


def fresh(r: random.Random, n: int) -> list[str]:
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def family(r: random.Random, n: int) -> list[str]:
    """A template of 200 words with 4 words changed, whose pairs are just below 0.8; every fourth text has a copy just above."""
    base, out = fresh(r, 200), []
    for k in range(n):
        places = r.sample(range(0, 200, 6), 8)
        text = list(base)
        for at in places[:4]:
            text[at] = fresh(r, 1)[0]
        out.append(" ".join(text))
        if k % 4 == 0:
            for at in places[4:]:
                text[at] = fresh(r, 1)[0]
            out.append(" ".join(text))
    return out


def components_of(spark, texts: list[str | None]) -> list[int]:
    got = dict(neardup.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect())
    return [got[i] for i in range(len(texts))]


def test_template_family(spark):
    """A family whose first texts are not alike loses no pair that is."""
    texts = family(random.Random(1), 480)
    expected = brute(texts)
    assert 200 < len(set(expected)) < len(texts) - 100
    assert components_of(spark, texts) == expected


def repeated_lines(r: random.Random) -> list[str]:
    """Texts of one line many times and much else, which share nothing else; and pairs that differ in how often they repeat it."""
    line = " ".join(fresh(r, 7))
    out = [" ".join([line] * 60 + fresh(r, 300)) for _ in range(20)]
    for _ in range(5):
        own = fresh(r, 300)
        out += [" ".join([line, *own]), " ".join([line] * 40 + own)]
    return out


def test_repeated_lines(spark):
    """Documents that one line dominates are told apart, and copies meet however often they repeat it."""
    texts = repeated_lines(random.Random(2))
    expected = brute(texts)
    assert len(set(expected)) == 25
    assert components_of(spark, texts) == expected


def test_one_row_of_each_component(spark):
    """Rows are told apart by doc_id and text: an id with two texts keeps both, and copies without an id leave one row."""
    r = random.Random(3)
    a, b, c = (" ".join(fresh(r, 100)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (None, c), (None, c), (None, c + " more"), (None, a), (2, b), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(x) for x in neardup.near_deduplicated(docs).collect())
    assert sum(got.values()) == 4 and got[1, a] == got[1, b] == got[3, None] == 1
    assert got[None, c] + got[None, c + " more"] == 1


def test_pipeline_rows(spark, data):
    """The stage keeps the row of the least doc_id of every component of brute force."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    roots = brute([r["text"] for r in rows])
    kept = corpus_pipeline.near_dedup(spark, docs, data).collect()
    assert sorted(r["doc_id"] for r in kept) == [rows[i]["doc_id"] for i in sorted(set(roots))] and len(kept) < len(rows)


def test_early_filter_keeps_similar_pairs(spark):
    """Pairs of sets whose similarity is 0.8 or more pass sizes and parities where keys meet; clearly different ones don't."""
    rng = np.random.default_rng(5)
    rows, alike, unlike = [], set(), set()
    for pair in range(300):
        whole = rng.integers(-(1 << 62), 1 << 62, int(rng.integers(10, 400)))
        cut = int(rng.integers(0, len(whole) // 9 + 1))
        other = rng.integers(-(1 << 62), 1 << 62, len(whole)) if pair % 3 == 0 else whole
        sets = [np.unique(whole[cut:]), np.unique(other[: len(other) - cut])]
        shared = len(np.intersect1d(*sets))
        likeness = shared / (len(sets[0]) + len(sets[1]) - shared)
        for side, found in enumerate(sets):
            odd = neardup.parities(found)
            folded = [int(np.bitwise_xor.reduce(odd[k::2])) for k in range(2)]
            rows.append((pair, [0], 2 * pair + side, 0, len(found), *folded))
        if likeness >= 0.8:
            alike.add((2 * pair, 2 * pair + 1))
        elif likeness == 0 and len(whole) < 100:
            unlike.add((2 * pair, 2 * pair + 1))
    keys = spark.createDataFrame(rows, "at long, bs array<smallint>, id long, sig long, n int, even long, odd long")
    met = {(r.a, r.b) for r in neardup.meeting(keys).collect() if r.key == -1}
    assert len(alike) > 100 and alike <= met
    assert unlike and not unlike & met


def near_copies(r: random.Random, n: int) -> list[str]:
    """Texts that two of 200 words tell apart; each pair has a similarity of 0.8 or more."""
    base, out = fresh(r, 200), []
    for _ in range(n):
        text = list(base)
        for at in r.sample(range(0, 200, 6), 2):
            text[at] = fresh(r, 1)[0]
        out.append(" ".join(text))
    return out


def test_rows_of_a_group_of_near_copies(spark, monkeypatch):
    """What leaves the buckets are a few rows for each of a group's near copies, at most the keys of one fingerprint however large it is; the group stays one component."""
    made, real = [], neardup.meeting
    monkeypatch.setattr(neardup, "meeting", lambda *args, **options: made.append(real(*args, **options)) or made[-1])
    counts = []
    for n in (150, 600):
        assert components_of(spark, near_copies(random.Random(4), n)) == [0] * n
        counts.append(sum(m.count() for m in made))
        made.clear()
    assert counts[0] <= 15 * 150 and counts[1] <= 15 * 600


def rows_of_keys(sets: list[np.ndarray], roots: list[int], bucket: list[int]):
    """Rows as keyed() gives them, each with one key."""
    wide = [np.concatenate((neardup.wide_fingerprint(s, 10), neardup.parities(s))) for s in sets]
    folded = [[int(np.bitwise_xor.reduce(w[10 + k :: 2])) for k in range(2)] for w in wide]
    return [(k, [0], i, int(w[1]), len(s), *f, root, w[2:4].tolist()) for i, (k, s, w, f, root) in enumerate(zip(bucket, sets, wide, folded, roots))]


def test_meeting_of_roots(spark):
    """Rows of one root give nothing. Of a large bucket come all members that have a candidate of another root, and no others, whatever its size."""
    rng = np.random.default_rng(6)
    whole = np.unique(rng.integers(-(1 << 62), 1 << 62, 300))
    alike = [np.delete(whole, [3 * i, 3 * i + 1]) for i in range(12)]
    unlike = [np.unique(rng.integers(-(1 << 62), 1 << 62, 300)) for _ in range(8)]
    schema = "at long, bs array<smallint>, id long, sig long, n int, even long, odd long, root long, more array<long>"

    def met(roots: list[int], **options) -> set[tuple[int, int, int]]:
        rows = spark.createDataFrame(rows_of_keys(alike + unlike, roots, [0] * 20), schema)
        return {(min(r.key, 0) if r.key >= -1 else -2, r.a, r.b) for r in neardup.meeting(rows, **options).collect()}

    apart = list(range(100, 108))
    assert met([1] * 12 + apart) == set()
    assert {x for x in met([1] * 11 + [2] + apart) if x[0] == 0} == {(0, i, i) for i in range(12)}
    assert {x for x in met([1] * 11 + [2] + apart) if x[0] == -2} == {(-2, 0, 11)}
    assert {x for x in met([1] * 11 + [2] + apart, small=20)} == {(-1, i, 11) for i in range(11)}
    # a bucket that is too large to be looked through gives all its members
    for options in ({"most": 10}, {"hold": 10}):
        assert {x for x in met([1] * 11 + [2] + apart, **options) if x[0] == 0} == {(0, i, i) for i in range(20)}
    assert met([1] * 11 + [2] + apart, stars=True) == {(-2, 0, 11)}
