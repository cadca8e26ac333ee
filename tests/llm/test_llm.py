"""The operators against brute force, round trips and held-out accuracy, and on nulls, empty and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import bytebpe, fingerprint, golay, langid, mixing, neighbours, simhash, substrings, token_counts, token_files, url_filter
from seqloom.llm.components import components
from seqloom.llm.queries import QUERIES
from seqloom.sources import read_table, work_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(seed: int, n: int, kinds: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(2 + k % 6)) for k in (r.randrange(kinds) for _ in range(n)))


LONG = words(1, 3000)
PASSAGE = words(2, 80)
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "  \n\t ", None, "a", 5), (4, LONG, "en", "b", None), (5, words(3, 200) + " " + PASSAGE + " " + words(4, 50), "en", "b", 1),
    (6, PASSAGE + " " + words(5, 100), None, "c", 1), (7, words(6, 60), "fr", "c", 1), (7, words(6, 60), "fr", "c", 1), (8, words(6, 60), "fr", None, 1), (None, "no id 1", None, None, None),
    (9, "<|endoftext|> x  y\n\n</s>é漢👍\x1c", "en", "a", 1), (10, "a" * 700, "en", "a", 1), (11, "123 456", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- 1
def test_url_rules(spark):
    urls = [None, "", "no scheme/en/", "http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/1", "http://b.example.com/de/1", "http://example.com", "http://cheap-pills.example.net/es/4", "http://x.net/fr", "http://net/fr/1", "ftp://h.org?q=/en/"]
    labelled = spark.createDataFrame(url_filter.seed_urls(), "url string, label int")
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["i"]: r for r in url_filter.judge(pages, labelled).select("_row.page_id", "host", "path", "rule", "verdict").withColumnRenamed("page_id", "i").collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/1", "example.com/en/"), ("b.example.com", "/de/1", "com/"), ("example.com", "", None),
        ("cheap-pills.example.net", "/es/4", "net/es/"), ("x.net", "/fr", None), ("net", "/fr/1", "net/fr/"), ("h.org", "", None),
    ]
    assert [got[i]["verdict"] for i in (3, 4, 5, 7, 9)] == ["allow", "block", "allow", "block", "block"]
    assert url_filter.judge(pages.limit(0), labelled).count() == 0


def test_url_model(spark):
    """Batch gradient steps on explicit weights give the same scores, and unseen hosts are told apart."""
    labelled = spark.createDataFrame(url_filter.seed_urls(), "url string, label int")
    weights = url_filter.fit(labelled, buckets=512, steps=50)
    rows = labelled.select("url", "label", url_filter.features(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), 512).alias("x")).collect()
    x = np.array([np.bincount(r["x"], minlength=513) for r in rows], float)
    y = np.array([r["label"] for r in rows], float)
    w = np.zeros(513)
    for _ in range(50):
        w = w * (1 - 0.002 * 0.01) + 0.002 * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    assert np.allclose(w, weights)
    new = spark.createDataFrame([("http://spam-farm.example.org/fr/9",), ("http://blog.casino-win.example.org/de/2",), ("http://m.thering.example.org/fr/9",), ("http://www.ththes.example.org/es/8",)], "url string")
    assert [r["verdict"] for r in url_filter.judge(new, labelled).collect()] == ["block", "block", "allow", "allow"]


def test_url_quality(spark, data):
    """No host of `pages` is in the labelled table; those with a hyphen, the unwanted ones of these tables, are told from the others."""

    def stem(host: str) -> str:
        return re.sub(r"^(www|m|blog)\.", "", host).split(".")[0]

    got = [(stem(r["host"]), r["score"] > 0.7) for r in QUERIES["op1_url_filter"](spark, data).collect()]
    assert not {h for h, _ in got} & {stem(url.split("://")[1]) for url, _ in url_filter.seed_urls()}
    bad, good = ([over for h, over in got if ("-" in h) == kind] for kind in (True, False))
    assert bad and sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


# ---------------------------------------------------------------- 2, 4, 10
def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(bytebpe.default_path())
    folder = work_dir(spark)
    got = token_files.read(spark, folder, token_files.write(docs, folder, parts=3)).orderBy("start").collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc_id, text, *_) in zip(got, rows, strict=True):
        ids = [*hf.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    folder = work_dir(spark)
    assert token_files.read(spark, folder, token_files.write(empty, folder)).count() == 0


@pytest.mark.parametrize("bits, top", [(1, 65535), (2, 2**31)])
def test_control_bytes(bits, top):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 1000):
        values = (rng.random(n) ** 6 * top).astype(np.uint32)
        control, data = token_files.pack(values, bits)
        assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n, bits) == values).all()


ODD = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ß", "　", "\x1c", "\x85", "\xa0", "²", "½", "Ⅷ", "👍", "'s", "'t", "'", "<|endoftext|>", "<|endof", "</s>", "<s>", "▁", "_", "-", "漢字", "한", "0", "123", "\r\n", "\x00", "aaaa", "ing", "tion"]


def odd_texts(n: int) -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(30))) for _ in range(n)] + ["a" * 900, " " * 300, "ab" * 500, ""]


def test_bpe_against_library():
    from tokenizers import Tokenizer

    hf, own = Tokenizer.from_file(bytebpe.default_path()), bytebpe.load(bytebpe.default_path())
    texts = odd_texts(3000)
    lib = token_files.Library(bytebpe.default_path(), most=100)
    for want, text, cached in zip(hf.encode_batch(texts, add_special_tokens=False), texts, lib.encode_all(texts)):
        ids = own.encode(text)
        assert ids.tolist() == want.ids == cached.tolist()
        assert own.decode(ids).decode() == text == hf.decode(want.ids, skip_special_tokens=False)
        assert own.decimals(ids).decode() == ",".join(map(str, want.ids))


def test_every_token_is_one_token():
    own = bytebpe.load(bytebpe.default_path())
    assert all(own.word(b) == [i] for b, i in own.ids.items())


def test_bpe_longest_tokens():
    """The tables by state and by token give the longest token at a place and the longest one that starts it."""
    own = bytebpe.load(bytebpe.default_path())
    for word in (" unbelievably", "zzxqjkvw", "naïveté", "…—x", "antidisestablishment"):
        text = word.encode().decode("latin-1")
        for at in range(len(text)):
            rest = text[at:]
            found = [own.ids[b] for n in range(1, len(rest) + 1) if (b := rest[:n].encode("latin-1")) in own.ids]
            assert own.under[rest[: own.find.longest_prefix(rest)]] == found[-1]
            assert own.shorter[found[-1]] == (found[-2] if len(found) > 1 else -1)


def test_bpe_rows(docs, empty):
    got = by_id(bytebpe.round_trip(docs))
    assert len(got) == len(ROWS)
    for doc_id, n, _, sha in got:
        texts = [t or "" for i, t, *_ in ROWS if i == doc_id]
        assert sha in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    assert bytebpe.encoded(docs).filter("NOT exact OR n_tokens <> size(ids)").count() == 0
    assert bytebpe.round_trip(empty).count() == 0


def test_token_counts(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts(3000)
    assert token_counts.batch_counts(texts, token_counts.load(path), most=1000) == [len(x) for x in sp.encode(texts, num_threads=1)]
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in ROWS)
    assert Counter(tuple(r)[:3] for r in token_counts.counted(docs).collect()) == want
    assert token_counts.counted(docs, limit=10).filter("over_limit <> (n_tokens > 10)").count() == 0
    assert token_counts.counted(empty).count() == 0


# ---------------------------------------------------------------- 3
def removed(texts: list[bytes], length: int) -> list[np.ndarray]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        out.append(cover)
    return out


def check_removal(docs, length, **options):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for (doc_id, t), cover in zip(rows, removed([t for _, t in rows], length)):
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        want[doc_id, len(t), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.digests(docs, length=length, **options).collect()) == want


def test_substrings(docs, empty):
    check_removal(docs, 200)
    assert substrings.digests(empty).count() == 0


@pytest.mark.parametrize("most, chunk", [(2000, 1 << 20), (2, 1 << 20), (2000, 64)])
def test_substrings_of_small_alphabet(spark, most, chunk):
    """Many overlapping repeats, periodic texts and collections with one anchor; also when all of these are too large,
    and when texts are longer than a chunk."""
    r = random.Random(3)
    core = "".join(r.choice("ab") for _ in range(60))
    texts = [core[a:z] * k + "".join(r.choice("ab") for _ in range(r.randrange(80))) for a in (0, 7) for z in (20, 41, 60) for k in (1, 2, 5)] + ["a" * 90, "ab" * 70, core, core]
    docs = table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    check_removal(docs, 24, gram=8, most=most, chunk=chunk, slice_windows=5)


def test_substring_texts(docs):
    got = {(r["doc_id"], r["text"]) for r in substrings.deduplicated(docs).collect()}
    assert (1, None) in got and (4, LONG) in got and (7, "") in got
    assert substrings.deduplicated(docs.withColumn("spans", F.lit(1)).withColumn("body", F.lit(2))).columns == [*docs.columns, "spans", "body"]


# ---------------------------------------------------------------- 5
def phrases(text: str) -> set[str]:
    out, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in out:
            end += 1
        if end > len(text):
            break
        out.add(text[at:end])
        at = end
    return out


def test_phrases():
    for text in ["", "a", "aaaaaaa", "abababab", LONG[:2000], "é漢👍" * 30]:
        seen: set[str] = set()
        end, starts = fingerprint.parse(text, 0, seen)
        assert seen == phrases(text) and len(starts) == len(seen) and end <= len(text)


def test_fingerprints(docs, empty):
    got = fingerprint.edits(docs, parts=3).collect()
    assert len(got) == len(ROWS)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t, *_ in rows]
    found = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for k, (r, text) in enumerate(zip(found, texts)):
        follower = texts[(k + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 4] + follower[: len(text) // 4]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.fingerprint(text) and r["edited_fingerprint"] == fingerprint.fingerprint(edited)
        for other, near in ((edited, r["near_edited"]), (follower, r["near_next"])):
            a, b = phrases(text), phrases(other)
            assert 0 <= near <= 1 and abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert fingerprint.edits(empty).count() == 0


# ---------------------------------------------------------------- 6
def test_mix(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and mixing.mix(empty).count() == 0
    size = {(r["doc_id"], r["size"]) for r in rows}
    assert (1, 0) in size and (3, 0) in size and (4, 3000) in size
    sources = {r["source"]: r for r in rows}
    total = sum(r["size"] for r in rows)
    assert sum(r["target"] for r in sources.values()) == pytest.approx(min(total, sum(3 * r["source_size"] for r in sources.values())))
    for s, one in sources.items():
        mine = [r for r in rows if r["source"] == s]
        assert one["source_size"] == sum(r["size"] for r in mine) and one["target"] <= 3 * one["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in mine) - one["target"]) <= max(r["size"] for r in mine)
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    assert by_id(mixing.mix(docs)) == by_id(mixing.mix(docs.repartition(5)))
    whole = Counter(r["doc_id"] for r in mixing.mixed_documents(docs.withColumn("h", F.lit(1))).collect())
    assert whole == Counter({i: n for i in {r["doc_id"] for r in rows} if (n := sum(r["epochs"] for r in rows if r["doc_id"] == i))})


def test_mix_of_repeated_rows(spark):
    """Rows without an id, and equal rows, are taken apart."""
    text = " ".join(["word"] * 10)
    rows = [(None, f"{text} {i % 25}", None, "a", 1) for i in range(50)] + [(5, text, None, "b", 1)] * 400 + [(i, text, None, "c", 1) for i in range(10, 110)]
    docs = table(spark, rows)
    for source, one in {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}.items():
        assert abs(one["taken"] - one["target"]) <= 11, source
    assert by_id(mixing.mix(docs)) == by_id(mixing.mix(docs.repartition(7)))
    assert mixing.mixed_documents(docs).count() == mixing.mix(docs).agg(F.sum("epochs")).first()[0]


def test_targets(spark):
    """Water-filling by hand: the first two stop at three times their size."""
    sizes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 97)], "source string, size long")
    got = {r["source"]: (r["target"], r["epochs"]) for r in mixing.source_targets(sizes, (1, 2, 3), 3).collect()}
    assert got == {"a": (3.0, 3), "b": (6.0, 3), "c": (91.0, 0)}


# ---------------------------------------------------------------- 7
def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))
    v[100:140] = v[99]
    rows = [(i, x.astype(float).tolist()) for i, x in enumerate(v)] + [(5001, None), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [1.0]), (5005, [None] * 24), (None, [1.0] * 24), (0, v[0].tolist())]
    vectors = neighbours.usable(spark.createDataFrame(rows[:-2], "vec_id long, embedding array<double>"))
    assert vectors.count() == 3001
    got = neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"), floor=200, shard_rows=1500).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 3000, 20):
        scores = v @ v[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:20]
        assert sorted(found[q]) == list(range(1, 21))
        hits += len(set(best.tolist()) & {i for i, _ in found[q].values()})
        assert all(s == pytest.approx(float(v[i] @ v[q])) for i, s in found[q].values())
    assert hits / (20 * 150) >= 0.9
    few = vectors.filter("vec_id < 5")
    assert neighbours.nearest(few, few.filter("vec_id = 0")).count() == 4
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Every row but the query's own: repeated ids and rows, null ids, other lengths; equal vectors have equal scores."""
    rng = np.random.default_rng(1)
    one, two, other = (rng.normal(size=40).tolist() for _ in range(3))
    rows = [(0, one), (0, one), (20, two), (20, other), (7, one), (8, one), (None, one), (3, [1.0, 2.0]), (40, [2.0, 1.0]), *[(i, rng.normal(size=40).tolist()) for i in range(101, 119)]]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    want = Counter()
    for at, (q, v) in enumerate(rows):
        if q is not None and q % 20 == 0:
            scores = [(-float((np.array(v) * np.array(w)).sum()), float("inf") if i is None else i) for k, (i, w) in enumerate(rows) if k != at and len(w) == len(v)]
            want.update((q, r + 1, None if i == float("inf") else i, -s) for r, (s, i) in enumerate(sorted(scores)[:20]))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


# ---------------------------------------------------------------- 8
def test_forward_backward():
    """Against the sum over all labellings."""
    from itertools import product

    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    post, pairs = langid.forward_backward(scores, np.array([4, 3]), move)
    want, want_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for lo, n in ((0, 4), (4, 3)):
        z, part, both = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in product(range(3), repeat=n):
            p = np.exp(sum(scores[lo + t, y[t]] for t in range(n)) + sum(move[y[t], y[t + 1]] for t in range(n - 1)))
            z += p
            part[np.arange(n), y] += p
            for t in range(n - 1):
                both[y[t], y[t + 1]] += p
        want[lo : lo + n], want_pairs = part / z, want_pairs + both / z
    assert np.allclose(post, want) and np.allclose(pairs, want_pairs)


def test_language(spark, data, docs, empty):
    real = read_table(spark, data, "documents")
    model = langid.fitted(real)
    out = langid.predict(real, model).withColumn("held", langid.held_out(F.col("doc_id"))).filter("held AND lang IS NOT NULL").collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) >= 0.9
    signs = spark.createDataFrame([(1, "m\u00b2"), (2, "x\u00bd y\u00b2"), (3, "\u00b2 \u00bd 4_")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.predict(signs, model).orderBy("doc_id").collect()] == [False, False, True]
    odd = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3, 11)] == ["und"] * 4 and odd[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert langid.predict(empty, langid.fitted(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    mixed = real.filter("lang = 'en'").first()["text"][:200] + " " + real.filter("lang = 'de'").first()["text"][:200]
    split = langid.LETTERS.findall(mixed.lower())
    at, scores = langid.word_scores(split, model)
    best = langid.forward_backward(scores[at], langid.runs(np.array([len(split)]), 64), model.move)[0].argmax(axis=1)
    assert {model.labels[b] for b in best[:10]} == {"en"} and {model.labels[b] for b in best[-10:]} == {"de"}


# ---------------------------------------------------------------- 9
def slow_fingerprint(text: str | None, n: int) -> int:
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 400)
    for errors in (0, 1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(23, errors, replace=False)) for _ in x], np.int64)
        for a, b in zip(golay.segment_keys(x), golay.segment_keys(x ^ flips)):
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_links_are_complete(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base} | {int(b) ^ sum(1 << int(k) for k in rng.choice(64, e, replace=False)) for b in base for e in (1, 2, 3, 4, 5, 6) for _ in range(4)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(simhash.bucketed(df), 4)).collect()}
    forest = simhash.Forest()
    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 4]:
            forest.joins(int(x), int(y))
    name = lambda x: got.get(int(np.uint64(x).view(np.int64)), int(np.uint64(x).view(np.int64)))
    pairs = {(forest.root(int(x)), name(x)) for x in fps}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["fp"] % (1 << 64) in {slow_fingerprint(t, 4) for i, t, *_ in ROWS if i == r["doc_id"]}
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[7] == of[8] == 7 and of[4] == 4
    kept = Counter(r["doc_id"] for r in simhash.near_deduplicated(docs).collect())
    assert kept[7] == 1 and kept[8] == 0 and kept[1] == 1 and kept[2] == 0 and kept[4] == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (5, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {i: 0 for i in range(31)} | {50: 50, 70: 50, 100: 50}
    assert components(edges.limit(0)).count() == 0


# ---------------------------------------------------------------- queries and pipeline
def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = read_table(spark, data, "documents")
    rows = docs.count()
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES:
        path = work_dir(spark)
        f(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_dedup":
            texts = [r["text"] for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts)) < rows
        if name == "substring_dedup":
            left = [r["text"].encode() for r in docs.select("text").collect()]
            assert docs.filter("n_chars <> length(text)").count() == 0 and sum(map(len, left)) > 0
    assert docs.filter("NOT exact").count() == 0 and docs.count() > 0.5 * rows
