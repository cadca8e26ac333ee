"""Whole jobs on small files, readers and small joins."""

from __future__ import annotations

import json

import pytest

from seqloom.jobs import classes, config, model
from seqloom.operators import corpus, evaluation
from seqloom.sources import text


@pytest.fixture(scope="module")
def corpus_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "words"
    rows = ["T AE K", "T IY . P AE", "K AE T", "P IY K", "S AE . T IY", "P AE T", "K IY", "S IY P", "T AE . S IY K", "AE T"]
    path.write_text("\n".join(rows * 3) + "\n")
    return path


def test_settings_reach_the_counts(spark, corpus_file, tmp_path):
    """window and separate_lens of a settings file shape the contexts of the classes; a mark of syllables is a neighbour and no symbol."""
    seen = {}
    for window, separate in ((1, 1), (2, 0)):
        (tmp_path / "c.json").write_text(json.dumps({"class": {"window": window, "separate_lens": separate, "method": "recurse", "graph_type": "cov"}}))
        kinds, _ = config.load(str(tmp_path / "c.json"))
        out = tmp_path / f"out{window}"
        classes.run(spark, str(corpus_file), str(out), kinds)
        rows = [line.split("\t") for p in out.glob("part-*") for line in p.read_text(encoding="utf-8").splitlines()]
        assert rows and not any("." in phones.split(" ") for phones, _ in rows)
        seen[window] = {c for _, contexts in rows for c in contexts.split(" ")}
    assert all(c[0] == "1" for c in seen[1]) and all(c[0] in "LR" for c in seen[2])


def test_repetitions(spark, corpus_file, tmp_path):
    """One row a seed, with p-values, and the steps of the fit kept."""
    words = text.read_words(spark, str(corpus_file)).groupBy("phones").count().withColumnRenamed("count", "n")
    forms = model.dotted(words)
    ratings = forms.selectExpr("ngram", "length(ngram) AS rating")
    kinds = config.ClassConfig(window=1, min_embs=1)
    got = model.repeated(words, forms, ratings, [1, 2], kinds, config.ModelConfig(n_iter=30)).orderBy("seed").collect()
    assert [r["seed"] for r in got] == [1, 2]
    assert all(r["classes"] > 1 and -1 <= r["tau"] <= 1 and 0 <= r["tau_p"] <= 1 and -1 <= r["r"] <= 1 and 0 <= r["r_p"] <= 1 for r in got)


def test_readers_and_merges(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("phone\thigh\nIY\t+\nAE\t-\n")
    assert [r["phone"] for r in text.read_features(spark, str(tmp_path / "f.tsv")).collect()] == ["IY", "AE"]
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 3.0)], "onset string, mean double")
    b = spark.createDataFrame([("y", 5.0), ("z", 1.0)], "onset string, mean double")
    rows = sorted(map(tuple, evaluation.merged(a, b, "onset").collect()))
    assert rows == [("y", 2.0, 5.0), ("y", 3.0, 5.0)]
    assert evaluation.merged(a, b, "onset").columns == ["onset", "mean_x", "mean_y"]
    marks = spark.createDataFrame([("<s>",), ("a",), (".",), ("x<y",)], "phone string")
    assert {r["phone"] for r in corpus.without_specials(marks).collect()} == {"a", "."}
    means = evaluation.kind_means(spark.createDataFrame([("u", "x", 1.0), ("u", "x", 3.0), ("a", "x", 9.0)], "kind string, onset string, rating double"), "kind", "u", "onset", "rating")
    assert [tuple(r) for r in means.collect()] == [("x", 2.0)]


def test_lines_keep_their_order(spark, tmp_path):
    """Lines order by file and place, whatever the splits."""
    (tmp_path / "lines").mkdir()
    want = []
    for name in ("a", "b"):
        rows = [f"{name}{i} {'x' * (i % 50)}" for i in range(3000)]
        (tmp_path / "lines" / name).write_text("\n".join(rows) + "\n")
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = [r["value"] for r in text.read_lines(spark, str(tmp_path / "lines")).orderBy("line").select("value").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
