"""Text files, settings, staged tables and streams."""

import json
from datetime import datetime

import pytest

from seqloom.jobs import config
from seqloom.sources import discard, stage, text
from seqloom.streaming import counts


def test_text_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("S T\tx\nS  T R\nK\n")
    forms = [r["form"] for r in text.read_forms(spark, str(tmp_path / "w.txt")).collect()]
    assert forms == ["#.S.T.#.", "#.S.T.R.#.", "#.K.#."]
    assert {r["phone"] for r in text.read_inventory(spark, str(tmp_path / "w.txt")).collect()} == {"S", "T", "R", "K", "x"}
    assert [r["phone"] for r in text.read_phone_file(spark, str(tmp_path / "w.txt")).collect()] == ["S", "T", "x"]
    assert "#.!.K.!.#." in {r["form"] for r in text.read_test_forms(spark, str(tmp_path / "w.txt")).collect()}
    (tmp_path / "r.csv").write_bytes(b"a,b\rx,1\ry,2\r")
    assert text.read_ratings(spark, str(tmp_path / "r.csv")).count() == 2
    (tmp_path / "p.tsv").write_text("front\tV:hi,lo\n")
    assert text.read_projections(spark, str(tmp_path / "p.tsv")).first()["features"] == ["hi", "lo"]


def test_class_and_grammar_files(spark, tmp_path):
    rows = spark.createDataFrame([(["b", "a"], ["x"]), (["a", "b"], ["y"])], "phones array<string>, contexts array<string>")
    text.write_classes(rows, str(tmp_path / "c"))
    assert [r["phones"] for r in text.read_classes(spark, str(tmp_path / "c")).collect()] == [["a", "b"]]
    text.write_grammar(spark.createDataFrame([("(a)", 0.5), ("(b)", 0.0), ("(c)", 2.0)], "regex string, weight double").coalesce(1), str(tmp_path / "g"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()] == ["(c)\t2.000", "(a)\t0.500"]
    text.write_judgements(spark.createDataFrame([("#.a.b.#.", -1.0)], "form string, harmony double"), str(tmp_path / "j"))
    assert text.read_judgements(spark, str(tmp_path / "j")).first()["score"] == -1.0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"class": {"window": 3, "unweighted": 0, "separate_lens": 0}, "phonotactic": {"N": 3}}))
    kinds, model = config.load(str(tmp_path / "c.json"))
    assert kinds.window == 3 and kinds.separate_lens is False and model.N == 3 and model.match == "substring"
    with pytest.raises(ValueError):
        config.ClassConfig(method="louvain")


def test_stage(spark):
    kept = stage(spark.range(3))
    assert kept.count() == 3
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    discard(kept)
    import os

    assert not os.path.exists(folder)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "a"), (datetime(2024, 1, 1, 0, 6), "a"), (datetime(2024, 1, 1, 3, 0), "b")], "ts timestamp, event_type string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = counts.symbol_counts(stream).writeStream.outputMode("complete").format("memory").queryName("symbol_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["phone"], r["n"]) for r in spark.table("symbol_counts").collect()) == [("a", 2), ("b", 1)]
    spark.createDataFrame([("st",), ("st",)], "word string").write.parquet(str(tmp_path / "w"))
    words = spark.readStream.schema("word string").parquet(str(tmp_path / "w"))
    counts.write_ngrams(words, 2, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["ngram"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"#.s": 2, "s.t": 2, "t.#": 2}
