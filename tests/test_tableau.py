"""Tableaux by substring and by token over whole constraint tables, scoring by windows, and the flow of files."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.jobs import model
from seqloom.jobs.config import ModelConfig
from seqloom.operators import grammar

SYMBOLS = ["H", "S", "HS", "T", "TH", ".x", "a(b", "é"]


@pytest.fixture(scope="module")
def made(spark):
    """forms, classes and the constraints of up to two classes over symbols that begin and end each other."""
    r = random.Random(1)
    forms = {".".join(["#", *r.choices(SYMBOLS, k=r.randrange(0, 7)), "#"]) for _ in range(60)} | {"#..#", "", "HS", "H.S.H.S.H"}
    sets = {"H S": ["H", "S"], "HS": ["HS"], "[odd]": [".x", "a(b"], "T TH é": ["T", "TH", "é"], "word": ["#"]}
    classes = spark.createDataFrame(list(sets.items()), "class string, phones array<string>")
    cons = grammar.constraints(classes, 2).cache()
    return spark.createDataFrame([(f,) for f in sorted(forms)], "ngram string").repartition(3).cache(), classes, cons


def test_substring_table(made):
    """One automaton gives what each regex of the table gives, overlaps counted."""
    forms, classes, cons = made
    names = {r["regex"]: r["con"] for r in cons.collect()}
    want = {(r["ngram"], names[r["regex"]]): r["v"] for r in grammar.regex_violations(forms, sorted(names)).collect()}
    got = {(r["ngram"], r["con"]): r["v"] for r in grammar.substring_violations(forms, cons, classes).collect()}
    assert got == want and len(want) > 200
    tokens = {(r["ngram"], r["con"]): r["v"] for r in grammar.token_violations(forms, cons, classes).collect()}
    assert tokens != want


def test_automata_of_blocks(made):
    forms, classes, cons = made
    windows = grammar.substring_windows(forms, grammar.longest_match(cons, classes)).select("window").distinct()
    one, many = (Counter(map(tuple, grammar.substring_starts(windows, cons, classes, block).collect())) for block in (10**6, 7))
    assert one == many and max(one.values()) == 1


@pytest.mark.parametrize("substrings", [False, True])
def test_windowed_harmony(made, substrings):
    """Costs of distinct windows give the harmony of the whole tableau."""
    forms, classes, cons = made
    weights = cons.select("con", (F.length("con") / 7.0).alias("weight")).filter("weight > 1")
    tableau = grammar.substring_violations if substrings else grammar.token_violations
    want = {r["ngram"]: r["harmony"] for r in grammar.harmony(forms, tableau(forms, cons, classes), weights).collect()}
    got = {r["ngram"]: r["harmony"] for r in grammar.windowed_harmony(forms, cons, classes, weights, substrings).collect()}
    assert got == pytest.approx(want) and min(want.values()) < 0


@pytest.mark.parametrize("substrings", [False, True])
def test_places_are_not_broadcast(made, tmp_path, substrings):
    """The places of all forms stay in the executors, however small Spark takes the forms to be; a form without places, null or empty, costs nothing."""
    _, classes, cons = made
    spark = cons.sparkSession
    spark.createDataFrame([("#.H.S.#",), ("#.T.#",), ("",), (None,)], "ngram string").write.parquet(str(tmp_path / "forms"))
    forms = spark.read.parquet(str(tmp_path / "forms"))
    weights = cons.select("con", F.lit(1.0).alias("weight"))
    scores = grammar.windowed_harmony(forms, cons, classes, weights, substrings)
    got = {r["ngram"]: r["harmony"] for r in scores.collect()}
    assert got[""] == got[None] == 0 and got["#.H.S.#"] < got["#.T.#"] < 0
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "Exchange Single" not in plan
    tableau = grammar.substring_violations(forms, cons, classes)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in tableau.split("MapInArrow")[0]


def test_words_are_read_once_for_all_classes(spark):
    """Words lie in files for several tasks, symbols and target are made once, and several problems are judged in one pass."""
    words = spark.createDataFrame([("".join(w), n + 1) for n, w in enumerate(["ab", "ba", "aab", "abc", "cab", "bb"])], "word string, n long").coalesce(1)
    staged = model.staged_words(words)
    assert len(staged.inputFiles()) > 1 and sorted(staged.collect()) == sorted(words.collect())
    sets = {k: model.named_classes(spark.createDataFrame([(p,)], "phones array<string>")) for k, p in ((1, ["a"]), (2, ["b", "c"]))}
    made = model.all_tables(staged, sets)
    assert made[1]["target"] is made[2]["target"]
    forms = model.dotted(words)
    problems = {f"h{k}": (t["cons"], t["classes"], t["cons"].select("con", (F.length("con") / 3.0).alias("weight"))) for k, t in made.items()}
    got = {r["ngram"]: (r["h1"], r["h2"]) for r in model.all_judged(forms, problems).collect()}
    for k, t in made.items():
        alone = model.tables(words, sets[k])
        assert sorted(map(str, alone["violations"].collect())) == sorted(map(str, t["violations"].collect()))
        want = {r["ngram"]: r["harmony"] for r in grammar.harmony(forms, grammar.token_violations(forms, t["cons"], t["classes"]), problems[f"h{k}"][2]).collect()}
        assert {f: h[k - 1] for f, h in got.items()} == pytest.approx(want)


def test_names_of_classes(spark):
    """Names that are equal are refused; sets whose symbols joined would be equal have names of their own."""
    words = spark.createDataFrame([(["H", "S"], 2), (["HS"], 1), (["H", "S", "HS", "S"], 1)], "phones array<string>, n long")
    sets = spark.createDataFrame([(["S", "H"],), (["HS"],)], "phones array<string>")
    t = model.tables(words, model.named_classes(sets))
    assert t["cons"].select("con").distinct().count() == t["cons"].count() == 12
    v = {(r["ngram"], r["con"]): r["v"] for r in t["violations"].collect()}
    assert v[("S.H", "[H S][H S]")] == 1 and ("S.H", "[word][HS]") not in v
    with pytest.raises(ValueError, match="share a name"):
        model.tables(words, sets.select(F.lit("x").alias("class"), "phones"))


def test_syllable_marks(spark, tmp_path):
    """A dot between symbols is a mark only if both kinds of boundaries are; no n-gram holds it as a symbol."""
    (tmp_path / "w").write_text("T . R\tnote\nT R\nT . R\t5\n")
    for syllables, expected in ((True, {"#.T": 3, "T.!": 2, "!.R": 2, "R.#": 3, "T.R": 1}), (False, {"#.T": 3, "T.R": 3, "R.#": 3})):
        words = model.form_words(model.files.read_forms(spark, str(tmp_path / "w"), True, syllables))
        t = model.tables(words, model.named_classes(spark.createDataFrame([(["T"],)], "phones array<string>")), ModelConfig(syll_boundaries=syllables), ("target",))
        seen = {r["ngram"]: r["p"] for r in t["target"].filter("p > 0").collect()}
        total = sum(expected.values())
        assert seen == pytest.approx({k: n / total for k, n in expected.items()})


def test_files_round_trip(spark, tmp_path):
    """Test forms keep their lines, repeats and order; the tab field behind a form is not part of it."""
    r = random.Random(3)
    (tmp_path / "corpus").write_text("".join(" ".join(r.choices(["S", "T", "AE", "R"], k=r.randrange(1, 5))) + "\t7\n" for _ in range(200)))
    (tmp_path / "classes").write_text("S T\tc1\nAE\tc2\nT S\tc3\n")
    tests = [" ".join(r.choices(["S", "T", "AE", "R"], k=r.randrange(1, 4))) for _ in range(60)]
    (tmp_path / "tests").write_text("".join(f"{t}\tx{i}\n" for i, t in enumerate(tests)))
    model.run(spark, *(str(tmp_path / n) for n in ("corpus", "classes", "tests", "out")), ModelConfig(n_iter=20, match="substring"))
    parts = sorted((tmp_path / "out" / "judgements").glob("part-*"))
    lines = [x.split("\t") for p in parts for x in p.read_text(encoding="utf-8").splitlines()]
    assert [form.strip() for form, _ in lines] == tests
    scores = {}
    for form, score in lines:
        assert scores.setdefault(form, score) == score and float(score) <= 0
    assert len(set(scores.values())) > 3
