"""Hand-computed cases of the sequence, association, graph and model operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import linear
from seqloom.jobs import classes, fitting
from seqloom.jobs.config import ClassConfig, ModelConfig
from seqloom.operators import association, corpus, evaluation, grammar, graphs, sequences


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cells(spark, table):
    return spark.createDataFrame([(f"c{i}", f"p{j}", int(n)) for i, row in enumerate(table) for j, n in enumerate(row) if n], "context string, phone string, n long")


def test_bigrams_with_boundaries(spark):
    words = spark.createDataFrame([("st", 1), ("str", 1), ("k", 1)], "word string, n long")
    found = dict(rows(sequences.word_ngram_counts(words, 2)))
    assert found == {"#.s": 2, "s.t": 2, "t.#": 1, "t.r": 1, "r.#": 1, "#.k": 1, "k.#": 1}
    assert rows(sequences.word_ngram_counts(words, 4)) == [("#.s.t.#", 1), ("#.s.t.r", 1), ("s.t.r.#", 1)]


def test_contexts(spark):
    words = spark.createDataFrame([("st", 1), ("str", 1), ("k", 1)], "word string, n long")
    assert sequences.word_contexts(words).agg(F.sum("n")).first()[0] == 24
    one = sequences.word_contexts(spark.createDataFrame([("st", 3)], "word string, n long"))
    assert rows(one.filter("phone = 's'").select("context", "n")) == [("1L<s>", 3), ("1Rt", 3), ("2L<s>", 3), ("2R<e>", 3)]


def test_event_contexts_and_bigrams(spark):
    events = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2), (2, "a", 1, 3), (2, None, 2, 4)], "user_id long, event_type string, ts long, event_id long")
    assert rows(sequences.event_bigram_counts(events)) == [("#.a", 2), ("a.#", 1), ("a.b", 1), ("b.#", 1)]
    assert sequences.event_contexts(events).agg(F.sum("n")).first()[0] == 12


def test_letter_words(spark):
    docs = spark.createDataFrame([("The the, x1y",), (None,), ("",)], "text string")
    assert rows(corpus.letter_words(docs)) == [("the", 2), ("x", 1), ("y", 1)]


def test_ppmi(spark):
    found = {(r["context"], r["phone"]): r["ppmi"] for r in association.ppmi(cells(spark, [[2, 0], [1, 1]])).collect()}
    assert found["c0", "p0"] == pytest.approx(0.287682, abs=1e-6)
    assert found["c1", "p1"] == pytest.approx(0.693147, abs=1e-6)
    assert found["c1", "p0"] == 0


def test_symbols_of_contexts(spark):
    cut = spark.createDataFrame([("c0", 0), ("c1", 1)], "context string, cluster int")
    assert rows(association.symbols_of_contexts(cells(spark, [[2, 0], [1, 1]]), cut, 0.0)) == [(0, "p0", "c0"), (1, "p1", "c1")]


@pytest.mark.parametrize("smoothing, expected", [(1e-12, 0.759836), (1e-4, 0.759859)])
def test_kld(spark, smoothing, expected):
    found = {(r["src"], r["dst"]): r["w"] for r in graphs.kld_similarity(cells(spark, [[1, 1], [3, 1]]), smoothing).collect()}
    assert found["c0", "c1"] == pytest.approx(expected, abs=1e-6)
    assert found["c0", "c0"] == pytest.approx(1)
    assert found["c0", "c1"] == pytest.approx(found["c1", "c0"])


def test_kld_against_dense(spark):
    table = np.array([[5, 0, 2], [0, 3, 1], [4, 4, 0]])
    p = table + 2e-4
    p = p / p.sum(axis=1, keepdims=True)
    kl = (p[:, None] * np.log(p[:, None] / p[None])).sum(axis=2)
    for r in graphs.kld_similarity(cells(spark, table)).collect():
        i, j = int(r["src"][1]), int(r["dst"][1])
        assert r["w"] == pytest.approx(math.exp(-(kl[i, j] + kl[j, i])))


def test_graphs_against_dense(spark):
    table = np.array([[5, 0, 2], [0, 3, 1], [4, 4, 0]])
    cov = table @ table.T

    def dense(df):
        out = np.zeros((3, 3))
        for r in df.collect():
            out[int(r["src"][1]), int(r["dst"][1])] = r["w"]
        return out

    edges = graphs.covariance(cells(spark, table)).cache()
    d = cov.sum(axis=1)
    assert (dense(edges) == cov).all()
    assert np.allclose(dense(graphs.laplacian(edges)), np.diag(d) - cov)
    assert np.allclose(dense(graphs.laplacian(edges, "sym")), (np.diag(d) - cov) / np.sqrt(np.outer(d, d)))
    assert np.allclose(dense(graphs.laplacian(edges, "rw")), (np.diag(d) - cov) / d[:, None])
    assert np.allclose(dense(graphs.edge_normalised(edges)), cov / (d[:, None] + d[None]))
    assert np.allclose(dense(graphs.modularity_matrix(edges)), cov - np.outer(d, d) / (2 * cov.sum()))
    one = np.triu([[sum(a + b for a, b in zip(x, y) if a and b) for y in table] for x in table])
    assert (dense(graphs.one_mode(cells(spark, table))) == one).all()
    assert (dense(graphs.reflected(graphs.one_mode(cells(spark, table)))) == np.maximum(one, one.T)).all()
    coef = {r["node"]: r["coef"] for r in graphs.clustering_coefficients(edges).collect()}
    assert coef["c1"] == pytest.approx(np.linalg.matrix_power(cov, 3)[1, 1] / (d[1] ** 2 - (cov[1] ** 2).sum()))


def test_modularity(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, w long")
    for cut, expected in (((1, 1), 0.0), ((1, 0), -0.5)):
        nodes = spark.createDataFrame(list(zip("ab", cut)), "node string, cluster int")
        assert graphs.modularity(edges, nodes).first()["sum_form"] == pytest.approx(expected)
    label = np.array([1, 0])
    assert classes.sum_modularity(np.array([[0.0, 1], [1, 0]]), label) == pytest.approx(-0.5)


def test_jenks_and_fit():
    breaks = linear.jenks(np.array([1, 2, 10, 11]), 2)
    assert breaks == [1, 2, 11]
    assert linear.classify(np.array([1, 2, 10, 11]), breaks).tolist() == [0, 0, 1, 1]
    assert linear.variance_fit(np.array([1, 2, 10, 11]), breaks) == pytest.approx(81 / 82)
    assert linear.variance_fit(np.array([1, 2, 10, 11]), breaks, skip_first=True) == pytest.approx(81.5 / 82)


def test_spectrum():
    graph = np.array([[1, 0.9, 0, 0], [0.9, 1, 0.1, 0], [0, 0.1, 1, 0.9], [0, 0, 0.9, 1]])
    values, vectors = linear.spectrum(graph)
    assert abs(values[0]) < 1e-9 and values.max() <= 2
    assert len({v > 0 for v in vectors[:2, 1]}) == 1 and (vectors[0, 1] > 0) != (vectors[3, 1] > 0)
    assert linear.spectrum(np.zeros((2, 2)))[0].tolist() == [0, 0]


def test_knee_and_tails():
    assert linear.knee([1, 2, 3, 4], [0, 0.9, 0.95, 1]) == 2
    assert linear.knee([1, 2], [0, 1]) is None
    assert linear.two_sided_normal(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_violations(spark):
    forms = spark.createDataFrame([("b.b.b",), ("s.dh.",), ("#.iy.g.",)], "ngram string")
    found = {(r["ngram"], r["regex"]): r["v"] for r in grammar.regex_violations(forms, [r"(b)[\.](b)", r"(s)[\.](d)", r"(y)[\.](g)"]).collect()}
    assert found == {("b.b.b", r"(b)[\.](b)"): 2, ("s.dh.", r"(s)[\.](d)"): 1, ("#.iy.g.", r"(y)[\.](g)"): 1}
    members = spark.createDataFrame([("B", ["b"]), ("S", ["s"]), ("D", ["d"])], "class string, phones array<string>")
    cons = grammar.constraints(members, 2)
    found = {(r["ngram"], r["con"]): r["v"] for r in grammar.token_violations(forms, cons, members).collect()}
    assert found["b.b.b", "[B][B]"] == 2 and found["b.b.b", "[B]"] == 3 and ("s.dh.", "[S][D]") not in found


@pytest.mark.parametrize("most, expected", [(2, 342), (3, 5256)])
def test_constraint_numbers(spark, most, expected):
    members = spark.createDataFrame([(f"k{i}", [f"p{i}"]) for i in range(18)], "class string, phones array<string>")
    assert grammar.constraints(members, most).count() == expected


def test_complements(spark):
    own = spark.createDataFrame([("A", ["a", "b"]), ("B", ["c"])], "class string, phones array<string>")
    symbols = spark.createDataFrame([("a",), ("b",), ("c",)], "phone string")
    assert rows(grammar.with_complements(own, symbols)) == [("A", ["a", "b"]), ("B", ["c"]), ("word", ["#"])]
    assert grammar.with_complements(own, symbols, singletons=True).count() == 5


def test_step_and_fit(spark):
    target = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "ngram string, p double")
    viol = spark.createDataFrame([("y", "c", 1)], "ngram string, con string, v long")
    zero = spark.createDataFrame([("c", 0.0)], "con string, weight double")
    soft = grammar.softmax(grammar.harmony(target, viol, zero))
    assert grammar.loss(target, soft, zero, 0.001).first()["loss"] == pytest.approx(0.693147, abs=1e-6)
    assert grammar.gradient_step(target, soft, viol, zero, 0.1, 0.001).first()["weight"] == pytest.approx(0.0499)
    w, losses = fitting.descend(fitting.Table(np.array([1]), np.array([0]), np.array([1.0]), (2, 1)), np.ones(2), np.array([1.0, 0.0]), ModelConfig(n_iter=100))
    assert (np.diff(losses) <= 0).all() and w[0] > 1
    fitted = fitting.fit(target, viol, ModelConfig(n_iter=100)).first()
    assert fitted["weight"] == pytest.approx(w[0])


def test_type_target(spark):
    target = spark.createDataFrame([("x", 0.75), ("y", 0.25), ("z", 0.0)], "ngram string, p double")
    assert rows(grammar.type_target(target).select("p")) == [(0.0,), (1.0,), (1.0,)]
    assert rows(grammar.type_target(target, True).select("p")) == [(0.0,), (0.5,), (0.5,)]


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 4), (4, 4)], "x int, y int")
    tau = evaluation.kendall(pairs, F.col("x"), F.col("y")).first()["tau"]
    assert tau == pytest.approx((8 - 1) / 9)
    assert evaluation.pearson(pairs, "x", "y").first()["r"] == pytest.approx(np.corrcoef([1, 2, 3, 4, 4], [1, 3, 2, 4, 4])[0, 1])
    assert evaluation.last_value(pairs, ["x"], "y", "y").count() == 4


def test_classes_are_found(spark):
    """Two kinds of symbols in two kinds of places."""
    table = cells(spark, [[9, 8, 0, 0], [7, 9, 1, 0], [0, 0, 9, 8], [0, 1, 8, 9]])
    found = {r["phones"] for r in classes.discover(table, ClassConfig(method="recurse")).collect()}
    assert {"p0 p1", "p2 p3"} <= found
    spectral = ClassConfig(min_embs=1)
    found = [r["phones"] for r in classes.discover(table, spectral).collect()]
    assert set(" ".join(found).split()) == {"p0", "p1", "p2", "p3"}
    assert sorted(found) == sorted(r["phones"] for r in classes.discover(table, spectral).collect())
    assert {"p0 p1", "p2 p3"} <= {r["phones"] for r in classes.symbol_axes(table, ClassConfig(min_embs=0, max_clusters=2)).collect()}


def test_bic_and_mixture(spark):
    table = cells(spark, [[9, 8, 0, 0], [7, 9, 1, 0], [0, 0, 9, 8], [0, 1, 8, 9], [8, 8, 0, 1], [1, 0, 9, 9], [9, 9, 1, 0]])
    found = classes.discover(table, ClassConfig(eigengap=False)).collect()
    assert found and all(r["phones"] for r in found)
    label = linear.mixture_labels(np.array([0.0, 0.1, 0.05, 5.0, 5.1, 5.05]), 2)
    assert len(set(label[:3])) == len(set(label[3:])) == 1 and label[0] != label[3]
    good, bad = (linear.spherical_bic(np.array([10, 10]), s, 2) for s in (0.1, 10.0))
    assert good > bad and linear.spherical_bic(np.array([1, 1]), 0.0, 1) == -math.inf


def test_agreement(spark):
    ratings = spark.createDataFrame([("a", "no", 1.0), ("a", "no", 3.0), ("b", "no", 4.0), ("c", "yes", 9.0), ("d", "no", 0.5)], "onset string, kind string, rating double")
    scores = spark.createDataFrame([("a", -3.0, 1), ("a", -1.0, 2), ("b", -0.5, 3)], "onset string, score double, line int")
    got = evaluation.agreement(ratings, scores, "onset", "kind", "no", "rating", "score", "line").first()
    assert got["tau"] == pytest.approx(-1 / 3) and got["r"] == pytest.approx(np.corrcoef([2, 4, 0.5], [-1, -0.5, 0])[0, 1])
    assert evaluation.long_form(ratings, ["onset"], ["rating"]).count() == 5
    row = spark.createDataFrame([(["a", "x"],)], "p array<string>")
    assert evaluation.looked_up(row, "p", {"a": 1.5}, "v").first()["v"] == [1.5, None]


def test_kendall_against_all_pairs(spark):
    """Unrounded values, ties and nulls, with blocks of two ranks."""
    rng = np.random.default_rng(3)
    data = [(float(rng.integers(0, 30)), float(round(rng.normal(), 2))) for _ in range(300)] + [(None, 1.0), (2.0, None)]
    got = evaluation.kendall(spark.createDataFrame(data, "x double, y double"), F.col("x"), F.col("y"), block=2).first()
    x, y = np.array(data[:300]).T
    sx, sy = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
    s = (sx * sy).sum() / 2
    assert got["tau"] == pytest.approx(s / np.sqrt((abs(sx).sum() / 2) * (abs(sy).sum() / 2))) and got["n"] == 300
    none = evaluation.kendall(spark.createDataFrame([], "x double, y double"), F.col("x"), F.col("y")).collect()
    assert [r["tau"] for r in none] == [None]


def test_p_values(spark):
    """Tails that tables of the distributions give."""
    assert linear.two_sided_student(2.228, 10) == pytest.approx(0.05, abs=1e-4) and linear.two_sided_student(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert linear.two_sided_student(3.182, 3) == pytest.approx(0.05, abs=1e-4)
    scores = spark.createDataFrame([(0.5, 1.959964, 20)], "tau double, z double, n long")
    assert evaluation.with_p_values(scores).first()["p"] == pytest.approx(0.05, abs=1e-6)


def test_arrays_of_symbols(spark):
    """Symbols of several characters, and syllable marks that are neighbours only."""
    words = spark.createDataFrame([(["S", "TH"], 2), (["K", "!", "S"], 1)], "phones array<string>, n long")
    assert rows(sequences.word_ngram_counts(words, 2)) == [("!.S", 1), ("#.K", 1), ("#.S", 2), ("K.!", 1), ("S.#", 1), ("S.TH", 2), ("TH.#", 2)]
    found = rows(sequences.word_contexts(words, 1, marks=("!",)))
    assert ("1R!", "K", 1) in found and ("1L!", "S", 1) in found and "!" not in {r[1] for r in found}
    assert rows(corpus.inventory(words)) == [("!",), ("K",), ("S",), ("TH",)]


def test_whole_flow_of_files(spark, tmp_path):
    """Files in, grammar and judgements out: forms with what the corpus lacks score lower."""
    from seqloom.jobs import model

    (tmp_path / "words").write_text("S T\nS T R\nK R\nT R\n")
    (tmp_path / "classes").write_text("S K\t1LT\nR\t1LS\n")
    (tmp_path / "tests").write_text("S T\nR S\n")
    model.run(spark, *[str(tmp_path / f) for f in ("words", "classes", "tests")], str(tmp_path / "out"), ModelConfig(n_iter=200))
    scores = {r["value"].split("\t")[0].strip(): float(r["value"].split("\t")[1]) for r in spark.read.text(str(tmp_path / "out" / "judgements")).collect()}
    assert scores["S T"] > scores["R S"]


def test_settings_are_read_or_refused(tmp_path):
    from seqloom.jobs import config

    (tmp_path / "c").write_text('{"class": {"norm_lap": 0, "mod_matrix": 1, "plot_cuts": 0}, "phonotactic": {"N": 2}}')
    assert config.load(str(tmp_path / "c"))[0].matrix == "modularity"
    for text in ('{"class": {"nonsense": 1}}', '{"phonotactic": {"opt": "LBFGS"}}', '{"class": {"mod_matrix": 1}}'):
        (tmp_path / "c").write_text(text)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c"))
