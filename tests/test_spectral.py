"""Spectra by joins against dense ones, cuts of all parts at once against a queue, breaks, knees, mixtures, components and combined p-values."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from seqloom.functions import linear
from seqloom.jobs import classes, fitting
from seqloom.jobs.config import ClassConfig, ModelConfig
from seqloom.operators import evaluation, graphs, spectral


def random_graph(seed: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    g = (rng.random((n, n)) < 0.4) * rng.random((n, n)) + 0.01
    g = g + g.T
    np.fill_diagonal(g, 0)
    return g


def edges_of(spark, graphs_: dict[int, np.ndarray]):
    rows = [(p, f"n{i:03d}", f"n{j:03d}", float(w)) for p, g in graphs_.items() for (i, j), w in np.ndenumerate(g) if w]
    return spark.createDataFrame(rows, "part long, src string, dst string, w double").repartition(3)


@pytest.mark.parametrize("kind", ["walk", "plain", "modularity"])
def test_lanczos(spark, kind):
    """Values and first vectors of several parts at once are those of the dense decomposition."""
    made = {0: random_graph(1, 37), 4: random_graph(2, 11), 9: random_graph(3, 2)}
    for dense in (0, 512):
        values, vectors = spectral.eigenvectors(edges_of(spark, made), kind, 3, dense)
        values = {r["part"]: r["values"] for r in values.collect()}
        rows: dict[int, dict] = {}
        for r in vectors.collect():
            rows.setdefault(r["part"], {})[r["node"]] = r["vector"]
        for p, g in made.items():
            want, table = linear.spectrum(g, kind)
            got = np.array([rows[p][n] for n in sorted(rows[p])])
            k = min(3, len(g))
            assert values[p][:k] == pytest.approx(want[:k], abs=1e-9)
            simple = np.diff(want)[: k - 1].min() > 1e-6
            turn = np.sign((got * table[:, : got.shape[1]]).sum(axis=0))
            assert simple and np.abs(got * turn - table[:, : got.shape[1]]).max() < 1e-6


def test_lanczos_of_a_large_part(spark):
    """Two clusters of 300 nodes: the first vectors settle long before the basis spans the graph."""
    rng = np.random.default_rng(4)
    n = 300
    g = (rng.random((n, n)) < np.where(np.equal.outer(np.arange(n) % 2, np.arange(n) % 2), 0.2, 0.01)).astype(float)
    g = np.triu(g, 1) + np.triu(g, 1).T
    values, vectors = spectral.lanczos(edges_of(spark, {0: g}), "walk", 2)
    want, table = linear.spectrum(g, "walk")
    assert len(values[0]) < n and values[0][:2] == pytest.approx(want[:2], abs=1e-8)
    got = {r["node"]: r["vector"][1] for r in vectors.collect()}
    assert np.abs(np.abs([got[f"n{i:03d}"] for i in range(n)]) - np.abs(table[:, 1])).max() < 1e-6


def queue_of_cuts(graph: np.ndarray, names: list[str], config: ClassConfig) -> list[set[str]]:
    """One part after the other."""
    np.fill_diagonal(graph, 0)
    queue, found = [np.arange(len(names))], []
    while queue:
        part = queue.pop(0)
        if len(part) < 2:
            continue
        sub = graph[np.ix_(part, part)]
        label = classes.split_values(linear.spectrum(sub, config.matrix)[1][:, 1], config, config.max_cuts)
        if classes.sum_modularity(sub, label) <= config.mod_threshold:
            continue
        for c in np.unique(label):
            piece = part[label == c]
            found.append({names[i] for i in piece})
            if len(piece) < len(part):
                queue.append(piece)
    return found


@pytest.mark.parametrize("options", [{}, {"sign_cut": False, "max_cuts": 3}, {"mod_threshold": -0.6}])
def test_recursive_cut(spark, options):
    """Clusters and their order are those of a queue, whether parts are cut by tasks or by joins."""
    r = random.Random(5)
    counts = [(f"c{i:02d}", f"s{j}", r.randrange(1, 40)) for i in range(14) for j in range(6) if r.random() < 0.7]
    cells = spark.createDataFrame(counts, "context string, phone string, n long")
    config = ClassConfig(method="recurse", graph_type="cov", **options)
    graph, names, _ = linear.dense(classes.context_graph(cells, config).collect(), "src", "dst", "w")
    want = queue_of_cuts(graph, names, config)
    for dense in (512, 6):
        got: dict[int, set] = {}
        for row in classes.recursive_cut(cells, config, dense).collect():
            got.setdefault(row["cluster"], set()).add(row["context"])
        assert [got[i] for i in sorted(got)] == want
        if options.get("mod_threshold"):
            break


def brute_breaks(x: np.ndarray, k: int) -> float:
    x = np.sort(x)
    return min(sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in itertools.pairwise([0, *cuts, len(x)])) for cuts in itertools.combinations(range(1, len(x)), k - 1))


def test_natural_breaks():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x = np.round(rng.normal(size=int(rng.integers(3, 11))), 1)
        for k, breaks in enumerate(linear.natural_breaks(x, len(x)), 1):
            label = np.searchsorted(np.array(breaks[1:]), np.sort(x))
            cost = sum(((np.sort(x)[label == c] - np.sort(x)[label == c].mean()) ** 2).sum() for c in np.unique(label))
            assert len(breaks) == k + 1 and cost == pytest.approx(brute_breaks(x, k), abs=1e-9)
    big = np.concatenate([rng.normal(c, 0.1, 5000) for c in (0, 5, 9)])
    assert [round(b) for b in linear.natural_breaks(big, 3)[-1][1:]] in ([0, 5, 9],)


def test_knee():
    xs = list(range(1, 11))
    assert linear.knee(xs, [1 - 1 / x for x in xs]) == 3
    assert linear.knee(xs, [float(x) for x in xs]) is None
    # a smaller sensitivity takes the first bend, a large one none
    ys = [0, 0.5, 0.52, 0.54, 0.8, 0.9, 0.95, 0.97, 0.99, 1.0]
    assert linear.knee(xs, ys, 0.5) == 2 and linear.knee(xs, ys, 50) is None


def test_mixture_labels():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.2, 200) for c in (3, 0, 8)])
    label = linear.mixture_labels(x, 5)
    assert (label == np.repeat([1, 0, 2], 200)).mean() > 0.99
    assert len(linear.mixture_labels(np.array([1.0, 1.0, 1.0]), 3)) == 3


def test_graph_components(spark):
    r = random.Random(8)
    pairs = [(f"n{r.randrange(400)}", f"n{r.randrange(400)}", 1.0) for _ in range(230)] + [(f"p{i:03d}", f"p{i + 1:03d}", 0.5) for i in range(150)] + [("x", "y", 0.0), ("z", "z", 1.0)]
    up: dict = {}

    def root(a):
        while up.get(a, a) != a:
            a = up[a]
        return a

    for a, b, w in pairs:
        if w and root(a) != root(b):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {n: root(n) for a, b, w in pairs if w for n in (a, b)}
    found = graphs.components(spark.createDataFrame(pairs, "src string, dst string, w double")).collect()
    assert {x["node"]: x["root"] for x in found} == want and len(found) == len(want)


def test_combined_p(spark):
    rows = [("a", 0.5), ("b", 0.1), ("b", 0.1), ("c", 1.0), ("c", 1.0), ("d", None), ("d", 0.3)] + [("e", 0.999)] * 2000 + [("f", 0.37)] * 900
    got = {r["k0"]: r for r in evaluation.combined_p(spark.createDataFrame(rows, "k0 string, p double"), ["k0"], "p").collect()}
    assert got["a"]["fisher"] == pytest.approx(0.5) and got["b"]["harmonic"] == pytest.approx(0.1) and got["d"]["k"] == 1
    assert got["b"]["fisher"] == pytest.approx(0.01 * (1 - math.log(0.01))) and got["c"]["fisher"] == 1
    assert got["e"]["fisher"] == pytest.approx(1) and 0.3 < got["f"]["fisher"] < 0.7  # a mean of ln p close to -1, though exp(-h) is 0


def test_fit_of_blocks(spark, tmp_path):
    """The weights of the fit over blocks are those of the same steps over one table, whatever the number of blocks."""
    r = random.Random(9)
    cons = [f"c{i}" for i in range(12)]
    viol = [(f"g{i}", c, r.randrange(1, 4)) for i in range(300) for c in r.sample(cons, r.randrange(0, 4))]
    avoided = {g for g, c, _ in viol if c in ("c0", "c1", "c2", "c3")}
    target = [(f"g{i}", 0.001 * r.random() if f"g{i}" in avoided else r.random()) for i in range(300)]
    total = sum(p for _, p in target)
    target = [(g, p / total) for g, p in target]
    t, v = spark.createDataFrame(target, "ngram string, p double"), spark.createDataFrame(viol, "ngram string, con string, v long")
    rows = fitting.profiles(t, v).collect()
    at = {c: i for i, c in enumerate(sorted({c for _, c, _ in viol}))}
    cells = [(i, at[c["con"]], c["v"]) for i, x in enumerate(rows) for c in x["profile"]]
    row, col, value = (np.array([c[k] for c in cells]) for k in range(3))
    config = ModelConfig(n_iter=130)
    table = fitting.Table(row, col, value.astype(float), (len(rows), len(at)))
    want, _ = fitting.descend(table, np.array([float(x["times"]) for x in rows]), np.array([x["p"] for x in rows]), config)
    for size in (10**6, 40):
        got = {x["con"]: x["weight"] for x in fitting.fit(t, v, config, size).collect()}
        assert [got.get(c, 0.0) for c in sorted(at)] == pytest.approx(want, abs=1e-9)
    # two problems in one iteration, broken off after some steps and gone on with
    folder = str(tmp_path / "steps")
    problems = {3: (t, v), 5: (t, v.filter("con < 'c5'"))}
    fitting.fit_all(problems, ModelConfig(n_iter=60), 40, folder)
    assert fitting.kept_steps(spark, folder)[0][3][0] == 49
    both = fitting.fit_all(problems, config, 40, folder).collect()
    got = {x["con"]: x["weight"] for x in both if x["problem"] == 3}
    assert [got.get(c, 0.0) for c in sorted(at)] == pytest.approx(want, abs=1e-9) and {x["problem"] for x in both} == {3, 5}
    assert fitting.fit(t.limit(0), v.limit(0), config).count() == 0
    assert max(want) > 0
