"""Discovery of overlapping symbol classes: contexts are counted, and their graph is decomposed and cut, in Spark.

Eigenvalues of a whole graph, as many as were found, reach the driver; the graph and its vectors don't. The KLD graph has a row for each
pair of contexts, so graphs.kld_similarity checks their number.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import linear
from seqloom.jobs.config import ClassConfig
from seqloom.operators import association, graphs, sequences, spectral
from seqloom.sources import stage
from seqloom.sources import text as files

#: Most eigenvectors that are used as coordinates.
MOST_EMBEDDED = 64


def context_graph(cells: DataFrame, config: ClassConfig) -> DataFrame:
    if config.graph_type == "KLD":
        return graphs.kld_similarity(cells, config.smoothing)
    return graphs.reflected(graphs.one_mode(cells)) if config.graph_type == "one-mode" else graphs.covariance(cells)


def as_part(graph: DataFrame) -> DataFrame:
    """The edges of a whole graph as those of one part."""
    return graph.select(F.lit(0).cast("long").alias("part"), "src", "dst", F.col("w").cast("double").alias("w"))


def embedded(vectors: DataFrame, k: int) -> DataFrame:
    """context, features: the eigenvectors 1 to k at each context."""
    return vectors.select(F.col("node").alias("context"), array_to_vector(F.slice("vector", 2, k)).alias("features"))


def kmeans_cut(points: DataFrame, k: int, seed: int) -> tuple[DataFrame, float]:
    """context, cluster and the fit's BIC."""
    model = KMeans(k=k, seed=seed, maxIter=100).fit(points)
    bic = linear.spherical_bic(np.array(model.summary.clusterSizes), model.summary.trainingCost, len(model.clusterCenters()[0]))
    return model.transform(points).select("context", F.col("prediction").alias("cluster")), bic


def spectral_cut(cells: DataFrame, config: ClassConfig) -> DataFrame:
    """context, cluster: k-means on the eigenvectors before the widest gap, or with the k = 5, 7, ... of the best BIC.

    The gap is looked for among the eigenvalues that the decomposition gives: all of up to spectral.DENSE contexts, the lowest ones of more.
    """
    graph = stage(as_part(context_graph(cells, config)))
    values, vectors = spectral.eigenvectors(graph, config.matrix, MOST_EMBEDDED + 1)
    values, vectors = np.array(values.first()["values"]), stage(vectors)
    size = vectors.count()
    if config.eigengap:
        k = min(linear.eigengap(values, config.min_embs), size, MOST_EMBEDDED)
        points = embedded(vectors, k).cache()
        return kmeans_cut(points, k, config.seed)[0] if k > 1 else points.select("context", F.lit(0).alias("cluster"))
    fits = [kmeans_cut(embedded(vectors, k).cache(), k, config.seed) for k in range(5, min(size, MOST_EMBEDDED + 1), 2)]
    if not fits:
        raise ValueError("the sweep over k starts at 5 and needs more than 5 contexts")
    return max(fits, key=lambda f: f[1])[0]


def split_values(values: np.ndarray, config: ClassConfig, most: int) -> np.ndarray:
    """Parts of one vector of at least two values: by sign, by a mixture, or by natural breaks with the number of classes, `most` at most, at the knee of their fit."""
    if config.sign_cut:
        return (values > 0).astype(int)
    if not config.use_jenks:
        return linear.mixture_labels(values, most)
    if len(values) == 2:
        return np.array([0, 1])
    breaks = linear.natural_breaks(values, max(2, min(most, len(values) - 1)))
    fits = [0.0, *[linear.variance_fit(values, b) for b in breaks[1:]]]
    k = int(linear.knee(list(range(1, len(fits) + 1)), fits) or 2)
    return linear.classify(values, breaks[k - 1])


def split(values: DataFrame, config: ClassConfig, most: int) -> DataFrame:
    """part, node, label of the values (part, node, v): each part by itself, a number a node in one task."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        return rows.assign(label=split_values(rows["v"].to_numpy(), config, most))[["part", "node", "label"]]

    kinds = dict(values.dtypes)
    if config.sign_cut:
        return values.select("part", "node", (F.col("v") > 0).cast("long").alias("label"))
    return values.groupBy("part").applyInPandas(each, f"part {kinds['part']}, node {kinds['node']}, label long")


def sum_modularity(graph: np.ndarray, label: np.ndarray) -> float:
    """graphs.modularity's sum_form of a dense graph."""
    total, d = graph.sum(), graph.sum(axis=1)
    same = label[:, None] == label[None, :]
    return float((graph[same].sum() - ((d[:, None] + d[None, :]) / 2)[same].sum() / total) / total) if total else 0.0


def whole_cuts(edges: DataFrame, config: ClassConfig) -> DataFrame:
    """part, path, node: all pieces of all cuts below parts that one task can hold (spectral.DENSE nodes); `path` has the labels from the part down."""
    axis = 0 if config.mod_matrix else 1

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate((rows["src"], rows["dst"])).astype(object), return_inverse=True)
        graph = np.zeros((len(names), len(names)))
        np.add.at(graph, (at[: len(rows)], at[len(rows) :]), rows["w"])
        queue, found = [((), np.arange(len(names)))], []
        while queue:
            path, part = queue.pop(0)
            if len(part) < 2:
                continue
            sub = graph[np.ix_(part, part)]
            label = split_values(linear.spectrum(sub, config.matrix)[1][:, axis], config, config.max_cuts)
            if sum_modularity(sub, label) <= config.mod_threshold:
                continue
            for c in np.unique(label):
                piece = part[label == c]
                found += [(rows["part"].iloc[0], [*path, int(c)], names[i]) for i in piece]
                if len(piece) < len(part):
                    queue.append(((*path, int(c)), piece))
        return pd.DataFrame(found, columns=["part", "path", "node"])

    kinds = dict(edges.dtypes)
    return edges.select("part", "src", "dst", "w").groupBy("part").applyInPandas(solve, f"part long, path array<int>, node {kinds['src']}")


def recursive_cut(cells: DataFrame, config: ClassConfig, dense: int = spectral.DENSE) -> DataFrame:
    """context, cluster: every part of every cut, from the second-lowest eigenvector; parts that don't shrink end.

    All parts of a level are cut at once. Those of at most `dense` nodes are cut down to their ends by a task each; larger ones are decomposed,
    split and judged by joins and sums, and their pieces make the next level. Clusters are numbered as a queue would: level by level, by the parts they come from.
    """
    graph = stage(context_graph(cells, config).filter("src <> dst"))
    nodes = cells.select(F.col("context").alias("node")).distinct()
    none = F.array().cast("array<int>")
    cut = stage(nodes.select(F.lit(0).cast("long").alias("part"), none.alias("path"), "node"))
    found = nodes.limit(0).select(none.alias("path"), "node")
    axis = 0 if config.mod_matrix else 1
    while True:
        sizes = cut.groupBy("part").agg(F.count("*").alias("size")).filter("size > 1")
        cut = stage(cut.join(sizes, "part"))
        if cut.isEmpty():
            break
        paths = stage(cut.select("part", "path").distinct())
        small = spectral.symmetric(spectral.in_parts(graph, cut.filter(F.col("size") <= dense)))
        ends = whole_cuts(small, config).join(paths.withColumnRenamed("path", "above"), "part").select(F.concat("above", "path").alias("path"), "node")
        found = found.unionByName(stage(ends))
        cut = cut.filter(F.col("size") > dense)
        if cut.isEmpty():
            break
        edges = stage(spectral.in_parts(graph, cut))
        _, vectors = spectral.eigenvectors(edges, config.matrix, axis + 1, dense)
        labels = stage(split(vectors.select("part", "node", F.get("vector", F.lit(axis)).alias("v")), config, config.max_cuts))
        judged = graphs.part_modularity(edges, labels).filter(F.col("sum_form") > config.mod_threshold).select("part")
        pieces = labels.join(cut, ["part", "node"]).join(judged, "part").withColumn("path", F.concat("path", F.array(F.col("label").cast("int"))))
        names = pieces.groupBy("path").agg(F.count("*").alias("own")).withColumn("id", F.row_number().over(Window.orderBy("path")).cast("long"))  # a row a piece
        rows = stage(pieces.join(names, "path").select(F.col("id").alias("part"), "path", "node", "own", "size"))
        found = found.unionByName(rows.select("path", "node"))
        cut = rows.filter("own < size").select("part", "path", "node")
    found = stage(found)
    order = found.select("path").distinct().withColumn("cluster", F.row_number().over(Window.orderBy(F.size("path"), "path")) - 1)  # a row a cluster
    return found.join(order, "path").select(F.col("node").alias("context"), "cluster")


def scored(cells: DataFrame) -> DataFrame:
    """The count table with PPMI scores for counts."""
    return stage(association.ppmi(cells).filter("ppmi > 0").withColumnRenamed("ppmi", "n"))


def discover(cells: DataFrame, config: ClassConfig = ClassConfig()) -> DataFrame:
    """phones, contexts: the distinct symbol classes, each with the contexts of the first cluster that gave it."""
    cells = scored(cells) if config.PMI else cells
    cut = spectral_cut(cells, config) if config.method == "spectral" else recursive_cut(cells, config)
    classes = association.symbols_of_contexts(cells, cut, config.PPMI_threshold)
    return classes.groupBy("phones").agg(F.min_by("contexts", "cluster").alias("contexts"))


def symbol_axes(cells: DataFrame, config: ClassConfig = ClassConfig()) -> DataFrame:
    """phones: symbols clustered along each of the eigenvectors before the widest gap (the first one at least) of their own graph, one axis at a time.

    With natural breaks the number of clusters of an axis is the knee over all numbers; a mixture has max_clusters components at most.
    """
    turned = cells.select(F.col("phone").alias("context"), F.col("context").alias("phone"), "n")
    graph = stage(as_part(context_graph(turned, config)))
    values, vectors = spectral.eigenvectors(graph, config.matrix, MOST_EMBEDDED + 1)
    axes = linear.eigengap(np.array(values.first()["values"]), config.min_embs) if config.eigengap else config.num_embs
    rows = vectors.select("node", F.posexplode("vector").alias("part", "v")).filter((F.col("part") > 0) & (F.col("part") < max(axes, 2)))
    size = vectors.count()
    by = replace(config, sign_cut=False)
    labels = split(rows.select("part", "node", "v"), by, size if config.use_jenks else config.max_clusters)
    return labels.groupBy("part", "label").agg(F.array_join(F.array_sort(F.collect_set("node")), " ").alias("phones")).select("phones").distinct()


def run(spark: SparkSession, corpus_file: str, out: str, config: ClassConfig = ClassConfig()) -> None:
    """A corpus file in, the classes with their contexts in the folder `out`; the settings' window and separate_lens shape the contexts, a dot is a neighbour but no symbol."""
    words = files.read_words(spark, corpus_file).filter("value <> ''").groupBy("phones").agg(F.count("*").alias("n"))
    cells = stage(sequences.word_contexts(words, config.window, config.separate_lens, (".",)))
    files.write_classes(discover(cells, config), out)
