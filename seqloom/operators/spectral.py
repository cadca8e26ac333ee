"""Spectra of the parts of a graph: edges (part, src, dst, w), symmetric after averaging both directions.

Two ways give the same vectors. A part of at most DENSE nodes is decomposed by one task, as a dense matrix of bounded size.
Larger parts go through a block Lanczos iteration, all of a batch at once: the product of the matrix with a block of vectors is a
join of edges and vectors and a sum, products of vectors are summed in the tasks, and only matrices of the projected problem,
as wide as the basis, reach the driver. The graph never does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import linear
from seqloom.sources import discard, stage

#: Most nodes of a part that one task decomposes, and most parts of one iteration.
DENSE, BATCH = 512, 64


def symmetric(edges: DataFrame) -> DataFrame:
    """part, src, dst, w: the mean of both directions; every node has a diagonal entry, 0 if it has no other."""
    half = edges.select("part", "src", "dst", (F.col("w").cast("double") / 2).alias("w"))
    turned = half.select("part", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    loops = edges.select("part", F.explode(F.array("src", "dst")).alias("src")).distinct().select("part", "src", F.col("src").alias("dst"), F.lit(0.0).alias("w"))
    return half.unionByName(turned).unionByName(loops).groupBy("part", "src", "dst").agg(F.sum("w").alias("w"))


def in_parts(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """part, src, dst, w: edges between nodes of one part (cut: part, node); nodes without such an edge keep a loop of weight 0."""
    a, b = (cut.select(F.col("part").alias(f"p_{c}"), F.col("node").alias(c)) for c in ("src", "dst"))
    inside = edges.join(a, "src").join(b, "dst").filter("p_src = p_dst").select(F.col("p_src").alias("part"), "src", "dst", F.col("w").cast("double").alias("w"))
    return inside.unionByName(cut.select("part", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w")))


def dense_vectors(edges: DataFrame, kind: str, k: int) -> DataFrame:
    """part, node, vector (its entries of the first k eigenvectors), values (of the part, on the row of its first node), for parts that one task can hold."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate((rows["src"], rows["dst"])).astype(object), return_inverse=True)
        graph = np.zeros((len(names), len(names)))
        np.add.at(graph, (at[: len(rows)], at[len(rows) :]), rows["w"])
        values, vectors = linear.spectrum(graph, kind)
        first = [values.tolist()] + [None] * (len(names) - 1)
        return pd.DataFrame({"part": rows["part"].iloc[0], "node": names, "vector": list(vectors[:, :k]), "values": first})

    kinds = dict(edges.dtypes)
    return edges.select("part", "src", "dst", "w").groupBy("part").applyInPandas(solve, f"part {kinds['part']}, node {kinds['src']}, vector array<double>, values array<double>")


def matrix(edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The symmetric matrix of linear.spectrum without its rank-one term (part, src, dst, w), and its nodes (part, node, d, scale: what
    vectors are multiplied by in the end, rank: the node's factor in the rank-one term)."""
    edges = stage(symmetric(edges))
    nodes = edges.groupBy("part", F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    total = nodes.groupBy("part").agg(F.sum("d").alias("total"))
    half = F.when(F.col("d") > 0, 1 / F.sqrt("d"))
    scale = F.coalesce(half, F.lit(1.0)) if kind == "walk" else F.lit(1.0)
    rank = F.coalesce(F.try_divide(F.col("d"), F.sqrt(2 * F.col("total"))), F.lit(0.0)) if kind == "modularity" else F.lit(0.0)
    nodes = stage(nodes.join(total, "part").select("part", "node", "d", scale.alias("scale"), rank.alias("rank"), F.coalesce(half, F.lit(0.0)).alias("half")))
    if kind == "walk":
        a, b = (nodes.select("part", F.col("node").alias(c), F.col("half").alias(f"h_{c}")) for c in ("src", "dst"))
        off = edges.join(a, ["part", "src"]).join(b, ["part", "dst"]).select("part", "src", "dst", (-F.col("w") * F.col("h_src") * F.col("h_dst")).alias("w"))
        loops = nodes.select("part", F.col("node").alias("src"), F.col("node").alias("dst"), (F.col("d") > 0).cast("double").alias("w"))
    else:
        off = edges.select("part", "src", "dst", (-F.col("w")).alias("w"))
        loops = nodes.select("part", F.col("node").alias("src"), F.col("node").alias("dst"), (F.col("d") if kind == "plain" else F.lit(0.0)).alias("w"))
    whole = stage(off.unionByName(loops).groupBy("part", "src", "dst").agg(F.sum("w").alias("w")).filter("w <> 0"))
    discard(edges)
    return whole, nodes


def as_matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix, a row a row."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def by_part(batch: pa.RecordBatch) -> list[tuple[object, np.ndarray]]:
    """The rows of each part of a batch."""
    parts = batch.column(0).to_pylist()
    found: dict = {}
    for i, p in enumerate(parts):
        found.setdefault(p, []).append(i)
    return [(p, np.array(at)) for p, at in found.items()]


def summed(rows: DataFrame, each: Callable[..., np.ndarray]) -> dict:
    """rows: part, then array columns. The matrices that `each` gives for a part's rows, summed by part: what reaches the driver is a matrix a task and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            columns = [as_matrix(c) for c in batch.columns[1:]]
            for p, at in by_part(batch):
                new = each(p, *[c[at] for c in columns])
                found[p] = found[p] + new if p in found else new
        cells = pa.array([m.ravel() for m in found.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), kind), cells, pa.array([m.shape[1] for m in found.values()], pa.int32())], ["part", "m", "width"])

    kind = pa.int64()
    out: dict = {}
    for r in rows.mapInArrow(run, "part long, m array<double>, width int").collect():
        new = np.array(r["m"]).reshape(-1, r["width"])
        out[r["part"]] = out[r["part"]] + new if r["part"] in out else new
    return out


def times(edges: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """part, node, y: the matrix (edges) times vectors (part, node, x: array of `width`), by a join and a sum."""
    met = edges.join(vectors.select("part", F.col("node").alias("dst"), "x"), ["part", "dst"])
    sums = [F.sum(F.col("w") * F.get("x", F.lit(i))).alias(f"y{i}") for i in range(width)]
    return met.groupBy("part", F.col("src").alias("node")).agg(*sums).select("part", "node", F.array(*[f"y{i}" for i in range(width)]).alias("y"))


def directions(gram: np.ndarray, room: int, block: int) -> np.ndarray:
    """A matrix that turns 2 * block candidates with this Gram matrix into at most `room` orthonormal vectors and zero columns: first from the one half, then from the other."""
    out = np.zeros((2 * block, block))
    n = 0
    for half in (slice(0, block), slice(block, 2 * block)):
        cross = gram[half] @ out[:, :n]
        left = gram[half, half] - cross @ cross.T
        values, vectors = np.linalg.eigh((left + left.T) / 2)
        good = np.flatnonzero(values > 1e-10 * max(1.0, float(gram[half, half].trace())))[::-1][: room - n]
        turn = vectors[:, good] / np.sqrt(values[good])
        new = np.zeros((2 * block, len(good)))
        new[half] = turn
        out[:, n : n + len(good)] = new - out[:, :n] @ (cross.T @ turn)
        n += len(good)
        if n >= room:
            break
    return out


def lanczos(edges: DataFrame, kind: str, k: int, block: int = 8, most: int = 512, tolerance: float = 1e-10) -> tuple[dict, DataFrame]:
    """The eigenvalues that were found of each part (a number), rising, and the table part, node, vector of its first k eigenvectors, unit and with a positive largest entry.

    The basis of a part grows by a block a step: the matrix times the last block, orthogonalised twice against all before it; directions that are lost
    are replaced by new ones. It ends when it spans the part, has `most` vectors, or the residuals of the first k vectors are below the tolerance.
    """
    whole, nodes = matrix(edges, kind)
    node = dict(nodes.dtypes)["node"]
    sizes = {r["part"]: r["n"] for r in nodes.groupBy("part").agg(F.count("*").alias("n")).collect()}
    new = lambda turn: F.array(*[F.hash("part", "node", F.lit(turn * block + i)) / float(1 << 31) for i in range(block)])
    zeros = F.array_repeat(F.lit(0.0), block)
    basis = stage(nodes.select("part", "node", "rank", "scale", F.array().cast("array<double>").alias("q"), zeros.alias("y")))
    alive = {p: np.zeros(0, bool) for p in sizes}  # columns of the basis that aren't zero
    small = {p: np.zeros((0, 0)) for p in sizes}  # the projected matrix
    for turn in range(most // block + 2):
        width = turn * block
        now = stage(basis.withColumn("z", new(turn)))
        discard(basis)
        first = summed(now.select("part", "q", "y", "z"), lambda p, q, y, z: np.vstack((q.T @ np.hstack((y, z)), np.zeros((1, 2 * block)))))
        if width:  # y is the matrix times the last block
            for p, t in small.items():
                grown = np.zeros((width, width))
                grown[: len(t), : len(t)] = t
                grown[:, width - block :] = first[p][:-1, :block]
                grown[width - block :] = grown[:, width - block :].T
                small[p] = grown
        if all(alive[p].sum() >= n for p, n in sizes.items()) or width >= most:
            break

        def rest(p, q: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
            v = np.hstack((y, z)) - q @ first[p][:-1]
            return np.vstack((q.T @ v, v.T @ v))

        second = summed(now.select("part", "q", "y", "z"), rest)
        plan, settled = {}, True
        for p, m in second.items():
            gram = m[width:] - m[:width].T @ m[:width]
            _, vectors = projected(small[p], alive[p])
            last = vectors[width - block :, :k] if width else np.ones((block, 1))
            settled &= bool(width > k and (np.einsum("ik,ij,jk->k", last, gram[:block, :block], last) < tolerance**2).all()) or alive[p].sum() >= sizes[p]
            plan[p] = (first[p][:-1] + m[:width], directions(gram, min(block, sizes[p] - int(alive[p].sum())), block))
        if settled:
            break

        def orthonormal(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, y, z = (as_matrix(batch.column(i)) for i in (2, 3, 4))
                out = np.zeros((batch.num_rows, block))
                for p, at in by_part(batch):
                    h, d = plan[p]
                    out[at] = (np.hstack((y[at], z[at])) - q[at] @ h) @ d
                ends = pa.array(np.arange(0, out.size + 1, block, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["part", "node", "x"])

        x = stage(now.select("part", "node", "q", "y", "z").mapInArrow(orthonormal, f"part long, node {node}, x array<double>"))
        for p, (_, d) in plan.items():
            alive[p] = np.append(alive[p], d.any(axis=0))
        grown = now.drop("y", "z").join(x, ["part", "node"]).join(times(whole, x, block), ["part", "node"], "left").withColumn("y", F.coalesce("y", zeros))
        if kind == "modularity":
            ranks = summed(grown.select("part", "x", F.array("rank").alias("r")), lambda p, x, r: r.T @ x)
            table = basis.sparkSession.createDataFrame([(p, v[0].tolist()) for p, v in ranks.items()], "part long, t array<double>")
            grown = grown.join(table, "part").withColumn("y", F.zip_with("y", "t", lambda u, t: u + F.col("rank") * t))
        basis = stage(grown.select("part", "node", "rank", "scale", F.concat("q", "x").alias("q"), "y"))
        for t in (now, x):
            discard(t)
    solved = {p: projected(t, alive[p]) for p, t in small.items()}
    turned = {p: c[:, :k] for p, (_, c) in solved.items()}

    def ritz(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, scale = as_matrix(batch.column(2)), batch.column(3).to_numpy()
            found: list = [None] * batch.num_rows
            for p, at in by_part(batch):
                for i, v in zip(at.tolist(), q[at] @ turned[p] * scale[at, None]):
                    found[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["part", "node", "x"])

    raw = stage(now.select("part", "node", "q", "scale").mapInArrow(ritz, f"part long, node {node}, x array<double>"))
    discard(now)
    long = raw.select("part", "node", F.posexplode("x").alias("at", "v"))
    signs = long.groupBy("part", "at").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"), F.max_by("v", F.abs("v")).alias("top"))
    unit = long.join(signs, ["part", "at"]).select("part", "node", "at", (F.col("v") / F.col("size") * F.signum("top")).alias("v"))
    vectors = unit.groupBy("part", "node").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v"))  # k numbers a node
    return {p: values for p, (values, _) in solved.items()}, vectors.select("part", "node", F.transform("v", lambda e: e["v"]).alias("vector"))


def projected(t: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues of the projected matrix, and its vectors over all columns of the basis."""
    kept = np.flatnonzero(alive)
    values, vectors = np.linalg.eigh((t[np.ix_(kept, kept)] + t[np.ix_(kept, kept)].T) / 2)
    out = np.zeros((len(alive), len(values)))
    out[kept] = vectors
    return values, out


def eigenvectors(edges: DataFrame, kind: str, k: int, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Tables part, values (rising: all of a small part, those that were found of a large one) and part, node, vector (of the first k): edges
    (part: long, src, dst, w). Small parts by one task each, large ones by batches of Lanczos iterations."""
    edges = stage(edges)
    sizes = stage(edges.select("part", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("part").agg(F.count("*").alias("n")))
    found = stage(dense_vectors(symmetric(edges.join(sizes.filter(F.col("n") <= dense).select("part"), "part")), kind, k))
    values, vectors = found.filter("values IS NOT NULL").select("part", "values"), found.select("part", "node", "vector")
    large = [r["part"] for r in sizes.filter(F.col("n") > dense).select("part").orderBy("part").collect()]  # a row for each `dense` nodes at most
    for lo in range(0, len(large), BATCH):
        some, more = lanczos(edges.filter(F.col("part").isin(large[lo : lo + BATCH])), kind, k)
        values = values.unionByName(edges.sparkSession.createDataFrame([(p, v.tolist()) for p, v in some.items()], "part long, values array<double>"))
        vectors = vectors.unionByName(stage(more))
    return values, vectors
