"""Similarity graphs over the rows of a count table, and measures of graphs held as edges (src, dst, w).

Rows meet through the symbols that they share (a self-join on the symbol), so cells without a count cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sources import discard, stage


def _pairs(cells: DataFrame) -> DataFrame:
    """Pairs of rows that share a symbol: src, dst, a, b."""
    left = cells.select("phone", F.col("context").alias("src"), F.col("n").alias("a"))
    right = cells.select("phone", F.col("context").alias("dst"), F.col("n").alias("b"))
    return left.join(right, "phone")


def covariance(cells: DataFrame) -> DataFrame:
    return _pairs(cells).groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("w"))


def one_mode(cells: DataFrame, upper: bool = True) -> DataFrame:
    """Summed weights of the shared symbols; only src <= dst if `upper`."""
    pairs = _pairs(cells)
    return (pairs.filter("src <= dst") if upper else pairs).groupBy("src", "dst").agg(F.sum(F.col("a") + F.col("b")).alias("w"))


def reflected(edges: DataFrame) -> DataFrame:
    """The missing triangle filled from the other one."""
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.unionByName(swapped.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))


def row_sums(edges: DataFrame, name: str) -> DataFrame:
    return edges.groupBy(F.col("src").alias(f"{name}_node")).agg(F.sum("w").alias(name))


def with_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the row sums ds of src and dd of dst."""
    return edges.join(row_sums(edges, "ds"), F.col("src") == F.col("ds_node")).join(row_sums(edges, "dd"), F.col("dst") == F.col("dd_node")).drop("ds_node", "dd_node")


def cosine(cells: DataFrame) -> DataFrame:
    norm = cells.groupBy(F.col("context").alias("c")).agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("len"))
    dots = covariance(cells).join(norm.select(F.col("c").alias("src"), F.col("len").alias("ls")), "src").join(norm.select(F.col("c").alias("dst"), F.col("len").alias("ld")), "dst")
    return dots.select("src", "dst", (F.col("w") / (F.col("ls") * F.col("ld"))).alias("w"))


def bhattacharyya(cells: DataFrame) -> DataFrame:
    total = cells.groupBy("context").agg(F.sum("n").alias("t"))
    shares = cells.join(total, "context").select("context", "phone", (F.col("n") / F.col("t")).alias("n"))
    return _pairs(shares).groupBy("src", "dst").agg(F.sum(F.sqrt(F.col("a") * F.col("b"))).alias("w"))


def kld_similarity(cells: DataFrame, smoothing: float = 2e-4, most_nodes: int = 4000) -> DataFrame:
    """exp(-(KL(a|b) + KL(b|a))) of all pairs of rows, each cell of the grid smoothed.

    With z the smoothed row total, KL(a|b) = sum p_a ln p_a - ln(s / z_b) - (sum over b's symbols of p_a ln((n_b + s) / s)): only
    cells with a count are joined, and the rows' entropies are sums of one table.
    """
    phones = cells.select("phone").distinct().count()
    if cells.select("context").distinct().count() > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes")
    s = F.lit(smoothing)
    gain = F.ln((F.col("n") + s) / s)
    rows = cells.groupBy("context").agg((F.sum("n") + s * phones).alias("z"), F.sum(gain).alias("gains"), F.sum((F.col("n") + s) * F.ln(F.col("n") + s)).alias("own"), F.count("*").alias("k"))
    # sum p ln p over the grid: the cells with a count, and the others at the smoothing value
    rows = rows.withColumn("entropy", (F.col("own") + (phones - F.col("k")) * s * F.ln(s)) / F.col("z") - F.ln("z"))
    a = rows.select(F.col("context").alias("src"), *[F.col(c).alias(f"{c}_a") for c in ("z", "gains", "entropy")])
    b = rows.select(F.col("context").alias("dst"), *[F.col(c).alias(f"{c}_b") for c in ("z", "gains", "entropy")])
    shared = _pairs(cells).groupBy("src", "dst").agg(F.sum(F.col("a") * F.ln((F.col("b") + s) / s)).alias("ab"), F.sum(F.col("b") * F.ln((F.col("a") + s) / s)).alias("ba"))
    grid = a.crossJoin(b).join(shared, ["src", "dst"], "left").fillna(0.0, ["ab", "ba"])  # nodes x nodes is the result
    kl = lambda x, y, part: F.col(f"entropy_{x}") - F.ln(s / F.col(f"z_{y}")) - (F.col(part) + s * F.col(f"gains_{y}")) / F.col(f"z_{x}")
    return grid.select("src", "dst", F.exp(-(kl("a", "b", "ab") + kl("b", "a", "ba"))).alias("w"))


def row_normalised(edges: DataFrame) -> DataFrame:
    """Edges over their row sums, the diagonal set to 0."""
    out = with_degrees(edges)
    return out.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("w") / F.col("ds")).alias("w"))


def edge_normalised(edges: DataFrame) -> DataFrame:
    return with_degrees(edges).select("src", "dst", (F.col("w") / (F.col("ds") + F.col("dd"))).alias("w"))


def symmetric_normalised(edges: DataFrame) -> DataFrame:
    return with_degrees(edges).select("src", "dst", (F.col("w") / (F.sqrt("ds") * F.sqrt("dd"))).alias("w"))


def laplacian(edges: DataFrame, kind: str = "plain") -> DataFrame:
    """plain: D - A; sym: D^-1/2 (D - A) D^-1/2; rw: D^-1 (D - A). All nodes have a diagonal entry."""
    degree = row_sums(edges, "d").select(F.col("d_node").alias("src"), F.col("d_node").alias("dst"), F.col("d").alias("w"))
    plain = degree.unionByName(edges.select("src", "dst", (-F.col("w")).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    if kind == "plain":
        return plain
    d = row_sums(edges, "d")
    out = plain.join(d.select(F.col("d_node").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("d_node").alias("dst"), F.col("d").alias("dd")), "dst")
    scale: Column = F.sqrt("ds") * F.sqrt("dd") if kind == "sym" else F.col("ds")
    return out.select("src", "dst", (F.col("w") / scale).alias("w"))


def modularity_matrix(edges: DataFrame) -> DataFrame:
    """w - d_src d_dst / (2 * all weights), all weights being the sum of the matrix."""
    total = edges.agg(F.sum("w").alias("t"))
    return with_degrees(edges).join(F.broadcast(total)).select("src", "dst", (F.col("w") - F.col("ds").cast("double") * F.col("dd") / (2 * F.col("t"))).alias("w"))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes of the cut (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def modularity(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """One row for a cut (node, cluster). sum_form subtracts (d_src / 2 + d_dst / 2) / 2m, product_form d_src d_dst / 2m. Pairs without an edge count."""
    total = edges.agg(F.sum("w").cast("double").alias("m2"))
    d = row_sums(edges, "d")
    nodes = cut.join(d, F.col("node") == F.col("d_node"), "left").select("node", "cluster", F.coalesce("d", F.lit(0)).cast("double").alias("d"))
    inside = edges.join(cut.select(F.col("node").alias("src"), F.col("cluster").alias("cs")), "src").join(cut.select(F.col("node").alias("dst"), F.col("cluster").alias("cd")), "dst").filter("cs = cd").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("inside"))
    # over all pairs of one cluster of k nodes: sum (d_i + d_j) / 2 = k * sum d, and sum d_i d_j = (sum d)^2
    parts = nodes.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("d").alias("s")).agg(F.sum(F.col("k") * F.col("s")).alias("sums"), F.sum(F.col("s") * F.col("s")).alias("products"))
    one = parts.join(F.broadcast(inside)).join(F.broadcast(total))  # single rows
    return one.select(((F.col("inside") - F.col("sums") / F.col("m2")) / F.col("m2")).alias("sum_form"), ((F.col("inside") - F.col("products") / F.col("m2")) / F.col("m2")).alias("product_form"))


def part_modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """part, sum_form: modularity()'s sum_form of the labels (part, node, label) in the graph of each part (part, src, dst, w); 0 without weight."""
    d = edges.groupBy("part", F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    nodes = labels.join(d, ["part", "node"], "left").groupBy("part", "label").agg(F.count("*").alias("k"), F.sum("d").alias("s"))
    nodes = nodes.groupBy("part").agg(F.coalesce(F.sum(F.col("k") * F.col("s")), F.lit(0.0)).alias("sums"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("m2"))
    a, b = (labels.select("part", F.col("node").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst"))
    inside = edges.join(a, ["part", "src"]).join(b, ["part", "dst"]).filter("l_src = l_dst").groupBy("part").agg(F.sum("w").alias("inside"))
    one = nodes.join(inside, "part", "left")
    form = F.try_divide(F.coalesce("inside", F.lit(0.0)) - F.try_divide("sums", "m2"), F.col("m2"))
    return one.select("part", F.coalesce(form, F.lit(0.0)).alias("sum_form"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node reaches, in either direction; edges: src, dst, of any weight but 0.

    Rounds of a star about the least neighbour and a jump of every pointer to its root's root: O(log nodes) of them, each written once.
    """
    pairs = edges.filter("w <> 0").select("src", "dst") if "w" in edges.columns else edges.select("src", "dst")
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    links = stage(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct())
    roots = stage(nodes.select("node", F.col("node").alias("root")))
    while True:
        own = links.join(roots.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.col("root").alias("near"))
        own = own.join(roots, "node")
        # every root learns of the least root next to its tree, and every node of that next to it
        hooks = own.select(F.col("root").alias("node"), "near").unionByName(own.select("node", "near")).groupBy("node").agg(F.min("near").alias("near"))
        moved = roots.join(hooks, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        moved = stage(moved)
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("far"))
        last = stage(moved.join(jump, "root").select("node", F.least("root", "far").alias("root"), (F.least("root", "far") != F.col("was")).alias("new")))
        discard(moved)
        discard(roots)
        roots = last.select("node", "root")
        if last.filter("new").isEmpty():
            return roots


def conductance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weight that leaves the cut (node) over the smaller of the two sides' weights."""
    side = nodes.select(F.col("node").alias("n"), F.lit(1).alias("in"))
    both = edges.join(side.withColumnsRenamed({"n": "src", "in": "s"}), "src", "left").join(side.withColumnsRenamed({"n": "dst", "in": "d"}), "dst", "left")
    row, inner = F.sum(F.when(F.col("s") == 1, F.col("w"))), F.sum(F.when((F.col("s") == 1) & (F.col("d") == 1), F.col("w")))
    return both.agg(((row - inner) / F.least(row, F.sum("w") - row)).alias("conductance"))


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    """node, coef: weight of closed walks of three steps over (sum of weights)^2 - sum of squared weights."""
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w1")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("w").alias("w2")), "b").groupBy("a", "c").agg(F.sum(F.col("w1") * F.col("w2")).alias("w2"))
    closed = two.join(e.select(F.col("src").alias("c"), F.col("dst").alias("a"), "w"), ["a", "c"]).groupBy("a").agg(F.sum(F.col("w2") * F.col("w")).alias("walks"))
    scale = e.groupBy(F.col("src").alias("a")).agg((F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))).alias("scale"))
    return closed.join(scale, "a").select(F.col("a").alias("node"), (F.col("walks") / F.col("scale")).alias("coef"))
