"""Marginals and association scores of a long count table (context, phone, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marginals(cells: DataFrame) -> DataFrame:
    """kind (phone, context, all), name, n."""
    cube = cells.groupingSets([["phone"], ["context"], []], "phone", "context").agg(F.sum("n").alias("n"), F.grouping("phone").alias("gp"), F.grouping("context").alias("gc"))
    kind = F.when((F.col("gp") == 1) & (F.col("gc") == 1), "all").when(F.col("gp") == 0, "phone").otherwise("context")
    return cube.select(kind.alias("kind"), F.coalesce("phone", "context", F.lit("")).alias("name"), "n")


def ppmi(cells: DataFrame) -> DataFrame:
    """context, phone, ppmi: ln(n * total / (row * column)), negative values as 0. Cells without a count are not rows."""
    rows = cells.groupBy("context").agg(F.sum("n").alias("by_context"))
    cols = cells.groupBy("phone").agg(F.sum("n").alias("by_phone"))
    total = cells.agg(F.sum("n").alias("total"))
    joined = cells.join(rows, "context").join(cols, "phone").join(F.broadcast(total))  # one row
    score = F.ln(F.col("n").cast("double") * F.col("total") / (F.col("by_context").cast("double") * F.col("by_phone")))
    return joined.select("context", "phone", F.greatest(score, F.lit(0.0)).alias("ppmi"))


def symbols_of_contexts(cells: DataFrame, cut: DataFrame, threshold: float) -> DataFrame:
    """cluster, phones, contexts: of each cluster of contexts (context, cluster) the symbols with a score above the threshold."""
    strong = ppmi(cells).filter(F.col("ppmi") > threshold).join(cut, "context")
    return strong.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("phone")), " ").alias("phones"), F.array_join(F.array_sort(F.collect_set("context")), " ").alias("contexts"))
