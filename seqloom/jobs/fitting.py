"""Fit of the log-linear model. Candidates with equal violations are one profile with a multiplicity and a summed target.

The sparse tableau of the profiles stays in the executors, as blocks of arrays over a written table, so a lost executor costs
a re-read. A problem of one block is fitted by one task. Of larger ones each step sends the weights out and adds up the partial
gradients of the blocks; only vectors as long as the number of constraints, which are the result, reach the driver.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.jobs.config import ModelConfig
from seqloom.sources import stage

#: Profiles of a block.
SIZE = 20_000


def profiles(target: DataFrame, violations: DataFrame, con: str = "string") -> DataFrame:
    """profile (sorted array of con, v), times, p."""
    rows = violations.groupBy("ngram").agg(F.array_sort(F.collect_list(F.struct("con", "v"))).alias("profile"))
    empty = F.array().cast(f"array<struct<con:{con},v:bigint>>")
    return target.join(rows, "ngram", "left").groupBy(F.coalesce("profile", empty).alias("profile")).agg(F.count("*").alias("times"), F.sum("p").alias("p"))


class Table:
    """A sparse matrix: row, column and value of each cell."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.col, self.value, self.shape = row, col, value, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def summed(self, p: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * p[self.row], self.shape[1])


def descend(table: Table, times: np.ndarray, target: np.ndarray, config: ModelConfig) -> tuple[np.ndarray, list[float]]:
    """Weights (never negative) after full-batch steps and the loss before each step. Every 50 steps the fit ends if the
    loss fell by no more than 1e-7 since the step before."""
    w, losses = np.zeros(table.shape[1]), []
    seen = table.summed(target)
    total = target.sum()
    for i in range(config.n_iter):
        h = -table.times(w)
        e = times * np.exp(h - h.max())
        p = e / e.sum()
        each = np.clip(p / times, 1e-20, 1)
        losses.append(float(-(target / total) @ np.log(each) + config.lam * (w @ w)))
        w = np.maximum(0, w + config.lr * (table.summed(p) - seen - config.lam))
        if i % 50 == 0 and i and losses[-2] - losses[-1] <= 1e-7:
            break
    return w, losses


class Block:
    """Profiles of one task: a sparse table with the multiplicity and the target of each row."""

    def __init__(self, table: Table, times: np.ndarray, target: np.ndarray) -> None:
        self.table, self.times, self.target = table, times, target

    def seen(self) -> np.ndarray:
        """The target's violations of each constraint, then the sum of the target."""
        return np.append(self.table.summed(self.target), self.target.sum())

    def expected(self, w: np.ndarray) -> tuple[float, float, np.ndarray]:
        """The largest harmony, and shifted by it the sum of exp(harmony) and the violations under it."""
        h = -self.table.times(w)
        top = float(h.max())
        e = self.times * np.exp(h - top)
        return top, float(e.sum()), self.table.summed(e)

    def loglik(self, w: np.ndarray, log_z: float) -> float:
        """The target times the log of the clipped probabilities."""
        return float(self.target @ np.log(np.clip(np.exp(-self.table.times(w) - log_z), 1e-20, 1)))


def added(a: tuple[float, float, np.ndarray], b: tuple[float, float, np.ndarray]) -> tuple[float, float, np.ndarray]:
    """Two partial sums of Block.expected, shifted by the larger harmony."""
    top = max(a[0], b[0])
    x, y = math.exp(a[0] - top), math.exp(b[0] - top)
    return top, a[1] * x + b[1] * y, a[2] * x + b[2] * y


def packed(target: DataFrame, violations: DataFrame, size: int = SIZE) -> tuple[DataFrame, int, list[str]]:
    """The profiles as written blocks (block: bytes), their number, and the names of the constraints in the order of the columns."""
    spark = target.sparkSession
    cons = [r["con"] for r in violations.select("con").distinct().orderBy("con").collect()]  # the weights' names
    names = spark.createDataFrame([(c, i) for i, c in enumerate(cons)], "con string, at int")
    rows = stage(profiles(target, violations.join(names, "con").select("ngram", F.col("at").alias("con"), "v"), "int"))
    width, parts = len(cons), max(1, -(-rows.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # about `size` rows
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        cells = table.column(0).chunk(0)
        own = cells.flatten()
        row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
        sparse = Table(row, own.field("con").to_numpy().astype(np.int64), own.field("v").to_numpy().astype(float), (len(cells), width))
        block = Block(sparse, table.column(1).to_numpy().astype(float), table.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return stage(rows.repartition(parts).mapInArrow(run, "block binary")), parts, cons


def summed(rdd: RDD, each, plus) -> dict:
    """The sum of a value of all blocks by problem, first in the tasks, then in a tree."""

    def merged(items: Iterator[tuple[int, object]]) -> Iterator[dict]:
        found: dict = {}
        for key, value in items:
            found[key] = plus(found[key], value) if key in found else value
        yield found

    parts = rdd.mapPartitions(lambda items: merged((key, each(key, b)) for key, b in items))
    if rdd.getNumPartitions() > 64:
        parts = parts.repartition(8).mapPartitions(lambda items: merged(kv for d in items for kv in d.items()))
    return next(merged(kv for d in parts.collect() for kv in d.items()))


def descend_blocks(rdd: RDD, widths: dict[int, int], config: ModelConfig, begun: dict[int, tuple[int, np.ndarray]] | None = None, keep=None) -> dict[int, np.ndarray]:
    """The weights of descend() for each problem over its blocks (problem, block), all problems in one iteration.

    `begun` has steps and weights to go on from; keep(step, weights) is called every 50 steps."""
    begun = begun or {}
    w = {k: begun[k][1] if k in begun else np.zeros(n) for k, n in widths.items()}
    steps = {k: begun[k][0] if k in begun else 0 for k in widths}
    first = summed(rdd, lambda k, b: b.seen(), lambda a, b: a + b)
    going, before = set(first), {}
    for i in range(min(steps.values(), default=0), config.n_iter):
        now = {k for k in going if steps[k] <= i}
        if not going:
            break
        sent = {k: w[k] for k in now}
        found = summed(rdd.filter(lambda kb, now=now: kb[0] in now), lambda k, b, sent=sent: b.expected(sent[k]), added)
        losses = {}
        if i % 50 in (0, 49):  # the fit looks at the loss of every 50th step and of the one before it
            logs = {k: top + math.log(z) for k, (top, z, _) in found.items()}
            fits = summed(rdd.filter(lambda kb, now=now: kb[0] in now), lambda k, b, sent=sent, logs=logs: b.loglik(sent[k], logs[k]), lambda a, b: a + b)
            losses = {k: -f / first[k][-1] + config.lam * float(w[k] @ w[k]) for k, f in fits.items()}
        for k, (_, z, expected) in found.items():
            w[k] = np.maximum(0, w[k] + config.lr * (expected / z - first[k][:-1] - config.lam))
        if i % 50 == 0 and i:
            going -= {k for k in now if k in before and before[k] - losses[k] <= 1e-7}
        before = losses
        if keep and i % 50 == 48:
            keep(i + 1, {k: w[k] for k in now})
    return w


def fit_all(problems: dict[int, tuple[DataFrame, DataFrame]], config: ModelConfig = ModelConfig(), size: int = SIZE, state: str | None = None) -> DataFrame:
    """problem, con, weight of the constraints with a positive weight, for several targets and violations.

    A problem of one block, at most `size` profiles, is fitted by one task; those of more go through one iteration together. With
    `state`, a folder that all executors share, steps are kept and a fit that was broken off goes on from them.
    """
    if not problems:
        raise ValueError("no problem to fit")
    spark = next(iter(problems.values()))[0].sparkSession
    made = {k: packed(t, v, size) for k, (t, v) in problems.items()}
    names = {k: cons for k, (_, _, cons) in made.items()}
    whole = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("problem"), "block") for k, (df, parts, _) in made.items() if parts == 1] or [spark.createDataFrame([], "problem int, block binary")])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = pickle.loads(data.as_py())
                w, _ = descend(b.table, b.times, b.target, config)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w.tolist()], pa.list_(pa.float64()))], ["problem", "w"])

    weights = {r["problem"]: np.array(r["w"]) for r in whole.mapInArrow(solve, "problem int, w array<double>").collect()}
    large = {k: df for k, (df, parts, _) in made.items() if parts > 1}
    if large:
        rdds = [df.rdd.map(lambda r, k=k: (k, pickle.loads(r["block"]))) for k, df in large.items()]
        rdd = spark.sparkContext.union(rdds).persist(StorageLevel.MEMORY_AND_DISK)
        weights |= descend_blocks(rdd, {k: len(names[k]) for k in large}, config, *kept_steps(spark, state))
        rdd.unpersist()
    rows = [(k, c, float(x)) for k, w in sorted(weights.items()) for c, x in zip(names[k], w) if x > 0]
    return spark.createDataFrame(rows, "problem int, con string, weight double")


def kept_steps(spark: SparkSession, folder: str | None):
    """What is kept in the folder (step and weights of each problem) and a function that keeps more."""
    if not folder:
        return {}, None
    kind = "problem int, step int, w array<double>"
    try:
        rows = spark.read.schema(kind).parquet(folder).groupBy("problem").agg(F.max_by("w", "step").alias("w"), F.max("step").alias("step")).collect()
    except AnalysisException:  # nothing is kept yet
        rows = []

    def keep(step: int, weights: dict[int, np.ndarray]) -> None:
        spark.createDataFrame([(k, step, w.tolist()) for k, w in weights.items()], kind).write.mode("append").parquet(folder)

    return {r["problem"]: (r["step"], np.array(r["w"])) for r in rows}, keep


def fit(target: DataFrame, violations: DataFrame, config: ModelConfig = ModelConfig(), size: int = SIZE) -> DataFrame:
    """con, weight of the constraints with a positive weight."""
    return fit_all({0: (target, violations)}, config, size).select("con", "weight")
