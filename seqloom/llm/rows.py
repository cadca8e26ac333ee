"""Rows of documents whatever other columns they have."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that stages read; all others travel as one.
READ = ("doc_id", "text", "lang", "source")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def keeps_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage docs -> docs that is given all columns that stages don't read packed into one, so that its own names clash with none of them."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names = docs.columns
        others = [c for c in names if c not in READ]
        if not others:
            return stage(docs, *args, **options)
        own = docs.select(*[c for c in names if c in READ], F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("others"))
        out = stage(own, *args, **options)
        return out.select(*[F.col("others").getField(f"c{others.index(c)}").alias(c) if c in others else F.col(c) for c in names])

    return run


def row_digest(columns: list[str]) -> Column:
    """128 bits of whole rows, of any types, maps included."""
    return F.md5(F.to_json(F.struct(*[quoted(c) for c in columns])))


def join_names(rows: DataFrame, names: DataFrame, key: str, least: int = 1000, most: int = 100_000) -> DataFrame:
    """The rows with the columns of names: one row a key, `times` being about its number of rows.

    Keys with more than `least` rows and over one in `most` of all rows, fewer than `most` keys for any input, are sent to all tasks, so that no task is given all rows of a hot
    key; the others are joined by the key.
    """
    total = names.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    hot = F.col("times") > max(least, total // most)
    few, rest = names.filter(hot).drop("times"), names.filter(~hot).drop("times")
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key)
    return cold.unionByName(rows.join(F.broadcast(few), key))
