"""Counts of n-grams and positional contexts. Words are counted first, so only distinct words are expanded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.corpus import EDGE, END, START, event_order, event_symbols, framed, padded, symbols


def ngrams(phones: Column, n: int) -> Column:
    """The n-grams of an array joined by dots; none if it is shorter."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(phones) - n + 1, F.lit(1))), lambda i: i <= F.size(phones) - n + 1)
    return F.transform(starts, lambda i: F.array_join(F.slice(phones, i, F.lit(n)), "."))


def word_ngram_counts(words: DataFrame, n: int) -> DataFrame:
    """ngram, n over framed words (word or phones, n)."""
    rows = words.select(F.col("n").alias("times"), framed(symbols(words)).alias("p"))  # a column of its own: an expression inside a lambda is worked out for every place
    rows = rows.select("times", F.explode(ngrams(F.col("p"), n)).alias("ngram"))
    return rows.groupBy("ngram").agg(F.sum("times").alias("n"))


def event_bigram_counts(events: DataFrame) -> DataFrame:
    """ngram, n over users' histories with a boundary at both ends."""
    rows = event_symbols(events).select("phone", F.lag("phone").over(event_order()).alias("before"), F.lead("phone").over(event_order()).alias("after"))
    first = F.concat_ws(".", F.coalesce("before", F.lit(EDGE)), "phone")
    last = F.when(F.col("after").isNull(), F.concat_ws(".", "phone", F.lit(EDGE)))
    grams = rows.select(F.explode(F.filter(F.array(first, last), lambda g: g.isNotNull())).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count("*").alias("n"))


def context_name(k: int, side: str, symbol: Column, separate: bool) -> Column:
    return F.concat(F.lit(f"{k if separate else ''}{side}"), symbol)


def event_contexts(events: DataFrame, window: int = 2, separate: bool = True) -> DataFrame:
    """context, phone, n: each symbol with its neighbours up to `window` on both sides of the user's history."""
    rows = event_symbols(events)
    near = [context_name(k, side, F.coalesce(f("phone", k).over(event_order()), F.lit(mark)), separate) for k in range(1, window + 1) for side, f, mark in (("L", F.lag, START), ("R", F.lead, END))]
    return rows.select("phone", F.array(*near).alias("near")).select(F.explode("near").alias("context"), "phone").groupBy("context", "phone").agg(F.count("*").alias("n"))


def word_contexts(words: DataFrame, window: int = 2, separate: bool = True, marks: tuple[str, ...] = ()) -> DataFrame:
    """context, phone, n over padded words (word or phones, n). `marks`, as of syllables, are neighbours but no phones."""
    rows = words.filter(F.size(symbols(words)) > 0).select("n", padded(symbols(words), window).alias("p"))
    rows = rows.select("n", "p", F.explode(F.sequence(F.lit(window), F.size("p") - window - 1)).alias("i")).filter(~F.get("p", "i").isin(*marks)) if marks else rows.select("n", "p", F.explode(F.sequence(F.lit(window), F.size("p") - window - 1)).alias("i"))
    near = [context_name(k, side, F.get("p", F.col("i") + (k if side == "R" else -k)), separate) for k in range(1, window + 1) for side in "LR"]
    rows = rows.select(F.get("p", "i").alias("phone"), "n", F.array(*near).alias("near")).select(F.explode("near").alias("context"), "phone", "n")
    return rows.groupBy("context", "phone").agg(F.sum("n").alias("n"))
