"""Corpora of symbol sequences as DataFrames: (word_id, phones) rows, or distinct words with their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE, START, END = "#", "<s>", "<e>"


def letter_words(docs: DataFrame) -> DataFrame:
    """word, n: every run of a-z in the lower-cased texts, counted before anything is expanded."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def letters(word: Column) -> Column:
    """The characters of a word as an array."""
    return F.split(word, "")


def symbols(words: DataFrame) -> Column:
    """The symbols of a row of counted words: the array `phones` where there is one, else the characters of `word`."""
    return F.col("phones") if "phones" in words.columns else letters(F.col("word"))


def sequence_words(rows: DataFrame, key: str, order: str, symbol: Column) -> DataFrame:
    """phones, n: the symbols of each key in order (ties by symbol) as one word, equal words counted. A word is as long as its key has rows."""
    pairs = rows.filter(symbol.isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), symbol.alias("s")))).alias("pairs"))
    return pairs.select(F.transform("pairs", lambda p: p["s"]).alias("phones")).groupBy("phones").agg(F.count("*").alias("n"))


def event_symbols(events: DataFrame) -> DataFrame:
    """user_id, phone, ts, event_id: one symbol an event, the user being the word."""
    return events.filter(F.col("event_type").isNotNull()).select("user_id", F.col("event_type").alias("phone"), "ts", "event_id")


def event_order() -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def padded(phones: Column, window: int) -> Column:
    """`window` start and end marks around a sequence."""
    return F.concat(F.array_repeat(F.lit(START), window), phones, F.array_repeat(F.lit(END), window))


def framed(phones: Column) -> Column:
    """One word boundary on each side of a sequence."""
    return F.concat(F.array(F.lit(EDGE)), phones, F.array(F.lit(EDGE)))


def inventory(words: DataFrame) -> DataFrame:
    """phone: the distinct symbols of distinct words."""
    return words.select(F.explode(symbols(words)).alias("phone")).filter("phone <> ''").distinct()


def without_specials(symbols: DataFrame) -> DataFrame:
    """Symbols (phone) that are no marks: those without `<`."""
    return symbols.filter(~F.contains("phone", F.lit("<")))
