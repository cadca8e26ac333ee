"""Running counts over streams of events (an extension: there is no streaming in the batch operators' model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def symbol_counts(events: DataFrame, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """start, phone, n of each time window; rows later than the watermark are dropped with their windows closed."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), F.col("event_type").alias("phone")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "phone", "n")


def write_ngrams(words: DataFrame, n: int, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's n-gram counts of a stream of words (word) to a table; its sum by n-gram is the running count."""
    from seqloom.operators.sequences import word_ngram_counts

    def save(batch: DataFrame, number: int) -> None:
        counts = word_ngram_counts(batch.groupBy("word").agg(F.count("*").alias("n")), n)
        # the batch number makes a repeated batch replace itself
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return words.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
