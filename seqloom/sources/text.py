"""Text files of symbol sequences, classes, grammars and judgements as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """value, phones: one word a line, symbols between single spaces, repeats kept."""
    return spark.read.text(path).select("value", F.split(F.rtrim("value"), " ").alias("phones"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line (file, block and place in it: lines order by it as they stand in the files)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.select("value", F.struct("file", "block", "at").alias("line"))


def read_forms(spark: SparkSession, path: str, word_boundaries: bool = True, syll_boundaries: bool = False) -> DataFrame:
    """line, form: the first tab field's symbols joined by dots, framed by word boundaries; '.' is '!' only if both kinds are marked."""
    symbols = F.filter(F.split(F.trim(F.split("value", "\t")[0]), r"\s+"), lambda t: t != "")
    if word_boundaries and syll_boundaries:
        symbols = F.transform(symbols, lambda t: F.when(t == ".", "!").otherwise(t))
    form = F.array_join(symbols, ".")
    framed = F.concat(F.lit("#."), form, F.lit(".#.")) if word_boundaries else F.concat(form, F.lit("."))
    return read_lines(spark, path).select("line", framed.alias("form"))


def read_test_forms(spark: SparkSession, path: str) -> DataFrame:
    """form: distinct symbol sequences framed by both kinds of boundaries."""
    symbols = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")
    return spark.read.text(path).select(F.concat(F.lit("#.!."), F.array_join(symbols, "."), F.lit(".!.#.")).alias("form")).distinct()


def read_phone_file(spark: SparkSession, path: str) -> DataFrame:
    """phone: the tokens of the first line, in order."""
    first = spark.read.text(path).limit(1)
    return first.select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda t: t != "")).alias("at", "phone")).orderBy("at").select("phone")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """phone: the distinct tokens of a text."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("phone")).filter("phone <> ''").distinct()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """phone: first column of a tab-separated table with a header."""
    table = spark.read.csv(path, sep="\t", header=True)
    return table.select(F.col(f"`{table.columns[0]}`").alias("phone"))


def read_projections(spark: SparkSession, path: str) -> DataFrame:
    """name, trigger, features of lines `name<tab>trigger:f1,f2`."""
    parts = F.split(F.split("value", "\t")[1], ":")
    return spark.read.text(path).filter(F.instr("value", "\t") > 0).select(F.split("value", "\t")[0].alias("name"), parts[0].alias("trigger"), F.split(parts[1], ",").alias("features"))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """phones (sorted array), contexts (array): distinct sets of symbols that aren't empty."""
    cols = spark.read.csv(path, sep="\t", schema="phones string, contexts string")
    phones = F.array_sort(F.filter(F.split("phones", " "), lambda t: t != ""))
    return cols.select(phones.alias("phones"), F.split(F.coalesce("contexts", F.lit("")), " ").alias("contexts")).filter(F.size("phones") > 0).dropDuplicates(["phones"])


def write_classes(classes: DataFrame, path: str) -> None:
    """phones and contexts (strings or arrays) as tab-separated lines."""
    kinds = dict(classes.dtypes)
    cols = [F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c) for c in ("phones", "contexts") if c in kinds]
    classes.select(F.concat_ws("\t", *cols)).write.text(path)


def write_grammar(grammar: DataFrame, path: str) -> None:
    """regex, weight: positive weights in falling order, three decimals."""
    rows = grammar.filter("weight > 0").orderBy(F.desc("weight"), "regex")
    rows.select(F.concat_ws("\t", "regex", F.format_string("%.3f", "weight"))).write.text(path)


def read_grammar(spark: SparkSession, path: str) -> DataFrame:
    """regex, weight of a written grammar."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("regex"), parts[1].cast("double").alias("weight"))


def write_judgements(scores: DataFrame, path: str) -> None:
    """form, harmony: symbols between spaces, without boundaries, and three decimals; in the order of `line` if there is one."""
    plain = F.replace(F.replace("form", F.lit("#."), F.lit("")), F.lit("."), F.lit(" "))
    rows = scores.orderBy("line") if "line" in scores.columns else scores
    rows.select(F.concat_ws("\t", plain, F.format_string("%.3f", "harmony"))).write.text(path)


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """onset (first two symbols), form, score."""
    rows = spark.read.csv(path, sep="\t", schema="form string, score double")
    return rows.select(F.array_join(F.slice(F.split(F.trim("form"), " "), 1, 2), " ").alias("onset"), "form", "score")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """A ratings table with bare carriage returns between its rows."""
    return spark.read.csv(path, header=True, inferSchema=False, lineSep="\r")
