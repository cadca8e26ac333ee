"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every document has a fixed 60-bit hash. A source's budget is the words it should give. Whole epochs of the source are
taken first; the rest of the budget is a threshold on the hash, found by summing words by source and hash bucket,
picking the bucket in which the running sum crosses the budget, and refining that bucket alone. No documents are sorted.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, after all
others; rows that repeat a doc_id, null included, have hashes of their own by their texts, and rows equal in these by their ordinal, which is any
order of theirs, as they are alike; an empty table gives an empty result. Only the three named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.rows import keeps_columns, row_digest
from seqloom.sources import stage

BITS, LEVELS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_name(doc_id: Column, text: Column, source: Column, seed: str) -> Column:
    """What a row's hash is made of, its ordinal aside; the same in every engine that has md5."""
    return F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))), source_key(source))


def hashed(rows: DataFrame, name: Column, to: str) -> DataFrame:
    """The rows with 60 bits of the hash of their name and ordinal, as column `to`; rows of one name are numbered from 1.

    Only names that repeat need numbers. Their equal rows are counted before they are numbered, so a hot name is few rows by then.
    """
    columns, named = rows.columns, rows.withColumn("_mix_name", name)
    bits = lambda at: F.conv(F.substring(F.md5(F.concat("_mix_name", F.lit("#"), at.cast("string"))), 1, 15), 16, 10).cast("long").alias(to)
    repeated = stage(named.groupBy(F.xxhash64("_mix_name").alias("_mix_key")).agg(F.count("*").alias("n")).filter("n > 1").select("_mix_key"))
    keyed = named.withColumn("_mix_key", F.xxhash64("_mix_name"))
    if repeated.isEmpty():
        return named.select(*[named[c] for c in columns], bits(F.lit(1)))
    once = keyed.join(repeated, "_mix_key", "left_anti").select(*columns, bits(F.lit(1)))
    some = keyed.join(repeated, "_mix_key", "left_semi").groupBy("_mix_name", row_digest(columns).alias("_mix_row"))
    some = some.agg(F.count("*").alias("_mix_n"), F.first(F.struct(*columns)).alias("_mix_whole")).select("_mix_name", "_mix_row", "_mix_n", "_mix_whole.*")
    before = Window.partitionBy("_mix_name").orderBy("_mix_row").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("_mix_lo", F.coalesce(F.sum("_mix_n").over(before), F.lit(0)))
    some = some.withColumn("_mix_at", F.explode(F.sequence(F.col("_mix_lo") + 1, F.col("_mix_lo") + F.col("_mix_n"))))
    return once.union(some.select(*columns, bits(F.col("_mix_at"))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """One row a source: source_size, target, whole epochs and the words still needed after them.

    Shares are proportional to the weights, dealt in code-point order of the sources; a share stops at `max_epochs` times the
    source's size and the excess goes to the others. With sources in ascending order of cap/weight the stopped ones
    are a prefix, so one pass of running sums finds the common share.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    deal = F.array(*[F.lit(float(w)) for w in weights])
    src = src.withColumn("weight", F.element_at(deal, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    src = src.withColumn("share", left / rest)
    src = src.withColumn("common", F.max(F.when(F.col("share") < F.col("ratio"), F.col("share"))).over(all_rows))
    src = src.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("common")), F.col("cap").cast("double")))
    src = src.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return src.select("source", source_key(F.col("source")).alias("skey"), "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("need"))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def prefix(level: int) -> Column:
    """The first `level` groups of BITS bits of the hash."""
    return F.shiftright("h", BITS * (LEVELS - level))


def thresholds(sizes: DataFrame, src: DataFrame) -> DataFrame:
    """One row a source with need > 0: documents with a hash below `threshold` are taken once more."""
    state = src.filter("need > 0").select("skey", "need", F.lit(0).cast("long").alias("lo"))
    running = F.sum("words").over(Window.partitionBy("skey").orderBy("at"))
    for level in range(1, LEVELS + 1):
        rows = sizes.select("skey", "size", prefix(level).alias("at"), prefix(level - 1).alias("lo"))
        if level == 1:  # every row counts: summed by bucket before it meets the state, so a hot source is small by then
            hist = rows.groupBy("skey", "at", "lo").agg(F.sum("size").alias("words")).join(state, ["skey", "lo"])
        else:  # only the boundary bucket of each source
            hist = rows.join(state, ["skey", "lo"]).groupBy("skey", "need", "at").agg(F.sum("size").alias("words"))
        hist = hist.withColumn("upto", running)
        edge = hist.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
        state = edge.select("skey", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), F.col("at").alias("lo"), "words")
    return state.select("skey", (F.col("lo") + F.when(2 * F.col("need") >= F.col("words"), 1).otherwise(0)).alias("threshold"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, skey, size, h of every document, and a row a source: skey, source_size, target, epochs, threshold."""
    rows = docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"), row_name(F.col("doc_id"), F.col("text"), F.col("source"), seed).alias("name"))
    sizes = stage(hashed(stage(rows), F.col("name"), "h").drop("name"))
    src = stage(source_targets(sizes, weights, max_epochs))
    return sizes, stage(src.join(thresholds(sizes, src), "skey", "left").drop("source", "need"))


def taken_epochs(h: Column, epochs: Column, threshold: Column) -> Column:
    return epochs + F.when(h < threshold, 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (times the whole document is taken), taken (words)."""
    sizes, plan = mix_plan(docs, weights, max_epochs, seed)
    out = sizes.join(plan, "skey").withColumn("epochs", taken_epochs(F.col("h"), F.col("epochs"), F.col("threshold")))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))


@keeps_columns
def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as the mix takes it; only the plan, a row a source, meets the texts."""
    _, plan = mix_plan(docs, weights, max_epochs, seed)
    plan = plan.select(F.col("skey").alias("_mix_key"), F.col("epochs").alias("_mix_epochs"), F.col("threshold").alias("_mix_threshold"))
    own = hashed(docs, row_name(F.col("doc_id"), F.col("text"), F.col("source"), seed), "_mix_h")
    rows = own.join(plan, source_key(F.col("source")) == F.col("_mix_key"))
    times = taken_epochs(F.col("_mix_h"), F.col("_mix_epochs"), F.col("_mix_threshold")).cast("int")
    rows = rows.withColumn("_mix_times", times).filter("_mix_times > 0")
    return rows.withColumn("_mix_time", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*docs.columns)


def op6_mix_sources(spark, sf_dir) -> DataFrame:
    """The contract's digest of the mix of all documents."""
    from seqloom.sources import read_table

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(name || '#' || row_number() OVER (PARTITION BY name)), 1, 15))::BIGINT AS h
  FROM (SELECT *, 'mix' || coalesce(doc_id::VARCHAR, '') || md5(coalesce(text, '')) || coalesce('s' || source, 'n') AS name FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::BIGINT AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
q AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - (coalesce(sum(cap) OVER b, 0))::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, max(CASE WHEN share < ratio THEN share END) OVER () AS common FROM q),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * common), cap::DOUBLE) AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
x AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS need,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS at_h
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN need > 0 AND (upto < need OR (upto - at_h < need AND 2 * (need - upto + at_h) >= at_h)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
