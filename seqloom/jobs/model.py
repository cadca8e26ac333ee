"""The whole flow: words and classes in, grammar and judgements of test forms out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.jobs import classes as discovery
from seqloom.jobs import fitting
from seqloom.jobs.config import ClassConfig, ModelConfig
from seqloom.operators import corpus, evaluation, grammar, sequences
from seqloom.sources import spread, stage
from seqloom.sources import text as files

EDGE, SYLLABLE, DOT = "#", "!", "."


def dotted(words: DataFrame) -> DataFrame:
    """ngram, n: framed words as dotted forms."""
    return words.select(F.array_join(corpus.framed(corpus.symbols(words)), ".").alias("ngram"), "n")


def violations(forms: DataFrame, cons: DataFrame, classes: DataFrame, config: ModelConfig) -> DataFrame:
    """ngram, con, v of distinct forms, matched as the settings say."""
    by = grammar.substring_violations if config.match == "substring" else grammar.token_violations
    return by(forms, cons, classes)


def staged_words(words: DataFrame) -> DataFrame:
    """Words (word or phones, n) written in as many files as there are shuffle partitions: a file is read by one task, however many symbols its few bytes hold."""
    return stage(spread(words, *(c for c in ("phones", "word") if c in words.columns)))


def model_classes(symbols: DataFrame, classes: DataFrame, config: ModelConfig) -> DataFrame:
    """class, phones of the model: the classes, their complements, single symbols (phone) if asked for and the marks in use, written once."""
    spark = symbols.sparkSession
    every = grammar.with_complements(classes, symbols, EDGE, config.singletons)
    if not config.word_boundaries:
        every = every.filter(F.col("class") != "word")
    if config.syll_boundaries:
        every = every.unionByName(spark.range(1).select(F.lit("syllable").alias("class"), F.array(F.lit(SYLLABLE)).alias("phones")))
    every = stage(every)
    grammar.refuse_repeated_names(every)
    return every


def inventory(words: DataFrame) -> DataFrame:
    """phone: the symbols of words without marks."""
    return corpus.inventory(words).filter(~F.col("phone").isin(EDGE, SYLLABLE, DOT))


def model_target(words: DataFrame, symbols: DataFrame, config: ModelConfig) -> DataFrame:
    """ngram, p of all candidates of the symbols (phone), written once."""
    alphabet = symbols
    for m, used in ((EDGE, config.word_boundaries), (SYLLABLE, config.syll_boundaries)):
        if used:
            alphabet = alphabet.union(words.sparkSession.range(1).select(F.lit(m)))
    kept = words if "phones" not in words.columns else words.withColumn("phones", F.filter("phones", lambda p: ~p.isin(DOT, "")))
    counts = sequences.word_ngram_counts(kept, config.N)
    if not config.word_boundaries:
        counts = counts.filter(~F.array_contains(F.split("ngram", r"\."), EDGE))
    target = grammar.observed(alphabet, counts, config.N)
    return stage(grammar.type_target(target) if config.type_frequency else target)


def tables(words: DataFrame, classes: DataFrame, config: ModelConfig = ModelConfig(), parts: tuple[str, ...] = ("classes", "cons", "target", "violations")) -> dict[str, DataFrame]:
    """classes, cons, target, violations of words (word or phones, n) and classes (class, phones), each written once; only the `parts` asked for.

    Without word boundaries neither forms nor classes hold the mark; with syllable boundaries the mark is a symbol and a class. A
    symbol that is a dot is no symbol of an n-gram.
    """
    return all_tables(staged_words(words), {0: classes}, config, parts)[0]


def all_tables(words: DataFrame, classes: dict[int, DataFrame], config: ModelConfig = ModelConfig(), parts: tuple[str, ...] = ("classes", "cons", "target", "violations")) -> dict[int, dict[str, DataFrame]]:
    """tables() of the same written words for several sets of classes, whose symbols and target are one."""
    symbols = stage(inventory(words))
    shared = {"target": model_target(words, symbols, config)} if {"target", "violations"} & set(parts) else {}
    made = {}
    for k, own in classes.items():
        found = made[k] = dict(shared)
        if {"classes", "cons", "violations"} & set(parts):
            found["classes"] = model_classes(symbols, own, config)
            found["cons"] = stage(grammar.constraints(found["classes"], config.N))
        if "violations" in parts:
            found["violations"] = stage(violations(found["target"].select("ngram"), found["cons"], found["classes"], config))
    return made


def judged(forms: DataFrame, cons: DataFrame, classes: DataFrame, weights: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """ngram, harmony of every distinct form (ngram, dotted) under the constraints that have a weight (con, weight)."""
    return all_judged(forms, {"harmony": (cons, classes, weights)}, config)


def all_judged(forms: DataFrame, problems: dict[str, tuple[DataFrame, DataFrame, DataFrame]], config: ModelConfig = ModelConfig()) -> DataFrame:
    """ngram and for each problem (constraints, classes, weights) a column of its name with the harmony of every distinct form."""
    return grammar.windowed_harmonies(spread(forms.select("ngram"), "ngram").distinct(), problems, config.match == "substring")


def fitted_judgements(words: DataFrame, classes: DataFrame, forms: DataFrame, config: ModelConfig = ModelConfig()) -> tuple[DataFrame, DataFrame]:
    """The grammar (con, regex, weight) and the judgements (ngram, harmony) of the forms."""
    t = tables(words, classes, config)
    weights = stage(fitting.fit(t["target"], t["violations"], config))
    return weights.join(t["cons"].select("con", "regex"), "con").select("con", "regex", "weight"), judged(forms, t["cons"], t["classes"], weights, config)


def form_words(forms: DataFrame) -> DataFrame:
    """phones, n: the symbols of dotted forms without word boundaries, equal ones counted."""
    phones = F.filter(F.split("form", r"\."), lambda p: ~p.isin("", EDGE))
    return forms.select(phones.alias("phones")).groupBy("phones").agg(F.count("*").alias("n"))


def named_classes(classes: DataFrame) -> DataFrame:
    """class, phones: a class is named by its symbols in order, with spaces between them."""
    return classes.select(F.array_join(F.array_sort("phones"), " ").alias("class"), "phones")


def run(spark: SparkSession, corpus_file: str, classes_file: str, tests_file: str, out: str, config: ModelConfig = ModelConfig(match="substring")) -> None:
    """Files in; folders `grammar` and `judgements` under `out`. Every line of the test file has a line of its own, in the file's order."""
    marks = config.word_boundaries, config.syll_boundaries
    words = form_words(files.read_forms(spark, corpus_file, *marks))
    classes = named_classes(files.read_classes(spark, classes_file))
    tests = stage(files.read_forms(spark, tests_file, *marks))
    rules, scores = fitted_judgements(words, classes, tests.select(F.col("form").alias("ngram")), config)
    files.write_grammar(rules, f"{out}/grammar")
    files.write_judgements(tests.join(scores.withColumnRenamed("ngram", "form"), "form").select("line", "form", "harmony"), f"{out}/judgements")


def repeated(words: DataFrame, forms: DataFrame, ratings: DataFrame, seeds: list[int], kinds: ClassConfig = ClassConfig(), config: ModelConfig = ModelConfig(), state: str | None = None) -> DataFrame:
    """seed, classes (their number), tau, tau_p, r, r_p: the whole flow for each seed of the class discovery, held against ratings (ngram, rating).

    Contexts are counted once; all fits are one job or one iteration, whose steps are kept in the folder `state` if it is given.
    """
    words = staged_words(words)
    cells = stage(sequences.word_contexts(words, kinds.window, kinds.separate_lens, (DOT,)))
    found = {seed: discovery.discover(cells, replace(kinds, seed=seed)).select(F.split("phones", " ").alias("phones")) for seed in seeds}
    made = all_tables(words, {seed: named_classes(c) for seed, c in found.items()}, config)
    weights = stage(fitting.fit_all({k: (t["target"], t["violations"]) for k, t in made.items()}, config, state=state))
    problems = {f"harmony_{k}": (t["cons"], t["classes"], weights.filter(F.col("problem") == k).select("con", "weight")) for k, t in made.items()}
    scores = all_judged(forms, problems, config).select("ngram", *[F.round(k, 9).alias(k) for k in problems])  # forms of equal violations tie, in whatever order their costs were added up
    both = stage(scores.join(ratings.select("ngram", "rating").hint("merge"), "ngram"))
    out = None
    for seed, t in made.items():
        tau = evaluation.with_p_values(evaluation.kendall(both, F.col(f"harmony_{seed}"), F.col("rating"))).select("tau", F.col("p").alias("tau_p"))
        r = evaluation.with_p_values(evaluation.pearson(both, f"harmony_{seed}", "rating")).select("r", F.col("p").alias("r_p"))
        size = t["classes"].agg(F.count("*").alias("classes"))
        row = size.join(F.broadcast(tau)).join(F.broadcast(r)).select(F.lit(seed).alias("seed"), "classes", "tau", "tau_p", "r", "r_p")  # single rows
        out = row if out is None else out.unionByName(row)
    return out
