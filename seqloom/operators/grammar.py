"""Candidate n-grams, class constraints, their violations, and one step of the log-linear model.

constraints: con, n, classes (array of class names), regex; members: class, phone. Violations are kept sparse and positive.
Two ways to match are kept apart: by token (a symbol lies in a class) and by substring (the constraint's regex starts anywhere
in the dotted form, so a class member may be the end of one symbol or the start of another).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources import stage


def candidates(symbols: DataFrame, n: int, most: int = 5_000_000) -> DataFrame:
    """All n-grams of the symbols (phone); their number is the result's, and is checked."""
    size = symbols.count() ** n
    if size > most:
        raise ValueError(f"{size} candidates")
    part = symbols.select(F.col("phone").alias("ngram"))
    return reduce(lambda a, b: a.crossJoin(b.select(F.col("ngram").alias("next"))).select(F.concat_ws(".", "ngram", "next").alias("ngram")), [part] * n)


def unattested(symbols: DataFrame, attested: DataFrame, n: int) -> DataFrame:
    """Candidates that no n-gram of the corpus (ngram) equals."""
    return candidates(symbols, n).join(attested.select("ngram"), "ngram", "left_anti")


def observed(symbols: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """ngram, p: relative frequency of every candidate, 0 for those that are not attested."""
    total = counts.agg(F.sum("n").alias("total"))
    seen = counts.join(F.broadcast(total)).select("ngram", (F.col("n") / F.col("total")).alias("p"))  # one row
    return candidates(symbols, n).join(seen, "ngram", "left").select("ngram", F.coalesce("p", F.lit(0.0)).alias("p"))


def type_target(target: DataFrame, normalise: bool = False) -> DataFrame:
    """Every attested candidate counts once; summing to one only if `normalise`."""
    ones = target.withColumn("p", (F.col("p") > 0).cast("double"))
    return ones.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy())) if normalise else ones


def with_complements(classes: DataFrame, symbols: DataFrame, boundary: str = "#", singletons: bool = False) -> DataFrame:
    """class, phones (sorted arrays): the classes, their complements (named !class) that are no class, single symbols
    if asked for, and the boundary. The first of equal sets stays; complements are taken before the boundary joins."""
    every = symbols.agg(F.array_sort(F.collect_set("phone")).alias("every"))
    own = classes.select(F.lit(0).alias("kind"), "class", F.array_sort(F.array_distinct("phones")).alias("phones"))
    rest = own.join(F.broadcast(every)).select(F.lit(1).alias("kind"), F.concat(F.lit("!"), "class").alias("class"), F.array_sort(F.array_except("every", "phones")).alias("phones"))
    parts = own.unionByName(rest).filter(F.size("phones") > 0)
    if singletons:
        parts = parts.unionByName(symbols.select(F.lit(2).alias("kind"), F.col("phone").alias("class"), F.array("phone").alias("phones")))
    first = parts.groupBy("phones").agg(F.min(F.struct("kind", "class")).alias("f")).select("f.kind", "f.class", "phones")
    edge = classes.sparkSession.range(1).select(F.lit(3).alias("kind"), F.lit("word").alias("class"), F.array(F.lit(boundary)).alias("phones"))
    return first.unionByName(edge).select("class", "phones")


def quoted(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def bracketed(name: Column) -> Column:
    return F.regexp_replace(name, r"([\\\[\]])", r"\\$1")


def constraints(classes: DataFrame, most: int, limit: int = 20_000_000) -> DataFrame:
    """con, n, classes, regex for sequences of 1 to `most` classes that are all different or all the same.

    A constraint is its regex, the sets of symbols in order; con spells the classes' names, whose brackets are escaped, so that it is as distinct as they are.
    The rows are the result, about the number of classes to the power of `most`; their number is checked against `limit`."""
    if (size := classes.count() ** most) > limit:
        raise ValueError(f"{size} sequences of classes")
    named = classes.select("class", F.concat(F.lit("("), F.array_join(F.transform("phones", quoted), "|"), F.lit(")")).alias("part"))
    base = named.select(F.array("class").alias("classes"), F.col("part").alias("regex"))
    level, parts = base, [base]
    for _ in range(1, most):
        level = level.crossJoin(named).select(F.concat("classes", F.array("class")).alias("classes"), F.concat("regex", F.lit(r"[\.]"), "part").alias("regex"))
        kinds = F.size(F.array_distinct("classes"))
        parts.append(level.filter((kinds == F.size("classes")) | (kinds == 1)))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("regex").agg(F.min("classes").alias("classes")).select(F.concat(F.lit("["), F.array_join(F.transform("classes", bracketed), "]["), F.lit("]")).alias("con"), F.size("classes").alias("n"), "classes", "regex")


def refuse_repeated_names(classes: DataFrame) -> None:
    """Constraints, members and weights meet by the names of classes, so each has to be one class."""
    names = [r["class"] for r in classes.groupBy("class").count().filter("count > 1").select("class").orderBy("class").limit(5).collect()]
    if names:
        raise ValueError(f"classes that share a name: {', '.join(map(str, names))}")


def token_violations(forms: DataFrame, cons: DataFrame, classes: DataFrame) -> DataFrame:
    """ngram, con, v: places at which the tokens lie in the constraint's classes one by one. Equi-joins on the symbol only."""
    members = classes.select("class", F.explode(F.array_distinct("phones")).alias("phone"))
    tokens = forms.select("ngram", F.posexplode(F.split("ngram", r"\.")).alias("pos", "phone"))
    hits = tokens.join(members, "phone").select("ngram", "pos", "class")
    wanted = cons.select("con", "n", F.posexplode("classes").alias("k", "class"))
    found = hits.join(wanted, "class").groupBy("ngram", "con", "n", (F.col("pos") - F.col("k")).alias("at")).agg(F.count("*").alias("k"))  # a place has one symbol, which is in a class once
    return found.filter("k = n").groupBy("ngram", "con").agg(F.count("*").alias("v"))


def token_windows(forms: DataFrame, most: int) -> DataFrame:
    """ngram, window: for every place of a dotted form the tokens from there on, `most` at most, joined again."""
    rows = forms.select("ngram", F.split("ngram", r"\.").alias("tokens"))  # a column of its own: an expression inside a lambda is worked out for every place
    windows = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.array_join(F.slice("tokens", i, F.lit(most)), "."))
    return rows.select("ngram", F.explode_outer(windows).alias("window"))


def substring_windows(forms: DataFrame, longest: int) -> DataFrame:
    """ngram, window: for every place of a form the characters from there on, `longest` at most; a form without places has one null window."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("ngram"), F.lit(1))), lambda i: i <= F.length("ngram"))
    windows = F.transform(starts, lambda i: F.substring(F.col("ngram"), i, F.lit(longest)))
    return forms.select("ngram", F.explode_outer(windows).alias("window"))


def distinct_windows(windows: DataFrame) -> DataFrame:
    """window: the distinct ones of all forms."""
    return windows.select("window").filter("window IS NOT NULL").distinct()


def token_starts(windows: DataFrame, cons: DataFrame, classes: DataFrame) -> DataFrame:
    """window, con: constraints that the tokens of a distinct window fit from its first one on."""
    members = classes.select("class", F.explode(F.array_distinct("phones")).alias("phone"))
    tokens = windows.select("window", F.posexplode(F.split("window", r"\.")).alias("k", "phone"))
    wanted = cons.select("con", "n", F.posexplode("classes").alias("k", "class"))
    found = tokens.join(members, "phone").join(wanted, ["k", "class"]).groupBy("window", "con", "n").agg(F.count("*").alias("fits"))
    return found.filter("fits = n").select("window", "con")


class Automaton:
    """All constraints as one trie of class sequences, run over characters: a state is a trie node and a place of the text."""

    def __init__(self, cons: list[tuple[str, list[str]]], members: dict[str, list[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        for con, classes in cons:
            at = 0
            for c in classes:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][c]
            self.ends[at].append(con)
        self.first: dict[str, list[tuple[str, list[str]]]] = {}
        by_phone: dict[str, list[str]] = {}
        for c, phones in members.items():
            for p in phones:
                by_phone.setdefault(p, []).append(c)
        for p, found in by_phone.items():
            self.first.setdefault(p[:1], []).append((p, found))

    def matches(self, text: str) -> list[str]:
        """The constraints that match at the start of the text, each once."""
        found, queue, seen = [], [(0, 0)], {(0, 0)}
        ended = set()
        while queue:
            node, at = queue.pop()
            onward = self.next[node]
            for phone, classes in self.first.get(text[at : at + 1], ()):
                if not text.startswith(phone, at):
                    continue
                end = at + len(phone)
                for c in classes:
                    if (to := onward.get(c)) is None:
                        continue
                    if to not in ended:
                        ended.add(to)
                        found += self.ends[to]
                    if self.next[to] and text.startswith(".", end) and (to, end + 1) not in seen:
                        seen.add((to, end + 1))
                        queue.append((to, end + 1))
        return found


def substring_starts(windows: DataFrame, cons: DataFrame, classes: DataFrame, block: int = 200_000) -> DataFrame:
    """window, con: constraints whose regex matches at the start of a distinct window. The constraints go to the tasks as automata of at most `block` each."""
    members = {r["class"]: r["phones"] for r in classes.select("class", F.array_distinct("phones").alias("phones")).collect()}
    if any(p == "" for phones in members.values() for p in phones):
        raise ValueError("an empty symbol in a class")
    total = cons.count()
    parts = max(1, -(-total // block))
    sc = windows.sparkSession.sparkContext
    out = None
    for part in range(parts):  # one, but for huge constraint tables
        own = cons.filter(F.pmod(F.xxhash64("con"), F.lit(parts)) == part).select("con", "classes")
        automaton = sc.broadcast(Automaton([(r["con"], r["classes"]) for r in own.toLocalIterator()], members))

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    texts = batch.column(0).slice(lo, 1024).to_pylist()
                    found = [(t, c) for t in texts for c in automaton.value.matches(t)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(2)], ["window", "con"])

        rows = windows.select("window").filter("window IS NOT NULL").mapInArrow(run, "window string, con string")
        out = rows if out is None else out.unionByName(rows)
    return out


def longest_match(cons: DataFrame, classes: DataFrame) -> int:
    """Characters that the longest match of any constraint can have."""
    size = classes.select("class", F.array_max(F.transform("phones", F.length)).alias("size"))
    spans = cons.select("con", "n", F.explode("classes").alias("class")).join(size, "class").groupBy("con", "n").agg((F.sum("size") + F.col("n") - 1).alias("span"))
    return int(spans.agg(F.coalesce(F.max("span"), F.lit(1))).first()[0])


def substring_violations(forms: DataFrame, cons: DataFrame, classes: DataFrame) -> DataFrame:
    """ngram, con, v: start positions at which the regex of each constraint of the table matches, overlaps counted.

    What a place gives depends on the characters that a match can span, so the automaton reads each distinct window once.
    """
    windows = substring_windows(forms, longest_match(cons, classes))
    starts = substring_starts(distinct_windows(windows), cons, classes)
    # neither side is as small as Spark takes rows to be that are made by explode or in Python: no broadcast
    return windows.join(starts.hint("merge"), "window").groupBy("ngram", "con").agg(F.count("*").alias("v"))


def windowed_harmonies(forms: DataFrame, problems: dict[str, tuple[DataFrame, DataFrame, DataFrame]], substrings: bool = False) -> DataFrame:
    """ngram and for each problem (constraints, classes, weights) a column of its name: as harmony() of the violations of all constraints with a weight, by token or by substring.

    The forms are distinct and expanded once for all problems. The cost of every distinct window is summed once and written, so that its size is known; forms then
    meet one row for each of their places, whatever the number of constraints. In a left join Spark can broadcast the costs alone, never the
    places, and with the costs broadcast no place is shuffled.
    """
    weighted = {k: cons.join(weights.select("con"), "con", "left_semi") for k, (cons, _, weights) in problems.items()}
    if substrings:
        windows = substring_windows(forms, max(longest_match(weighted[k], classes) for k, (_, classes, _) in problems.items()))
    else:
        windows = token_windows(forms, int(reduce(DataFrame.union, [c.select("n") for c in weighted.values()]).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]))
    different, starts = stage(distinct_windows(windows)), substring_starts if substrings else token_starts
    rows = [starts(different, weighted[k], classes).join(weights, "con").select("window", F.lit(k).alias("problem"), "weight") for k, (_, classes, weights) in problems.items()]
    costs = stage(reduce(DataFrame.union, rows).groupBy("window").agg(*[F.sum(F.when(F.col("problem") == k, F.col("weight"))).alias(k) for k in problems]))
    return windows.join(costs, "window", "left").groupBy("ngram").agg(*[F.coalesce(F.sum(-F.col(k)), F.lit(0.0)).alias(k) for k in problems])


def windowed_harmony(forms: DataFrame, cons: DataFrame, classes: DataFrame, weights: DataFrame, substrings: bool = False) -> DataFrame:
    """ngram, harmony: windowed_harmonies() of one problem."""
    return windowed_harmonies(forms, {"harmony": (cons, classes, weights)}, substrings)


def regex_violations(forms: DataFrame, patterns: list[str]) -> DataFrame:
    """ngram, regex, v: start positions at which a pattern matches, overlaps counted. The patterns are literals of the plan."""
    pairs = F.array(*[F.struct(F.lit(p).alias("regex"), F.regexp_count("ngram", F.lit(f"(?={p})")).cast("long").alias("v")) for p in patterns])
    return forms.select("ngram", F.inline(pairs)).filter("v > 0")


def harmony(forms: DataFrame, violations: DataFrame, weights: DataFrame) -> DataFrame:
    """ngram, harmony: minus the weighted violations (weights: con, weight)."""
    cost = violations.join(weights, "con").groupBy("ngram").agg(F.sum(-F.col("v") * F.col("weight")).alias("h"))
    return forms.select("ngram").join(cost, "ngram", "left").select("ngram", F.coalesce("h", F.lit(0.0)).alias("harmony"))


def softmax(scores: DataFrame) -> DataFrame:
    """ngram, p: exp(harmony) over its sum, shifted by the largest harmony."""
    top = scores.agg(F.max("harmony").alias("top"))
    lifted = scores.join(F.broadcast(top)).select("ngram", F.exp(F.col("harmony") - F.col("top")).alias("e"))
    total = lifted.agg(F.sum("e").alias("z"))
    return lifted.join(F.broadcast(total)).select("ngram", (F.col("e") / F.col("z")).alias("p"))


def loss(target: DataFrame, predicted: DataFrame, weights: DataFrame, lam: float) -> DataFrame:
    """One row: loglik (minus the target times ln of the clipped prediction) and loss, with lam times the squared weights."""
    both = target.withColumnRenamed("p", "o").join(predicted, "ngram")
    fit = both.agg((-F.sum(F.col("o") * F.ln(F.least(F.greatest("p", F.lit(1e-20)), F.lit(1.0)))) / F.sum("o")).alias("loglik"))
    size = weights.agg(F.sum(F.col("weight") * F.col("weight")).alias("sq"))
    return fit.join(F.broadcast(size)).select("loglik", (F.col("loglik") + lam * F.col("sq")).alias("loss"))


def gradient_step(target: DataFrame, predicted: DataFrame, violations: DataFrame, weights: DataFrame, rate: float, lam: float) -> DataFrame:
    """con, weight: max(0, weight + rate * (expected violations - observed violations - lam))."""
    both = target.withColumnRenamed("p", "o").join(predicted, "ngram")
    grad = violations.join(both, "ngram").groupBy("con").agg(F.sum(F.col("v") * (F.col("p") - F.col("o"))).alias("g"))
    return weights.join(grad, "con", "left").select("con", F.greatest(F.lit(0.0), F.col("weight") + rate * (F.coalesce("g", F.lit(0.0)) - lam)).alias("weight"))
