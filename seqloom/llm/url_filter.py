"""URL filter in DataFrame functions only: host and path rules, and logistic regression on hashed character n-grams.

The regression learns from a small labelled URL table (at most `max_labelled` rows, a fixed bound of the model's
fit). It has one weight for each of `buckets` hash buckets of n-grams of host and path, and gradient steps are taken on
one coefficient for each labelled URL: from zero weights these are the same steps, and the labelled table is small.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and gets the method's
verdict on its bias alone; ties between rules of one length go to the first in the list; repeated rows are judged alike; an empty
table gives an empty result. Columns other than the named url column pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_GOOD = ("city-library", "weather", "www.gardening", "blog.bakery", "history-museum", "m.stations", "northern-school", "wiki.rivers", "www.theatre", "shop.lanterns", "science-institute", "docs.compiler", "news.harbour", "m.cathedral", "mountain-weather", "www.orchestra", "blog.birding", "nation-archive", "m.therapist", "students-union")
_BAD = ("cheap-meds", "www.pills-24", "spam-links", "link-farm", "blog.casino-777", "m.adult-cams", "x-adult", "adult-xx", "bets-online", "www.free-casino", "win-cash", "m.free-pills", "track-ads", "ads-click", "www.tracker-ads", "sports-bets", "cheap-loans", "spam-mailer", "casino-games", "m.winbets")
_TLD, _LANG = ("com", "net", "org"), ("en", "fr", "de", "es")


def seed_urls() -> list[tuple[str, int]]:
    """The default labelled table: invented hosts, 1 for those to block; both labels share domains, languages and page numbers."""
    return [(f"http://{host}.example.{_TLD[i % 3]}/{_LANG[i % 4]}/{37 * i + 11}", y) for y, hosts in ((0, _GOOD), (1, _BAD)) for i, host in enumerate(hosts)]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES, part: int | None = None) -> Column:
    """The text of the longest rule that fits (part None), or its verdict (part 0); null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, rule[1] + rule[2] if part is None else rule[part]).otherwise(out)
    return out


def features(host: Column, path: Column, buckets: int, sizes=(3, 4, 5)) -> Column:
    """Hash buckets of the character n-grams of host and path, and the bias as bucket `buckets`."""
    def grams(kind: str, text: Column, n: int) -> Column:
        # a text shorter than n has no n-gram of it; the filter drops the one start that sequence() gives then
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: i <= F.length(text) - n + 1)
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substr(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    texts = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": F.concat(path, F.lit("$"))}
    parts = [F.array(F.lit(buckets)), *[grams(kind, text, n) for kind, text in texts.items() for n in sizes]]
    return F.concat(*parts)


def fit(labelled: DataFrame, buckets: int = 4096, steps: int = 300, rate: float = 0.002, decay: float = 0.01, max_labelled: int = 256) -> list[float]:
    """Weights by bucket, the bias last. labelled: url, label (1: block)."""
    rows = labelled.select(F.col("url").alias("u"), F.col("label").cast("double").alias("y")).filter("y IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("u", "y"), "u", "y").limit(max_labelled)
    ones = rows.groupBy("u", "y").agg(F.count("*").alias("times"))
    x = ones.select("u", "y", "times", F.explode(features(host_of(F.col("u")), path_of(F.col("u")), buckets)).alias("b")).groupBy("u", "y", "times", "b").agg(F.count("*").alias("n"))
    left, right = x.alias("l"), x.alias("r")
    dots = left.join(right, F.col("l.b") == F.col("r.b")).groupBy(F.struct("l.u", "l.y", "l.times").alias("i"), F.struct("r.u", "r.y").alias("j")).agg(F.sum(F.col("l.n") * F.col("r.n")).cast("double").alias("dot"))
    lines = dots.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "dot"))).alias("js"))
    table = lines.agg(F.sort_array(F.collect_list(F.struct("i", F.transform("js", lambda p: p["dot"]).alias("k")))).alias("rows"))
    add = lambda a, v: a + v

    def step(a: Column, _: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(r["k"], a, lambda k, v: k * v), F.lit(0.0), add)
            return a[i] * (1 - rate * decay) + rate * r["i"]["times"] * (r["i"]["y"] - 1 / (1 + F.exp(-margin)))

        return F.transform("rows", one)

    solved = table.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("rows", lambda r: F.lit(0.0)), step).alias("a"))
    coef = solved.select(F.inline(F.zip_with("rows", "a", lambda r, a: F.struct(r["i"]["u"].alias("u"), r["i"]["y"].alias("y"), a.alias("a")))))
    summed = x.join(coef, (x["u"].eqNullSafe(coef["u"])) & (x["y"] == coef["y"])).groupBy("b").agg(F.sum(F.col("n") * F.col("a")).alias("w"))
    weights = [0.0] * (buckets + 1)
    for b, w in summed.collect():  # one row a bucket at most
        weights[b] = w
    return weights


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, buckets: int = 4096, url: str = "url", limit: float = 0.7) -> DataFrame:
    """The columns of `pages` and host, path, rule, score (chance that it is to be blocked), verdict."""
    weights = F.lit(fit(labelled, buckets))
    base = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("_row"), host_of(pages[url]).alias("_host"), path_of(pages[url]).alias("_path"))
    margin = F.aggregate(features(F.col("_host"), F.col("_path"), buckets), F.lit(0.0), lambda s, b: s + F.get(weights, b))
    base = base.withColumn("_score", 1 / (1 + F.exp(-margin)))
    host, path = F.col("_host"), F.col("_path")
    verdict = F.coalesce(longest_rule(host, path, rules, 0), F.when(F.col("_score") > limit, "block").otherwise("allow"))
    return base.select("_row", host.alias("host"), path.alias("path"), longest_rule(host, path, rules).alias("rule"), F.col("_score").alias("score"), verdict.alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every page."""
    labelled = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in seed_urls()])))
    out = judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), labelled)
    return out.select("_row.page_id", "host", "path", "rule", "verdict", "score")
