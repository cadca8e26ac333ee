"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.jobs import classes as class_jobs
from seqloom.jobs import fitting, model
from seqloom.jobs.config import ClassConfig, ModelConfig
from seqloom.operators import association, corpus, evaluation, grammar, graphs, sequences, spectral
from seqloom.sources import read_table, stage, work_dir
from seqloom.sources import text as files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- SQL that several oracles start with
WORDS = "words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word)"
LETTERS = "syms AS (SELECT DISTINCT unnest(string_split(word, '')) AS phone FROM words)"
SEQ = "seq AS (SELECT event_type AS p, lag(event_type, 1) OVER w AS l1, lag(event_type, 2) OVER w AS l2, lead(event_type, 1) OVER w AS r1, lead(event_type, 2) OVER w AS r2 FROM events WHERE event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _cells(separate: bool = True) -> str:
    one, two = ("1", "2") if separate else ("", "")
    near = ((one, "L", "l1", "<s>"), (two, "L", "l2", "<s>"), (one, "R", "r1", "<e>"), (two, "R", "r2", "<e>"))
    union = " UNION ALL ".join(f"SELECT '{k}{side}' || coalesce({c}, '{mark}') AS context, p AS phone FROM seq" for k, side, c, mark in near)
    return f"{SEQ}, cells AS (SELECT context, phone, count(*) AS n FROM ({union}) GROUP BY 1, 2)"


CELLS = _cells()
LETTER_CELLS = WORDS + """, pad AS (SELECT n, list_concat(['<s>', '<s>'], string_split(word, ''), ['<e>', '<e>']) AS p FROM words),
pos AS (SELECT n, p, unnest(range(3, len(p) - 1)) AS i FROM pad),
cells AS (SELECT context, phone, sum(n)::BIGINT AS n FROM (
  SELECT '1L' || p[i - 1] AS context, p[i] AS phone, n FROM pos UNION ALL SELECT '2L' || p[i - 2], p[i], n FROM pos UNION ALL
  SELECT '1R' || p[i + 1], p[i], n FROM pos UNION ALL SELECT '2R' || p[i + 2], p[i], n FROM pos) GROUP BY 1, 2)"""
PAIRS = "pairs AS (SELECT x.context AS src, y.context AS dst, x.n AS a, y.n AS b FROM cells x JOIN cells y USING (phone))"
COV = CELLS + ", " + PAIRS + ", edges AS (SELECT src, dst, sum(a * b)::BIGINT AS w FROM pairs GROUP BY 1, 2)"
DEG = COV + ", deg AS (SELECT src AS node, sum(w) AS d FROM edges GROUP BY 1), ed AS (SELECT e.*, x.d AS ds, y.d AS dd FROM edges e JOIN deg x ON e.src = x.node JOIN deg y ON e.dst = y.node)"
CUT = "cut AS (SELECT DISTINCT context AS node, CASE WHEN substr(context, 2, 1) = 'L' THEN 1 ELSE 0 END AS cluster FROM cells)"
PPMI = """marg AS (SELECT context, phone, n, sum(n) OVER (PARTITION BY context) AS rs, sum(n) OVER (PARTITION BY phone) AS cs, sum(n) OVER () AS tot FROM cells),
ppmi AS (SELECT context, phone, greatest(ln(n::DOUBLE * tot::DOUBLE / (rs::DOUBLE * cs::DOUBLE)), 0.0) AS s FROM marg)"""
NGRAMS = WORDS + """, frame AS (SELECT n, list_concat(['#'], string_split(word, ''), ['#']) AS p FROM words),
ngrams AS (SELECT p[i] || '.' || p[i + 1] AS ngram, sum(n)::BIGINT AS n FROM (SELECT n, p, unnest(range(1, len(p))) AS i FROM frame) GROUP BY 1)"""
SPACE = NGRAMS + ", " + LETTERS + """, alphabet AS (SELECT phone FROM syms UNION SELECT '#'),
cands AS (SELECT a.phone || '.' || b.phone AS ngram FROM alphabet a, alphabet b),
target AS (SELECT c.ngram, coalesce(g.n / (SELECT sum(n) FROM ngrams)::DOUBLE, 0) AS p FROM cands c LEFT JOIN ngrams g USING (ngram))"""
#: Two classes of letters that the corpus itself gives: more often first than last in a word, and more frequent than the mean.
CLASSES = SPACE + """, occ AS (SELECT n, unnest(string_split(word, '')) AS phone, substr(word, 1, 1) AS f, right(word, 1) AS l FROM words),
firsts AS (SELECT substr(word, 1, 1) AS phone, sum(n) AS f FROM words GROUP BY 1), lasts AS (SELECT right(word, 1) AS phone, sum(n) AS l FROM words GROUP BY 1),
freq AS (SELECT phone, sum(n) AS n FROM occ GROUP BY 1),
mem0 AS (SELECT 'early' AS class, s.phone FROM syms s LEFT JOIN firsts USING (phone) LEFT JOIN lasts USING (phone) WHERE coalesce(f, 0) > coalesce(l, 0)
  UNION ALL SELECT 'frequent', phone FROM freq WHERE n * (SELECT count(*) FROM freq) > (SELECT sum(n) FROM freq)),
comp AS (SELECT '!' || k.class AS class, s.phone FROM (SELECT DISTINCT class FROM mem0) k, syms s WHERE NOT EXISTS (SELECT 1 FROM mem0 m WHERE m.class = k.class AND m.phone = s.phone)),
sets AS (SELECT kind, class, list_sort(list(phone)) AS phones FROM (SELECT 0 AS kind, * FROM mem0 UNION ALL SELECT 1, * FROM comp) GROUP BY 1, 2),
classes AS (SELECT split_part(min(kind || ':' || class), ':', 2) AS class, phones FROM sets GROUP BY phones UNION ALL SELECT 'word', ['#']),
named AS (SELECT class, '(' || array_to_string(phones, '|') || ')' AS part FROM classes),
cons AS (SELECT '[' || class || ']' AS con, 1::INTEGER AS n, class AS c1, NULL AS c2, part AS regex FROM named
  UNION ALL SELECT '[' || a.class || '][' || b.class || ']', 2, a.class, b.class, a.part || '[\\.]' || b.part FROM named a, named b),
members AS (SELECT class, unnest(phones) AS phone FROM classes),
tok AS (SELECT ngram, split_part(ngram, '.', 1) AS t1, split_part(ngram, '.', 2) AS t2 FROM cands),
viol AS (SELECT ngram, con, count(*) AS v FROM (
  SELECT ngram, con FROM tok JOIN members m ON m.phone = t1 JOIN cons ON n = 1 AND c1 = m.class UNION ALL
  SELECT ngram, con FROM tok JOIN members m ON m.phone = t2 JOIN cons ON n = 1 AND c1 = m.class UNION ALL
  SELECT ngram, con FROM tok JOIN members m ON m.phone = t1 JOIN members k ON k.phone = t2 JOIN cons ON n = 2 AND c1 = m.class AND c2 = k.class) GROUP BY 1, 2),
weights AS (SELECT con, 0.5 + length(con) / 100.0::DOUBLE AS weight FROM cons),
scores AS (SELECT c.ngram, coalesce(-sum(v * weight), 0.0) AS harmony FROM cands c LEFT JOIN (viol JOIN weights USING (con)) USING (ngram) GROUP BY 1),
soft AS (SELECT ngram, exp(harmony) / sum(exp(harmony)) OVER () AS p FROM scores)""".replace("\\\\", "\\")


def query(sql: str | None = None):
    """Register a query under its name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.letter_words(read_table(spark, d, "documents"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


def _event_cells(spark: SparkSession, d: str) -> DataFrame:
    """Written once: what follows reads the count table several times, and the events only for it."""
    return stage(sequences.event_contexts(_events(spark, d)))


def _letter_cells(spark: SparkSession, d: str) -> DataFrame:
    """Written once, like _event_cells."""
    return stage(sequences.word_contexts(_words(spark, d)))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """phones, n: the return flags and line states of an order's lines, in their order, as a word; an open line is a mark."""
    symbol = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("N"), F.col("l_linestatus"))).otherwise(F.col("l_returnflag"))
    return corpus.sequence_words(read_table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", symbol)


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return stage(graphs.covariance(sequences.event_contexts(_events(spark, d))))


def _cut(cells: DataFrame, name: str = "node") -> DataFrame:
    """A fixed cut: contexts on the left against those on the right."""
    return cells.select(F.col("context").alias(name)).distinct().withColumn("cluster", F.when(F.substring(name, 2, 1) == "L", 1).otherwise(0))


def _rounded(edges: DataFrame, digits: int = 6) -> DataFrame:
    return edges.withColumn("w", F.round("w", digits))


# ---------------------------------------------------------------- sequences
@query(f"WITH {WORDS}, {LETTERS} SELECT phone FROM syms")
def seq_inventory(spark, d):
    return corpus.inventory(_words(spark, d))


@query(f"WITH {WORDS} SELECT word, n FROM words")
def seq_word_types(spark, d):
    return _words(spark, d)


@query(f"WITH {NGRAMS} SELECT ngram, n FROM ngrams")
def seq_ngram_count(spark, d):
    return sequences.word_ngram_counts(_words(spark, d), 2)


@query(f"""WITH {WORDS}, frame AS (SELECT n, list_concat(['#'], string_split(word, ''), ['#']) AS p FROM words)
SELECT p[i] || '.' || p[i + 1] || '.' || p[i + 2] AS ngram, sum(n)::BIGINT AS n FROM (SELECT n, p, unnest(range(1, len(p) - 1)) AS i FROM frame) GROUP BY 1""")
def seq_trigram_count(spark, d):
    return sequences.word_ngram_counts(_words(spark, d), 3)


@query(f"""WITH {SEQ} SELECT ngram, count(*) AS n FROM (SELECT coalesce(l1, '#') || '.' || p AS ngram FROM seq UNION ALL SELECT p || '.#' FROM seq WHERE r1 IS NULL) GROUP BY 1""")
def seq_event_ngram_count(spark, d):
    return sequences.event_bigram_counts(_events(spark, d))


@query(f"WITH {CELLS} SELECT context, phone, n FROM cells")
def seq_context_count(spark, d):
    return _event_cells(spark, d)


@query(f"WITH {_cells(False)} SELECT context, phone, n FROM cells")
def seq_context_count_merged(spark, d):
    return sequences.event_contexts(_events(spark, d), separate=False)


@query(f"WITH {LETTER_CELLS} SELECT context, phone, n FROM cells")
def seq_letter_context_count(spark, d):
    return sequences.word_contexts(_words(spark, d))


_ARRAYS = """words AS (SELECT p, count(*) AS n FROM (SELECT list(s ORDER BY l_linenumber, s) AS p FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'N' || l_linestatus ELSE l_returnflag END AS s FROM lineitem) WHERE s IS NOT NULL GROUP BY l_orderkey) GROUP BY p)"""


@query(f"WITH {_ARRAYS} SELECT DISTINCT unnest(p) AS phone FROM words")
def seq_array_inventory(spark, d):
    return corpus.inventory(_orders(spark, d))


@query(f"WITH {_ARRAYS}, frame AS (SELECT n, list_concat(['#'], p, ['#']) AS p FROM words) SELECT p[i] || '.' || p[i + 1] || '.' || p[i + 2] AS ngram, sum(n)::BIGINT AS n FROM (SELECT n, p, unnest(range(1, len(p) - 1)) AS i FROM frame) GROUP BY 1")
def seq_array_ngram_count(spark, d):
    return sequences.word_ngram_counts(_orders(spark, d), 3)


@query(f"""WITH {_ARRAYS}, pad AS (SELECT n, list_concat(['<s>', '<s>'], p, ['<e>', '<e>']) AS p FROM words), pos AS (SELECT n, p, unnest(range(3, len(p) - 1)) AS i FROM pad),
cells AS (SELECT '1L' || p[i - 1] AS context, p[i] AS phone, n FROM pos UNION ALL SELECT '2L' || p[i - 2], p[i], n FROM pos UNION ALL SELECT '1R' || p[i + 1], p[i], n FROM pos UNION ALL SELECT '2R' || p[i + 2], p[i], n FROM pos)
SELECT context, phone, sum(n)::BIGINT AS n FROM cells WHERE phone <> 'NO' GROUP BY 1, 2""")
def seq_array_context_count(spark, d):
    return sequences.word_contexts(_orders(spark, d), marks=("NO",))


@query(f"WITH {WORDS}, {LETTERS} SELECT phone FROM syms")
def seq_plain_symbols(spark, d):
    """The symbols of padded words that are no marks."""
    rows = _words(spark, d).select(F.explode(corpus.padded(corpus.letters(F.col("word")), 2)).alias("phone")).distinct()
    return corpus.without_specials(rows)


# ---------------------------------------------------------------- association
@query(f"WITH {CELLS} SELECT 'phone' AS kind, phone AS name, sum(n)::BIGINT AS n FROM cells GROUP BY 2 UNION ALL SELECT 'context', context, sum(n)::BIGINT FROM cells GROUP BY 2 UNION ALL SELECT 'all', '', sum(n)::BIGINT FROM cells")
def assoc_marginals(spark, d):
    return association.marginals(_event_cells(spark, d))


@query(f"WITH {CELLS}, {PPMI} SELECT context, phone, round(s, 6) AS ppmi FROM ppmi")
def assoc_ppmi(spark, d):
    return association.ppmi(_event_cells(spark, d)).withColumn("ppmi", F.round("ppmi", 6))


@query(f"WITH {LETTER_CELLS}, {PPMI} SELECT context, phone, round(s, 6) AS ppmi FROM ppmi")
def assoc_ppmi_letters(spark, d):
    return association.ppmi(_letter_cells(spark, d)).withColumn("ppmi", F.round("ppmi", 6))


@query(f"WITH {LETTER_CELLS}, {PPMI}, {CUT}, strong AS (SELECT cluster, phone, context FROM ppmi JOIN cut ON context = node WHERE s > 0.1) SELECT cluster, array_to_string(list_sort(list(DISTINCT phone)), ' ') AS phones, array_to_string(list_sort(list(DISTINCT context)), ' ') AS contexts FROM strong GROUP BY 1")
def cls_contexts_to_symbols(spark, d):
    cells = _letter_cells(spark, d)
    return association.symbols_of_contexts(cells, _cut(cells, "context"), 0.1)


# ---------------------------------------------------------------- graphs
@query(f"WITH {COV} SELECT src, dst, w FROM edges")
def graph_cov(spark, d):
    return _graph(spark, d)


@query(f"WITH {CELLS}, {PAIRS} SELECT src, dst, sum(a + b)::BIGINT AS w FROM pairs WHERE src <= dst GROUP BY 1, 2")
def graph_one_mode(spark, d):
    return graphs.one_mode(_event_cells(spark, d))


@query(f"WITH {CELLS}, {PAIRS} SELECT src, dst, sum(a + b)::BIGINT AS w FROM pairs GROUP BY 1, 2")
def graph_reflected(spark, d):
    return graphs.reflected(graphs.one_mode(_event_cells(spark, d)))


@query(f"WITH {COV}, nrm AS (SELECT context, sqrt(sum(n::DOUBLE * n)) AS l FROM cells GROUP BY 1) SELECT src, dst, round(w / (x.l * y.l), 6) AS w FROM edges JOIN nrm x ON src = x.context JOIN nrm y ON dst = y.context")
def graph_cosine(spark, d):
    return _rounded(graphs.cosine(_event_cells(spark, d)))


@query(f"WITH {CELLS}, sh AS (SELECT context, phone, n / (sum(n) OVER (PARTITION BY context))::DOUBLE AS p FROM cells) SELECT x.context AS src, y.context AS dst, round(sum(sqrt(x.p * y.p)), 6) AS w FROM sh x JOIN sh y USING (phone) GROUP BY 1, 2")
def graph_bhattacharyya(spark, d):
    return _rounded(graphs.bhattacharyya(_event_cells(spark, d)))


_KLD = """grid AS (SELECT c.context, p.phone, coalesce(n, 0) + 0.0002::DOUBLE AS n FROM (SELECT DISTINCT context FROM cells) c CROSS JOIN (SELECT DISTINCT phone FROM cells) p LEFT JOIN cells USING (context, phone)),
q AS (SELECT context, phone, n / sum(n) OVER (PARTITION BY context) AS p FROM grid)
SELECT x.context AS src, y.context AS dst, round(exp(-(sum(x.p * ln(x.p / y.p)) + sum(y.p * ln(y.p / x.p)))), 6) AS w FROM q x JOIN q y USING (phone) GROUP BY 1, 2"""


@query(f"WITH {CELLS}, {_KLD}")
def graph_kld(spark, d):
    return _rounded(graphs.kld_similarity(_event_cells(spark, d)))


@query(f"WITH {LETTER_CELLS}, {_KLD}")
def graph_kld_letters(spark, d):
    return _rounded(graphs.kld_similarity(_letter_cells(spark, d)))


@query(f"WITH {DEG} SELECT src, dst, round(CASE WHEN src = dst THEN 0 ELSE w / ds::DOUBLE END, 6) AS w FROM ed")
def graph_row_norm_cov(spark, d):
    return _rounded(graphs.row_normalised(_graph(spark, d)))


@query(f"WITH {DEG} SELECT src, dst, round(w / (ds + dd)::DOUBLE, 6) AS w FROM ed")
def graph_edge_norm(spark, d):
    return _rounded(graphs.edge_normalised(_graph(spark, d)))


@query(f"WITH {DEG} SELECT src, dst, round(w / (sqrt(ds::DOUBLE) * sqrt(dd::DOUBLE)), 6) AS w FROM ed")
def graph_norm_adj(spark, d):
    return _rounded(graphs.symmetric_normalised(_graph(spark, d)))


_LAP = ", lap AS (SELECT src, dst, ((CASE WHEN src = dst THEN ds ELSE 0 END) - w)::BIGINT AS w, ds, dd FROM ed)"


@query(f"WITH {DEG}{_LAP} SELECT src, dst, w FROM lap")
def graph_laplacian(spark, d):
    return graphs.laplacian(_graph(spark, d))


@query(f"WITH {DEG}{_LAP} SELECT src, dst, round(w / (sqrt(ds::DOUBLE) * sqrt(dd::DOUBLE)), 6) AS w FROM lap")
def graph_laplacian_sym(spark, d):
    return _rounded(graphs.laplacian(_graph(spark, d), "sym"))


@query(f"WITH {DEG}{_LAP} SELECT src, dst, round(w / ds::DOUBLE, 6) AS w FROM lap")
def graph_laplacian_rw(spark, d):
    return _rounded(graphs.laplacian(_graph(spark, d), "rw"))


@query(f"WITH {DEG} SELECT src, dst, round(w - ds::DOUBLE * dd::DOUBLE / (2 * (SELECT sum(w) FROM edges))::DOUBLE, 3) AS w FROM ed")
def graph_modularity_matrix(spark, d):
    return _rounded(graphs.modularity_matrix(_graph(spark, d)), 3)


@query(f"WITH {COV}, {CUT} SELECT src, dst, w FROM edges WHERE src IN (SELECT node FROM cut WHERE cluster = 1) AND dst IN (SELECT node FROM cut WHERE cluster = 1)")
def graph_subgraph(spark, d):
    cells = _event_cells(spark, d)
    return graphs.subgraph(graphs.covariance(cells), _cut(cells).filter("cluster = 1"))


@query(f"""WITH {DEG}, {CUT}, mm AS (SELECT sum(w)::DOUBLE AS m2 FROM edges),
node AS (SELECT cut.node, cluster, d::DOUBLE AS d FROM cut JOIN deg USING (node)),
pr AS (SELECT x.d AS dx, y.d AS dy, coalesce(e.w, 0) AS w FROM node x JOIN node y ON x.cluster = y.cluster LEFT JOIN edges e ON e.src = x.node AND e.dst = y.node)
SELECT round(sum(w - (dx / 2 + dy / 2) / m2) / any_value(m2), 6) AS sum_form, round(sum(w - dx * dy / m2) / any_value(m2), 6) AS product_form FROM pr, mm""")
def graph_modularity(spark, d):
    cells = _event_cells(spark, d)
    return graphs.modularity(graphs.covariance(cells), _cut(cells)).select(*[F.round(c, 6).alias(c) for c in ("sum_form", "product_form")])


@query(f"""WITH {COV}, {CUT}, c AS (SELECT node FROM cut WHERE cluster = 1),
s AS (SELECT sum(w) FILTER (src IN (FROM c)) AS r, sum(w) FILTER (src IN (FROM c) AND dst IN (FROM c)) AS i, sum(w) AS t FROM edges)
SELECT round((r - i) / least(r, t - r)::DOUBLE, 6) AS conductance FROM s""".replace("(FROM c)", "(SELECT node FROM c)"))
def graph_conductance(spark, d):
    cells = _event_cells(spark, d)
    return graphs.conductance(graphs.covariance(cells), _cut(cells).filter("cluster = 1").select("node")).select(F.round("conductance", 6).alias("conductance"))


@query(f"""WITH {COV}, e AS (SELECT src, dst, w::DOUBLE AS w FROM edges), wk AS (SELECT x.src AS node, sum(x.w * y.w * z.w) AS t FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src GROUP BY 1),
sc AS (SELECT src AS node, sum(w) * sum(w) - sum(w * w) AS s FROM e GROUP BY 1) SELECT node, round(t / s, 3) AS coef FROM wk JOIN sc USING (node)""")
def graph_clustering_coef(spark, d):
    return graphs.clustering_coefficients(_graph(spark, d)).withColumn("coef", F.round("coef", 3))


@query(f"""WITH {COV}, e AS (SELECT src, dst, w::DOUBLE AS w FROM edges), wk AS (SELECT x.src AS node, sum(x.w * y.w * z.w) AS t FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src GROUP BY 1),
sc AS (SELECT src AS node, sum(w) * sum(w) - sum(w * w) AS s FROM e GROUP BY 1) SELECT round(avg(t / s), 3) AS coef FROM wk JOIN sc USING (node)""")
def graph_avg_clustering_coef(spark, d):
    return graphs.clustering_coefficients(_graph(spark, d)).agg(F.round(F.avg("coef"), 3).alias("coef"))


@query(f"""WITH RECURSIVE {LETTER_CELLS}, kld AS ({_KLD.replace("grid AS", "WITH grid AS", 1)}), e AS (SELECT src, dst FROM kld WHERE w > 0.2),
reach AS (SELECT DISTINCT context AS node, context AS root FROM cells UNION SELECT reach.node, e.dst FROM reach JOIN e ON e.src = reach.root)
SELECT node, min(root) AS root FROM reach GROUP BY 1""")
def graph_components(spark, d):
    """The parts of the context graph that links of over 0.2 leave."""
    edges = _rounded(graphs.kld_similarity(_letter_cells(spark, d)))
    return graphs.components(stage(edges.filter("w > 0.2")))


@query(f"""WITH {DEG}, na AS (SELECT src, dst, w / (sqrt(ds::DOUBLE) * sqrt(dd::DOUBLE)) AS w FROM ed), l AS (SELECT src, dst, -w AS w FROM na UNION ALL SELECT src, src, sum(w) FROM na GROUP BY src)
SELECT src, dst, round(sum(w), 6) AS w FROM l GROUP BY 1, 2 HAVING abs(sum(w)) > 0.000001""")
def graph_from_spectrum(spark, d):
    """The Laplacian of the normalised graph, put together again from all eigenvalues and vectors of the Lanczos iteration."""
    edges = stage(class_jobs.as_part(graphs.symmetric_normalised(_graph(spark, d))))
    size = edges.select("src").distinct().count()
    values, vectors = spectral.lanczos(edges, "plain", size)
    scaled = F.transform("vector", lambda v, i: v * F.get(F.array(*[F.lit(float(x)) for x in values[0]]), i))
    a, b = vectors.select(F.col("node").alias("src"), scaled.alias("a")), vectors.select(F.col("node").alias("dst"), F.col("vector").alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.crossJoin(b).select("src", "dst", F.round(dot, 6).alias("w")).filter("abs(w) > 0.000001")  # nodes x nodes is the result


# ---------------------------------------------------------------- candidates, constraints, model
def _alphabet(words: DataFrame) -> DataFrame:
    return corpus.inventory(words).union(words.sparkSession.range(1).select(F.lit(corpus.EDGE)))


def _classes(words: DataFrame) -> DataFrame:
    """class, phones: letters that are more often first than last in a word, and letters above the mean frequency."""
    ends = words.select(F.explode(F.array(F.struct(F.substring("word", 1, 1).alias("phone"), F.col("n").alias("d")), F.struct(F.substring("word", -1, 1).alias("phone"), (-F.col("n")).alias("d")))).alias("e")).select("e.*")
    early = ends.groupBy("phone").agg(F.sum("d").alias("d")).filter("d > 0").select(F.lit("early").alias("class"), "phone")
    freq = words.select("n", F.explode(corpus.letters(F.col("word"))).alias("phone")).groupBy("phone").agg(F.sum("n").alias("n"))
    frequent = freq.join(F.broadcast(freq.agg(F.avg("n").alias("mean")))).filter("n > mean").select(F.lit("frequent").alias("class"), "phone")
    return early.unionByName(frequent).groupBy("class").agg(F.array_sort(F.collect_set("phone")).alias("phones"))


def _model(spark: SparkSession, d: str, *parts: str) -> dict[str, DataFrame]:
    """The model's tables that a query needs, each written once: all of them are small next to the corpus and read several times."""
    words = model.staged_words(_words(spark, d))
    own = {"weights": "cons", "scores": "violations"}
    t = model.tables(words, _classes(words), parts=tuple(own.get(p, p) for p in parts)) | {"words": words}
    if {"weights", "scores"} & set(parts):
        t["weights"] = t["cons"].select("con", (0.5 + F.length("con") / 100.0).alias("weight"))
    if "scores" in parts:
        t["scores"] = stage(grammar.harmony(t["target"], t["violations"], t["weights"]))
    return t


@query(f"WITH {SPACE} SELECT ngram FROM cands WHERE ngram NOT IN (SELECT ngram FROM ngrams)")
def cand_unattested(spark, d):
    words = stage(_words(spark, d))
    return grammar.unattested(_alphabet(words), sequences.word_ngram_counts(words, 2), 2)


@query(f"WITH {SPACE} SELECT ngram, round(p, 9) AS p FROM target")
def cand_observed_prob(spark, d):
    return _model(spark, d, "target")["target"].withColumn("p", F.round("p", 9))


@query(f"WITH {CLASSES} SELECT con, n, regex FROM cons")
def con_build(spark, d):
    return _model(spark, d, "cons")["cons"].select("con", "n", "regex")


@query(f"WITH {CLASSES} SELECT ngram, con, v FROM viol")
def con_violations_token(spark, d):
    return _model(spark, d, "violations")["violations"]


_FIXED = (r"(t|h)[\.](h)", r"(e|i|o)", r"(h|e)[\.](#)")


@query("WITH " + SPACE + ", pats AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in _FIXED) + "]) AS regex), hits AS (SELECT ngram, regex, len(list_filter(range(1, length(ngram) + 1), lambda i: regexp_matches(substr(ngram, i::INTEGER), '^(' || regex || ')')))::BIGINT AS v FROM cands, pats) SELECT * FROM hits WHERE v > 0")
def con_violations_substring(spark, d):
    return grammar.regex_violations(grammar.candidates(_alphabet(_words(spark, d)), 2), list(_FIXED))


@query(f"WITH {CLASSES} SELECT ngram, round(harmony, 6) AS harmony FROM scores")
def score_harmony(spark, d):
    return _model(spark, d, "scores")["scores"].withColumn("harmony", F.round("harmony", 6))


@query(f"WITH {CLASSES} SELECT ngram, round(p, 9) AS p FROM soft")
def score_softmax(spark, d):
    return grammar.softmax(_model(spark, d, "scores")["scores"]).withColumn("p", F.round("p", 9))


@query(f"WITH {CLASSES}, ll AS (SELECT -sum(t.p * ln(least(greatest(s.p, 1e-20), 1.0))) / sum(t.p) AS l FROM target t JOIN soft s USING (ngram)), sq AS (SELECT sum(weight * weight) AS q FROM weights) SELECT round(l, 6) AS loglik, round(l + 0.001 * q, 6) AS loss FROM ll, sq")
def score_loss(spark, d):
    m = _model(spark, d, "scores")
    return grammar.loss(m["target"], grammar.softmax(m["scores"]), m["weights"], 0.001).select(*[F.round(c, 6).alias(c) for c in ("loglik", "loss")])


@query(f"WITH {CLASSES}, g AS (SELECT con, sum(v * (s.p - t.p)) AS g FROM viol JOIN soft s USING (ngram) JOIN target t USING (ngram) GROUP BY 1) SELECT con, round(greatest(0, weight + 0.1 * (coalesce(g, 0) - 0.001)), 6) AS weight FROM weights LEFT JOIN g USING (con)")
def fit_gradient_step(spark, d):
    m = _model(spark, d, "scores")
    return grammar.gradient_step(m["target"], grammar.softmax(m["scores"]), m["violations"], m["weights"], 0.1, 0.001).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {CLASSES}, size AS (SELECT count(*) AS k FROM cands), w1 AS (SELECT con, greatest(0, 0.1::DOUBLE * (sum(v * (1 / k - p)) - 0.001)) AS weight FROM viol JOIN target USING (ngram), size GROUP BY con),
h1 AS (SELECT c.ngram, exp(coalesce(-sum(v * weight), 0.0)) AS e FROM cands c LEFT JOIN (viol JOIN w1 USING (con)) USING (ngram) GROUP BY 1), p1 AS (SELECT ngram, e / sum(e) OVER () AS q FROM h1),
w2 AS (SELECT con, greatest(0, any_value(weight) + 0.1::DOUBLE * (sum(v * (q - p)) - 0.001)) AS weight FROM viol JOIN target USING (ngram) JOIN p1 USING (ngram) JOIN w1 USING (con) GROUP BY con)
SELECT con, round(weight, 9) AS weight FROM w2 WHERE weight > 0""")
def fit_two_steps(spark, d):
    """The first two steps of the fit, which SQL can follow."""
    m = _model(spark, d, "violations")
    return fitting.fit(m["target"], m["violations"], ModelConfig(n_iter=2)).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {CLASSES}, place AS (SELECT word, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT word, list_concat(['#'], string_split(word, ''), ['#']) AS p FROM words)),
hits AS (SELECT word, con FROM place JOIN members m ON m.phone = p[i] JOIN cons ON n = 1 AND c1 = m.class UNION ALL
  SELECT word, con FROM place JOIN members m ON m.phone = p[i] JOIN members k ON k.phone = p[i + 1] JOIN cons ON n = 2 AND c1 = m.class AND c2 = k.class WHERE i < len(p))
SELECT array_to_string(list_concat(['#'], string_split(word, ''), ['#']), '.') AS ngram, round(coalesce(-sum(weight), 0.0), 6) AS harmony FROM words LEFT JOIN (hits JOIN weights USING (con)) USING (word) GROUP BY 1""")
def score_judgements(spark, d):
    m = _model(spark, d, "weights")
    return model.judged(model.dotted(m["words"]), m["cons"], m["classes"], m["weights"]).withColumn("harmony", F.round("harmony", 6))


_STARTS = "(SELECT count(*) FROM (SELECT unnest(range(1, length({form}) + 1)) AS i) WHERE regexp_matches(substr({form}, i::INTEGER), '^(' || regex || ')'))"


@query(f"WITH {CLASSES}, hits AS (SELECT ngram, con, {_STARTS.format(form='ngram')}::BIGINT AS v FROM cands, cons) SELECT * FROM hits WHERE v > 0")
def con_violations_substring_table(spark, d):
    """The whole constraint table by substring, through one automaton."""
    m = _model(spark, d, "target", "cons")
    return grammar.substring_violations(m["target"].select("ngram"), m["cons"], m["classes"])


@query(f"""WITH {CLASSES}, forms AS (SELECT array_to_string(list_concat(['#'], string_split(word, ''), ['#']), '.') AS ngram FROM words),
spots AS (SELECT ngram, substr(ngram, unnest(range(1, length(ngram) + 1))::INTEGER, 3) AS w FROM forms),
cost AS (SELECT w, sum(weight) AS cost FROM (SELECT DISTINCT w FROM spots), cons JOIN weights USING (con) WHERE regexp_matches(w, '^(' || regex || ')') GROUP BY 1)
SELECT ngram, round(coalesce(-sum(cost), 0.0), 6) AS harmony FROM spots LEFT JOIN cost USING (w) GROUP BY 1""")
def score_judgements_substring(spark, d):
    m = _model(spark, d, "weights")
    return model.judged(model.dotted(m["words"]), m["cons"], m["classes"], m["weights"], ModelConfig(match="substring")).withColumn("harmony", F.round("harmony", 6))


_JUDGED = f"""{CLASSES}, forms AS (SELECT list_concat(['#'], string_split(word, ''), ['#']) AS p, word FROM words), place AS (SELECT word, p, unnest(range(1, len(p) + 1)) AS i FROM forms),
hits AS (SELECT word, con FROM place JOIN members m ON m.phone = p[i] JOIN cons ON n = 1 AND c1 = m.class UNION ALL
  SELECT word, con FROM place JOIN members m ON m.phone = p[i] JOIN members k ON k.phone = p[i + 1] JOIN cons ON n = 2 AND c1 = m.class AND c2 = k.class WHERE i < len(p)),
sums AS (SELECT word, coalesce(-sum(weight), 0.0) AS harmony FROM words LEFT JOIN (hits JOIN weights USING (con)) USING (word) GROUP BY 1)"""


@query(f"WITH {_JUDGED} SELECT array_to_string(string_split(word, ''), ' ') || ' ' AS form, array_to_string(string_split(word, '')[:2], ' ') AS onset, round(harmony, 3) AS score FROM sums")
def sink_judgements(spark, d):
    """Judgements written as text and read again."""
    m, folder = _model(spark, d, "weights"), work_dir(spark)
    scores = model.judged(model.dotted(m["words"]), m["cons"], m["classes"], m["weights"])
    files.write_judgements(scores.select(F.concat("ngram", F.lit(".")).alias("form"), "harmony"), folder)
    return files.read_judgements(spark, folder)


@query(f"WITH {CLASSES} SELECT regex, round(weight, 3) AS weight FROM cons JOIN weights USING (con)")
def sink_grammar(spark, d):
    """A grammar written as text and read again."""
    m, folder = _model(spark, d, "weights"), work_dir(spark)
    files.write_grammar(m["cons"].join(m["weights"], "con"), folder)
    return files.read_grammar(spark, folder)


@query(f"WITH {CLASSES} SELECT array_to_string(phones, ' ') AS phones FROM classes")
def sink_classes(spark, d):
    """Classes written as text and read again."""
    m, folder = _model(spark, d, "classes"), work_dir(spark)
    files.write_classes(m["classes"], folder)
    return files.read_classes(spark, folder).select(F.array_join("phones", " ").alias("phones"))


# symbols of one and of two characters, a mark of syllables, and two classes whose symbols joined without a separator are equal
_MARKED = """syl AS (SELECT list(s ORDER BY l_linenumber, s) AS p FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'N' WHEN l_returnflag = 'A' THEN 'F' WHEN l_linestatus = 'F' THEN 'NF' ELSE '!' END AS s FROM lineitem) GROUP BY l_orderkey),
orders_of AS (SELECT p, count(*) AS n FROM syl GROUP BY p),
classes AS (SELECT * FROM (VALUES ('F N', ['F', 'N']), ('NF', ['NF']), ('word', ['#']), ('syllable', ['!'])) t(class, phones)),
named AS (SELECT class, '(' || array_to_string(phones, '|') || ')' AS part FROM classes),
cons AS (SELECT '[' || class || ']' AS con, 1 AS n, class AS c1, NULL AS c2, part AS regex FROM named UNION ALL SELECT '[' || a.class || '][' || b.class || ']', 2, a.class, b.class, a.part || '[.]' || b.part FROM named a, named b),
members AS (SELECT class, unnest(phones) AS phone FROM classes), alphabet AS (SELECT DISTINCT phone FROM members),
cands AS (SELECT a.phone AS t1, b.phone AS t2, a.phone || '.' || b.phone AS ngram FROM alphabet a, alphabet b)"""


def _marked(spark: SparkSession, d: str, match: str, *parts: str) -> dict[str, DataFrame]:
    symbol = F.when(F.col("l_returnflag") == "R", "N").when(F.col("l_returnflag") == "A", "F").when(F.col("l_linestatus") == "F", "NF").otherwise(model.SYLLABLE)
    words = stage(corpus.sequence_words(read_table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", symbol))
    classes = model.named_classes(spark.createDataFrame([(["N", "F"],), (["NF"],)], "phones array<string>"))
    return model.tables(words, classes, ModelConfig(syll_boundaries=True, match=match), parts) | {"words": words}


@query(f"""WITH {_MARKED} SELECT ngram, con, count(*) AS v FROM (SELECT ngram, con FROM cands JOIN members m ON m.phone = t1 JOIN cons ON n = 1 AND c1 = m.class UNION ALL SELECT ngram, con FROM cands JOIN members m ON m.phone = t2 JOIN cons ON n = 1 AND c1 = m.class UNION ALL
SELECT ngram, con FROM cands JOIN members m ON m.phone = t1 JOIN members k ON k.phone = t2 JOIN cons ON n = 2 AND c1 = m.class AND c2 = k.class) GROUP BY 1, 2""")
def con_violations_marked(spark, d):
    """Symbols of several characters and marks of syllables, by token."""
    return _marked(spark, d, "token", "violations")["violations"]


@query(f"WITH {_MARKED}, hits AS (SELECT ngram, con, {_STARTS.format(form='ngram')}::BIGINT AS v FROM cands, cons) SELECT * FROM hits WHERE v > 0")
def con_violations_marked_substring(spark, d):
    return _marked(spark, d, "substring", "violations")["violations"]


@query(f"""WITH {_MARKED}, forms AS (SELECT array_to_string(list_concat(['#'], p, ['#']), '.') AS ngram FROM orders_of),
hits AS (SELECT ngram, {_STARTS.format(form='ngram')} * (0.5 + length(con) / 100.0::DOUBLE) AS cost FROM forms, cons)
SELECT ngram, round(coalesce(-sum(cost), 0.0), 6) AS harmony FROM hits GROUP BY 1""")
def score_marked_substring(spark, d):
    m = _marked(spark, d, "substring", "cons")
    weights = m["cons"].select("con", (0.5 + F.length("con") / 100.0).alias("weight"))
    return model.judged(model.dotted(m["words"]), m["cons"], m["classes"], weights, ModelConfig(match="substring")).withColumn("harmony", F.round("harmony", 6))


# ---------------------------------------------------------------- evaluation
def _rated(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("SELECT lang, toxic, round(avg(quality), 6) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def eval_group_mean(spark, d):
    return evaluation.group_mean(_rated(spark, d), ["lang", "toxic"], "quality").withColumn("mean", F.round("mean", 6))


@query("SELECT source, round(avg(quality), 6) AS mean FROM labels JOIN documents USING (doc_id) WHERE lang = 'fr' GROUP BY 1")
def eval_kind_means(spark, d):
    return evaluation.kind_means(_rated(spark, d), "lang", "fr", "source", "quality").withColumn("mean", F.round("mean", 6))


@query("""WITH q AS (SELECT source, avg(quality) AS mean FROM labels JOIN documents USING (doc_id) WHERE lang = 'fr' GROUP BY 1), l AS (SELECT source, avg(n_chars) AS mean FROM documents GROUP BY 1)
SELECT source, round(q.mean, 6) AS mean_x, round(l.mean, 4) AS mean_y FROM q JOIN l USING (source)""")
def eval_merge(spark, d):
    lengths = evaluation.group_mean(read_table(spark, d, "documents"), ["source"], "n_chars")
    both = evaluation.merged(evaluation.kind_means(_rated(spark, d), "lang", "fr", "source", "quality"), lengths, "source")
    return both.select("source", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"))


@query("SELECT source, arg_max(quality, doc_id) AS last FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def eval_last_wins(spark, d):
    return evaluation.last_value(_rated(spark, d), ["source"], "doc_id", "quality")


@query("SELECT doc_id, coalesce(quality, 0)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def eval_default_zero(spark, d):
    labels = read_table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return evaluation.with_default(read_table(spark, d, "documents").select("doc_id"), labels, "doc_id", "score")


@query("""WITH v AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL), c AS (SELECT x, y, count(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT sum(a.n::DOUBLE * b.n * sign(b.y - a.y)) AS s FROM c a JOIN c b ON a.x < b.x),
tx AS (SELECT sum(t * (t - 1) / 2) AS a, sum(t * (t - 1) * (t - 2)) AS b, sum(t * (t - 1) * (2 * t + 5)) AS c, sum(t) AS n FROM (SELECT sum(n)::DOUBLE AS t FROM c GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2) AS a, sum(t * (t - 1) * (t - 2)) AS b, sum(t * (t - 1) * (2 * t + 5)) AS c FROM (SELECT sum(n)::DOUBLE AS t FROM c GROUP BY y))
SELECT round(s.s / sqrt((tx.n * (tx.n - 1) / 2 - tx.a) * (tx.n * (tx.n - 1) / 2 - ty.a)), 6) AS tau,
  round(s.s / sqrt((tx.n * (tx.n - 1) * (2 * tx.n + 5) - tx.c - ty.c) / 18 + 2 * tx.a * ty.a / (tx.n * (tx.n - 1)) + tx.b * ty.b / (9 * tx.n * (tx.n - 1) * (tx.n - 2))), 6) AS z, tx.n::BIGINT AS n FROM s, tx, ty""")
def eval_kendall(spark, d):
    return evaluation.kendall(read_table(spark, d, "part"), F.col("p_size"), F.col("p_retailprice")).select(F.round("tau", 6).alias("tau"), F.round("z", 6).alias("z"), "n")


@query("WITH v AS (SELECT corr(p_size::DOUBLE, p_retailprice) AS r, count(*) AS n FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL) SELECT round(r, 6) AS r, round(r * sqrt(n - 2) / sqrt(1 - r * r), 5) AS t, n FROM v")
def eval_pearson(spark, d):
    return evaluation.pearson(read_table(spark, d, "part"), "p_size", "p_retailprice").select(F.round("r", 6).alias("r"), F.round("t", 5).alias("t"), "n")


@query("""WITH p AS (SELECT o_custkey, (o_orderkey % 97 + 1) / 98.0::DOUBLE AS p FROM orders), s AS (SELECT o_custkey, count(*) AS k, -sum(ln(p)) AS h, sum(1 / p) AS i FROM p GROUP BY 1)
SELECT o_custkey, k, round(list_sum(list_transform(range(0, k), lambda j: exp(j * ln(h) - lgamma(j + 1) - h))), 9) AS fisher, round(k / i, 9) AS harmonic FROM s""")
def eval_combined_p(spark, d):
    p = read_table(spark, d, "orders").select("o_custkey", ((F.col("o_orderkey") % 97 + 1) / F.lit(98.0)).alias("p"))
    return evaluation.combined_p(p, ["o_custkey"], "p").select("o_custkey", "k", F.round("fisher", 9).alias("fisher"), F.round("harmonic", 9).alias("harmonic"))


@query("""WITH r AS (SELECT source, avg(quality) AS mean FROM labels JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY 1),
l AS (SELECT source, arg_max(n_chars, doc_id)::DOUBLE AS last FROM documents GROUP BY 1), b AS (SELECT source, mean AS x, coalesce(last, 0) AS y FROM r LEFT JOIN l USING (source)),
t AS (SELECT sum(sign(q.x - p.x) * sign(q.y - p.y)) AS s, sqrt(sum(abs(sign(q.x - p.x))) * sum(abs(sign(q.y - p.y)))) AS d FROM b p JOIN b q ON p.source < q.source)
SELECT round(s / nullif(d, 0), 6) AS tau, (SELECT round(corr(x, y), 6) FROM b) AS r FROM t""")
def eval_agreement(spark, d):
    """Mean ratings of one kind's keys against the keys' last scores."""
    ratings = _rated(spark, d)
    scores = read_table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return evaluation.agreement(ratings, scores, "source", "lang", "en", "quality", "n_chars", "doc_id").select(F.round("tau", 6).alias("tau"), F.round("r", 6).alias("r"))


# ---------------------------------------------------------------- whole jobs, rows only
@query()
def cluster_spectral(spark, d):
    return class_jobs.discover(_letter_cells(spark, d))


@query()
def cluster_recursive(spark, d):
    return class_jobs.discover(_event_cells(spark, d), ClassConfig(method="recurse"))


@query()
def cluster_symbol_axes(spark, d):
    return class_jobs.symbol_axes(_letter_cells(spark, d))


@query()
def fit_maxent(spark, d):
    m = _model(spark, d, "violations")
    return fitting.fit(m["target"], m["violations"], ModelConfig())


@query()
def model_judgements(spark, d):
    """Grammar fitted on the words and classes of the corpus, and the harmony of every word under it."""
    words = model.staged_words(_words(spark, d))
    return model.fitted_judgements(words, _classes(words), model.dotted(words))[1]


@query()
def model_repetitions(spark, d):
    """Classes, grammar and judgements of the corpus for three seeds, held against the logarithm of the words' counts."""
    words = model.staged_words(_words(spark, d))
    forms = model.dotted(words)
    return model.repeated(words, forms, forms.select("ngram", F.ln("n").alias("rating")), [1, 2, 3])
