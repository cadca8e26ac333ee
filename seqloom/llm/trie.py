"""The prefix trie of rebuilt conversations and totals of its subtrees by parallel tree contraction.

Rows are put in order by one range sort (a long conversation may lie in several parts) and numbered by counts of the parts. A
prefix is known by the XOR of 128-bit hashes of its turns, each hashed with its place; prefixes of a conversation are running
XORs, taken in blocks of turns, so that no task needs a whole conversation. Equal prefixes are one node, named by its least
member and its depth.

Totals of subtrees: rounds rake all leaves (their totals go to their parents) and then compress all chains of nodes with one
child: doubling jumps give each node of a chain the end of the chain and the sum on the way, and the end takes the
place of the chain under the parent of its top. When only the root is left, chains are expanded from the last round back to the first:
a node's total is that of its end and the sum on the way. Rounds grow with the logarithm of the nodes, not with the depth.

Defined results: rows with a null conv_id take no part; turns order with null first, ties by role, then text; rows that
repeat a turn are turns of their own; null roles and texts are empty; an empty table gives an empty result, without
a root. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources import discard, read_table, stage

#: Turns of one conversation in a block of running XORs, and the most turns that come from another conversation.
BLOCK, MOST_HEAD = 256, 8
NODE = ["depth", "k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, own (place among the conversation's rows in its part of the range sort), h1, h2 (of role and text), bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text, F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "text", "tie"]  # equal rows can lie in different parts
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    hashed = dealt.select("conv_id", F.spark_partition_id().alias("part"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            own = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0] == last:
                own[: starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own), *batch.columns[2:]], ["conv_id", "part", "own", "h1", "h2", "bytes"])

    return hashed.mapInArrow(run, "conv_id long, part int, own long, h1 long, h2 long, bytes long")


def rebuilt(turns: DataFrame, of: Column, heads: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, length) and their turns (c, depth, h1, h2, bytes): of `numbered` turns, the first `heads` of conversation `of`, then the own ones after so many."""
    sizes = turns.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    by = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("size").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("conv_id", "part", before.alias("before"), F.sum("size").over(by).alias("all"))  # a row for each part that holds the conversation
    parts = parts.withColumns({"base": of, "h": heads.cast("long")})
    lengths = parts.select(F.col("conv_id").alias("base"), F.col("all").alias("base_all")).distinct()
    parts = stage(parts.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_all", F.lit(0)))))
    convs = parts.select(F.col("conv_id").alias("c"), "base", "h", (F.col("taken") + F.greatest(F.col("all") - F.col("h"), F.lit(0))).alias("length")).distinct()
    placed = turns.join(parts, ["conv_id", "part"]).withColumn("at", F.col("own") + F.col("before"))
    tails = placed.filter("at >= h").select(F.col("conv_id").alias("c"), (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "h1", "h2", "bytes")
    given = placed.filter((F.col("at") < MOST_HEAD) & (F.col("conv_id") == F.col("base"))).select("conv_id", "at", "h1", "h2", "bytes")
    first = given.join(convs.select("c", "base", "h"), F.col("conv_id") == F.col("base")).filter("at < h").select("c", (F.col("at") + 1).alias("depth"), "h1", "h2", "bytes")
    return convs.select("c", "length"), first.unionByName(tails)


def prefixes(turns: DataFrame) -> DataFrame:
    """c, depth, k1, k2 (of the first `depth` turns), t1, t2 (of the last one alone), bytes."""
    own = turns.select("c", "depth", F.xxhash64("depth", "h1", "h2").alias("t1"), F.xxhash64("h2", "depth", "h1").alias("t2"), "bytes", F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    inner = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("c", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    blocks = blocks.select("c", "block", *[F.coalesce(F.bit_xor(f"x{i}").over(outer), F.lit(0)).alias(f"x{i}") for i in (1, 2)])
    run = own.select("*", *[F.bit_xor(f"t{i}").over(inner).alias(f"r{i}") for i in (1, 2)]).join(blocks, ["c", "block"])
    return run.select("c", "depth", *[F.col(f"r{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"k{i}") for i in (1, 2)], "t1", "t2", "bytes")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the conversations (c) that end at a node: ids are joined in chunks of at most 4,096, chunks are hashed as a stream."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*NODE, F.shiftright("c", 12).alias("chunk")).agg(ids.alias("ids"))  # ids are distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*NODE, "ends_sha256"])

        for batch in batches:
            found = []
            for *now, ids in zip(*[c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2), batch.column(4))]):
                if now == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    found.append((*node, state.hexdigest()))
                node, state = now, hashlib.sha256(ids.encode())
            yield done(found)
        if node is not None:
            yield done([(*node, state.hexdigest())])

    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "chunk", "ids")
    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def compressed(rest: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """The tree without its chains and a table id, next, s_* of each chain node: the node that ends its chain and the sums down to it; None if there is no chain."""
    chain = rest.filter("kids = 1 AND parent IS NOT NULL")
    below = rest.select(F.col("parent").alias("id"), F.col("id").alias("next"), *[F.col(f"up_{v}").alias(f"u_{v}") for v in values])
    jumps = stage(chain.join(below, "id").select("id", "next", *[(F.col(v) + F.col(f"u_{v}")).alias(f"s_{v}") for v in values]))
    if jumps.isEmpty():
        return None
    while True:
        ahead = jumps.select(F.col("id").alias("next"), F.col("next").alias("far"), *[F.col(f"s_{v}").alias(f"f_{v}") for v in values])
        sums = [(F.col(f"s_{v}") + F.coalesce(f"f_{v}", F.lit(0))).alias(f"s_{v}") for v in values]
        longer = stage(jumps.join(ahead, "next", "left").select("id", F.coalesce("far", "next").alias("next"), *sums, F.col("far").isNotNull().alias("moved")))
        discard(jumps)
        jumps = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            break
    members = jumps.select("id")
    tops = chain.join(members.withColumnRenamed("id", "parent"), "parent", "left_anti").select("id", F.col("parent").alias("above"), *[F.col(f"up_{v}").alias(f"u_{v}") for v in values])
    moved = tops.join(jumps, "id").select(F.col("next").alias("id"), "above", *[(F.col(f"u_{v}") + F.col(f"s_{v}")).alias(f"n_{v}") for v in values])
    kept = rest.join(members, "id", "left_anti").join(moved, "id", "left")
    ups = [F.coalesce(f"n_{v}", f"up_{v}").alias(f"up_{v}") for v in values]
    return stage(kept.select("id", F.coalesce("above", "parent").alias("parent"), "kids", *values, *ups)), jumps


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """id and the sums of each value over the subtree; tree: id, parent (null for roots), kids (number of children), values (long)."""
    now = stage(tree.select("id", "parent", "kids", *values, *[F.lit(0).cast("long").alias(f"up_{v}") for v in values]))
    raked, spliced, used = [], [], []
    while not now.isEmpty():
        leaves = now.filter("kids = 0")
        raked.append(stage(leaves.select("id", *values)))
        gain = leaves.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("gone"), *[F.sum(F.col(v) + F.col(f"up_{v}")).alias(f"g_{v}") for v in values])
        more = [(F.col(v) + F.coalesce(f"g_{v}", F.lit(0))).alias(v) for v in values]
        rest = stage(now.filter("kids > 0").join(gain, "id", "left").select("id", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *more, *[f"up_{v}" for v in values]))
        used.append(now)
        now, found = rest, compressed(rest, values)
        if found:
            used.append(rest)
            now = found[0]
            spliced.append(found[1])
    for t in used:
        discard(t)
    known = raked[0] if raked else now.select("id", *values)
    for t in raked[1:]:
        known = known.unionByName(t)
    for jumps in reversed(spliced):
        end = known.withColumnsRenamed({"id": "next"} | {v: f"e_{v}" for v in values})
        known = known.unionByName(stage(jumps.join(end, "next").select("id", *[(F.col(f"s_{v}") + F.col(f"e_{v}")).alias(v) for v in values])))
    return known


def prefix_trie(conversations: DataFrame, of: Column, heads: Column) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: of (the conversation that gives the first turns) and heads (how many, eight at most) are
    expressions over conv_id. Conversations that give turns are those whose `of` is their own id."""
    turns = stage(numbered(conversations))
    convs, rows = rebuilt(turns, of, heads)
    convs, rows = stage(convs), stage(prefixes(rows))
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("bytes"), *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    inner = rows.withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"t{i}")) for i in (1, 2)})
    inner = inner.groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("bytes", "p1", "p2")])
    nodes = stage(inner.unionByName(root).withColumn("id", F.monotonically_increasing_id()))  # written once, so the ids stay
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(above, ["depth", "p1", "p2"], "left")
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    nodes = stage(nodes.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    sums = subtree_sums(nodes.select("id", "parent", "kids", (F.col("kids") == 0).cast("long").alias("n_leaves"), saved), ["n_leaves", "saved_tokens"])
    last = convs.join(rows.select("c", F.col("depth").alias("length"), "k1", "k2"), ["c", "length"], "left")
    ends = hashed_ends(last.select("c", F.col("length").alias("depth"), F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2")))
    out = nodes.join(sums, "id").join(ends, NODE, "left")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", sha)


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    """The contract's columns: conversation c starts with up to crc32(c) % 9 turns of conversation c - c % 5."""
    c = F.col("conv_id")
    return prefix_trie(read_table(spark, sf_dir, "conversations"), c - c % 5, F.crc32(c.cast("string")) % 9)


# fixed value: the polynomial of CRC-32, bit by bit, as DuckDB has no such function
_CRC = """crc AS (SELECT conv_id AS c, 0 AS i, encode(conv_id::VARCHAR) AS b, 4294967295::UBIGINT AS r FROM ids UNION ALL
  SELECT c, i + 1, b, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END FROM (
    SELECT c, i, b, CASE WHEN i % 8 = 0 THEN xor(r, ascii(substr(c::VARCHAR, i // 8 + 1, 1))::UBIGINT) ELSE r END AS x FROM crc WHERE i < 8 * octet_length(b)))"""
OP11_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM t),
{_CRC},
h AS (SELECT c, c - c % 5 AS base, (xor(r, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM crc WHERE i = 8 * octet_length(b)),
r AS (SELECT c, 0 AS k, p, role, text FROM h JOIN t ON conv_id = base AND p <= h UNION ALL SELECT c, 1, p, role, text FROM h JOIN t ON conv_id = c AND p > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k, p) AS d, role, text FROM r),
len AS (SELECT h.c, coalesce(max(d), 0) AS len FROM h LEFT JOIN q USING (c) GROUP BY 1),
lists AS (SELECT h.c, coalesce(list({{'r': role, 't': text}} ORDER BY d) FILTER (d IS NOT NULL), []) AS s FROM h LEFT JOIN q USING (c) GROUP BY 1),
pre AS (SELECT c, d, md5(to_json(s[:d])::VARCHAR) AS k, md5(to_json(s[:d - 1])::VARCHAR) AS pk, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS bytes, d = len(s) AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM lists)),
n AS (SELECT d, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM pre GROUP BY 1, 2),
k AS (SELECT pk, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
a AS (SELECT k AS node, k AS top, d FROM n UNION ALL SELECT a.node, n.pk, a.d - 1 FROM a JOIN n ON n.k = a.top AND a.d > 0),
s AS (SELECT top AS k, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM a JOIN n ON n.k = a.node LEFT JOIN k ON k.pk = a.node GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.kids, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (k) LEFT JOIN k ON k.pk = n.k LEFT JOIN n p ON n.d > 0 AND p.k = n.pk"""
