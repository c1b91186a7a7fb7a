"""Trie of the shared beginnings of conversations, built by a van Emde Boas recursion.

Sequences of up to 2^K - 1 turns are cut at half depth; the prefix before the cut gets a
name; the upper trie and the forest of lower tries below the cuts are built in parallel
by the same cut; all pieces of one height are one Spark job, so there are K steps, not
one for each turn.

1. Every turn is a 32-byte digest. Going up, two neighbouring blocks of 2^k turns make
   one of 2^(k+1), named by the SHA-256 of both names.
2. Going down, the name of a prefix that ends at a cut is the SHA-256 of the name above
   and of the block between. Equal prefixes get equal names wherever they occur, so a
   name and a depth are a node; its smallest conversation stands for it.
3. Going up again, totals are grafted: the totals of the tries hanging at a cut node are
   summed and added to the node and its ancestors within the upper trie, by the path of
   the conversation that stands for the node. A row takes part in one graft.

A turn moves as digest and word count, never as text. Rows are shuffled by conversation
and position or by node with sums made beforehand; order within a conversation comes from
range partitions, so one conversation with a third of all turns spreads over many tasks.
A sum over the ids that end at a node is a hash over their text: it is cut into pieces of
a few KB by range partitions and streamed piece by piece, never held as a list.

Defined cases: rows without conv_id take no part; a null role or text is empty; turns are
ordered by turn (null first), role and the text's SHA-256, so equal rows are two equal
turns; c % 20 has the sign of c; an empty table gives an empty result. Other columns are
never read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_rank
from .scratch import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
ROOT = b"root"
PIECE = 4096


def _sha(*parts: Column) -> Column:
    """Binary SHA-256 of digests put one after another."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def prefix_seed(c: Column) -> Column:
    """How many turns a conversation takes from another one: 0 to 3."""
    return (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, depth, len, digest, words) of every rebuilt turn, (c, len) of every conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("body"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = scratch.save(turns)
    ranked = global_rank(turns, ["c", F.col("turn").asc_nulls_first(), "role", "body"], "at").select(
        "c", "at", _sha(F.unhex(F.sha2("role", 256)), "body").alias("digest"), "words")
    size = ranked.groupBy("c").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    base = size.select(F.col("c").alias("base"), F.least("n", F.lit(3)).alias("there"))
    info = size.withColumn("h", prefix_seed(F.col("c"))).withColumn("base", F.col("c") - F.col("c") % 20).join(base, "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    info = scratch.save(info.select("c", "base", "start", "h", taken.cast("long").alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    placed = scratch.save(ranked.join(info.drop("base"), "c").withColumn("at", F.col("at") - F.col("start") + 1).drop("start"))
    own = placed.where("at > h").select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "len", "digest", "words")
    lead = placed.where("at <= 3").select(F.col("c").alias("base"), F.col("at").alias("depth"), "digest", "words")
    lead = info.where("taken > 0").select("c", "base", "taken", "len").join(lead, "base").where("depth <= taken")
    turns = scratch.save(own.unionByName(lead.select("c", "depth", "len", "digest", "words")))
    return turns, info.select("c", "len")


def named(turns: DataFrame, convs: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """(c, depth, name) of every prefix with at least one turn. ``height``: K, where no
    sequence has 2^K turns."""
    blocks = [turns.select("c", (F.col("depth") - 1).alias("j"), "len", "digest")]
    for k in range(1, height):
        up = F.shiftright("j", 1)
        whole = blocks[-1].where(F.shiftleft(up + 1, k) <= F.col("len"))
        side = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("digest")))
        pairs = whole.groupBy("c", up.alias("up"), "len").agg(side(0).alias("left"), side(1).alias("right"))
        blocks.append(scratch.save(pairs.select("c", F.col("up").alias("j"), "len", _sha("left", "right").alias("digest"))))
    heads = convs.where("len > 0").select("c", F.lit(0).cast("long").alias("j"), F.lit(ROOT).alias("name"))
    for k in reversed(range(height)):
        cut = blocks[k].where("j % 2 = 0").select("c", (F.col("j") / 2).cast("long").alias("j"), F.col("digest").alias("above"))
        both = heads.join(cut, ["c", "j"], "left")
        upper = F.struct((F.col("j") * 2).alias("j"), F.col("name"))
        lower = F.struct((F.col("j") * 2 + 1).alias("j"), _sha("name", "above").alias("name"))
        heads = both.select("c", F.inline(F.when(F.col("above").isNull(), F.array(upper)).otherwise(F.array(upper, lower))))
    return heads.where("j > 0").withColumnRenamed("j", "depth")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, c) -> (name, first c, comma-joined decimals of some KB)."""
    now, ids, size, out = None, [], 0, []

    def flush():
        if ids:
            out.append((now, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for name, c in zip(batch.column("name").to_pylist(), batch.column("c").to_pylist(), strict=True):
            if name != now or size > PIECE:
                flush()
                now, ids, size = name, [], 0
            ids.append(c)
            size += len(str(c)) + 1
            if len(out) >= 1000:
                yield _rows(out, ["name", "first", "piece"])
                out = []
    flush()
    yield _rows(out, ["name", "first", "piece"])


def _rows(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = {"name": pa.binary(), "first": pa.int64(), "piece": pa.string(), "sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (name, first) -> (name, SHA-256 of the pieces joined by commas)."""
    now, state, out = None, None, []
    for batch in batches:
        for name, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if name == now:
                state.update(b"," + piece.encode())
                continue
            if state:
                out.append((now, state.hexdigest()))
            now, state = name, hashlib.sha256(piece.encode())
            if len(out) >= 10_000:
                yield _rows(out, ["name", "sha256"])
                out = []
    if state:
        out.append((now, state.hexdigest()))
    yield _rows(out, ["name", "sha256"])


def id_digests(ids: DataFrame) -> DataFrame:
    """(name, c) -> (name, sha256 of its ids in ascending order, as comma-joined decimals)."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ids.select("name", "c").repartitionByRange(n, "name", "c").sortWithinPartitions("name", "c").mapInArrow(_pieces, "name binary, first long, piece string")
    return pieces.repartition(n, "name").sortWithinPartitions("name", "first").mapInArrow(_hashes, "name binary, sha256 string")


def grafted(own: DataFrame, path: DataFrame, height: int, scratch: Scratch) -> list[DataFrame]:
    """Tables of (node, depth, parent, saved, leaves) whose sums by node are the totals of
    the node's subtree. ``own``: each node's own values; ``path``: (c, depth, len, node,
    parent) of the conversations that stand for nodes."""
    parts = [own]
    for k in range(height):
        # what hangs at the cuts of this height: depth - 1 is an odd multiple of 2^k
        hang = [p.where((F.col("depth") - 1) % (2 << k) == 1 << k) for p in parts]
        below = hang[0]
        for p in hang[1:]:
            below = below.unionByName(p)
        cuts = below.groupBy(F.col("parent").alias("c"), (F.col("depth") - 1).alias("cut")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        cuts = cuts.withColumn("block", F.shiftright("cut", k) - 1)
        block = F.shiftright(F.col("depth") - 1, k)
        above = path.withColumn("block", block).where((F.col("block") % 2 == 0) & (F.shiftleft(F.col("block") + 1, k) <= F.col("len")))
        added = cuts.select("c", "block", "saved", "leaves").join(above.select("c", "block", "depth", "node", "parent"), ["c", "block"])
        added = added.groupBy("node", "depth").agg(F.min("parent").alias("parent"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        parts.append(scratch.save(added))
    return parts


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations, the root
    included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, words (of its last turn) and name (null for the root)."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long, name binary"
    turns, convs = rebuilt(conversations, scratch)
    root, n_convs, longest = convs.agg(F.min("c"), F.count("*"), F.max("len")).first()
    if not n_convs:
        return spark.createDataFrame([], schema)
    height = int(longest).bit_length()
    names = named(turns, convs, height, scratch).join(turns.select("c", "depth", "len", "words"), ["c", "depth"])
    names = scratch.save(names)
    nodes = scratch.save(names.groupBy("name", "depth").agg(F.min("c").alias("node"), F.count("*").alias("n_convs")))
    # a conversation that stands for no node has a smaller equal one
    path = names.join(nodes.select(F.col("node").alias("c")).distinct(), "c", "left_semi").join(nodes, ["name", "depth"])
    path = scratch.save(path)
    up = path.select("c", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    path = scratch.save(path.join(up, ["c", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(root).cast("long"))))
    stand = path.where("node = c")
    children = stand.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    stand = stand.join(children, ["node", "depth"], "left")
    stand = scratch.save(stand.select("node", "depth", "parent", "n_convs", "name", "words", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    own = stand.select("node", "depth", "parent", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), leaf.alias("leaves"))
    parts = grafted(own, path.select("c", "depth", "len", "node", "parent"), height, scratch)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    totals = whole.groupBy("node", "depth").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = names.where("depth = len").select("name", "c").unionByName(convs.where("len = 0").select(F.lit(ROOT).alias("name"), "c"))
    ends = scratch.save(id_digests(ends))
    nothing = hashlib.sha256(b"").hexdigest()
    out = stand.join(totals, ["node", "depth"]).join(ends, "name", "left")
    out = out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                     F.coalesce("sha256", F.lit(nothing)).alias("ends_sha256"), "words", "name")
    first = whole.where("depth = 1").agg(F.sum("saved"), F.sum("leaves")).first()
    n_children = stand.where("depth = 1").count()
    at_root = ends.where(F.col("name") == F.lit(ROOT)).first()
    top = (root, 0, None, n_convs, n_children, first[1] if n_children else 1, first[0] or 0, at_root.sha256 if at_root else nothing, 0, None)
    return out.unionByName(spark.createDataFrame([top], schema))


#: DuckDB SQL of the query: every prefix as text, every pair of a node and one above it.
ORACLE = """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos,
    sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, n, list_transform(range(8 * len(s)), lambda i: (ascii(s[i // 8 + 1]) >> (i % 8)) & 1) AS b
  FROM (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM t GROUP BY c)),
convs AS (SELECT c, n, c - c % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 4 AS h FROM bits),
info AS (SELECT convs.*, least(h, coalesce(o.n, 0)) AS taken, least(h, coalesce(o.n, 0)) + greatest(convs.n - h, 0) AS len
  FROM convs LEFT JOIN (SELECT c AS base, n FROM convs) o USING (base)),
turns AS (SELECT c, pos - h + taken AS d, len, digest, words FROM t JOIN info USING (c) WHERE pos > h
  UNION ALL SELECT info.c, pos, len, digest, words FROM info JOIN t ON t.c = info.base WHERE pos <= taken),
names AS MATERIALIZED (SELECT c, d, len, words, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d)) AS name FROM turns
  UNION ALL SELECT c, 0, len, 0, 'root' FROM info),
nodes AS MATERIALIZED (SELECT name, d, min(c) AS node, count(*) AS n_convs, min(words) AS words FROM names GROUP BY name, d),
path AS MATERIALIZED (SELECT c, d, node, name FROM names JOIN nodes USING (name, d)),
tree AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN path p ON p.c = n.node AND p.d = n.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY ALL),
own AS (SELECT tree.*, coalesce(n_children, 0) AS n_children FROM tree LEFT JOIN kids USING (node, d)),
totals AS (SELECT p.node, p.d, sum((o.n_convs - 1) * o.words) AS saved, count(*) FILTER (o.n_children = 0) AS leaves
  FROM own o JOIN path p ON p.c = o.node AND p.d <= o.d GROUP BY ALL),
ends AS (SELECT name, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS s FROM names WHERE d = len GROUP BY ALL)
SELECT node AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(s, sha256('')) AS ends_sha256
FROM own JOIN totals USING (node, d) LEFT JOIN ends USING (name, d)"""
