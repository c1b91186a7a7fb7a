"""Mixing sources to target weights (operator 10).

Each source's words, its documents one after another in hash order, are cut into
blocks of one fixed length, ``block_words`` in every source (the last block of a source can
be shorter). The mix is a number of output shards with equally
many slots; a slot takes one block. Multinomial draws give each shard its slots
per source, with odds in proportion to what the source still has to give, so a
source's draws add up to its target. A source's n-th slot overall is mapped
through a pseudorandom permutation of its block indices (a new one each time all
blocks are used up), and joined with the blocks by index.

Nothing random depends on the layout: reruns agree. The driver holds one row per
source and shard. Offsets are prefix sums within ``SUBS`` hash parts of a
source, so a hot source is split; slots and blocks join on (source, index),
which occurs once per use.

Defined cases: a null text has size 0; documents of size 0 are kept with nothing
taken; sources are ordered by code point with null last and is one source;
repeated rows count each for itself; empty tables give empty results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import Words, chunks, join_kept

SUBS, ROUNDS, STEP = 256, 24, 1 << 16
PLAN = "source string, source_id int, source_size long, target double, width long, n_blocks long, n_slots long"


def targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, cap: float) -> dict[str | None, float]:
    """Words to take of each source: ``share`` of all words by weight; a target
    stops at ``cap`` times its source and the rest is shared by weight again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out = dict.fromkeys(order, 0.0)
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
        left = max(left, 0.0)
    return out


def draw(slots: Sequence[int], n_shards: int, seed: int) -> list[list[int]]:
    """Slots of each source in each shard: multinomial with the odds of what is
    left of each source, never more than that; the column sums are ``slots``."""
    left = np.array(slots, np.int64)
    out = []
    for k in range(n_shards):
        rng = np.random.default_rng([seed, k])
        want = -(-int(left.sum()) // (n_shards - k))
        got = np.zeros_like(left)
        while want:
            new = np.minimum(rng.multinomial(want, left / left.sum()), left)
            got, left, want = got + new, left - new, want - int(new.sum())
        out.append(got.tolist())
    return out


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A keyed pseudorandom permutation of 0 .. size - 1: in each round an index
    and its mirror image about a keyed point change places or not, by a keyed bit
    of the pair."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *key), size) - x, size)
        swap = F.xxhash64(F.greatest(x, mirror), r, F.lit("swap"), *key) % 2 == 0
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


class Mix:
    """The mix of one table. ``plan`` one row per source; ``rows`` the documents
    with size and place in their source; ``slots`` (out_shard, slot, source_id,
    block, pass_no); ``pieces`` the words of each document in each block."""

    def __init__(self, docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                 weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                 block_words: int = 32, n_shards: int = 64, seed: int = 10):
        spark = docs.sparkSession
        self.scratch = scratch = Scratch(spark, "mixing")
        # a row's print tells different rows apart; equal rows are numbered
        self.print_ = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not dict(docs.dtypes)[c].startswith("map")])
        sized = scratch.save(
            docs.select(
                F.col(id_column).alias("doc_id"),
                F.col(source_column).cast("string").alias("source"),
                F.coalesce(F.regexp_count(F.col(text_column), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"),
                self.print_.alias("print"),
            ).withColumn("sub", F.pmod(F.xxhash64("doc_id", "print"), F.lit(SUBS)))
        )
        parts = scratch.save(sized.groupBy("source", "sub").agg(F.sum("size").alias("words")))
        sizes = {r.source: r.words for r in parts.groupBy("source").agg(F.sum("words").alias("words")).collect()}  # one row per source
        plan = []
        for i, (s, target) in enumerate(targets(sizes, weights, share, cap).items()):
            n_blocks = -(-sizes[s] // block_words)
            n_slots = min(int(cap * n_blocks), round(target / sizes[s] * n_blocks)) if sizes[s] else 0
            plan.append((s, i, sizes[s], float(target), block_words, n_blocks, n_slots))
        self.plan = spark.createDataFrame(plan, PLAN)
        here = Window.partitionBy("source").orderBy("sub")
        offsets = parts.select("source", "sub", (F.sum("words").over(here) - F.col("words")).alias("offset"))
        running = F.sum("size").over(Window.partitionBy("source", "sub").orderBy("doc_id", "print").rowsBetween(Window.unboundedPreceding, -1))
        placed = sized.withColumn("running", F.coalesce(running, F.lit(0)))
        placed = placed.join(offsets.withColumnsRenamed({"source": "_s", "sub": "_sub"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("sub") == F.col("_sub")))
        per_source = F.broadcast(self.plan.withColumnRenamed("source", "_p"))  # one row per source
        self.rows = scratch.save(
            placed.join(per_source, F.col("source").eqNullSafe(F.col("_p")))
            .select("doc_id", "print", "source", "source_id", "size", "source_size", "target", "width", (F.col("offset") + F.col("running")).alias("start"))
        )
        draws, used = [], [0] * len(plan)
        for k, counts in enumerate(draw([p[-1] for p in plan], n_shards, seed)):
            at = 0
            for i, n in enumerate(counts):
                if n:
                    draws.append((k, at, i, used[i], n, plan[i][5]))
                at, used[i] = at + n, used[i] + n
        runs = spark.createDataFrame(draws, "out_shard int, at long, source_id int, first long, n long, n_blocks long")
        runs = runs.withColumn("step", F.explode(F.expr(f"sequence(0L, n - 1, {STEP}L)")))
        # few rows that become very many: a fixed number of tasks, which isn't merged by size
        runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "out_shard", "source_id", "step")
        each = runs.withColumn("k", F.explode(F.expr(f"sequence(step, least(step + {STEP - 1}L, n - 1))")))
        each = each.withColumn("pass_no", F.floor((F.col("first") + F.col("k")) / F.col("n_blocks")).cast("int")).withColumn("turn", (F.col("first") + F.col("k")) % F.col("n_blocks"))
        self.slots = scratch.save(
            each.select(
                "out_shard", (F.col("at") + F.col("k")).alias("slot"), "source_id",
                permuted(F.col("turn"), F.col("n_blocks"), F.lit(seed), F.col("source_id"), F.col("pass_no")).alias("block"), "pass_no",
            )
        )
        last = F.col("start") + F.col("size") - 1
        at = self.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr("start div width"), F.floor(last / F.col("width")))))
        lo, hi = F.greatest(F.lit(0), F.col("block") * F.col("width") - F.col("start")), F.least(F.col("size"), (F.col("block") + 1) * F.col("width") - F.col("start"))
        self.pieces = at.select("doc_id", "print", "source_id", "start", "size", "source_size", "target", "block", lo.alias("lo"), hi.alias("hi"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), one row per input row."""
        uses = self.slots.groupBy("source_id", "block").agg(F.count("*").alias("uses"))
        got = (
            self.pieces.join(uses, ["source_id", "block"], "left").groupBy("doc_id", "source_id", "start", "size", "source_size", "target")
            .agg(F.sum(F.coalesce("uses", F.lit(0)) * (F.col("hi") - F.col("lo"))).alias("taken"))
        )
        columns = ["doc_id", "size", "source_size", "target", "taken"]
        return got.select(columns).unionByName(self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))

    def documents(self, docs: DataFrame, text_column: str = "text") -> DataFrame:
        """The mix as documents, with the columns of ``docs`` (the table the mix
        was made of): for each pass over a document's blocks one row holding the
        words that pass takes (the text itself when it takes all). Documents of
        which nothing is taken go."""
        spans = (
            self.pieces.join(self.slots, ["source_id", "block"])
            .groupBy("print", "start", "pass_no").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
        )  # at most a document's blocks
        one = docs.withColumn("_print", self.print_).dropDuplicates(["_print"])
        out = spans.select(F.col("print").alias("_print"), F.col("spans.lo").alias("_lo"), F.col("spans.hi").alias("_hi")).join(one, "_print")
        columns = docs.columns
        schema = docs.schema
        picked = out.select(*[F.col(f"`{c}`") for c in columns], "_lo", "_hi").mapInArrow(_take(columns, text_column), schema)
        if "n_chars" in columns:
            picked = picked.withColumn("n_chars", F.length(text_column).cast(docs.schema["n_chars"].dataType))
        return picked


def _take(columns: list[str], text_column: str):
    """mapInArrow function: rows with spans of words -> rows whose text is those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text_column):
                w = Words(batch.column(text_column))
                keep = np.zeros(len(w.start), bool)
                for a, lo, hi in zip(w.first.tolist(), batch.column("_lo").to_pylist(), batch.column("_hi").to_pylist(), strict=False):
                    for x, y in zip(lo, hi, strict=True):
                        keep[a + x : a + y] = True
                data, offsets = join_kept(w, keep)
                raw = data.tobytes()
                whole_text = np.add.reduceat(np.append(~keep, False), w.first[:-1]) == 0 if len(keep) else np.ones(batch.num_rows, bool)
                texts = [
                    t if full else raw[a:b].decode()
                    for t, full, a, b in zip(batch.column(text_column).to_pylist(), whole_text.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]
                arrays = [pa.array(texts, batch.schema.field(c).type) if c == text_column else batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return run
