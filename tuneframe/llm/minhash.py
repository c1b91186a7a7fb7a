"""Near-duplicate documents by circulant MinHash (operator 2).

One permutation ``sigma`` sends a shingle to a slot of a universe of
``2 ** universe_bits`` slots (a hash); a second one, ``pi``, is drawn once, and
signature coordinate k is the smallest ``pi`` over the document's slots shifted
circularly by k. As the K shifts of one slot are K neighbouring entries of
``pi``, a document's whole signature is the column minimum over contiguous
slices of one table. Coordinates are banded; documents meeting in a band are
compared with a pivot of their bucket, and every pair is confirmed by the exact
Jaccard similarity of the full shingle sets.

Skew: documents with equal shingle sets are one class before banding. A bucket of
copies never emits all its pairs. All members are compared with one pivot, the member
with the largest buckets (the original of a family of edited copies), and the
links found are contracted into components. What is left to find are links
between members o, x of different components that have a pivot c in common, and
with I = min(|o & c|, |x & c|) a link needs one of two things, as o and x can
share at most I shingles inside c:
- I alone is large enough for both sizes, which a join on (pivot, size) finds;
- they share shingles outside c, so one of the first ``(1 - t) * n + 1`` of
  those in hash order (prefix filter), which a join on (pivot, shingle) finds.
Either way bitmaps of what each lacks of c and has beyond it bound what they can
share from above, and only pairs that the bound lets link are compared.
Members that hold less than ``COVER`` % of their shingles in common with their
pivot are compared with further pivots of the bucket, ``GROWTH`` times as many
each round, until each has been one or all are connected. Every pair but those
with the first pivot passes a filter on one bit a signature coordinate first,
which a link fails with a probability of some 1e-8. So
nothing is capped, and a bucket of edited copies costs about as many pairs as it
has members; members of a bucket that are unlike all others meet all of them in
sketches, which a bucket of many such members pays for.

Defined cases: null or empty texts (or only white space) have no shingles and no
links; texts of fewer than ``k`` words are one shingle; rows with a null doc_id
keep their own row, unlinked with others (component null, kept); a doc_id that
repeats with the same text is one document, with another text its texts are linked
with each other as well (a caller that wants them apart gives each its own id, as the
pipeline's stage does); other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import Words, chunks, grams, mix

COMPARED = "a long, b long, n long, n_b long, inter long, linked boolean, outside array<long>, new array<long>, gone array<long>"
GROWTH = 16  # each round compares with this many times as many pivots
COVER, FAMILY = 50, 29  # % of a member's shingles that its pivot holds; a link's other end has FAMILY % then
SIGNED = "n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"


def _signer(id_column: str, k: int, bands: int, rows: int, universe_bits: int, seed: int):
    """mapInArrow function: (id, text) -> (id, SIGNED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, size = bands * rows, 1 << universe_bits
        pi = np.random.default_rng(seed).permutation(size).astype(np.uint32)
        shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        slot_mask = np.uint64(size - 1)
        for whole in batches:
            for batch in chunks(whole):
                w = Words(batch.column("text"), lower=True)
                h = w.hashes()
                g = grams(h, k)
                n = np.zeros(batch.num_rows, np.int64)
                keys = np.zeros((2, batch.num_rows), np.uint64)
                sig = np.zeros((batch.num_rows, width), np.uint32)
                for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    if b - a >= k:
                        s = np.unique(g[a : b - k + 1])
                    elif b > a:  # too short: the whole sequence is the one shingle
                        s = mix(grams(h[a:b], b - a)[:1] + np.uint64(b - a))
                    else:
                        continue
                    n[i] = len(s)
                    keys[0, i], keys[1, i] = mix(s).sum(), mix(s ^ salt[0]).sum()
                    slots = (s & slot_mask).astype(np.int64)
                    low = shifted[slots[:2048]].min(axis=0)
                    for c in range(2048, len(slots), 2048):
                        np.minimum(low, shifted[slots[c : c + 2048]].min(axis=0), out=low)
                    sig[i] = low
                per = sig.reshape(-1, bands, rows)
                key = np.repeat(salt[None, :], batch.num_rows, axis=0)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + per[:, :, r])
                has = n > 0
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                words = -(-width // 64)
                bits = np.zeros((batch.num_rows, words * 64), np.uint8)
                bits[:, :width] = sig & 1
                sketch = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_column),
                        pa.array(n),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[has].ravel().view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words), pa.array(sketch.ravel())),
                    ],
                    [id_column, "n_shingles", "k1", "k2", "bands", "sketch"],
                )

    return run


def _verifier(k: int, percent: int):
    """mapInArrow function: (a, b, text, text_b) -> COMPARED: how many shingles a
    and b have and share, whether they link, the first of a's shingles outside b
    in hash order, and bitmaps (of a length that b's size gives) of all shingles
    that only a has (new) and only b has (gone). The sets are full sets of 64-bit
    shingle hashes."""

    def bitmap(values: np.ndarray, size: int) -> np.ndarray:
        bits = np.zeros(1 << max(8, (2 * size - 1).bit_length()), np.uint8)
        bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
        return np.packbits(bits).view(np.int64)

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        sizes = np.concatenate([[0], np.cumsum([len(o) for o in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        w = Words(column, lower=True)
        h = w.hashes()
        g = grams(h, k)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            else:
                yield mix(grams(h[a:b], b - a)[:1] + np.uint64(b - a)) if b > a else g[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                for part in chunks(batch, "text_b"):
                    n, n_b, inter, linked, outside, new, gone = [], [], [], [], [], [], []
                    for x, y in zip(sets(part.column("text")), sets(part.column("text_b")), strict=True):
                        at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                        inside = y[at] == x if len(y) else np.zeros(len(x), bool)
                        both = int(inside.sum())
                        n.append(len(x))
                        n_b.append(len(y))
                        inter.append(both)
                        linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                        only = x[~inside]
                        outside.append(only[: (100 - percent) * len(x) // 100 + 1].view(np.int64))
                        new.append(bitmap(only, len(y)))
                        gone.append(bitmap(np.setdiff1d(y, x[inside], assume_unique=True), len(y)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("a"), part.column("b"), pa.array(n, pa.int64()), pa.array(n_b, pa.int64()), pa.array(inter, pa.int64()),
                            pa.array(linked, pa.bool_()), lists(outside), lists(new), lists(gone),
                        ],
                        ["a", "b", "n", "n_b", "inter", "linked", "outside", "new", "gone"],
                    )

    return run


def _merged(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``comp`` (node, component) after further links between nodes; a node that
    isn't there is its own component."""
    of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = scratch.save(components(between.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")), scratch))
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = comp.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return known.unionByName(joined.join(comp, "node", "left_anti").select("node", "component"))


def _count(x: str, y: str | None = None, both=None) -> Column:
    """The bits set in a bitmap, or in ``both`` of two."""
    words = F.col(x) if y is None else F.zip_with(x, y, both)
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def _differ(x: str, y: str) -> Column:
    """In how many bits two sketches differ."""
    return _count(x, y, lambda p, q: p.bitwiseXOR(q))


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    universe_bits: int = 20,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept).

    Documents link when ``100 * |A and B| >= percent * |A or B|`` over their
    sets of ``k``-word shingles of the text with A-Z lower-cased. component_id
    is the smallest doc_id reachable over links; kept: it is the row's own.
    A pair at the threshold meets in a band with probability
    ``1 - (1 - (percent / 100) ** rows) ** bands`` (0.999997 at 80, 1 - 7e-9 at
    85); pairs that meet are compared exactly. Texts of well over
    ``2 ** universe_bits`` different shingles meet more often than they need to."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = scratch.save(docs.mapInArrow(_signer("doc_id", k, bands, rows, universe_bits, seed), f"doc_id long, {SIGNED}"))
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")))

    # members of buckets that hold at least two classes
    entries = known.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    each = entries.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = scratch.save(
        each.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket", "size")
    )
    inside = scratch.save(each.join(shared, "bucket"))
    weights = inside.groupBy("node").agg(F.sum("size").alias("weight"))
    about = scratch.save(entries.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch").join(weights, "node").dropDuplicates(["node"]))
    members = scratch.save(inside.join(about, "node").withColumn("h", F.xxhash64("node", "bucket")))
    scratch.drop(inside)
    # the texts that may be compared, put aside once: only these are shuffled again
    texts_ = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").hint("merge")
    texts_ = scratch.save(texts_.join(about.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))

    # so many sketch bits of a pair at the threshold may differ: seven deviations above the mean
    width = bands * rows
    far = (1 - percent / 100) / 2
    link_bits = int(far * width + 7 * (far * (1 - far) * width) ** 0.5)
    def compare(pairs: DataFrame) -> DataFrame | None:
        """COMPARED for pairs (a, b), None without any."""
        pairs = scratch.save(pairs.select("a", "b").where("a <> b").distinct())
        if not pairs.head(1):
            return None
        used = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = scratch.save(texts_.join(used, "doc_id", "left_semi"))
        left = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a")
        both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        out = scratch.save(both.select("a", "b", "text", "text_b").mapInArrow(_verifier(k, percent), COMPARED))
        scratch.drop(texts)
        return out

    def relatives(compared: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that have a pivot in common and may link."""
        of = lambda node, name: comp.select(F.col("node").alias(node), F.col("component").alias(name))
        family = (
            compared.where(F.col("inter") * 100 >= FAMILY * F.col("n")).withColumnsRenamed({"a": "node", "b": "pivot"})
            .join(of("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        )
        several = family.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("pivot")
        family = family.join(several, "pivot", "left_semi").join(about.select("node", "sketch"), "node").join(of("pivot", "pivot_comp"), "pivot", "left")
        slack = F.col("n") - F.col("inter") - _count("new")  # new shingles that share a bit
        family = scratch.save(family.withColumn("pivot_comp", F.coalesce("pivot_comp", "pivot")).withColumn("slack", slack))
        other = lambda df, *on: df.select(*on, *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "inter", "comp", "sketch", "new", "gone", "slack")])
        may = (F.col("comp") != F.col("comp_2")) & F.expr(f"100 * least(n, n_2) >= {percent} * greatest(n, n_2)") & (_differ("sketch", "sketch_2") <= link_bits)
        # at most so many shingles in common: the pivot's that neither lacks, and the new ones of both
        most_common = F.col("n_b") - _count("gone", "gone_2", lambda p, q: p.bitwiseOR(q)) + _count("new", "new_2", lambda p, q: p.bitwiseAND(q)) + F.least("slack", "slack_2")
        may = may & (most_common * 100 >= percent * (F.col("n") + F.col("n_2") - most_common))
        common = F.least("inter", "inter_2")
        step = float(np.log(1.01))
        cell = lambda size: F.floor(F.log(size) / step)
        held = family.where(F.col("inter") * 100 >= percent * F.col("n"))
        most = F.col("inter") * (100 + percent) / percent - F.col("n")
        reach = held.where((F.col("comp") != F.col("pivot_comp")) & (most >= F.col("n") * percent / 100))
        reach = reach.withColumn("cell", F.explode(F.sequence(cell(F.col("n") * percent / 100), cell(most))))
        by_size = reach.join(other(held.withColumn("cell", cell(F.col("n"))), "pivot", "cell"), ["pivot", "cell"]).where(
            may & (common * 100 >= percent * (F.col("n") + F.col("n_2") - common))
        )
        # narrow rows first; the bitmaps join those that two components share
        slim = family.select("pivot", "node", "comp", F.explode("outside").alias("gram"))
        twice = slim.groupBy("pivot", "gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("pivot", "gram")
        slim = slim.select("pivot", "gram", "node").join(twice, ["pivot", "gram"], "left_semi")
        grams_ = scratch.save(slim.join(family.drop("outside"), ["pivot", "node"]))
        by_gram = grams_.join(other(grams_, "pivot", "gram"), ["pivot", "gram"]).where((F.col("node") < F.col("node_2")) & may)
        pair = [F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")]
        return by_size.select(*pair).unionByName(by_gram.select(*pair)).distinct()

    comp = spark.createDataFrame([], "node long, component long")
    open_, share = members, 0
    while True:
        # a member's place in its bucket is uniform between 0 and the bucket's size;
        # the pivots of a later round are the members whose place is up to ``share``
        if share == 0:
            head = members.groupBy("bucket").agg(F.max(F.struct("weight", "h", "node")).alias("head")).select("bucket", F.col("head.node").alias("head"))
            open_ = open_.join(head, "bucket")
            is_pivot = F.col("node") == F.col("head")
        else:
            is_pivot = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("size") <= share
        pivots = open_.where(is_pivot).select("bucket", F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
        met = open_.join(pivots, "bucket").where(F.col("node") != F.col("pivot"))
        if share:
            met = met.where(_differ("sketch", "pivot_sketch") <= link_bits)
        met = scratch.save(met.select("bucket", F.col("node").alias("a"), F.col("pivot").alias("b")))
        compared = compare(met)
        done = pivots.select("bucket", F.col("pivot").alias("node"))
        if compared is not None:
            comp = scratch.save(_merged(comp, compared.where("linked").select("a", "b"), scratch))
            closer = compare(relatives(compared, comp))
            if closer is not None and closer.where("linked").head(1):
                comp = scratch.save(_merged(comp, closer.where("linked").select("a", "b"), scratch))
            if share == 0:  # members that the first pivot covers are done, as the pivots are
                covered = compared.where(F.col("inter") * 100 >= COVER * F.col("n")).select("a", "b")
                done = done.unionByName(met.join(covered, ["a", "b"]).select("bucket", F.col("a").alias("node"))).distinct()
        left = open_.drop("head").join(done, ["bucket", "node"], "left_anti").join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        mixed = left.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        open_ = scratch.save(left.join(mixed, "bucket", "left_semi").drop("comp"))
        largest = open_.agg(F.max("size")).first()[0]
        if largest is None or share >= largest:
            break
        share = max(1, share) * GROWTH

    owner = scratch.save(
        classes.join(comp, "node", "left").select("k1", "k2", F.col("n_shingles").alias("n"), F.coalesce("component", "node").alias("class_component"))
    )
    s, o = signed.drop("bands", "sketch").alias("s"), owner.alias("o")
    return (
        s.join(o, (F.col("s.k1") == F.col("o.k1")) & (F.col("s.k2") == F.col("o.k2")) & (F.col("s.n_shingles") == F.col("o.n")) & F.col("s.doc_id").isNotNull(), "left")
        .select("s.doc_id", "s.n_shingles", F.coalesce("class_component", "s.doc_id").alias("component_id"))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )
