"""Removal of word sequences that repeat across or within documents (operator 9).

A *window* is ``window`` consecutive words. Every word covered by a window whose
word sequence also starts anywhere else is removed; windows are judged on the
input. Two passes:

1. Each partition builds count-min sketches and they are merged block by block.
   A window is counted through its anchor, the smallest hash among its
   ``gram``-word sequences: equal windows at two places have equal anchors at
   two places, so an anchor's count is never below the window's, and only some
   7 % of all positions are counted. Counters stop at 2; the merged sketch is
   one bit a counter ("at least 2") of at most ``max_sketch_bytes`` in all, which
   bounds the broadcast.
2. Windows whose anchor is estimated at 2 or more are grouped exactly, by 96
   bits of two independent hashes of the word sequence. None that repeats is
   lost: a smaller sketch only sends more windows to the exact pass. Beyond
   about ``2 * max_sketch_bytes`` anchors the sketch saturates and pass 2 groups
   most windows, at a cost that still grows in proportion to the input.

Skew: equal texts are one row (found by MD5) before any window is made, and a
text that occurs twice loses all its words if it has a window at all; counts are
pre-aggregated; a window that very many texts share is joined back through a
join whose large keys Spark can split.

Defined cases: null and empty texts have no words; texts of fewer than
``window`` words lose none; kept words are joined by one space; other columns
and repeated doc_ids are untouched, one result row per input row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import Words, chunks, grams, join_kept, mix, slide

DEPTH, BLOCK_BITS, FLUSH = 2, 16, 2_000_000


def _anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, is a window's start, the window's anchor, is an anchor)."""
    h = w.hashes()
    last = np.repeat(w.first[1:], np.diff(w.first))  # one past the text's last word
    starts = np.arange(len(h)) + window <= last
    g = grams(h, gram) | np.uint64(1)
    span = window - gram + 1
    low = slide(g, span, np.minimum)
    highest = slide(np.where(starts, low, np.uint64(0))[::-1], span, np.maximum)[::-1]
    return h, starts, low, highest == g


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(anchor + np.uint64(row)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch_partition(window: int, gram: int, bits: int):
    """mapInArrow function: text -> (block, once, twice), a partition's counters
    by block: the cells counted, and those counted twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            values = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            for d in range(DEPTH):
                cells, counts = np.unique(_cells(values, d, bits), return_counts=True)
                blocks, at = np.unique(cells >> BLOCK_BITS, return_index=True)
                low, ends = (cells & ((1 << BLOCK_BITS) - 1)).astype("<u2"), [*at[1:].tolist(), len(cells)]
                once = [low[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)] if len(at) else []
                twice = [low[a:b][counts[a:b] > 1].tobytes() for a, b in zip(at.tolist(), ends, strict=True)] if len(at) else []
                names = (blocks + (d << (bits - BLOCK_BITS))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])

        for whole in batches:
            for batch in chunks(whole):
                w = Words(batch.column("text"))
                h, _, _, is_anchor = _anchors(w, window, gram)
                low = grams(h, gram) | np.uint64(1)
                held.append(low[is_anchor])
                if sum(map(len, held)) > FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: adds the partitions' counters of each block, stopping
    at 2 -> (block, bits)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = held.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
            for cells in (once, twice):
                counts[np.frombuffer(cells, "<u2")] += 1
            np.minimum(counts, 2, out=counts)
    rows = [(b, np.packbits(c > 1, bitorder="little").tobytes()) for b, c in held.items()]
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int32()), pa.array([c for _, c in part], pa.binary())], ["block", "bits"])


def _kept_column(w: Words, keep: np.ndarray, digest: bool) -> list[str]:
    data, offsets = join_kept(w, keep)
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return [hashlib.sha256(t).hexdigest() if digest else t.decode() for t in texts]


RESULT = "key binary, n_words long, n_removed long, kept string"
ESTIMATED = f"{RESULT}, text string, h1 array<long>, h2 array<int>, pos array<int>"


def _estimate(window: int, gram: int, bits: int, sketch, digest: bool):
    """mapInArrow function: (key, copies, text) -> ESTIMATED. Texts without a
    window estimated repeated are done; for the others the row holds the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = sketch.value
        nothing = hashlib.sha256(b"").hexdigest() if digest else ""
        for whole in batches:
            for batch in chunks(whole):
                w = Words(batch.column("text"))
                h, starts, low, _ = _anchors(w, window, gram)
                at = np.flatnonzero(starts)
                for d in range(DEPTH):  # each row of the sketch is asked for what is left
                    cell = _cells(low[at], d, bits)
                    hit = (flags[(d << (bits - 3)) + (cell >> 3)] >> (cell & 7).astype(np.uint8)) & 1
                    at = at[hit.astype(bool)]
                h1 = grams(h, window)[at].view(np.int64)
                h2 = (grams(h, window, 0xD6E8FEB86659FD93)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                bounds = np.searchsorted(at, w.first)
                n_words = np.diff(w.first)
                pos = (at - np.repeat(w.first[:-1], np.diff(bounds))).astype(np.int32)
                copies = np.asarray(batch.column("copies"))
                gone = (copies > 1) & (n_words >= window)
                open_ = (np.diff(bounds) > 0) & ~gone
                kept = _kept_column(w, np.ones(len(h), bool), digest)
                kept = [nothing if g else None if o else x for x, g, o in zip(kept, gone.tolist(), open_.tolist(), strict=True)]
                lists = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(np.where(gone, n_words, 0).astype(np.int64)),
                        pa.array(kept, pa.string()),
                        batch.column("text").take(pa.array(np.arange(batch.num_rows), mask=~open_)),
                        *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in (h1, h2, pos)),
                    ],
                    ["key", "n_words", "n_removed", "kept", "text", "h1", "h2", "pos"],
                )

    return run


def _remove(window: int, digest: bool):
    """mapInArrow function: (key, text, pos: starts of repeated windows) -> RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                w = Words(batch.column("text"))
                n = int(w.first[-1])
                pos = batch.column("pos")
                sizes = np.asarray(pc.fill_null(pc.list_value_length(pos), 0))
                at = np.asarray(pc.list_flatten(pos), dtype=np.int64) + np.repeat(w.first[:-1], sizes)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                keep = np.cumsum(edge)[:n] <= 0
                gone = np.concatenate([[0], np.cumsum(~keep)])[w.first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(np.diff(gone).astype(np.int64)), pa.array(_kept_column(w, keep, digest), pa.string())],
                    ["key", "n_words", "n_removed", "kept"],
                )

    return run


def _merged_sketch(texts: DataFrame, window: int, gram: int, bits: int) -> np.ndarray:
    """The flags of all counters; DEPTH * 2 ** bits bits."""
    spark = texts.sparkSession
    parts = texts.select("text").mapInArrow(_sketch_partition(window, gram, bits), "block int, once binary, twice binary")
    merged = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").mapInArrow(_merge, "block int, bits binary")
    flags = np.zeros(DEPTH << (bits - 3), np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for row in merged.toLocalIterator():  # at most DEPTH << (bits - BLOCK_BITS) rows of 8 KiB
        flags[row.block * step : (row.block + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return flags


def clean_texts(docs: DataFrame, *, text_column: str = "text", window: int = 35, gram: int = 8, digest: bool = False, max_sketch_bytes: int = 64 << 20) -> DataFrame:
    """One row per different text: (key = MD5, n_words, n_removed, kept); kept is
    the text that stays, or with ``digest`` its SHA-256."""
    if window < gram:
        raise ValueError(f"window must be at least {gram} words")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    text = docs.select(F.col(text_column).alias("text")).where("text IS NOT NULL")
    texts = scratch.save(text.groupBy(F.unhex(F.md5("text")).alias("key")).agg(F.count("*").alias("copies"), F.any_value("text").alias("text")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # 8 counters for each anchor expected (one in 14 words of 6 bytes)
    bits = min(max(BLOCK_BITS, int(np.ceil(np.log2(max(1, 8 * size / 84))))), int(np.log2(max_sketch_bytes * 8 // DEPTH)))
    sketch = spark.sparkContext.broadcast(_merged_sketch(texts, window, gram, bits))
    est = scratch.save(texts.mapInArrow(_estimate(window, gram, bits, sketch, digest), ESTIMATED))
    scratch.drop(texts)
    sketch.unpersist()

    windows = est.where("size(h1) > 0").select("key", F.inline(F.arrays_zip("h1", "h2", "pos")))
    repeated = scratch.save(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    starts = (
        windows.join(repeated, ["h1", "h2"]).groupBy("key").agg(F.collect_list("pos").alias("pos"))  # at most a text's words
    )
    left = est.where("text IS NOT NULL").select("key", "text").join(starts, "key", "left")
    return est.where("text IS NULL").select("key", "n_words", "n_removed", "kept").unionByName(
        left.select("key", "text", "pos").mapInArrow(_remove(window, digest), RESULT)
    )


def attach(docs: DataFrame, cleaned: DataFrame, *, text_column: str = "text") -> DataFrame:
    """Every input row with the result of its text (null texts: 0 words, kept null)."""
    spark = docs.sparkSession
    cleaned = Scratch(spark, "substrings").save(cleaned)
    keyed = docs.withColumn("_key", F.unhex(F.md5(text_column)))
    return (
        keyed.join(cleaned.withColumnRenamed("key", "_key"), "_key", "left")
        .drop("_key")
        .withColumns({"n_words": F.coalesce("n_words", F.lit(0)), "n_removed": F.coalesce("n_removed", F.lit(0))})
    )


def substring_dedup(docs: DataFrame, *, text_column: str = "text", window: int = 35, **options) -> DataFrame:
    """``docs`` with n_words, n_removed and ``kept``, the text that stays. Input
    columns of those names are replaced."""
    docs = docs.drop("n_words", "n_removed", "kept")
    return attach(docs, clean_texts(docs, text_column=text_column, window=window, **options), text_column=text_column)
