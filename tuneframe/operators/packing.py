"""Sequence packing.

**Best-fit decreasing (D2).** Rows are hash-partitioned by key, sorted by key,
and packed in batches of ``shard_rows`` rows inside each partition (bin quality
is per batch; no task holds more than one batch). The payload is shuffled once;
each batch is planned (lengths only, an O(n log L) best-fit search) and
assembled with numpy. An alternative ``assemble="join"`` keeps the token payload
on the JVM (only ``(key, length)`` goes to Python, the plan is joined back and
bins are built with ``collect_list``) at the price of a second payload shuffle.

**Wrapped packing (D1)** concatenates every list column and cuts it every
``seq_length`` items. Token offsets come from the distributed prefix sum;
each row is split at chunk borders and pieces are regrouped per chunk (a
chunk holds at most ``seq_length`` items). ``shard_rows`` reproduces the
reference's per-batch remainders (default: one global stream).
"""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import global_rank, prefix_sum
from .tokens import truncate_lists

_BIN_SHIFT = 1 << 32


def _field(name: str):
    return lambda x: x[name]


def _list_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def bfd_plan(lengths: list[int], keys: list[int], seq_length: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing over ``lengths`` (all in ``1..seq_length``).

    Items are taken longest first (ties by key). Each goes into the open bin
    with the least remaining space that still fits it; among bins with equal
    space the one that reached that space first wins. A new bin is opened
    when nothing fits. Returns ``(bin, pos)`` per item, in input order.
    """
    n = len(lengths)
    order = sorted(range(n), key=lambda i: (-lengths[i], keys[i]))
    spaces: list[int] = []  # sorted distinct remaining spaces of open bins
    by_space: dict[int, deque] = {}
    fill: list[int] = []  # items placed per bin
    out_bin = [0] * n
    out_pos = [0] * n
    for i in order:
        need = lengths[i]
        j = bisect.bisect_left(spaces, need)
        if j < len(spaces):
            space = spaces[j]
            queue = by_space[space]
            b = queue.popleft()
            if not queue:
                del by_space[space]
                spaces.pop(j)
        else:
            space = seq_length
            b = len(fill)
            fill.append(0)
        out_bin[i] = b
        out_pos[i] = fill[b]
        fill[b] += 1
        left = space - need
        if left > 0:
            if left not in by_space:
                by_space[left] = deque()
                bisect.insort(spaces, left)
            by_space[left].append(b)
    return out_bin, out_pos


def _batches(frames, rows: int):
    """Regroup a partition's frames into batches of ``rows`` rows (the last one shorter)."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in frames:
        held.append(pdf)
        n += len(pdf)
        while n >= rows:
            whole = pd.concat(held, ignore_index=True)
            yield whole.iloc[:rows].reset_index(drop=True)
            rest = whole.iloc[rows:]
            held, n = ([rest] if len(rest) else []), len(rest)
    if n:
        yield pd.concat(held, ignore_index=True)


def _first_bin() -> int:
    return TaskContext.get().partitionId() * _BIN_SHIFT


def _plan_batches(seq_length: int, key: str, rows: int):
    """mapInPandas function: (key, length) -> (key, bin, pos)."""

    def run(frames):
        first = _first_bin()
        for pdf in _batches(frames, rows):
            bins, pos = bfd_plan(pdf["_tf_len"].tolist(), pdf[key].tolist(), seq_length)
            yield pd.DataFrame({key: pdf[key], "bin": [first + b for b in bins], "pos": pd.Series(pos, dtype="int32")})
            first += max(bins) + 1

    return run


def _assemble_batches(seq_length: int, key: str, lists: list[str], rows: int):
    """mapInPandas function: plan each batch on its lengths, then concatenate
    every list column in bin order with numpy."""

    def run(frames):
        first = _first_bin()
        for pdf in _batches(frames, rows):
            bins, pos = bfd_plan(pdf["_tf_len"].tolist(), pdf[key].tolist(), seq_length)
            order = np.lexsort((np.asarray(pos), np.asarray(bins)))
            cuts = np.flatnonzero(np.diff(np.asarray(bins)[order])) + 1
            groups = np.split(order, cuts)
            lens = pdf["_tf_len"].to_numpy()
            out = {"bin": [first + int(bins[g[0]]) for g in groups]}
            for c in lists:
                col = pdf[c].to_numpy()
                out[c] = [np.concatenate([col[i] for i in g]) for g in groups]
            out["seq_lengths"] = [lens[g].astype("int32") for g in groups]
            yield pd.DataFrame(out)
            first += max(bins) + 1

    return run


def pack_bfd(
    df: DataFrame,
    seq_length: int,
    key: str = "example_id",
    shard_rows: int = 1000,
    num_shards: int | None = None,
    assemble: str = "pandas",
) -> DataFrame:
    """Pack whole sequences into bins of ``seq_length`` (never split).

    List columns are first truncated to ``seq_length``; the first list column
    gives the length. Output: one row per bin with every list column
    concatenated in bin order, ``seq_lengths`` and the ``bin`` id. Empty
    sequences carry no tokens and are not placed (the reference rejects them).

    Rows are hash-partitioned by key (``num_shards`` partitions, by default the
    session's shuffle partitions), sorted by key there, and packed in batches of
    ``shard_rows`` rows, so nothing is counted beforehand, every partition is a
    task and a task holds one batch. ``assemble="pandas"`` (default) shuffles the
    payload once and concatenates in Python; ``assemble="join"`` sends lengths
    only to Python, joins the plan back and assembles bins with
    ``collect_list`` on the JVM - two payload shuffles instead of one.
    """
    lists = _list_columns(df)
    if not lists:
        raise ValueError("pack_bfd needs at least one list column")
    t = truncate_lists(df.select(key, *lists), seq_length, lists)
    t = t.withColumn("_tf_len", F.size(lists[0])).filter(F.col("_tf_len") > 0)
    if num_shards is None:
        num_shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {f.name: f.dataType.simpleString() for f in t.schema.fields}
    if assemble == "pandas":
        schema = ", ".join(["bin long", *[f"{c} {types[c]}" for c in lists], "seq_lengths array<int>"])
        return t.repartition(num_shards, key).sortWithinPartitions(key).mapInPandas(_assemble_batches(seq_length, key, lists, shard_rows), schema)
    lengths = t.select(key, "_tf_len").repartition(num_shards, key).sortWithinPartitions(key)
    plan = lengths.mapInPandas(_plan_batches(seq_length, key, shard_rows), f"{key} {types[key]}, bin long, pos int")
    grouped = t.join(plan, key).groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("pos", *lists))).alias("_tf_items"))
    outs = [F.flatten(F.transform("_tf_items", _field(c))).alias(c) for c in lists]
    return grouped.select(
        "bin",
        *outs,
        F.transform("_tf_items", lambda x: F.size(x[lists[0]])).alias("seq_lengths"),
    )


def pack_wrapped(
    df: DataFrame,
    seq_length: int,
    key: str = "example_id",
    shard_rows: int | None = None,
) -> DataFrame:
    """Concatenate all rows (in ``key`` order) and cut every ``seq_length``.

    With ``shard_rows`` the stream restarts every ``shard_rows`` rows (the
    reference packs each map batch on its own, leaving one short tail per
    batch). Output: ``chunk`` (0-based) and every list column.
    """
    lists = _list_columns(df)
    # the lists are made and written once; only (key, length) is put in order, and the
    # offsets come back by the row's number in that table
    base = df.select(key, *lists).withColumn("_tf_row", F.monotonically_increasing_id()).checkpoint()
    narrow = base.select("_tf_row", key, F.size(lists[0]).cast("long").alias("_tf_len"))
    order = [key, "_tf_row"]
    if shard_rows:
        ranked = global_rank(narrow, order, "_tf_rank")
        ranked = ranked.withColumn("_tf_batch", F.floor((F.col("_tf_rank") - 1) / shard_rows).cast("long"))
        starts = prefix_sum(ranked, order, "_tf_len", "_tf_start", inclusive=False)
        first = starts.groupBy("_tf_batch").agg(F.min("_tf_start").alias("_tf_b0"))
        starts = starts.join(first, "_tf_batch").withColumn("_tf_start", F.col("_tf_start") - F.col("_tf_b0"))
    else:
        starts = prefix_sum(narrow, order, "_tf_len", "_tf_start", inclusive=False).withColumn("_tf_batch", F.lit(0).cast("long"))
    starts = base.join(starts.select("_tf_row", "_tf_len", "_tf_start", "_tf_batch"), "_tf_row")
    L = F.lit(seq_length)
    s, n = F.col("_tf_start"), F.col("_tf_len")
    first_chunk = F.floor(s / L)
    last_chunk = F.floor((s + n - 1) / L)
    pieces = starts.filter(n > 0).select(
        "_tf_batch",
        key,
        s.alias("_s"),
        *lists,
        F.explode(F.sequence(first_chunk, last_chunk)).alias("chunk"),
    )
    lo = F.greatest(F.col("chunk") * L, F.col("_s"))
    hi = F.least((F.col("chunk") + 1) * L, F.col("_s") + F.size(lists[0]))
    sliced = pieces.select(
        "_tf_batch",
        "chunk",
        lo.alias("_lo"),
        *[F.slice(c, (lo - F.col("_s") + 1).cast("int"), (hi - lo).cast("int")).alias(c) for c in lists],
    )
    grouped = sliced.groupBy("_tf_batch", "chunk").agg(F.array_sort(F.collect_list(F.struct("_lo", *lists))).alias("_tf_items"))
    return grouped.select(
        F.col("_tf_batch").alias("batch"),
        "chunk",
        *[F.flatten(F.transform("_tf_items", _field(c))).alias(c) for c in lists],
    )


def pack(df: DataFrame, seq_length: int, strategy: str = "bfd", **kwargs) -> DataFrame:
    """D3: dispatch on the packing strategy."""
    if strategy == "bfd":
        return pack_bfd(df, seq_length, **kwargs)
    if strategy == "wrapped":
        return pack_wrapped(df, seq_length, **kwargs)
    raise ValueError(f"unknown packing strategy {strategy!r}: bfd or wrapped")


def fill_ratio(packed: DataFrame, seq_length: int) -> DataFrame:
    """Packing quality: ``sum(length) / (bins * seq_length)`` plus counts."""
    return packed.agg(
        F.count(F.lit(1)).alias("bins"),
        F.sum(F.aggregate("seq_lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"),
    ).withColumn("fill_ratio", F.col("tokens") / F.nullif(F.col("bins") * F.lit(seq_length), F.lit(0)))
