"""Minimax contiguous sharding (operator 7), DataFrame operations only.

Groups of equal texts are atomic and ordered by the MD5 of the text. The
smallest shard capacity under which a greedy scan fits all groups into the
shards is found by binary search, and the cuts are made there. The scan needs
only prefix sums at the cuts, so the search runs on a summary: about
``points`` prefix sums, each round refined between the bounds that the last
round proved (greedy on the known prefix sums gives a capacity that works,
greedy that may cut anywhere inside an unread gap gives one below which none
does), until both bounds meet. The capacity is thus exact while the driver holds
a fixed number of integers.

Skew: group sizes are pre-aggregated, prefix sums are taken within 4,096 hash
buckets and shifted by the buckets' totals, a row finds its shard by comparing
its own hash with the cut hashes (no join), and slots are numbered within
``shard x SUBS`` parts. A group larger than the mean capacity gets a shard of
its own before the others are cut, as it would otherwise set the capacity for
all and leave shards empty.

Defined cases: a null text has size ``overhead`` and no CRC, all null texts are
one group, empty texts another; rows repeat freely (each gets a slot); null
doc_ids sort first; an empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BUCKETS, SUBS = 4096, 256


class _Prefixes:
    """Some prefix sums of the group sizes; ``hidden[i]``: unread ones lie
    between points i - 1 and i."""

    def __init__(self, total: int):
        self.points, self.hidden, self.total = [0, total], [False, True], total

    def refine(self, rows: list[tuple[int, int, int]]) -> None:
        """Add what was read: the first and last prefix sum of each cell and how
        many it holds. Cells without any are empty, so unread ones can only lie
        between a cell's first and last: every gap read gives a new point."""
        known = dict(zip(self.points, self.hidden, strict=True))
        for first, last, n in rows:
            known[first] = False
            if last > first:
                known[last] = n > 2
        self.points = sorted(known)
        self.hidden = [known[p] for p in self.points]

    def reach(self, limit: int, hopeful: bool) -> int:
        """The last prefix sum up to ``limit``; if hopeful, any place in an unread gap may be one."""
        if limit >= self.total:
            return self.total
        i = bisect_right(self.points, limit) - 1
        return limit if hopeful and self.hidden[i + 1] else self.points[i]

    def path(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        out = [0]
        for _ in range(shards):
            out.append(self.reach(out[-1] + capacity, hopeful))
        return out

    def smallest(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity whose greedy scan reaches the end."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.path(mid, shards, hopeful)[-1] >= self.total else (mid + 1, high)
        return low

    def gaps(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The unread gaps that touch the spans, neighbours merged."""
        out: list[tuple[int, int]] = []
        for a, b in spans:
            i = max(1, bisect_right(self.points, a))
            while i < len(self.points) and self.points[i - 1] <= b:
                if self.hidden[i]:
                    if out and self.points[i - 1] <= out[-1][1]:
                        out[-1] = (out[-1][0], max(out[-1][1], self.points[i]))
                    else:
                        out.append((self.points[i - 1], self.points[i]))
                i += 1
        return out


def _read(prefixes: DataFrame, ranges: list[tuple[int, int]], points: int) -> list[tuple[int, int, int]]:
    """The ranges in about ``points`` cells of one width: (first prefix sum, last,
    how many) of each cell that holds any."""
    width = -(-sum(b - a for a, b in ranges) // points)
    starts, ends = F.array(*[F.lit(a) for a, _ in ranges]), F.array(*[F.lit(b) for _, b in ranges])
    where = F.size(F.filter(starts, lambda a: a < F.col("prefix")))
    rows = (
        prefixes.select("prefix", where.alias("r")).where("r > 0").where(F.col("prefix") <= F.element_at(ends, F.col("r")))
        .groupBy("r", F.floor((F.col("prefix") - 1 - F.element_at(starts, F.col("r"))) / F.lit(width)).alias("cell"))
        .agg(F.min("prefix").alias("first"), F.max("prefix").alias("last"), F.count("*").alias("n"))
    )
    return [(r["first"], r["last"], r.n) for r in rows.collect()]


def minimax_cuts(prefixes: DataFrame, total: int, largest: int, shards: int, points: int = 20_000) -> tuple[int, list[int]]:
    """(smallest capacity, the prefix sums at which shards end) for the groups
    whose running totals are ``prefixes.prefix``. Among the cuts that keep to the
    capacity, those nearest to equal shares are taken."""
    known = _Prefixes(total)
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    ranges = [(0, total)]
    while True:
        known.refine(_read(prefixes, ranges, points))
        low = known.smallest(low, high, shards, hopeful=True)
        high = known.smallest(low, high, shards, hopeful=False)
        if low == high:
            break
        first, last = known.path(low, shards, False), known.path(high, shards, True)
        ranges = known.gaps([(a + low, b + high) for a, b in zip(first[:-1], last[:-1], strict=True) if a + low < total])
        if not ranges:
            break
    # the earliest place each shard may end so that the rest still fits
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(known.points[bisect_left(known.points, max(0, earliest[-1] - high))])
    earliest.reverse()
    cuts, at = [], 0
    for j in range(shards - 1):
        a, b = bisect_left(known.points, max(earliest[j], at)), bisect_right(known.points, at + high) - 1
        want = total * (j + 1) // shards
        i = min(max(bisect_left(known.points, want), a), b)
        if i > a and want - known.points[i - 1] < known.points[i] - want:
            i -= 1
        at = known.points[i]
        cuts.append(at)
    return high, cuts


def minimax_shards(docs: DataFrame, n_shards: int = 40, *, id_column: str = "doc_id", text_column: str = "text", overhead: int = 16, points: int = 20_000) -> DataFrame:
    """One row per input row: (doc_id, size, text_crc32, shard, slot). ``size`` is
    the UTF-8 bytes of the text plus ``overhead``; rows with equal texts share a
    shard; slots count a shard's rows from 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(text_column)
    rows = scratch.save(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("")).alias("key"),
        )
    )
    groups = scratch.save(rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("bucket", F.coalesce(F.conv(F.substring("key", 1, 3), 16, 10).cast("int"), F.lit(0))))
    total, largest = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    own: list[tuple[str, int]] = []  # groups over the mean, fewer than shards
    while largest * (n_shards - len(own)) > total and len(own) < n_shards - 1:
        key, size = groups.where(F.col("bytes") == largest).orderBy("key").limit(1).select("key", "bytes").first()
        own.append((key, size))
        groups = groups.where(F.col("key") != key)
        total -= size
        largest = groups.agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]
    cut_keys: list[str] = []
    if total:
        offsets = groups.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).select(
            "bucket", (F.sum("bytes").over(Window.orderBy("bucket")) - F.col("bytes")).alias("offset")
        )  # at most BUCKETS rows
        running = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("key"))
        prefixes = scratch.save(groups.join(F.broadcast(offsets), "bucket").select("key", (F.col("offset") + running).alias("prefix")))
        _, cuts = minimax_cuts(prefixes, total, largest, n_shards - len(own), points)
        at = {r.prefix: r.key for r in prefixes.where(F.col("prefix").isin([c for c in cuts if c] or [0])).collect()}
        cut_keys = [at.get(c, "") if c else None for c in cuts]
    shard = F.lit(len(own))
    for key in cut_keys:  # a shard ends with its cut's group; a cut at 0 ends an empty shard
        shard = shard + (F.lit(1) if key is None else (F.col("key") > F.lit(key)).cast("int"))
    for i, (key, _) in enumerate(own):
        shard = F.when(F.col("key") == key, F.lit(i)).otherwise(shard)
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SUBS)).alias("sub"))
    counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))  # at most n_shards x SUBS rows
    before = counts.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("place", place).join(F.broadcast(before), ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot")
    )
