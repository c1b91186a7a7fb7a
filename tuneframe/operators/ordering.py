"""Distributed positions: global rank, prefix sums and in-group ranks.

Several operators are defined over a *position* (the n-th prompt, the running
token offset, the k-th sample of a group). A ``Window`` with ``orderBy`` and no
``partitionBy`` would move every row into one task, and a per-group window puts
a hot group into one task. The helpers here stay parallel:

1. range-partition on the order key and sort inside each partition;
2. tag each row with ``monotonically_increasing_id`` (partition index in the
   upper bits, row index in the lower 33 bits) and pin that layout with a
   reliable ``checkpoint`` so a recompute after a lost executor sees the same
   partitions;
3. per-partition counts / sums form a table with one row per partition (its
   size is bounded by the partition count, so it is broadcast), turned into
   offsets;
4. every row adds its partition offset.

In-group ranks are a global rank over ``(group, order)`` minus the group's
first global rank (a partial aggregate, safe for hot groups).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _tag_positions(df: DataFrame, order: Sequence[Column | str], num_partitions: int | None, materialize: bool = False) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    n = _partitions(df, num_partitions)
    if materialize:
        # an expensive input is written once instead of being recomputed by
        # the range-boundary sampling job and again by the tagging job
        df = df.checkpoint(eager=True)
    tagged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_tf_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    return tagged.withColumn("_tf_pid", F.shiftrightunsigned("_tf_mid", 33)).withColumn(
        "_tf_local", F.col("_tf_mid").bitwiseAND(F.lit(_LOW_BITS))
    )


def _partition_offsets(tagged: DataFrame, value: Column) -> DataFrame:
    """(pid, offset) with offset = sum of ``value`` over all earlier partitions.

    One row per partition: bounded by the partition count, safe to broadcast.
    """
    per_part = tagged.groupBy("_tf_pid").agg(F.sum(value).alias("_tf_part_total"))
    w = Window.orderBy("_tf_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_tf_pid", F.coalesce(F.sum("_tf_part_total").over(w), F.lit(0)).alias("_tf_offset")
    )


def global_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    rank_col: str = "rank",
    num_partitions: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Add a 1-based position of every row in the total order ``order``.

    ``order`` must be a total order (ties broken by a key) for the result to be
    deterministic.
    """
    tagged = _tag_positions(df, order, num_partitions, materialize)
    offsets = _partition_offsets(tagged, F.lit(1).cast("long"))
    return (
        tagged.join(F.broadcast(offsets), "_tf_pid")
        .withColumn(rank_col, (F.col("_tf_offset") + F.col("_tf_local") + 1).cast("long"))
        .drop("_tf_mid", "_tf_pid", "_tf_local", "_tf_offset")
    )


def prefix_sum(
    df: DataFrame,
    order: Sequence[Column | str],
    value: str,
    out_col: str = "prefix",
    inclusive: bool = True,
    num_partitions: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Running sum of ``value`` along the total order ``order``.

    ``inclusive=False`` gives the sum of all *earlier* rows (the start offset).
    """
    tagged = _tag_positions(df, order, num_partitions, materialize)
    offsets = _partition_offsets(tagged, F.col(value).cast("long"))
    frame_end = Window.currentRow if inclusive else -1
    w = Window.partitionBy("_tf_pid").orderBy("_tf_local").rowsBetween(Window.unboundedPreceding, frame_end)
    return (
        tagged.join(F.broadcast(offsets), "_tf_pid")
        .withColumn(
            out_col,
            (F.col("_tf_offset") + F.coalesce(F.sum(F.col(value).cast("long")).over(w), F.lit(0))).cast("long"),
        )
        .drop("_tf_mid", "_tf_pid", "_tf_local", "_tf_offset")
    )


def group_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    rank_col: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """1-based position inside each group (like ``row_number`` over a group
    window) that stays parallel when one group holds a large share of rows."""
    ranked = global_rank(df, [*group, *order], "_tf_grank", num_partitions)
    first = ranked.groupBy(*group).agg(F.min("_tf_grank").alias("_tf_gfirst"))
    return (
        ranked.join(first, list(group))
        .withColumn(rank_col, F.col("_tf_grank") - F.col("_tf_gfirst") + 1)
        .drop("_tf_grank", "_tf_gfirst")
    )
