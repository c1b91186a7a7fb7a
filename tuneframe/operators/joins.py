"""Keyed joins replacing the reference's positional zips.

All are equi-joins on explicit keys; Spark (with AQE) chooses broadcast only
when a side's runtime size is under the threshold, sort-merge otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import _tag_positions


def attach_reference_logps(rows: DataFrame, ref: DataFrame, key: str = "example_id") -> tuple[DataFrame, DataFrame]:
    """Add precomputed reference log-probs to each row. Returns the joined
    rows and the rows without a reference value (to be reported, not lost)."""
    return rows.join(ref, key, "inner"), rows.join(ref, key, "left_anti")


def rotate_partners(df: DataFrame, batch: str, pos: str, cols: list[str], prefix: str = "KL_", num_partitions: int | None = None) -> DataFrame:
    """Mismatched prompt/answer pairs. Inside each batch (ordered by ``pos``, unique
    there) row i takes the answer columns of row i-1 and the first row takes the last
    row's.

    Rows are laid out by range partitions of (batch, pos), so a batch of any size spreads
    over tasks. A row takes its predecessor's values from its own partition, a partition's
    first row those of the last row before it (one border row a partition goes round).
    Only the first row of each batch is joined, with the last row's values of its batch
    (a partial aggregate, one row a batch)."""
    back = [f"{prefix}{c}" for c in cols]
    tagged = _tag_positions(df, [batch, pos], num_partitions)
    # of the layout, not of ``df``, whose plan would run again
    last = tagged.groupBy(F.col(batch).alias("_tf_b")).agg(F.max_by(F.struct(*cols), pos).alias("_tf_last"))
    ends = tagged.groupBy("_tf_pid").agg(F.max_by(F.struct(F.col(batch).alias("_tf_b"), *cols), "_tf_local").alias("end")).collect()
    border, before = {}, None
    for r in sorted(ends, key=lambda r: r["_tf_pid"]):  # one row a partition
        border[r["_tf_pid"]] = before
        before = r["end"].asDict()
    kept = [c for c in df.columns if c not in back]
    schema = df.select(*kept, *[F.col(c).alias(b) for c, b in zip(cols, back, strict=True)], F.lit(True).alias("_tf_first")).schema
    moved = tagged.mapInArrow(_previous_rows(batch, cols, kept, back, border), schema)
    # the two branches read the checkpointed layout
    first = moved.where("_tf_first").drop(*back).join(last, F.col(batch).eqNullSafe(F.col("_tf_b")))
    first = first.select(*kept, *[F.col("_tf_last")[c].alias(b) for c, b in zip(cols, back, strict=True)])
    return moved.where("NOT _tf_first").drop("_tf_first").unionByName(first)


def _previous_rows(batch: str, cols: list[str], kept: list[str], back: list[str], border: dict):
    """mapInArrow function: each row with ``cols`` of the row before it, and whether that
    one is of another batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the row before: batch and columns, as arrays of one
        for rows in batches:
            n = rows.num_rows
            if n == 0:
                continue
            names = [batch, *cols]
            if carry is None:
                row = border.get(rows.column("_tf_pid")[0].as_py())
                known = row is not None
                carry = [pa.array([row[k] if known else None], rows.column(c).type) for k, c in zip(["_tf_b", *cols], names, strict=True)]
                starts = not known
            else:
                starts = False
            of, *values = (pa.concat_arrays([c, rows.column(name).slice(0, n - 1)]) for c, name in zip(carry, names, strict=True))
            now = rows.column(batch)
            same = pc.or_(pc.fill_null(pc.equal(of, now), False), pc.and_(pc.is_null(of), pc.is_null(now)))
            first = np.array(pc.invert(same))
            first[0] |= starts
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *values, pa.array(first)], [*kept, *back, "_tf_first"])
            carry = [rows.column(c).slice(n - 1, 1) for c in names]

    return run


def pair_with_reference(policy: DataFrame, reference: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Line up policy and reference completions of the same prompt."""
    return policy.join(reference, key)


def align_token_groups(a: DataFrame, b: DataFrame, text_key: str = "text_id") -> DataFrame:
    """Align two tokenisations of the same text. Inputs are long tables
    ``(text_id, pos, n_chars)``; tokens are grouped between character offsets
    where both tokenisations have a boundary; tokens after the last common
    boundary form one trailing group. Output per text and group: the token
    positions of each side.

    Running character ends and the group number come from per-text windows
    (a text is one example). The group of a token is the number of common
    boundaries strictly before its end: tokens and boundaries are merged into
    one ordered stream and the boundaries are counted as it runs, so no
    token-by-boundary pairs are formed."""
    wa = Window.partitionBy(text_key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ea = a.withColumn("end", F.sum("n_chars").over(wa)).withColumn("side", F.lit(0))
    eb = b.withColumn("end", F.sum("n_chars").over(wa)).withColumn("side", F.lit(1))
    common = ea.select(text_key, "end").join(eb.select(text_key, "end"), [text_key, "end"]).distinct()
    stream = (
        ea.select(text_key, "end", "side", "pos", F.lit(0).alias("is_bound"))
        .unionByName(eb.select(text_key, "end", "side", "pos", F.lit(0).alias("is_bound")))
        .unionByName(common.select(text_key, "end", F.lit(2).alias("side"), F.lit(-1).cast("long").alias("pos"), F.lit(1).alias("is_bound")))
    )
    ws = Window.partitionBy(text_key).orderBy("end", "is_bound", "side", "pos").rowsBetween(Window.unboundedPreceding, -1)
    tagged = stream.withColumn("grp", F.coalesce(F.sum("is_bound").over(ws), F.lit(0))).filter(F.col("is_bound") == 0)
    grouped = tagged.groupBy(text_key, "grp").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("pos")))).alias("positions_a"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("pos")))).alias("positions_b"),
    )
    return grouped
