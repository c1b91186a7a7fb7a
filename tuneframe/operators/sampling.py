"""Sampling, splitting and ordering.

Randomness is hash-seeded (``md5(key|seed)``): the same seed gives the
same split/sample on any cluster layout and after any task retry, unlike
``rand()`` whose value depends on the partition. Positions come from the
parallel ``global_rank`` (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_rank
from .scans import Affine, running

_U_BITS = 1 << 52


def uniform(key: Column | str, seed: int) -> Column:
    """Deterministic uniform value in (0, 1) from a key and a seed: the first 13
    hex digits of ``md5(key|seed)``, which other engines compute alike."""
    k = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.md5(F.concat(k.cast("string"), F.lit(f"|{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(_U_BITS)


def uniform_sql(key: str, seed: int) -> str:
    """:func:`uniform` in DuckDB."""
    return f"((('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 13))::BIGINT + 0.5) / {float(_U_BITS)})"


def split_fraction(df: DataFrame, key: str, test_size: float, seed: int = 0) -> DataFrame:
    """L1: ``split`` = ``test`` for a stable ``test_size`` share of rows (by
    hash threshold, so the share is approximate), else ``train``."""
    return df.withColumn("split", F.when(uniform(key, seed) < test_size, F.lit("test")).otherwise(F.lit("train")))


def split_count(df: DataFrame, key: str, train_size: int, seed: int = 0) -> DataFrame:
    """L1: exactly ``train_size`` rows in ``train`` (a seeded shuffle order
    and a distributed rank), the rest in ``test``."""
    ranked = global_rank(df.withColumn("_tf_u", uniform(key, seed)), [F.col("_tf_u"), F.col(key)], "_tf_rank")
    return ranked.withColumn("split", F.when(F.col("_tf_rank") <= train_size, F.lit("train")).otherwise(F.lit("test"))).drop(
        "_tf_u", "_tf_rank"
    )


def repeat_sampler(
    df: DataFrame,
    key: str,
    mini_repeat_count: int,
    batch_size: int = 1,
    repeat_count: int = 1,
    shuffle: bool = True,
    seed: int = 0,
) -> DataFrame:
    """L2: order rows (seeded shuffle or by key), cut into chunks of
    ``batch_size`` unique rows, drop the short last chunk, then emit every
    chunk ``repeat_count`` times and each row ``mini_repeat_count`` times in a
    row. Output has an explicit ``position`` (0-based) column; the row count is
    ``⌊n/B⌋·B·m·R``."""
    order = [uniform(key, seed), F.col(key)] if shuffle else [F.col(key)]
    base = df.withColumn("_tf_o", order[0]) if shuffle else df
    ranked = global_rank(base, [F.col("_tf_o"), F.col(key)] if shuffle else [F.col(key)], "_tf_rank")
    n = ranked.agg(F.count(F.lit(1)).alias("_tf_n"))
    full = ranked.join(F.broadcast(n), how="inner", on=F.lit(True))  # attach the 1-row count
    full = full.filter(F.col("_tf_rank") <= F.floor(F.col("_tf_n") / batch_size) * batch_size)
    i = F.col("_tf_rank") - 1
    chunk = F.floor(i / batch_size)
    in_chunk = i - chunk * batch_size
    out = full.withColumn("chunk", chunk).withColumn("_tf_in", in_chunk)
    out = out.withColumn("_tf_r", F.explode(F.sequence(F.lit(0), F.lit(repeat_count - 1))))
    out = out.withColumn("_tf_m", F.explode(F.sequence(F.lit(0), F.lit(mini_repeat_count - 1))))
    block = batch_size * mini_repeat_count * repeat_count
    pos = F.col("chunk") * block + F.col("_tf_r") * (batch_size * mini_repeat_count) + F.col("_tf_in") * mini_repeat_count + F.col("_tf_m")
    return out.withColumn("position", pos.cast("long")).drop("_tf_o", "_tf_rank", "_tf_n", "_tf_in", "_tf_r", "_tf_m")


def split_chunks(df: DataFrame, key: str, num_chunks: int) -> DataFrame:
    """L4: ``num_chunks`` equal chunks in key order (``chunk_size = n // k``);
    rows beyond ``k·chunk_size`` belong to no chunk and are left out, as the
    reference's slicing leaves them out."""
    ranked = global_rank(df, [F.col(key)], "_tf_rank")
    n = ranked.agg(F.count(F.lit(1)).alias("_tf_n"))
    j = ranked.join(F.broadcast(n), how="inner", on=F.lit(True))
    size = F.floor(F.col("_tf_n") / num_chunks)
    return (
        j.filter((size > 0) & (F.col("_tf_rank") <= size * num_chunks))
        .withColumn("chunk", F.floor((F.col("_tf_rank") - 1) / size).cast("int"))
        .drop("_tf_rank", "_tf_n")
    )


def weighted_sample(df: DataFrame, n: int, weight: str, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows drawn with probability proportional to ``weight``
    without replacement (Efraimidis-Spirakis keys ``-ln(u)/w``, smallest
    first). A top-``n`` is the sampling operator itself."""
    k = -F.log(uniform(key, seed)) / F.col(weight)
    return df.filter(F.col(weight) > 0).withColumn("_tf_k", k).orderBy("_tf_k", key).limit(n).drop("_tf_k")


def uniform_draws(df: DataFrame, n: int, order: list[str], group: str | None = None, seed: int = 0) -> DataFrame:
    """``min(n, rows)`` uniform draws with replacement from the rows, or from
    each ``group``; ``draw`` counts them from 0. A draw picks a position in
    ``order``, so a row can come several times."""
    keys = [group] if group else []
    ranked = global_rank(df, [*keys, *order], "_tf_pos")
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tf_n"), F.min("_tf_pos").alias("_tf_first")).filter("_tf_n > 0")
    d = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_tf_n"), F.lit(n)) - 1)))
    u = uniform(F.concat_ws("-", *[F.col(c).cast("string") for c in [*keys, "draw"]]), seed)
    d = d.select("draw", (F.col("_tf_first") + F.floor(u * F.col("_tf_n"))).alias("_tf_pos"))
    return d.join(ranked, "_tf_pos").drop("_tf_pos")


def weighted_sample_with_replacement(buffer: DataFrame, n: int, weight: str, key: str, seed: int = 0) -> DataFrame:
    """L6 with replacement: ``n`` draws (0 .. n - 1), see :func:`weighted_draws`."""
    return weighted_draws(buffer.sparkSession.range(n).withColumnRenamed("id", "draw"), buffer, weight, key, seed)


def weighted_draws(draws: DataFrame, buffer: DataFrame, weight: str, key: str, seed: int = 0) -> DataFrame:
    """A draw with probability proportional to ``weight`` for every row of
    ``draws`` (its column ``draw`` seeds it), from a table of any size: the item
    is the first in ``key`` order whose running weight exceeds the drawn point.

    Running weights come from a scan over range partitions, so an item is an
    interval of points. Points and intervals meet in as many equal bins as there
    are items: a bin holds on average one item's worth of points, so a bin full of
    light items gets few points, and a heavy item's interval is repeated in the
    bins it spans. Items of no weight are never drawn."""
    items = buffer.filter(F.col(weight) > 0)
    cum = running(items, Affine, [], [key], [F.lit(1.0), F.col(weight)], ["_tf_lo"], inclusive=False).checkpoint()
    cum = cum.withColumn("_tf_hi", F.col("_tf_lo") + F.col(weight))
    total, n = cum.agg(F.max("_tf_hi"), F.count(F.lit(1))).first()
    if not n:
        return draws.join(buffer.limit(0), F.lit(False))
    bin_of = lambda x: F.least(F.floor(x / F.lit(total) * n), F.lit(n - 1))
    step = 1 << 16  # a heavy item's bins are made some at a time
    first, last = bin_of(F.col("_tf_lo")), bin_of(F.col("_tf_hi"))
    spans = cum.withColumn("_tf_from", F.explode(F.sequence(first, last, F.lit(step).cast("long"))))
    spans = spans.withColumn("_tf_bin", F.explode(F.sequence(F.col("_tf_from"), F.least(F.col("_tf_from") + step - 1, last)))).drop("_tf_from")
    point = uniform("draw", seed) * F.lit(total)
    asked = draws.withColumn("_tf_x", point).withColumn("_tf_bin", bin_of(F.col("_tf_x")))
    hit = asked.join(spans, "_tf_bin").where("_tf_lo <= _tf_x AND _tf_x < _tf_hi")
    return hit.drop("_tf_bin", "_tf_x", "_tf_lo", "_tf_hi")
