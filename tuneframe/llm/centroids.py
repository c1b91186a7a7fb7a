"""Centroid clustering of 64-component vectors by Walsh-Hadamard progressive search.

A component x becomes the integer floor(64 * x). The Walsh-Hadamard transform H of
integers is exact and keeps distances up to a factor: |Hv - Hc|^2 = 64 * |v - c|^2. A
search adds up squared differences of coefficients from coarse to fine (by sequency).
The centroid that is best after the first block is finished first and gives an upper
bound; a centroid whose partial sum is strictly above it can't be nearest and goes. What
stays gets all 64 coefficients, so the answer is exact, ties to the smaller number.

A round is one scan: each task assigns its vectors and sends one sum for each centroid;
the driver and the tasks hold k x 64 integers, whatever the input. No vector is shuffled,
so many equal vectors cost no more than others.

Defined cases: vectors that are null, of another length, with null or non-finite
components or with |x| >= 2^47 (from there on doubles skip integers) take no part. Each row with a
repeated vec_id counts. A null vec_id hashes as the empty text. Equal hashes order by
vector. With fewer than k vectors there are as many centroids as vectors; an empty table
gives an empty result. Beyond 2^24 the search works on Python integers. A distance or
inertia that no long holds is null. Other columns are never read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

DIM = 64
#: Coefficients that a search adds at a time, coarse to fine.
BLOCKS = ((0, 4), (4, 8), (8, 16), (16, 32), (32, 64))
#: Up to here 64 squared differences of coefficients fit in 64 bits.
EXACT = 1 << 24
SUMS = "cluster int, n long, total array<decimal(38,0)>"
LONG = 1 << 63


def _sequency() -> np.ndarray:
    """Where each coefficient of rising sequency stands in the natural order."""
    h = np.ones((1, 1), np.int64)
    while len(h) < DIM:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((h[:, 1:] != h[:, :-1]).sum(1), kind="stable")


ORDER = _sequency()


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, by rising sequency."""
    n, size = len(x), 1
    while size < DIM:
        pairs = x.reshape(n, -1, 2, size)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, DIM)
        size *= 2
    return x[:, ORDER]


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of coefficients ``v`` the number of the nearest row of ``c``, the
    squared distance, and how many coefficient differences were computed for all."""
    n, k = len(v), len(c)
    row, number = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, dtype=v.dtype)
    work, bound = 0, None
    for a, b in BLOCKS:
        diff = v[row, a:b] - c[number, a:b]
        part = part + (diff * diff).sum(1)
        work += diff.size
        if bound is None:
            lead = part.reshape(n, k).argmin(1)
            diff = v - c[lead]
            bound = (diff * diff).sum(1)
            work += diff.size
        stay = np.flatnonzero(part <= bound[row])  # the lead always stays
        row, number, part = row[stay], number[stay], part[stay]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(part, first)
    won = np.flatnonzero(part == np.repeat(best, np.diff(first, append=len(row))))
    won = won[np.flatnonzero(np.diff(row[won], prepend=-1))]  # smallest number of equal ones
    return number[won], best // DIM, work


def integers(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components floor(64 * x))."""
    col = batch.column(column)
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(col), DIM), False)))
    flat = col.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan"))
    x = 64 * np.asarray(flat).reshape(-1, DIM)
    with np.errstate(invalid="ignore"):
        sound = (np.abs(x) < 2.0**53).all(1)
    return rows[sound], np.floor(x[sound]).astype(np.int64)


def _assigned(batch: pa.RecordBatch, column: str, centroids: np.ndarray):
    rows, x = integers(batch, column)
    if not len(rows):
        return rows, x, rows, rows
    small = max(int(np.abs(x).max()), max(abs(int(i)) for i in centroids.ravel())) <= EXACT
    kind = np.int64 if small else object
    number, distance, _ = nearest(transform(x.astype(kind)), transform(centroids.astype(kind)))
    return rows, x, number, distance


def _sums(centroids: np.ndarray, column: str):
    """mapInArrow function: one row for each centroid with vectors in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * len(centroids), [[0] * DIM for _ in centroids]
        for batch in batches:
            _, x, number, _ = _assigned(batch, column, centroids)
            for c in np.unique(number).tolist():
                mine = x[number == c]
                n[c] += len(mine)
                # 32-bit halves: their sums over a batch stay within 64 bits
                high, low = (mine >> 32).sum(0).tolist(), (mine & 0xFFFFFFFF).sum(0).tolist()
                total[c] = [t + (a << 32) + b for t, a, b in zip(total[c], high, low, strict=True)]
        there = [c for c in range(len(centroids)) if n[c]]
        yield pa.RecordBatch.from_arrays([
            pa.array(there, pa.int32()), pa.array([n[c] for c in there], pa.int64()),
            pa.array([[Decimal(t) for t in total[c]] for c in there], pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "total"])

    return run


def _kept(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch, column)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), vectors], ["id", "x"])

    return run


def _final(centroids: np.ndarray, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _, number, distance = _assigned(batch, column, centroids)
            exact = pa.array([Decimal(int(d)) for d in distance], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(number, pa.int32()), exact], ["id", "cluster", "exact"])

    return run


def start(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes of ``salt:id``, in that order."""
    kept = vectors.mapInArrow(_kept("vector"), f"id {vectors.schema['id'].dataType.simpleString()}, x array<long>")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.withColumn("key", key).orderBy("key", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=object).reshape(len(rows), DIM)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's exact floor(sum / count) over its vectors; empty ones stay."""
    sums = vectors.mapInArrow(_sums(centroids, "vector"), SUMS)
    sums = sums.select("cluster", "n", F.posexplode("total").alias("at", "total"))
    sums = sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # at most k x 64 rows
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, id_column: str = "vec_id", vector_column: str = "embedding", salt: str = "1") -> DataFrame:
    """Per vector that takes part: ``id_column``, cluster, distance (squared, of the
    integers), cluster_inertia, inertia, centroid_sha256, centroid (its components)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    vectors = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("vector"))
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, exact decimal(38,0)"
    centroids = start(vectors, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    if len(centroids):
        found = scratch.save(vectors.mapInArrow(_final(centroids, "vector"), schema))
    else:
        found = spark.createDataFrame([], schema)
    inertia = {r["cluster"]: LONG if r["total"] is None else int(r["total"]) for r in found.groupBy("cluster").agg(F.try_sum("exact").alias("total")).collect()}
    long = lambda n: n if n < LONG else None
    rows = [(c, long(n), long(sum(inertia.values())), hashlib.sha256(",".join(str(int(i)) for i in centroids[c]).encode()).hexdigest(), [int(i) for i in centroids[c]]) for c, n in inertia.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    found = found.select(F.col("id").alias(id_column), "cluster", F.expr("try_cast(exact AS long)").alias("distance"))
    return found.join(F.broadcast(of), "cluster").select(id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """DuckDB SQL of the query: every distance in full."""

    def assign(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT r, number, d FROM (SELECT r, number,
          CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i})
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, number) = 1)"""

    def move(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (SELECT number, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
          SELECT number, list(q ORDER BY pos) AS c FROM (
            SELECT number, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q FROM (
              SELECT number, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM kept JOIN a{i} USING (r))
            GROUP BY number, pos) GROUP BY number) m USING (number))"""

    steps = [s for i in range(rounds) for s in (assign(i), move(i))]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
          list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS number, x AS c
        FROM (SELECT sha256('1:' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT {k})),
      {", ".join(steps)}, {assign(rounds)}
      SELECT vec_id, CAST(number AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
      FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (number)"""


ORACLE = _oracle()
