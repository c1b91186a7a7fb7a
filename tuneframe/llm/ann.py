"""Approximate nearest neighbours by adaptive dimension scans (operator 4).

Largest inner products become smallest distances by one extra coordinate
``sqrt(M ** 2 - |x| ** 2)`` (M the largest norm). k-means on a bounded sample gives
lists; every vector goes to its nearest list and a query scans the share
``probe_share`` of the lists nearest to it (or as many as hold ``50 * k`` vectors
on average, if more). Vectors are rotated at random and
scanned in blocks of columns: after d of D columns a candidate is abandoned when
its partial distance exceeds what a hypothesis test allows a vector within the
query's threshold, ``(d / D) * (1 + epsilon / sqrt(d)) ** 2`` times the threshold.
The threshold is the k-th distance found in the query's nearest list (in one part
of it, if it is cut). Survivors are scored exactly, in double precision on the
original vectors.

Skew: equal vectors are one (with their ``k + 1`` smallest ids, as no more can be
among a query's k nearest), for candidates and queries alike; lists that the sample
shows to be large are cut into parts of about ``part_rows`` vectors by hash.

Data moved: no copy of a query is made for a list. Parts of lists are packed into
blocks, queries into parts of their own, and a task reads all blocks (or a share of
them, where queries are few) against one part of the queries, keeping ``k + 1`` rows
a query. What is shuffled and written grows with the table: each vector is shuffled
twice and written once, at the width it came in. Pairs compared grow with its square.
``vectors`` is read six times, so it should be a table, not a costly plan.

Bounds: at most ``sample`` vectors and ``max_lists`` centres reach the driver.
Defined cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; a query never finds its own id; rows
that repeat an id with the same vector are one; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .scratch import Scratch

FOUND = "query long, found long, least long, score double"
PACKED = f"units array<int>, uids array<long>, leasts array<long>, vecs binary, home array<struct<{FOUND.replace(' ', ': ').replace(',:', ',')}>>"


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten()
    return np.asarray(values, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    """The extra coordinate for stored vectors."""
    return np.concatenate([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))[:, None]], axis=1)


def _flat(q: np.ndarray) -> np.ndarray:
    """The extra coordinate for queries."""
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far each row is from each centre, up to a term of the row's own."""
    return 0.5 * (centres * centres).sum(1) - x @ centres.T


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_far(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])


def kmeans(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = _near(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def layout(sizes: np.ndarray, part_rows: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these sizes: the first unit of each (and the end), the block of each unit.
    A unit is a list, or a part of a list of over ``part_rows``; a block is units that follow
    one another."""
    cuts = np.maximum(1, np.ceil(sizes / part_rows)).astype(np.int64)
    each = np.repeat(sizes / cuts, cuts)
    return np.concatenate([[0], np.cumsum(cuts)]), ((np.cumsum(each) - each / 2) // block_rows).astype(np.int32)


def _place(centres: np.ndarray, norm: float, first: np.ndarray, blocks: np.ndarray, probes: int):
    """mapInArrow function: stored vectors (probes 0), (uid, least, vec) -> (uid, least, vec, unit,
    block); queries, (uid, vec) -> (uid, vec, unit, block, reach), the unit being their home and
    reach how far the last of the probed lists is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                x = _matrix(batch.column("vec"))
                far = _far(_flat(x) if probes else _lift(x, norm), centres)
                lists = far.argmin(1)
                unit = first[lists] + np.asarray(batch.column("uid")) % (first[lists + 1] - first[lists])
                more = {"unit": pa.array(unit.astype(np.int32)), "block": pa.array(blocks[unit])}
                if probes:
                    more["reach"] = pa.array(np.partition(far, probes - 1, axis=1)[:, probes - 1])
                yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    return run


def scan(x: np.ndarray, q: np.ndarray, limit: np.ndarray, columns: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(distance, alive) of each rotated query and vector; ``limit``: each query's
    squared threshold. Abandoned pairs keep a partial distance."""
    dims, left = x.shape[1], len(q) * len(x)
    total, alive = np.zeros((len(q), len(x))), np.ones((len(q), len(x)), bool)
    one = np.ones((max(total.shape), 1))
    for a in range(0, dims, columns):
        b = min(a + columns, dims)
        xb, qb = x[:, a:b], q[:, a:b]
        if left > 0.05 * total.size:  # one product gives |q|^2 - 2 qx + |x|^2
            total += np.concatenate([-2 * qb, (qb * qb).sum(1)[:, None], one[: len(q)]], axis=1) @ np.concatenate([xb, one[: len(x)], (xb * xb).sum(1)[:, None]], axis=1).T
        else:  # few are left: only they are read
            i, j = np.nonzero(alive)
            total[i, j] += ((qb[i] - xb[j]) ** 2).sum(1)
        allowed = 1.0 if b == dims else b / dims * (1 + epsilon / np.sqrt(b)) ** 2
        alive &= total <= (limit * allowed * (1 + 1e-9) + 1e-9)[:, None]
        left = np.count_nonzero(alive)
        if not left:
            break
    return total, alive


class Asked:
    """Queries of one task, and the k best rows that each has found so far."""

    def __init__(self, uid: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, rotation: np.ndarray):
        self.uid, self.q, self.limit, self.k = uid, q, limit, k
        self.turned = _flat(q) @ rotation
        self.bound = limit * (1 + 1e-9) + 1e-9  # only what is within it can be among a query's k best
        self.rows, self.pending = [], 0

    def look(self, asks: np.ndarray, x: np.ndarray, turned: np.ndarray, uid: np.ndarray, least: np.ndarray, columns: int, epsilon: float) -> None:
        """Queries ``asks`` scan the vectors ``x`` of a unit."""
        step = max(16, 65536 // len(x))
        for a in range(0, len(asks), step):
            i = asks[a : a + step]
            total, alive = scan(turned, self.turned[i], self.limit[i], columns, epsilon)
            bound = self.bound[i]
            if len(x) > self.k and np.isinf(bound).any():
                total[~alive] = np.inf
                bound = np.minimum(bound, np.partition(total, self.k - 1, axis=1)[:, self.k - 1] * (1 + 1e-9) + 1e-9)
            alive &= total <= bound[:, None]
            r, j = np.divmod(np.flatnonzero(alive), len(x))
            if len(r):
                score = np.einsum("nd,nd->n", self.q[i[r]], x[j])
                self.rows.append((i[r], score, least[j], uid[j], total[r, j]))
                self.pending += len(r)
                if self.pending > 65536 + 8 * self.k * len(self.q):
                    self.keep()

    def keep(self) -> None:
        if not self.rows:
            return
        query, score, least, found, total = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((found, least, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        full = query[place == self.k - 1]
        query, total = query[place < self.k], total[order]
        most = np.full(len(self.q), -np.inf)
        np.maximum.at(most, query, total)
        self.bound[full] = np.minimum(self.bound[full], most[full] * (1 + 1e-9) + 1e-9)
        self.rows, self.pending = [(query, score[order], least[order], found[order], total)], 0

    def found(self) -> list[pa.Array]:
        """The columns of FOUND."""
        self.keep()
        if not self.rows:
            return [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
        query, score, least, found, _ = self.rows[0]
        return [pa.array(self.uid[query]), pa.array(found), pa.array(least), pa.array(score)]


def _units(unit: np.ndarray, rows: int = 4096) -> list[tuple[int, int, int]]:
    """(unit, begin, end) of sorted units; one larger than the sample showed comes in slices."""
    names, begins = np.unique(unit, return_index=True)
    return [(u, c, min(c + rows, b)) for u, a, b in zip(names.tolist(), begins.tolist(), [*begins[1:].tolist(), len(unit)], strict=True) for c in range(a, b, rows)]


def _pack(rotation: np.ndarray, norm: float, k: int, columns: int, epsilon: float):
    """Function of a block's vectors and the queries at home in it: the block as one row, with
    the k best that each of these queries finds in its home unit."""

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        order = np.argsort(stored.column("unit").to_numpy(), kind="stable")
        unit, uid, least = (stored.column(c).to_numpy()[order] for c in ("unit", "uid", "least"))
        vecs = stored.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order] if len(order) else np.zeros((0, 1))
        home, q = asked.column("unit").to_numpy(), _matrix(asked.column("vec").combine_chunks())
        queries = Asked(asked.column("uid").to_numpy(), q, np.full(len(q), np.inf), k, rotation) if len(q) else None
        for u, a, b in _units(unit):
            asks = np.flatnonzero(home == u)
            if len(asks):
                x = vecs[a:b].astype(np.float64)
                queries.look(asks, x, _lift(x, norm) @ rotation, uid[a:b], least[a:b], columns, epsilon)
        rows = pa.StructArray.from_arrays(queries.found() if queries else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], ["query", "found", "least", "score"])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        row = pa.Table.from_arrays([one(pa.array(unit)), one(pa.array(uid)), one(pa.array(least)), pa.array([vecs.tobytes()], pa.binary()), one(rows)], ["units", "uids", "leasts", "vecs", "home"])
        return row if len(order) else row.slice(0, 0)

    return run


def _search(rotation: np.ndarray, centres: np.ndarray, first: np.ndarray, norm: float, kind: str, k: int, columns: int, epsilon: float):
    """mapInArrow function: blocks, each beside a part of the queries -> FOUND, the k best of all
    the blocks that the task reads, without the home units."""
    margin = 1e-12 * norm * norm  # the same distance to a centre can be summed up in another order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for batch in batches:
            for r in range(batch.num_rows):
                part = batch.column("part")[r].as_py()
                if part not in parts:
                    uid, limit, home, reach = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).copy() for c in ("query_uids", "limits", "homes", "reaches"))
                    parts[part] = Asked(uid, _matrix(batch.column("query_vecs")[r].values), limit, k, rotation), home, reach + margin
                queries, home, reach = parts[part]
                unit, uid, least = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("units", "uids", "leasts"))
                vecs = np.frombuffer(batch.column("vecs")[r].as_buffer(), kind).reshape(len(uid), -1)
                flat = _flat(queries.q)
                units = _units(unit)
                lists = np.searchsorted(first, [u for u, *_ in units], side="right") - 1
                probed = _far(flat, centres[lists]) <= reach[:, None]
                for n, (u, a, b) in enumerate(units):
                    asks = np.flatnonzero(probed[:, n] & (home != u))
                    if len(asks):
                        x = vecs[a:b].astype(np.float64)
                        queries.look(asks, x, _lift(x, norm) @ rotation, uid[a:b], least[a:b], columns, epsilon)
        for queries, *_ in parts.values():
            yield pa.RecordBatch.from_arrays(queries.found(), ["query", "found", "least", "score"])

    return run


def nearest(vectors: DataFrame, is_query, *, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, lists_per_root: float = 4.0, max_lists: int = 4096,
            probe_share: float = 0.65, sample: int = 20_000, columns: int = 16, epsilon: float = 2.1, part_rows: int = 2048, seed: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each row for which
    ``is_query`` (a condition on the id column) holds. ``lists_per_root`` lists are
    made per square root of the number of different vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    kind, code = ("float", "<f4") if vectors.schema[vector_column].dataType.elementType == FloatType() else ("double", "<f8")
    plain = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(f"array<{kind}>").alias("vec"), is_query.alias("asks")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    wide = F.col("vec").cast("array<double>")
    size = F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)  # null with a null component
    sound = (
        plain.where(~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .withColumns({"norm2": size, "dims": F.size("vec")}).where("norm2 > 0").withColumn("uid", F.xxhash64(wide))
    )
    common = sound.groupBy("dims").agg(F.count("*").alias("count"), F.max("norm2").alias("norm2")).orderBy(F.desc("count"), F.desc("dims")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    sound = sound.where(F.col("dims") == common.dims)  # read anew each time: a copy would be as large as the table
    width = common.dims * (4 if kind == "float" else 8)
    few = Window.partitionBy("uid").orderBy("vec_id")
    ids = sound.select("uid", "vec_id").distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).groupBy("uid").agg(F.collect_list("vec_id").alias("ids"))
    ids = scratch.save(ids)
    n, norm = ids.count(), float(np.sqrt(common.norm2))
    once = lambda rows: rows.groupBy("uid").agg(F.min("vec_id").alias("least"), F.any_value("vec").alias("vec"))
    some = sound if n <= 2 * sample else sound.where(F.xxhash64("uid") < -(2**63) + int(2**64 * 1.5 * sample / n))  # holds the first ``sample``
    drawn = once(some).orderBy(F.xxhash64("uid")).limit(sample).select("vec").collect()
    drawn = _lift(np.array([r.vec for r in drawn]), norm)
    n_lists = int(min(max_lists, max(1, np.ceil(lists_per_root * np.sqrt(n))), len(drawn)))
    centres = kmeans(drawn, n_lists, 6, seed)
    probes = int(np.ceil(min(1.0, max(probe_share, 50 * k / n)) * n_lists))  # lists of 50 * k vectors at least
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((common.dims + 1,) * 2))[0]
    first, blocks = layout(np.bincount(_near(drawn, centres), minlength=n_lists) * (n / len(drawn)), part_rows, max(1, min(2**23 // width, max(4096, n // 64))))

    asked = once(sound.where("asks")).select("uid", "vec").mapInArrow(_place(centres, norm, first, blocks, probes), f"uid long, vec array<{kind}>, unit int, block int, reach double")
    asked = scratch.save(asked)
    stored = once(sound).mapInArrow(_place(centres, norm, first, blocks, 0), f"uid long, least long, vec array<{kind}>, unit int, block int")
    packed = scratch.save(stored.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_pack(rotation, norm, k + 1, columns, epsilon), PACKED))
    home = packed.select(F.inline("home"))

    # each query's threshold, from its home; queries in parts, one for each task
    tasks, n_asked = 3 * spark.sparkContext.defaultParallelism, max(1, asked.count())
    parts = -(-n_asked // max(1, min(2**22 // width, max(256, -(-n_asked // tasks)))))
    own = F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)
    limits = home.groupBy(F.col("query").alias("uid")).agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k + 1)
    asking = (
        asked.join(limits, "uid", "left").withColumn("limit", F.coalesce(F.lit(norm * norm) + own - 2 * F.col("score"), F.lit(float("inf"))))
        .groupBy(F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("uid", "vec", "limit", "unit", "reach")).alias("m"))
        .select("part", F.col("m.uid").alias("query_uids"), F.col("m.vec").alias("query_vecs"), F.col("m.limit").alias("limits"), F.col("m.unit").alias("homes"), F.col("m.reach").alias("reaches"))
    )
    found = home
    if probes > 1 or len(blocks) > n_lists:
        sides = packed.select("units", "uids", "leasts", "vecs").coalesce(-(-tasks // parts)), scratch.save(asking).repartitionByRange(parts, "part")
        pairs = sides[0].hint("shuffle_replicate_nl").crossJoin(sides[1])  # reads both, shuffles neither
        found = home.unionByName(pairs.mapInArrow(_search(rotation, centres, first, norm, code, k + 1, columns, epsilon), FOUND))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "found")
    at, batch = "spark.sql.execution.arrow.maxBytesPerBatch", 2**23  # a row holds a block
    before = spark.conf.get(at)
    spark.conf.set(at, batch)
    try:
        top = scratch.save(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))
    finally:
        spark.conf.set(at, before)
    scratch.drop(packed)

    # each found vector's ids, then the queries that asked with that vector
    rows = top.join(ids.withColumnRenamed("uid", "found"), "found").select("query", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))).alias("hits"))
    asks = scratch.save(sound.where("asks").select(F.col("vec_id").alias("query_id"), F.col("uid").alias("query")).distinct())
    hits = asks.join(scratch.save(rows), "query").select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    return hits.select("query_id", F.posexplode("hits").alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.m")).alias("score"))
