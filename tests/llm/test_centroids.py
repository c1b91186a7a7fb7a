"""Exact clustering by Walsh-Hadamard progressive search."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tuneframe.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, id string, x long, vector int"


def plain(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster's sum, sum, centroid) by Python integers."""
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) and abs(c) < 2**47 for c in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        to = [j for _, j in assign()]
        for j in set(to):
            mine = [v for (_, v), t in zip(kept, to, strict=True) if t == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    of = {j: sum(d for d, t in found if t == j) for _, j in found}
    fits = lambda n: n if n < 2**63 else None
    return sorted((str(i), j, str(fits(d)), fits(of[j]), fits(sum(of.values())), tuple(c[j])) for (i, _), (d, j) in zip(kept, found, strict=True))


def got(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "c", "i", 1, 2) for r in rows], SCHEMA)
    out = centroids.cluster(frame, **more).collect()
    for r in out:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()
    return sorted((str(r.vec_id), r.cluster, str(r.distance), r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out)


def test_transform_keeps_distances_and_search_is_exact():
    rng = np.random.default_rng(3)
    v, c = rng.integers(-500, 500, (300, 64)), rng.integers(-500, 500, (16, 64))
    v[:150] = c[rng.integers(0, 16, 150)] + rng.integers(-40, 40, (150, 64))
    c[7] = c[3]  # equal centroids
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    number, distance, work = centroids.nearest(centroids.transform(v), centroids.transform(c))
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert work < 0.7 * 300 * 16 * 64  # strictly worse centroids are not finished
    same, exact, _ = centroids.nearest(centroids.transform(v.astype(object)), centroids.transform(c.astype(object)))
    assert (same == number).all() and (exact == distance).all()


def test_clusters_equal_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(64) + 3 * (i % 5)).tolist()) for i in range(120)]
    rows += [(500 + i, [0.25] * 64) for i in range(40)] + [(1, [0.5] * 64), (None, [0.1] * 64), (None, [0.2] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0, None] * 32), (905, [float("nan")] * 64), (906, [float("-inf")] * 64), (907, [2.0**47] * 64)]
    assert got(spark, rows) == plain(rows)


def test_small_and_empty_tables(spark):
    assert got(spark, [(i, [i / 7] * 64) for i in range(5)]) == plain([(i, [i / 7] * 64) for i in range(5)])
    assert got(spark, [(1, None)]) == [] and got(spark, []) == []


def test_components_beyond_the_fast_range(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(64) * scale).tolist()) for i, scale in enumerate([1e7] * 20 + [1e14] * 20 + [1.0] * 5)]
    assert got(spark, rows, k=4) == plain(rows, k=4)


def test_float_components_are_taken_as_doubles(spark):
    value = float(np.float32(0.1))
    frame = spark.range(3).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.1).cast("float"), 64).alias("embedding"))
    assert {tuple(r.centroid) for r in centroids.cluster(frame).collect()} == {(int(np.floor(64 * value)),) * 64}
