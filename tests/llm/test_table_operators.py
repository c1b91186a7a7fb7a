"""Vectors, mixing, sharding, quality and the pipeline."""

import contextlib
import hashlib
import threading
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_text_operators import ODD, SF, documents, frame
from tests.oracle_check import compare, duck
from tuneframe.llm import ann, mixing, quality, queries, sharding


def test_queries_with_sql_equal_it(spark):
    con = duck(SF)
    for name, sql in queries.ORACLES.items():
        r = compare(spark, name, queries.QUERIES[name], sql, SF, con)
        assert r["cols_ok"] and r["hash_ok"], r


def brute(vectors, k):
    out = {}
    for q, x in vectors.items():
        if q % 20 == 0:
            out[q] = sorted(((-float(np.dot(x, y)), i) for i, y in vectors.items() if i != q))[:k]
    return out


def test_op4_recall_and_scores(spark):
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want, got = brute(vectors, 20), defaultdict(list)
    for r in queries.QUERIES["op4_adaptive_dimension_ann"](spark, SF).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert abs(r.score - np.dot(vectors[r.query_id], vectors[r.vec_id])) < 1e-12
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)
    assert all([x[0] for x in sorted(rows)] == list(range(1, 21)) for rows in got.values())


def test_nearest_defined_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(100, 160)]
    rows += [(i, [1.0] * 8) for i in range(200, 260)] + [(200, [1.0] * 8)]
    rows += [(1, None), (2, [0.0] * 8), (3, [1.0, None] * 4), (4, [float("nan")] * 8), (5, [float("inf")] * 8), (6, [1.0] * 3), (None, [1.0] * 8)]
    frame_ = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, uid string")
    got = defaultdict(list)
    for r in ann.nearest(frame_, F.col("vec_id") % 20 == 0, k=20, probe_share=1.0, epsilon=50.0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    sound = {i: np.array(x, np.float32).astype(np.float64) for i, x in rows if i and i >= 100}
    for q, want in brute(sound, 20).items():
        rows_ = sorted(got[q])
        assert [i for _, i, _ in rows_] == [i for _, i in want] and np.allclose([s for *_, s in rows_], [-s for s, _ in want])
    assert ann.nearest(frame_.limit(0), F.col("vec_id") > 0).count() == 0
    few = frame_.where("vec_id between 100 and 103")
    assert ann.nearest(few, F.col("vec_id") == 100, k=20).count() == 3


def test_nearest_ties_go_to_smaller_ids(spark):
    vectors = {i: np.eye(64)[i - 100] for i in range(100, 164)}
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in vectors.items()], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, k=20, probe_share=1.0, epsilon=50.0).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in brute(vectors, 20).items()}


def test_nearest_recall_where_not_all_lists_are_probed(spark):
    rng = np.random.default_rng(2)
    vectors = dict(enumerate(rng.standard_normal((2500, 16))))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in vectors.items()], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, k=20).collect()}
    hits = sum((q, i) in got for q, x in brute(vectors, 20).items() for _, i in x)
    assert hits >= 0.95 * 20 * 125  # 65 % of the lists are probed


def test_nearest_where_lists_are_cut(spark):
    rng = np.random.default_rng(3)
    vectors = {i: x.astype(np.float32).astype(np.float64) for i, x in enumerate(np.repeat(rng.standard_normal((3, 8)), 300, axis=0) + 0.1 * rng.standard_normal((900, 8)))}
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in vectors.items()], "vec_id long, embedding array<float>")
    want = {q: [(i, -s) for s, i in x] for q, x in brute(vectors, 3).items()}
    for lists in (0.001, 4.0):  # one list in 15 parts; small lists
        got = defaultdict(list)
        for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, k=3, probe_share=1.0, epsilon=50.0, lists_per_root=lists, part_rows=64).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert {q: [i for _, i, _ in sorted(x)] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
        assert all(np.allclose([s for *_, s in sorted(x)], [s for _, s in want[q]]) for q, x in got.items())


def test_units_and_blocks():
    first, blocks = ann.layout(np.array([10.0, 0.0, 250.0, 90.0]), 100, 120)
    assert first.tolist() == [0, 1, 2, 5, 6] and blocks.tolist() == [0, 0, 0, 1, 1, 2]


def test_queries_keep_their_best_rows():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-1, 2, (500, 4)).astype(float), rng.integers(-1, 2, (7, 4)).astype(float)  # many ties
    norm, uid, least = 2.0, rng.permutation(500), rng.integers(0, 50, 500)
    asked = ann.Asked(np.arange(7), q, np.full(7, np.inf), 5, np.eye(5))
    for a in range(0, 500, 50):
        asked.look(np.arange(7), x[a : a + 50], ann._lift(x[a : a + 50], norm), uid[a : a + 50], least[a : a + 50], 2, 50.0)
        if a % 100:
            asked.keep()
    got = sorted(zip(*(c.to_pylist() for c in asked.found()), strict=True))
    assert got == sorted((i, f, n, s) for i in range(7) for s, n, f in sorted(zip((x @ q[i]).tolist(), least.tolist(), uid.tolist(), strict=True), key=lambda r: (-r[0], *r[1:]))[:5])


def test_nearest_moves_no_query_to_every_list(spark):
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    sizes, done = {}, threading.Event()

    def watch(seen):  # files can be cleaned up meanwhile
        for d in dirs:
            for f in Path(d).rglob("shuffle_*.data"):
                with contextlib.suppress(OSError):
                    seen[f.name] = f.stat().st_size

    def watching():
        while not done.wait(0.1):
            watch(sizes)

    rng = np.random.default_rng(6)
    table = pa.table({"vec_id": pa.array(range(12_000)), "embedding": pa.array(list(rng.standard_normal((12_000, 64)).astype(np.float32)), pa.list_(pa.float32()))})
    rows, before, thread = spark.createDataFrame(table), {}, threading.Thread(target=watching)
    watch(before)
    thread.start()
    try:
        assert ann.nearest(rows, F.col("vec_id") % 20 == 0, k=20).count() == 20 * 600
    finally:
        done.set()
        thread.join()
    watch(sizes)
    moved = sum(n for name, n in sizes.items() if name not in before)
    assert 0 < moved < 8 * 12_000 * 64 * 4  # 600 queries go to 286 of 439 lists


def capacity(rows, shards):
    sizes = Counter()
    for _, t in rows:
        sizes[hashlib.md5(t.encode()).hexdigest() if t is not None else ""] += len((t or "").encode()) + 16
    sizes, own = [sizes[k] for k in sorted(sizes)], 0
    largest = max(sizes)
    while max(sizes) * (shards - own) > sum(sizes) and own < shards - 1 and len(sizes) > 1:
        sizes.remove(max(sizes))
        own += 1
    return max(largest if own else 0, plain.smallest_capacity(sizes, shards - own))


@pytest.mark.parametrize("points", [20_000, 60])
def test_shards_are_as_even_as_can_be(spark, points):
    rows = documents(spark) + [(None, "x"), (900, None), (901, None), (902, ""), (903, "same"), (904, "same"), (904, "same")]
    for shards in (1, 7, 40):
        got = sharding.minimax_shards(frame(spark, rows), shards, points=points).collect()
        sizes, slots = Counter(), defaultdict(list)
        for r in got:
            sizes[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert len(got) == len(rows) and max(sizes.values()) == capacity(rows, shards) and set(sizes) <= set(range(shards))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({r.shard for r in got if r.doc_id in (903, 904)}) == 1


def test_sharding_small_tables(spark):
    assert sharding.minimax_shards(frame(spark, [(1, "x")]).limit(0), 3).count() == 0
    assert [r.shard for r in sharding.minimax_shards(frame(spark, [(1, "x")]), 3).collect()] == [0]
    hot = [(i, "hot " * 50) for i in range(50)] + [(100 + i, f"text {i}") for i in range(100)]
    got = sharding.minimax_shards(frame(spark, hot), 5).collect()
    rows = Counter(r.shard for r in got)
    assert len(rows) == 5 and len({r.shard for r in got if r.doc_id < 50}) == 1


def test_targets_stop_at_the_cap():
    got = mixing.targets({"b": 100, "a": 10, None: 1000, "c": 0}, (3, 1, 2), 1.5, 2.0)
    assert got["a"] == 20 and got["c"] == 0 and abs(sum(got.values()) - 1.5 * 1110) < 1e-9
    assert mixing.targets({}, (1,), 1.5, 2.0) == {}
    assert mixing.targets({"a": 5}, (1,), 3.0, 2.0) == {"a": 10.0}


def test_permutation_visits_each_index_once(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_op10_comes_near_its_targets(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op10_source_mixing"](spark, SF).collect()
    again = queries.QUERIES["op10_source_mixing"](spark.newSession(), SF).repartition(3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert r.size == len(plain.split(rows[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        taken[rows[r.doc_id].source] += r.taken
        target[rows[r.doc_id].source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in target)


def test_mix_as_documents_holds_the_words_taken(spark):
    rows = [*documents(spark)[:60], *ODD, (8, "same row of words"), (8, "same row of words")]
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise((F.col("doc_id") % 4).cast("string")))
    mix = mixing.Mix(docs)
    want = Counter()
    for r in mix.taken().collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in mix.documents(docs).collect():
        got[r.doc_id] += len(plain.split(r.text))
        assert r.n_chars == len(r.text) and r.key == "k"
    assert +want == got and mix.documents(docs).columns == docs.columns
    assert mixing.Mix(docs.limit(0)).taken().count() == 0


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = np.random.default_rng(n).integers(1, 255, n).astype(np.uint8)
        pieces, first = quality.cut(data, np.array([0, n]))
        assert first.tolist() == [0, len(pieces)]
        step = quality.CHUNK - quality.OVERLAP
        back = np.concatenate([pieces[0], *[p[quality.OVERLAP :] for p in pieces[1:]]])
        assert (back[:n] == data).all() and not back[n:].any() and len(pieces) == max(1, -(-(n - quality.OVERLAP) // step))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(2)
    net = quality.Network.random(1)
    pieces, first, y = rng.integers(0, 255, (5, quality.CHUNK)).astype(np.uint8), np.array([0, 2, 5]), np.array([1.0, 0.0], np.float32)
    weight = np.array([0.7, 1.3])

    def loss():
        s = net.score(pieces, first)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    for w, g in zip(net.weights(), net.gradients(pieces, first, y, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-4
        up = loss()
        w[at] = old - 1e-4
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 0.1 * abs(g[at]) + 1e-4


def test_quality_learns_and_handles_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in queries.QUERIES["op8_quality_cnn"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    out = [(scores[r.doc_id].predicted == r.quality) for r in labels if scores[r.doc_id].held_out]
    assert len(scores) == 1000 and np.mean(out) > 0.9
    docs = frame(spark, ODD)
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    net = quality.Network.random(0)
    got = quality.score(docs, net)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "score"] and all(0 <= r.score <= 1 for r in got.collect())
    assert quality.score(docs.limit(0), net).count() == 0


def test_pipeline_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    good = corpus_pipeline.good_quality(spark, docs, SF)
    assert good.columns == docs.columns and 0.6 * docs.count() < good.count() < docs.count()
    want = plain.near_duplicates([(r.doc_id, r.text) for r in docs.collect()], 80)
    lone = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs.limit(5)), SF)
    assert sorted(r.doc_id for r in lone.collect()) == sorted(i for i, (_, root) in want.items() if root == i) and lone.columns == docs.columns
    clean = corpus_pipeline.decontaminated(spark, docs, SF)
    from tuneframe.llm.decontamination import normal

    bench = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if not any(b in normal(r.text) for b in bench)}
    docs.unpersist()


def test_pipeline_runs_and_repeats(spark):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == again and len(first) > 100


def test_pipeline_classes_each_text_of_a_repeated_doc_id(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (5, text("b")), (7, text("c")), (8, text("d")), (8, text("c")), (9, None), (None, text("a"))]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()
    assert sorted(r.text[0] for r in got if r.doc_id is not None and r.text) == ["a", "b", "c", "d"]
    assert {r.doc_id for r in got} == {1, 5, 7, 8, 9, None} or {r.doc_id for r in got} == {1, 5, 8, 9, None}


def plain_score(net, text):
    """The network's answer for one text, filter by filter and place by place."""
    data = (text or "").encode()
    step = quality.CHUNK - quality.OVERLAP
    pooled = []
    for at in range(0, max(1, len(data) - quality.OVERLAP), step):
        piece = data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        best = np.full(quality.FILTERS, -np.inf)
        for k in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            seen = np.concatenate([net.embed[b] for b in piece[k : k + quality.WIDTH]])
            best = np.maximum(best, seen @ net.filters)
        pooled.append(np.maximum(best + net.bias, 0))
    pooled = np.array(pooled)
    features = np.concatenate([pooled.mean(0), pooled.max(0), pooled.min(0)])
    hidden = np.tanh(features @ net.hidden + net.hidden_bias)
    return float(1 / (1 + np.exp(-(hidden @ net.out + net.out_bias)[0])))


def test_scores_equal_a_plain_loop_over_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    net = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    rows = sorted(documents(spark), key=lambda r: len(r[1]))
    picked = rows[:10] + rows[len(rows) // 2 : len(rows) // 2 + 10] + rows[-4:]
    assert len(picked[-1][1]) > 10 * quality.CHUNK
    for i, t in picked:
        assert abs(got[i] - plain_score(net, t)) < 1e-4


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints (given as ("int", x)) and texts; nulls are skipped."""
    import struct

    import xxhash

    h = 42
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v) if isinstance(v, int) else v.encode()
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def plain_taken(rows, block=32, seed=10):
    """(doc_id, taken) from the draws' sums and a plain form of the permutations."""
    import math

    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain.split(t))
    out = Counter()
    for number, (source, target) in enumerate(mixing.targets(dict(sizes), (3, 1, 2), 1.5, 2.0).items()):
        blocks = math.ceil(sizes[source] / block)
        slots = min(int(2.0 * blocks), round(target / sizes[source] * blocks)) if sizes[source] else 0
        uses = Counter()
        for n in range(slots):
            x, key = n % blocks, (("int", seed), ("int", number), ("int", n // blocks))
            for r in range(1, mixing.ROUNDS + 1):
                mirror = (spark_hash(("int", r), *key) % blocks - x) % blocks
                if spark_hash(max(x, mirror), ("int", r), "swap", *key) % 2 == 0:
                    x = mirror
            uses[x] += 1
        at, mine = 0, []
        for i, t, s in rows:
            if s == source:
                row_print = spark_hash(i, t, s)
                mine.append((spark_hash(i, row_print) % mixing.SUBS, (i is not None, i), row_print, len(plain.split(t))))
        for _, (_, i), _, size in sorted(mine):
            out[i] += sum(uses[k // block] for k in range(at, at + size))
            at += size
    return out


def test_op10_equals_a_plain_reenactment(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = {r.doc_id: r.taken for r in queries.QUERIES["op10_source_mixing"](spark, SF).collect()}
    assert {i: n for i, n in plain_taken(rows).items() if n} == {i: n for i, n in got.items() if n}
    odd = [(i, t, ["a", None, "b"][k % 3]) for k, (i, t) in enumerate([*ODD, (9, "one two three four " * 30), (10, "five six " * 41)])]
    frame_ = spark.createDataFrame(odd, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.Mix(frame_).taken().collect():
        taken[r.doc_id] += r.taken
    assert +taken == +plain_taken(odd)
