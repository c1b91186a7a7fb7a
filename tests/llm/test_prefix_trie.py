"""The trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.oracle_check import compare, duck
from tuneframe.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, c long, name string, depth int, node long"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x, key=lambda y: (y[0], y[1] or 0, *y[2:]))] for c, x in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [k for k in members if len(k) == len(node) + 1 and k[:-1] == node]
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", node[-1][1].encode())) if node else 0
        out[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids),
            sum(out[k][5] for k in kids) or 1, (len(members[node]) - 1) * words + sum(out[k][6] for k in kids),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
    return sorted(out.values())


def got(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], SCHEMA)
    return sorted(tuple(r)[:8] for r in prefix_trie.prefix_trie(frame).collect())


def conversations(seed):
    """Copies, shared beginnings of every length, one conversation of 70 turns."""
    rng = random.Random(seed)
    rows, said = [], ["hi there", "", "a  b\tc", None, "Hi there", "é"]
    for c in range(60):
        for i in range(rng.randint(1, 7)):
            rows.append((c, i, rng.choice(["user", "bot", None]), said[rng.choice([0, 0, 0, 1, 2, 3, 4, 5])]))
    rows += [(100 + c, i, "u", f"turn {i} of a copy") for c in range(30) for i in range(9)]
    rows += [(200, i, "u", f"turn {i}") for i in range(70)] + [(220, i, "u", f"turn {min(i, 40)}") for i in range(66)]
    rows += [(-5, 1, "u", "below"), (-20, 1, "u", "zero"), (-20, 2, "u", "more"), (None, 1, "u", "nobody")]
    rows += [(300, None, "u", "first"), (300, 1, "u", "tie"), (300, 1, "u", "tie"), (300, 1, "a", "tie"), (301, 5, "u", "x" * 50_000)]
    rng.shuffle(rows)
    return rows


def test_trie_equals_plain_python(spark):
    rows = conversations(1)
    assert got(spark, rows) == plain(rows)


def test_small_tries(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    for rows in ([(lone, 1, "a", "b")], [(20, 1, "a", "b")], [(20, i, "a", "b") for i in range(8)], [(lone, 1, "a", "b"), (20, 1, "a", "b"), (40, 1, "a", "b")]):
        assert got(spark, rows) == plain(rows)


def test_query_equals_sql_and_plain(spark):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, "op12", queries.QUERIES["op12_prefix_trie"], queries.ORACLES["op12_prefix_trie"], sf, duck(sf))
    assert r["cols_ok"] and r["hash_ok"], r


def test_sql_equals_plain_on_odd_rows(spark):
    import duckdb
    import pandas as pd

    rows = conversations(3)
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT * FROM given")
    assert sorted(tuple(r) for r in con.execute(queries.ORACLES["op12_prefix_trie"]).fetchall()) == plain(rows)


def test_digests_of_many_ids_are_streamed_in_pieces(spark):
    ids = spark.range(0, 30_000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.lit(b"x")).otherwise(F.lit(b"y")).alias("name"), F.col("id").alias("c"))
    want = {bytes(k): hashlib.sha256(",".join(str(i) for i in range(30_000) if (i % 3 == 0) == (k == b"x")).encode()).hexdigest() for k in (b"x", b"y")}
    assert {bytes(r["name"]): r.sha256 for r in prefix_trie.id_digests(ids).collect()} == want
