"""Operators over texts: plain Python versions and defined cases."""

import random
import textwrap
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tuneframe.llm import decontamination, licenses, line_templates, minhash, queries, substrings, tokens
from tuneframe.llm.words import Words, join_kept

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, score double, size string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 0.1, "x") for i, t in rows], SCHEMA)


def texts(seed=1, n=3000):
    rng = random.Random(seed)
    return rng, [f"w{i}" for i in range(n)]


ODD = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n\t "), (4, "Two words"), (5, "two WORDS"), (6, "é" * 40), (7, "x" * 100_000)]


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_words_are_split_and_joined_by_ascii_white_space():
    for t in [["a  b\tc", "", None, "d\n", " x y z", "é ü"], ["end", "start"], [None], [""]]:
        w = Words(pa.array(t, pa.string()))
        got = [[w.data[a:b].tobytes() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [plain.split(x) for x in t]
        data, offsets = join_kept(w, w.start >= 0)
        assert [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [b" ".join(x) for x in got]


def test_long_words_differ_by_their_last_byte():
    w = Words(pa.array(["a" * 37 + "b", "a" * 37 + "c", "a" * 38, "a" * 37 + "b"]))
    h = w.hashes().tolist()
    assert len(set(h)) == 3 and h[0] == h[3]


def families():
    """Chains, families of edited copies with copies of their own, and texts that
    share a passage only."""
    rng, v = texts(5)
    base = [rng.choice(v) for _ in range(400)]
    out = [" ".join(base[i * 3 : i * 3 + 120]) for i in range(25)]
    original, copies = [rng.choice(v) for _ in range(150)], []
    for _ in range(60):
        c = list(original)
        for _ in range(rng.randint(1, 7)):
            c[rng.randrange(len(c))] = rng.choice(v)
        copies.append(c)
        out.append(" ".join(c))
    for c in copies[:8]:
        for _ in range(5):
            e = list(c)
            for _ in range(rng.randint(0, 4)):
                e[rng.randrange(len(e))] = rng.choice(v)
            if rng.random() < 0.5:
                del e[: rng.randint(0, 12)]
            out.append(" ".join(e))
    passage = [rng.choice(v) for _ in range(60)]
    for _ in range(40):
        out.append(" ".join([rng.choice(v) for _ in range(4)] + passage + [rng.choice(v) for _ in range(rng.randint(0, 5))]))
    out += out[:10]
    rng.shuffle(out)
    return list(enumerate(out, start=10))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_find_every_link(spark, percent):
    rows = families()
    extra = ODD + rows[:3] if percent == 85 else ODD
    got = minhash.near_duplicates(frame(spark, rows + extra), percent=percent).collect()
    assert len(got) == len(rows) + len(extra)
    want = plain.near_duplicates(rows + [r for r in ODD if r[0] is not None], percent)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    lone = [r for r in got if r.doc_id is None]
    assert [(r.n_shingles, r.component_id, r.kept) for r in lone] == [(2, None, True)]


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_op2_equals_plain_python(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op2_minhash_near_dedup"](spark, SF).collect()}
    assert got == plain.near_duplicates(documents(spark), 85)


def test_substring_dedup_cases(spark):
    rng, v = texts(2)
    passage = [rng.choice(v) for _ in range(50)]
    rows = [(i, " ".join([rng.choice(v) for _ in range(20)] + passage[: 30 + i] + [rng.choice(v) for _ in range(9)])) for i in range(20)]
    rows += [(30, "again " * 80), (31, " ".join(passage)), (31, " ".join(passage)), (32, " ".join(v)), *ODD]
    out = substrings.substring_dedup(frame(spark, rows), window=35).collect()
    want = plain.without_repeats(rows, 35)
    assert sorted((r.n_words, r.n_removed, (r.kept or "").encode()) for r in out) == sorted(want)
    assert {r.key for r in out} == {"k"}


def test_substring_dedup_loses_nothing_with_a_tiny_sketch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = substrings.clean_texts(docs, digest=True).collect()
    tiny = substrings.clean_texts(docs, digest=True, max_sketch_bytes=1 << 14).collect()
    assert sorted(map(tuple, full)) == sorted(map(tuple, tiny))
    assert substrings.substring_dedup(docs.limit(0)).count() == 0


def test_op9_equals_plain_python(spark):
    rows = documents(spark)
    want = {i: (n, gone, plain.digest(kept)) for (i, _), (n, gone, kept) in zip(rows, plain.without_repeats(rows, 35), strict=True)}
    got = queries.QUERIES["op9_substring_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_qgram_bands_find_what_full_alignment_finds():
    rng = random.Random(3)
    for _ in range(40):
        items = [(i, "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(14, 60)))) for i in range(4)]
        index = decontamination.Index(items, 5, 0.1)
        found = []
        for _ in range(5):
            p = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(p))
                kind = rng.randint(0, 2)
                if kind == 0:
                    p[at] = rng.choice("abcxyz")
                elif kind == 1:
                    del p[at]
                else:
                    p.insert(at, rng.choice("abcxyz"))
            found.append("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 50))) + "".join(p))
        got = {}
        for t, i, _, _, edits in index.matches(found):
            got[t, i] = min(edits, got.get((t, i), edits))
        for t, text in enumerate(found):
            for i, codes in enumerate(index.codes):
                edits = plain.least_edits("".join(map(chr, codes)), text)
                assert got.get((t, i)) == (edits if edits <= index.budget[i] else None)


def test_decontamination_cases(spark):
    rng, v = texts(4)
    item = " ".join(rng.choice(v) for _ in range(40))
    swapped = item[:90] + "#" + item[91:]
    bench = spark.createDataFrame([(1, item, "x"), (2, item.upper(), "y"), (3, "short", "z"), (4, None, ""), (None, " ".join(v[:30]), "n")], "item_id long, text string, doc_id string")
    rows = [(10, "before " + item + " after"), (11, swapped), (12, item[: len(item) // 3]), (13, " ".join(v[100:] * 4)), (14, item + " / " + item), (14, item), *ODD]
    got = sorted((r.doc_id, r.item_id or 0, r.edits) for r in decontamination.leaks(frame(spark, rows), bench).collect())
    assert got == sorted([(10, 1, 0), (10, 2, 0), (11, 1, 1), (11, 2, 1)] + [(14, i, 0) for i in (1, 2)] * 3)
    clean = decontamination.decontaminate(frame(spark, rows), bench, max_index_chars=100)
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted([12, 13] + [i or 0 for i, _ in ODD]) and clean.columns == frame(spark, rows).columns
    assert decontamination.leaks(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.decontaminate(frame(spark, rows).limit(0), bench).count() == 0


def test_repetitive_texts_need_little_memory():
    import tracemalloc

    rng, v = texts(9)
    line = " ".join(rng.choice(v) for _ in range(12)) + "\n"
    pair, other = "ab" * 150, decontamination.normal(line)
    for text, item in [("ab" * 50_000, pair), (line * 1500, other), ("a" * 100_000, "a" * 200), ("ab" * 1000 + "x" + "ab" * 1000, pair)]:
        index = decontamination.Index([(1, item)], 12, 0.05)
        tracemalloc.start()
        got = index.matches([decontamination.normal(text)])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300e6
        spans = [(a, b) for _, _, a, b, _ in got]
        assert all(y <= x for (_, y), (x, _) in zip(spans, spans[1:], strict=False))  # none overlaps another
        # all but what is too short for another one is covered
        assert sum(b - a for a, b in spans) > 0.85 * len(decontamination.normal(text)) - len(item) and any(e == 0 for *_, e in got)


def test_counts_of_positions_add_up_over_slices(monkeypatch):
    rng = random.Random(8)
    items = [(i, "".join(rng.choice("abc") for _ in range(40))) for i in range(6)]
    found = ["".join(rng.choice("abc") for _ in range(300)) + rng.choice(items)[1] for _ in range(12)]
    index = decontamination.Index(items, 5, 0.1)
    want = index.matches(found)
    monkeypatch.setattr(decontamination, "SLICE", 50)
    monkeypatch.setattr(decontamination, "WIDE", 64)
    assert index.matches(found) == want and {t for t, *_ in want} == set(range(12))


def test_items_shorter_than_a_gram_match_exactly(spark):
    bench = spark.createDataFrame([(1, "tiny"), (2, "é"), (3, ""), (4, "eleven chrs")], "item_id long, text string")
    rows = [(10, "a Tiny thing"), (11, "tin y"), (12, "cafÉ"), (13, "eleven  chrs"), (14, "eleven chr"), (15, None)]
    got = {(r.doc_id, r.item_id, r.start, r.end, r.edits, r.item_chars) for r in decontamination.leaks(frame(spark, rows), bench).collect()}
    assert got == {(10, 1, 2, 6, 0, 4), (12, 2, 3, 4, 0, 1), (13, 4, 0, 11, 0, 11)}
    assert {r.doc_id for r in decontamination.decontaminate(frame(spark, rows), bench, max_index_chars=70).collect()} == {11, 14, 15}


def test_op3_finds_every_exact_passage(spark):
    normal = decontamination.normal
    bench = [(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(i, j) for i, t in documents(spark) for j, b in bench if b in normal(t)}
    got = queries.QUERIES["op3_benchmark_decontamination"](spark, SF).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in got}
    text, item = dict(documents(spark)), dict(bench)
    for r in got:
        assert plain.least_edits(item[r.item_id], normal(text[r.doc_id])[r.start : r.end]) == r.edits


def test_license_notices(spark):
    notice = licenses.TEMPLATES["mit-grant"][1]
    changed = notice.replace("free of charge", "for a fee")
    rows = [(20, "Some code.\n" + notice + "\nMore."), (21, changed), (22, "All rights reserved.\nReleased under the MIT License."), (23, "I have no permission to license copies of a warranty."), (24, "RELEASED UNDER THE MIT LICENSE"), *ODD]
    got = {(r.doc_id, r.template): r for r in licenses.license_notices(frame(spark, rows)).collect()}
    assert set(got) == {(20, "mit-grant"), (21, "mit-grant"), (22, "reserved-line"), (22, "mit-line"), (24, "mit-line")}
    assert (got[20, "mit-grant"].first_line, got[20, "mit-grant"].last_line) == (1, 8) and not got[20, "mit-grant"].differences
    assert sorted(got[21, "mit-grant"].differences) == sorted(["-free", "-of", "-charge", "+for", "+a", "+fee"])
    assert licenses.license_notices(frame(spark, rows).limit(0)).count() == 0


def exhaustive(text, ranker):
    """Every template aligned over every stretch first; of the spans that overlap, the one
    that its template compresses most stays, and the words between are searched again."""
    text = text.lower()
    found = [(m.start(), m.end()) for m in licenses.WORD.finditer(text)]
    codes = np.array([ranker.code.get(text[x:y], len(ranker.code)) for x, y in found], dtype=np.int64)
    out, todo = [], [(0, len(found))]
    while todo:
        low, high = todo.pop()
        hits = []
        for t, holds in zip(ranker.templates, ranker.holds, strict=True):
            for a, b in licenses._stretches(holds[codes[low:high]], t):
                for first, end, missing, extra in licenses._spans(t, codes, low + a, low + b):
                    hits.append((-ranker.saved(text[found[first][0] : found[end - 1][1]], t)[0], t.name, first, end, missing, [text[slice(*found[x])] for x in extra]))
        taken = []
        for _, name, first, end, missing, extra in sorted(hits, key=lambda x: x[:4]):
            at = bisect_left(taken, (first, end))
            if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < end):
                continue
            taken.insert(at, (first, end))
            out.append((text.count("\n", 0, found[first][0]), name, sorted(missing), sorted(extra)))
        if taken:
            todo += [(a, b) for a, b in zip([low, *(y for _, y in taken)], [*(x for x, _ in taken), high], strict=True) if a < b]
    return sorted(out)


def ranked(text, ranker):
    return sorted((first, name, sorted(missing), sorted(extra)) for _, name, first, _, _, missing, extra in licenses.find(text, ranker))


def licensed_texts():
    """Every template in seven layouts, edited, beside others, and in other prose."""
    rng, vocabulary = texts(6)
    flat = [" ".join(t.split()) for _, t in licenses.TEMPLATES.values()]
    out = []
    for text, words in zip([t for _, t in licenses.TEMPLATES.values()], flat, strict=True):
        out += [text, words, words.upper(), "// " + text.replace("\n", "\n// "), *(textwrap.fill(words, w, break_long_words=False, break_on_hyphens=False) for w in (1, 30, 72))]
        for _ in range(3):
            w = words.split()
            for _ in range(max(1, len(w) // 12)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [w[k], rng.choice(vocabulary)], [rng.choice(vocabulary)]])
            out.append(" ".join(rng.choices(vocabulary, k=30) + w + rng.choices(vocabulary, k=30)))
    for _ in range(40):
        out.append("\n".join(rng.sample(flat, 4)))
        out.append(" ".join(" ".join(rng.choices(vocabulary, k=5)) + " " + x for x in rng.sample(flat, 6)))
    return out


def test_ranked_blocks_find_what_all_alignments_find(spark):
    ranker = licenses.Ranker(licenses.TEMPLATES, 0.15)
    whole = licensed_texts() + [t for _, t in [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()] if t and "icense" in t]
    assert len(whole) > 300
    assert all(ranked(t, ranker) == exhaustive(t, ranker) for t in whole)


def test_every_template_has_triggers_to_spare():
    import re

    for name, (_, text) in licenses.TEMPLATES.items():
        least = licenses.Template(name, "", text, licenses.words(text), 0.15).most_missing
        words = licenses.words(text)
        hits = sum(any(x in w for x in licenses.TRIGGERS if " " not in x) for w in words) + sum(len(re.findall(x, " ".join(words))) for x in licenses.TRIGGERS if " " in x)
        assert hits > least, name


def test_the_ranking_decides(spark, monkeypatch):
    ranker = licenses.Ranker(licenses.TEMPLATES, 0.15)
    whole = [t for t in licensed_texts()]
    by_rank = [ranked(t, ranker) for t in whole]
    monkeypatch.setattr(licenses.Ranker, "saved", lambda self, span, t: (0, 0.0))
    assert sum(a != ranked(t, ranker) for a, t in zip(by_rank, whole, strict=True)) >= 10


def test_op1_finds_the_lines_of_notices(spark):
    got = queries.QUERIES["op1_license_scan"](spark, SF).collect()
    lines = {t[1]: name for name, t in licenses.TEMPLATES.items() if name.endswith("-line")}
    want = sorted((i, lines[line]) for i, t in documents(spark) for line in (t or "").split("\n") if line in lines)
    assert want and sorted((r.doc_id, r.template) for r in got) == want


def test_line_templates_cases(spark):
    rows = [(i, f"Page {i} of 20 was printed by user{i}\n{chr(97 + i)} line of my own here\n\n  ") for i in range(9)]
    rows += [(20, "Page 3 of 20 was printed by user3"), *[(21, "the very same thing here") for _ in range(9)], *ODD]
    got = Counter((r.doc_id, r.text, r.kept, r.n_dropped) for r in line_templates.drop_recurring_lines(frame(spark, rows)).collect())
    want = Counter((i, t, t.split("\n", 1)[1], 1) for i, t in rows[:9])
    want += Counter([(20, "Page 3 of 20 was printed by user3", "", 1)] + [(21, "the very same thing here", "the very same thing here", 0)] * 9 + [(i, t, t, 0) for i, t in ODD])
    assert got == want
    assert line_templates.drop_recurring_lines(frame(spark, rows).limit(0)).count() == 0


def test_token_rollup_batches(spark, tmp_path):
    docs = frame(spark, [*ODD, (1, "hello world"), (1, "hello world")])
    counted = tokens.count_tokens(docs, keep=["doc_id", "source", "lang"])
    assert {r.n_tokens for r in counted.where("doc_id = 2").collect()} == {0}
    rollup = tokens.Rollup(spark, f"file://{tmp_path}/totals")
    assert rollup.totals().count() == 0
    assert rollup.apply("a", tokens.inserted(counted)) and not rollup.apply("a", tokens.inserted(counted))
    # an attempt that failed before its commit leaves no trace in the totals
    tokens.inserted(counted).groupBy(*tokens.KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"file://{tmp_path}/totals/batches/b")
    after = counted.where("doc_id = 1").withColumn("n_tokens", F.lit(100).cast("long"))
    assert rollup.apply("b", tokens.revised(counted.where("doc_id = 1"), after))
    assert rollup.apply("c", tokens.deleted(counted.where("doc_id = 4"))) and rollup.apply("d", tokens.deleted(counted.limit(0)))
    total = rollup.totals().first()
    rest = counted.where("doc_id IS NULL OR doc_id NOT IN (1, 4)").agg(F.sum("n_tokens"), F.count("*")).first()
    assert (total.n_tokens, total.n_docs) == (rest[0] + 300, rest[1] + 3)


def test_op5_equals_a_count_from_scratch(spark):
    import re

    import tiktoken
    from public_tokenizers import PATTERN

    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=tokens.load_ranks(tokens.TOKENIZER), special_tokens={})
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.doc_id not in toxic:
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", r.text).strip(" ") if re.search(r"^[ \t\n\x0b\f\r]|[ \t\n\x0b\f\r]{2}|[ \t\n\x0b\f\r]$", r.text) else r.text
            n, t = want.get((r.source, r.lang), (0, 0))
            want[r.source, r.lang] = (n + 1, t + len(encoding.encode_ordinary(text)))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.QUERIES["op5_token_rollup"](spark, SF).collect()} == want


def test_every_license_template_verbatim_and_rewrapped(spark):
    shapes = {}
    for name, (_, text) in licenses.TEMPLATES.items():
        flat = " ".join(text.split())
        for k, notice in enumerate([text, flat, *(textwrap.fill(flat, w, break_long_words=False, break_on_hyphens=False) for w in (1, 20, 40, 72, 120))]):
            shapes[len(shapes)] = (name, k, "Some code here.\n\n" + notice + "\n\nMore prose follows.", notice.count("\n"))
    rows = [(i, t) for i, (_, _, t, _) in shapes.items()]
    got = [(r.doc_id, r.template, r.first_line, r.last_line, r.n_missing + r.n_extra) for r in licenses.license_notices(frame(spark, rows)).collect()]
    assert sorted(got) == [(i, name, 2, 2 + n, 0) for i, (name, _, _, n) in shapes.items()]


def test_license_notices_inside_longer_lines(spark):
    rng, vocabulary = texts(5)
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, want = [], []
    for name, (_, text) in licenses.TEMPLATES.items():
        for n in (0, 1, 5, 10, 20, 200, 2000):
            rows.append((len(rows), f"{prose(n)} {' '.join(text.split())} {prose(n)}"))
            want.append((len(want), name))
    several = "Copyright 2020 Acme Corporation and its contributors, all rights reserved. Released under the MIT License. " + licenses.TEMPLATES["bsd-conditions"][1]
    rows.append((len(rows), several + "\n" + prose(4) + " copies " + prose(4) + "\nAll rights\nreserved."))
    want += [(len(rows) - 1, x) for x in ("bsd-conditions", "mit-line", "reserved-line", "reserved-line")]
    got = licenses.license_notices(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.template) for r in got) == want and not any(r.differences for r in got)
