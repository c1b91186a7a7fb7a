"""Message literals against Python's own reader, density weights against a plain solver."""

import ast
import json
import random

import numpy as np
from pyspark.sql import functions as F

from tuneframe.operators import density as dn
from tuneframe.sources import literals as lt


def written(rng, value):
    """A random way to write a value as Python or JSON does."""
    if isinstance(value, (list, tuple)):
        inner = [written(rng, v) for v in value]
        if rng.random() < 0.5:
            return "[" + ", ".join(inner) + rng.choice(["", ",", " "] if inner else [""]) + "]"
        return "(" + ", ".join(inner) + ("," if len(inner) == 1 or (inner and rng.random() < 0.5) else "") + ")"
    if isinstance(value, dict):
        return "{" + ",".join(f"{written(rng, k)}: {written(rng, v)}" for k, v in value.items()) + "}"
    if isinstance(value, str):
        cut = rng.randint(0, len(value))
        forms = [repr, lambda s: "u" + repr(s), lambda s: '"""' + s.replace("\\", "\\\\").replace('"', '\\"') + '"""', lambda s: "'" + "".join(f"\\U{ord(c):08x}" for c in s) + "'"]
        return " ".join(rng.choice(forms)(part) for part in ([value[:cut], value[cut:]] if rng.random() < 0.4 else [value]))
    return repr(value)


def test_reader_agrees_with_python(spark):
    rng = random.Random(4)
    alphabet = "ab'\"\\\n\té😀{}[](),:# "
    texts, want = [], []
    for _ in range(300):
        messages = [{"from": rng.choice(["human", "gpt", None]), "value": "".join(rng.choices(alphabet, k=rng.randint(0, 30))), "n": rng.choice([1, 2.5, None, True, (1, 2)])} for _ in range(rng.randint(0, 4))]
        text = written(rng, messages)
        assert [(m["from"], m["value"]) for m in ast.literal_eval(text)] == [(m["from"], m["value"]) for m in messages]
        texts.append(text)
        want.append([(m["from"], m["value"]) for m in messages])
    texts += ['"\\N{BULLET} x"', "[{'from': 'a', 'value': '\\N{BULLET}'}]", json.dumps([{"from": "a", "value": "é\n", "extra": [None, False]}])]
    want += [None, [("a", "•")], [("a", "é\n")]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(5)
    got = {r.i: r for r in lt.read_message_literals(frame, "text").collect()}
    for i, w in enumerate(want):
        assert (got[i].messages and [(m["from"], m["value"]) for m in got[i].messages]) == (w if w != [] else []), texts[i]
        assert (got[i].reject_reason is None) == (w is not None)


def test_rejects_say_what_and_where(spark):
    rows = ["[{'from': 'a', 'value': 'b'}", "[1,\n {'from': }]", "__import__('os')", "[1]", "{'from': 'a'}", "[{'from': 1}]", "[" * 5000, "", None, "[{'value': '\\ud800'}]", "[{'from': 'a'} for x in y]"]
    frame = spark.createDataFrame([(i, t, "old") for i, t in enumerate(rows)], "i int, text string, reject_reason string")
    got = {r.i: r for r in lt.read_message_literals(frame, "text").collect()}
    assert len(got) == len(rows) and all(r.messages is None and r.reject_reason for r in got.values())
    assert (got[0].reject_line, got[0].reject_column) == (1, 1) and got[1].reject_line == 2
    assert got[3].reject_reason == "message 0 is not a mapping" and got[8].reject_reason == "no text"
    assert "old" not in {r.reject_reason for r in got.values()}


def test_density_weights_equal_a_plain_solver(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("desirable", F.col("label") % 3 == 1)
    rows = e.collect()
    x = np.array([[*r.embedding, 1.0] for r in rows], np.float64)
    y = np.array([float(r.desirable) for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    reg = 0.01
    theta = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method; the intercept is not held back
        p = 1 / (1 + np.exp(-x @ theta))
        scale = np.append(np.full(x.shape[1] - 1, reg * weight.sum()), 0.0)
        # MLlib holds back the coefficients of features scaled to unit variance
        var = np.average((x - np.average(x, axis=0, weights=weight)) ** 2, axis=0, weights=weight) * len(y) / (len(y) - 1)
        scale[:-1] *= var[:-1]
        grad = x.T @ (weight * (p - y)) + scale * theta
        theta -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(scale), grad)
    want = 1 / (1 + np.exp(-x @ theta))
    got = {r.vec_id: r for r in dn.density_ratio_weights(dn.fit_density_classifier(e, reg=reg, max_iter=200), e, min_ratio=0.2, max_ratio=10.0).collect()}
    for r, p in zip(rows, want, strict=True):
        assert abs(got[r.vec_id].prob_desirable - p) < 5e-3
        assert abs(got[r.vec_id].weight - min(max(p / (1 - p), 0.2), 10.0)) < 0.05
    assert 0.1 < np.ptp(want)
