"""Recipe fixtures, including rows the reference would stop on (rejects)."""

import ast
import warnings

from tuneframe.operators import recipes as rc

TREE = (
    "question struct<problem:string>, label struct<steps:array<struct<completions:array<struct<text:string,rating:int>>,"
    "human_completion:struct<text:string>,chosen_completion:int>>>"
)


def test_step_tree(spark):
    steps = [
        ([("a1", 1), ("a2", -1)], None, 0),  # chosen a1, terminal a2
        ([("b1", 0), ("b2", 1)], None, 1),  # chosen b2, terminal b1
        ([("c1", -1)], ("human c",), None),  # human completion extends the prefix
        ([("d1", 1)], None, None),  # no pick: d1 is terminal, then stop
        ([("e1", 1)], None, 0),  # never reached
    ]
    df = spark.createDataFrame([(("p",), (steps,))], TREE)
    out = sorted((tuple(r.completions), tuple(r.labels)) for r in rc.step_tree(df).collect())
    assert out == sorted([
        (("a2",), (False,)),
        (("a1", "b1"), (True, False)),
        (("a1", "b2", "c1"), (True, True, False)),
        (("a1", "b2", "human c", "d1"), (True, True, True, True)),
        (("a1", "b2", "human c"), (True, True, True)),
    ])


def test_inline_steps_branches_and_rejects(spark):
    rows = [
        ("Q: Step 1: x ки\nStep 2: y ки", "Q: Step 1: x +\nStep 2: y -"),
        ("What? x ки\ny ки", "What? x -\ny +"),
        ("No marker here ки", "No marker here +"),
        ("Bad label ки", "Bad label ?"),
    ]
    df = spark.createDataFrame(rows, "input string, label string")
    out = rc.inline_steps(df).collect()
    assert (out[0].prompt, list(out[0].completions), list(out[0].labels)) == ("Q:", ["Step 1: x", "Step 2: y"], [True, False])
    assert (out[1].prompt, list(out[1].completions), list(out[1].labels)) == ("What?", ["x", "y"], [False, True])
    assert out[2].reject_reason == "prompt can't be processed"
    assert out[3].reject_reason == "label is not + or - at a step marker"


def test_dialogue_pairs(spark):
    c = "\n\nHuman: Hi\n\nAssistant: Hello\n\nHuman: How are you?\n\nAssistant: Fine."
    r = "\n\nHuman: Hi\n\nAssistant: Hello\n\nHuman: How are you?\n\nAssistant: Bad."
    df = spark.createDataFrame([(c, r), (c, c + " more")], "chosen string, rejected string")
    out = rc.dialogue_pairs(df).collect()
    assert [tuple(m) for m in out[0].prompt] == [("user", "Hi"), ("assistant", "Hello"), ("user", "How are you?")]
    assert out[0].chosen[0].content == "Fine." and out[0].rejected[0].content == "Bad."
    assert out[0].reject_reason is None
    assert out[1].reject_reason is not None


def test_best_of_n_drops_all_equal(spark):
    df = spark.createDataFrame([(" q ", "a", "a", "b", "a", 2), ("q2", "x", "x", "x", "x", 0)],
                               "query string, s0 string, s1 string, s2 string, s3 string, best int")
    out = rc.best_of_n(df, ["s0", "s1", "s2", "s3"]).collect()
    assert [(r.prompt, r.chosen, r.rejected) for r in out] == [("q", "b", "a")]


def test_tldr_preference_unknown_batch(spark):
    schema = "batch string, choice int, info struct<title:string,article:string,post:string,subreddit:string>, summaries array<struct<text:string>>"
    df = spark.createDataFrame([("batch5", 1, ("T", None, "a\n\nb", "sub"), [("s0",), ("s1",)]), ("other", 0, ("T", "x", None, None), [("s0",), ("s1",)])], schema)
    out = rc.comparisons_to_preference(df).collect()
    assert out[0].prompt == "SUBREDDIT: r/sub\n\nTITLE: T\n\nPOST: a\nb\n\nTL;DR:"
    assert (out[0].chosen, out[0].rejected) == ("s1", "s0")
    assert out[1].reject_reason == "Unknown batch: other"


def test_python_literals_and_image_conversation_rejects(spark):
    from tuneframe.sources import readers as rd

    values = ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash \\x41 \\' end\\", "nb\xa0sp\x85 \x07\x0b\x7f\x00", "tab\tnew\nline\r", "é \U0001f600  ", "None, True] }", "", "x'" * 20_000]
    rows = [(i, repr([{"from": "human", "value": v}, {"from": "gpt", "value": "ok", "n": None, "t": True}])) for i, v in enumerate(values)]
    rows.append((len(rows), ascii([{"from": "human", "value": "\U0001f600\xe9"}, {"from": "gpt", "value": "ok"}])))
    rows.append((len(rows), r"[{'from': 'human', 'value': '\101\d\
z'}, {'from': 'gpt', 'value': 'ok'},]"))
    got = {r.id: r.m for r in spark.createDataFrame(rows, "id long, s string").select("id", rd.parse_message_literal("s").alias("m")).collect()}
    for i, s in rows:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = [(m["from"], m["value"]) for m in ast.literal_eval(s)]
        assert [tuple(m) for m in got[i]] == want, s[:100]

    conv = [("good", rows[5][1]), ("none", "[{'from': 'human', 'value': None}, {'from': 'gpt', 'value': 'a'}]"), ("broken", "[{'from': 'human', 'value': 'a"), ("null", None),
            ("raw", "[{'from': 'human', 'value': 'a\nb'}]"), ("one", "[{'from': 'human', 'value': 'a'}]"), ("long", repr([{"from": "human", "value": "a" * 1001}, {"from": "gpt", "value": "b"}]))]
    out = rc.image_conversations(spark.createDataFrame([(i, s, "img") for i, s in conv], "id string, conversations string, image string")).collect()
    assert {r.id: r.reject_reason for r in out} == {"good": None, "none": "message without content", "broken": "conversation literal does not parse", "null": "conversation literal does not parse",
                                                    "raw": "conversation literal does not parse", "one": "conversation needs at least two messages"}
    assert all((r.prompt is None) == (r.reject_reason is not None) for r in out)


def test_a_null_text_keeps_its_conversation(spark, tmp_path):
    from tuneframe.plans.misc_queries import parse_literal_messages
    from tuneframe.plans.recipe_queries import _llava

    turns = [(1, 0, "user", "ab"), (1, 1, "assistant", None), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, parse_literal_messages(spark, str(tmp_path)).collect())) == [(1, 2, 2), (2, 2, 2)]
    out = rc.image_conversations(_llava(spark, str(tmp_path))).collect()
    assert {r.example_id: r.reject_reason for r in out} == {1: "message without content", 2: None}
