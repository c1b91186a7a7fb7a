"""Literal input -> expected output cases (values taken from the reference's
unit tests, see FIXTURES.md §3), run through the Spark operators."""

from tuneframe.functions import rewards as rw
from tuneframe.functions import text as tx
from tuneframe.operators import conversions as cv
from tuneframe.operators import formats as fm
from tuneframe.operators import judging as jd
from tuneframe.operators import packing as pk
from tuneframe.operators import preference as pf
from tuneframe.operators import replay as rp
from tuneframe.operators import sampling as sm
from tuneframe.operators import tokens as tk
from tuneframe.sources import readers as rd


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_unpair(spark):
    df = spark.createDataFrame(
        [(0, "The sky is", " blue.", " green."), (1, "The sun is", " in the sky.", " in the sea.")],
        "example_id long, prompt string, chosen string, rejected string",
    )
    out = cv.unpair(df).orderBy("pair_side", "example_id")
    assert rows(out, "prompt", "completion", "label") == [
        ("The sky is", " blue.", True),
        ("The sun is", " in the sky.", True),
        ("The sky is", " green.", False),
        ("The sun is", " in the sea.", False),
    ]


def test_extract_prompt_string(spark):
    df = spark.createDataFrame([("The sky is blue.", "The sky is green.")], "chosen string, rejected string")
    r = cv.extract_prompt(df).collect()[0]
    assert (r.prompt, r.chosen, r.rejected) == ("The sky is", " blue.", " green.")


def test_extract_prompt_conversational(spark):
    schema = "chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>"
    user = ("user", "What color is the sky?")
    df = spark.createDataFrame([([user, ("assistant", "It is blue.")], [user, ("assistant", "It is green.")])], schema)
    r = cv.extract_prompt(df).collect()[0]
    assert [tuple(m) for m in r.prompt] == [user]
    assert [tuple(m) for m in r.chosen] == [("assistant", "It is blue.")]
    assert [tuple(m) for m in r.rejected] == [("assistant", "It is green.")]


def test_extract_prompt_no_mismatch_stops_one_early(spark):
    df = spark.createDataFrame([("abc", "abcd")], "chosen string, rejected string")
    r = cv.extract_prompt(df).collect()[0]
    assert (r.prompt, r.chosen, r.rejected) == ("ab", "c", "cd")


def _lists(spark, data):
    return spark.createDataFrame([(i, ids, [1] * len(ids)) for i, ids in enumerate(data)], "example_id long, input_ids array<int>, attention_mask array<int>")


def test_wrapped_packing(spark):
    df = _lists(spark, [[1, 2, 3], [4, 5, 6, 7], [8]])
    out = pk.pack_wrapped(df, 3).orderBy("chunk")
    assert [r.input_ids for r in out.collect()] == [[1, 2, 3], [4, 5, 6], [7, 8]]
    assert [r.attention_mask for r in out.collect()] == [[1, 1, 1], [1, 1, 1], [1, 1]]


def test_wrapped_packing_per_batch_tails(spark):
    df = _lists(spark, [[1, 2, 3], [4, 5, 6, 7], [8], [9, 10]])
    out = pk.pack_wrapped(df, 3, shard_rows=2).orderBy("batch", "chunk")
    assert [r.input_ids for r in out.collect()] == [[1, 2, 3], [4, 5, 6], [7], [8, 9, 10]]


def _bfd(spark, data, L):
    out = pk.pack_bfd(_lists(spark, data), L, num_shards=1).orderBy("bin")
    return [(r.input_ids, r.seq_lengths) for r in out.collect()]


def test_bfd_packing(spark):
    assert _bfd(spark, [[1, 2, 3], [4, 5, 6, 7], [8]], 4) == [([4, 5, 6, 7], [4]), ([1, 2, 3, 8], [3, 1])]


def test_bfd_truncating(spark):
    got = _bfd(spark, [[1, 2, 3, 4, 5], [6, 7], [8, 9, 10, 11], [12]], 4)
    assert got == [([1, 2, 3, 4], [4]), ([8, 9, 10, 11], [4]), ([6, 7, 12], [2, 1])]


def test_bfd_seq_length_5(spark):
    got = _bfd(spark, [[1, 2, 3, 4, 5], [6], [7, 8, 9, 10], [11, 12, 13]], 5)
    assert got == [([1, 2, 3, 4, 5], [5]), ([7, 8, 9, 10, 6], [4, 1]), ([11, 12, 13], [3])]


def test_bfd_plan_pure():
    bins, pos = pk.bfd_plan([3, 4, 1], [0, 1, 2], 4)
    assert bins == [1, 0, 1] and pos == [0, 0, 1]


def test_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3], "a"), ([4, 5, 6, 7], "b"), ([8], "c")], "input_ids array<int>, text string")
    out = tk.truncate_lists(df, 2)
    assert rows(out, "input_ids", "text") == [([1, 2], "a"), ([4, 5], "b"), ([8], "c")]


def test_to_chatml(spark):
    df = spark.createDataFrame(
        [([("human", "What color is the sky?"), ("gpt", "It is blue.")],)], "conversations array<struct<`from`:string,value:string>>"
    )
    assert fm.is_conversational_from_value(df)
    out = fm.to_chatml(df)
    assert out.columns == ["messages"]
    assert [tuple(m) for m in out.collect()[0].messages] == [("human", "What color is the sky?"), ("gpt", "It is blue.")]
    assert fm.is_conversational(out)


def test_soft_overlong_penalty(spark):
    df = spark.createDataFrame([(50,), (110,), (90,)], "n int")
    out = df.select(rw.soft_overlong_penalty("n", 100, 20).alias("r"))
    assert [r.r for r in out.collect()] == [0.0, -1.0, -0.5]


def test_think_format(spark):
    texts = [
        "<think>\nThis is my reasoning.\n</think>\nThis is my answer.",
        "<think>\nThis is my reasoning.\nThis is my answer.",
        "<think>\nreason\n</think>\n<think>again</think>",
        "This is my answer. <think>x</think>",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.r for r in df.select(rw.think_format("t").alias("r")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_pairwise_accuracy_ties_dropped(spark):
    df = spark.createDataFrame([(0.9, 0.1, 0), (0.6, 0.4, 1), (0.5, 0.5, 1)], "s0 double, s1 double, label int")
    r = pf.pairwise_accuracy(df, "s0", "s1", "label").collect()[0]
    assert r.accuracy == 0.5 and r.ties == 1


def test_token_accuracy(spark):
    def acc(preds, labels):
        df = spark.createDataFrame([(p, l) for p, l in zip(preds, labels)], "p array<int>, l array<int>")
        return pf.token_accuracy(df, "p", "l").collect()[0].accuracy

    assert abs(acc([[1, 0], [0, 1]], [[1, 1], [0, -100]]) - 2 / 3) < 1e-12
    assert acc([[1, 0], [1, 0]], [[1, 0], [1, -100]]) == 1.0
    assert acc([[0, 1], [1, 0]], [[0, 0], [1, 1]]) == 0.5


def test_pad_left_right_multiple(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [7, 8])], "b int, ids array<int>")
    left = tk.pad_batch(df, "b", "ids", 0, side="left")
    assert sorted(r.ids for r in left.collect()) == [[0, 7, 8], [1, 2, 3]]
    right = tk.pad_batch(df, "b", "ids", 0, side="right", multiple_of=4)
    assert sorted(r.ids for r in right.collect()) == [[1, 2, 3, 0], [7, 8, 0, 0]]


def test_repeat_sampler_counts(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    s = sm.repeat_sampler(df, "k", mini_repeat_count=2, batch_size=1, repeat_count=1, shuffle=False).orderBy("position")
    assert [r.k for r in s.collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]
    assert sm.repeat_sampler(df, "k", 1, batch_size=2, repeat_count=2, seed=1).count() == 12
    assert sm.repeat_sampler(df, "k", 2, batch_size=3, repeat_count=2, seed=1).count() == 24


def test_repeat_sampler_structure(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    s = [r.k for r in sm.repeat_sampler(df, "k", 2, batch_size=3, repeat_count=2, seed=4).orderBy("position").collect()]
    first = s[:12]
    assert first[:6] == first[6:12]  # the chunk repeats
    assert first[0] == first[1] and len(set(first[:6])) == 3


def test_replay_buffer_keeps_best(spark):
    scores = [0.5, 0.8, 0.3, 0.9, 0.7, 0.6, 0.4]
    df = spark.createDataFrame([(i, s, i, True) for i, s in enumerate(scores)], "group_id long, score double, arrival long, has_variance boolean")
    buf = rp.buffer_add(df, 5)
    assert min(r.score for r in buf.collect()) == 0.5
    assert buf.count() == 5


def test_win_rate(spark):
    df = spark.createDataFrame([(1, v) for v in [1, 0, 1, 0]], "step int, v int")
    assert jd.win_rate(df, "v").collect()[0].win_rate == 0.5
    soft = spark.createDataFrame([(1, 0.6), (1, 0.6)], "step int, p double")
    r = jd.soft_win_rate(soft, "p").collect()[0]
    assert abs(r.avg_win_prob - 0.4) < 1e-12 and r.win_rate == 0.0


def test_judge_mixture(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (-1, 1), (0, 0)], "a int, b int")
    assert [r.v for r in df.select(jd.combine_judges(["a", "b"]).alias("v")).collect()] == [1, 0, -1, 0]


def test_unflip_keeps_invalid(spark):
    df = spark.createDataFrame([(0, True), (1, True), (-1, True), (1, False)], "r int, f boolean")
    assert [r.v for r in df.select(jd.unflip("r", "f").alias("v")).collect()] == [1, 0, -1, 1]


def test_mixture_concatenates_and_errors(spark):
    a = spark.createDataFrame([("a", 1)], "prompt string, x int")
    b = spark.createDataFrame([("b", 2)], "prompt string, x int")
    assert [r.prompt for r in rd.mixture([a, b], ["prompt"]).collect()] == ["a", "b"]
    import pytest

    with pytest.raises(ValueError):
        rd.mixture([])


def test_chatml_and_simple_templates(spark):
    df = spark.createDataFrame([([("user", "Hi"), ("assistant", "Hello")],)], "m array<struct<role:string,content:string>>")
    r = df.select(tx.render_chatml("m", True).alias("a"), tx.render_simple("m", True).alias("b")).collect()[0]
    assert r.a == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nHello<|im_end|>\n<|im_start|>assistant\n"
    assert r.b == "User: Hi\n\nAssistant: Hello\n\nAssistant:"


def test_apply_chat_template_prompt_completion(spark):
    schema = "prompt array<struct<role:string,content:string>>, completion array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", "Hi")], [("assistant", "Yo")]), ([("system", "s")], [("assistant", "x")])], schema)
    out = fm.apply_chat_template(df).collect()
    assert out[0].prompt == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n"
    assert out[0].completion == "Yo<|im_end|>\n"
    assert out[0].reject_reason is None
    assert out[1].reject_reason == "last message has no user or assistant role: system"


def test_common_prefix(spark):
    df = spark.createDataFrame([("abcdef", "abcxyz"), ("", "a"), ("same", "same"), ("éa", "éb")], "a string, b string")
    assert [r.n for r in df.select(tx.common_prefix_len("a", "b").alias("n")).collect()] == [3, 0, 4, 1]


def test_gae_and_position_ids(spark):
    df = spark.createDataFrame([([3, 1],)], "s array<int>")
    assert df.select(tk.position_ids("s").alias("p")).collect()[0].p == [0, 1, 2, 0]


def test_apply_chat_template_strict_raises(spark):
    import pytest

    schema = "prompt array<struct<role:string,content:string>>, completion array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("system", "s")], [("assistant", "x")])], schema)
    with pytest.raises(Exception, match="last message has no user or assistant role"):
        fm.apply_chat_template(df, strict=True).collect()


def test_split_last_message_rejects_short(spark):
    schema = "messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", "hi")],), ([("user", "hi"), ("assistant", "yo")],)], schema)
    out = cv.split_last_message(df).collect()
    assert out[0].reject_reason is not None and out[0].prompt is None
    assert [tuple(m) for m in out[1].prompt] == [("user", "hi")] and [tuple(m) for m in out[1].completion] == [("assistant", "yo")]


def test_conversions_standard(spark):
    ss = spark.createDataFrame(
        [("Blue light", [" scatters more in the atmosphere,", " so the sky is green."], [True, False]),
         ("Water", [" forms a less dense structure in ice,", " which causes it to expand when it freezes."], [True, True])],
        "prompt string, completions array<string>, labels array<boolean>",
    )
    up = cv.ss_to_up(ss).collect()
    assert up[0].completion == " scatters more in the atmosphere, so the sky is green." and up[0].label is False
    lm = cv.ss_to_lm(ss).collect()
    assert [r.text for r in lm] == ["Water forms a less dense structure in ice, which causes it to expand when it freezes."]


def test_preference_collate(spark):
    df = spark.createDataFrame(
        [(0, 0, [1, 2, 3], [4, 5], [6]), (1, 0, [7, 8], [9, 10], [11, 12, 13])],
        "example_id long, batch int, prompt_input_ids array<int>, chosen_input_ids array<int>, rejected_input_ids array<int>",
    )
    out = {r.example_id: r for r in tk.preference_collate(df, "batch", 0).collect()}
    assert [out[0].prompt_input_ids, out[1].prompt_input_ids] == [[1, 2, 3], [0, 7, 8]]
    assert [out[0].prompt_attention_mask, out[1].prompt_attention_mask] == [[1, 1, 1], [0, 1, 1]]
    assert [out[0].rejected_input_ids, out[1].rejected_input_ids] == [[6, 0, 0], [11, 12, 13]]
    assert [out[0].chosen_attention_mask, out[1].chosen_attention_mask] == [[1, 1], [1, 1]]
