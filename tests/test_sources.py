"""Readers and writers: split-partitioned tables, JSON-lines splits,
literal message parsing (malformed -> NULL), percent slices, unique prompts."""

from pyspark.sql import functions as F

from tuneframe.sources import readers as rd


def test_write_and_read_splits(spark):
    df = spark.createDataFrame([(i, f"p{i}", "train" if i % 4 else "test") for i in range(20)], "id long, prompt string, split string")
    path = rd.write_splits(df, rd.scratch_path(spark, "t-splits"))
    test = rd.read(spark, path, columns=["id"], split="test")
    assert sorted(r.id for r in test.collect()) == [0, 4, 8, 12, 16]
    assert test.columns == ["id"]


def test_read_jsonl(spark):
    base = rd.scratch_path(spark, "t-jsonl")
    spark.createDataFrame([(1, "a")], "id long, text string").write.json(f"{base}/train")
    spark.createDataFrame([(2, "b")], "id long, text string").write.json(f"{base}/test")
    out = rd.read_jsonl(spark, {"train": f"{base}/train", "test": f"{base}/test"}, "id long, text string")
    assert sorted((r.split, r.id) for r in out.collect()) == [("test", 2), ("train", 1)]


def test_parse_message_literal(spark):
    rows = [("[{'from': 'human', 'value': 'hi'}, {'from': 'gpt', 'value': \"it's\"}]",), ("[{'from': 'human', 'value': ",)]
    df = spark.createDataFrame(rows, "s string").select(rd.parse_message_literal("s").alias("m"))
    got = df.collect()
    assert [tuple(x) for x in got[0].m] == [("human", "hi"), ("gpt", "it's")]
    assert got[1].m is None


def test_slice_fraction_and_unique_prompts(spark):
    df = spark.range(10).withColumn("prompt", (F.col("id") % 3).cast("string")).withColumn("step", F.floor(F.col("id") / 4))
    assert sorted(r.id for r in rd.slice_fraction(df, ["id"], 0.5).collect()) == [0, 1, 2, 3, 4]
    u = {r.prompt: r.id for r in rd.unique_prompts(df, "prompt", ("step", "id")).collect()}
    assert u == {"0": 0, "1": 1, "2": 2}
