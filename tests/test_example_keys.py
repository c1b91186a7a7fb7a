"""Example keys stay unique whatever a group's size."""

import pytest
from pyspark.sql import functions as F

from tuneframe.operators import packing as pk
from tuneframe.sources import views


@pytest.mark.parametrize("view", ["rollouts", "logps", "rtokens"])
def test_one_key_per_row_at_bench_scale(spark, view):
    rows = getattr(views, view)(spark, "/root/testdata/sf0.1").select("example_id")
    assert rows.count() == rows.distinct().count()


def test_one_key_per_row_of_a_large_group(spark, tmp_path):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    one = li.limit(1).withColumn("l_linenumber", F.explode(F.sequence(F.lit(1), F.lit(40)))).select(*[F.col(c).cast(li.schema[c].dataType) for c in li.columns])
    one.write.parquet(f"{tmp_path}/lineitem.parquet")
    ro = views.rollouts(spark, str(tmp_path))
    assert ro.count() == 40 == ro.select("example_id").distinct().count()


def test_packing_uses_several_tasks(spark):
    rows = spark.range(400).select(F.col("id").alias("example_id"), F.array_repeat(F.lit(1), (F.col("id") % 50 + 1).cast("int")).alias("input_ids"))
    bins = pk.pack_bfd(rows, 100, shard_rows=50)
    assert bins.rdd.getNumPartitions() > 1 and bins.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert bins.agg(F.sum(F.size("seq_lengths"))).first()[0] == 400
    assert bins.select("bin").distinct().count() == bins.count()
