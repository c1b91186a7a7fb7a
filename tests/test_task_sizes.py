"""Tasks keep their size on larger tables, and rows don't meet in a task a step."""

import pytest
from pyspark.sql import functions as F

from tuneframe.operators import policy as po
from tuneframe.operators import rollouts as ro
from tuneframe.plans import registry
from tuneframe.sources import views as vw

SF = "/root/testdata/sf0.001"


def _hash(df):
    return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()


def test_rollouts_are_dealt_to_more_tasks(spark, monkeypatch):
    names = ("group_filter_hook", "entropy_mask")
    exp = [_hash(vw.rollouts(spark, SF)), *(_hash(registry.finish(registry.all_queries()[n](spark, SF))) for n in names)]
    monkeypatch.setattr(vw, "TASK_ROWS", 200, raising=False)
    r = vw.rollouts(spark, SF)
    n = -(-vw.table(spark, SF, "lineitem").count() // 200)
    assert r.rdd.getNumPartitions() == n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    # no group is in two tasks
    assert r.select("group_id", F.spark_partition_id()).distinct().count() == r.select("group_id").distinct().count()
    assert [_hash(r), *(_hash(registry.finish(registry.all_queries()[n](spark, SF))) for n in names)] == exp


@pytest.mark.parametrize("name", ["advantages", "mask", "kto_report"])
def test_steps_are_broadcast(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if name == "advantages":
            out = ro.leave_one_out_advantages(spark.range(40).selectExpr("id div 4 AS group_id", "id % 2 AS step", "id * 1.0D AS reward"), normalize=True)
        elif name == "mask":
            rows = spark.range(40).selectExpr("id % 2 AS step", "array(id * 1.0D, id + 0.5D) AS e", "array(1, 1) AS m")
            out = po.high_entropy_mask(rows, "e", "m", 0.2)
        else:
            out = registry.all_queries()[name](spark, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [step" in plan and "SortMergeJoin [step" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
