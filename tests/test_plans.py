"""Plans that should be chosen."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from granary import plans
from granary.sources import tables


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, node",
    [("smj_forced", "SortMergeJoin"), ("shuffle_hash_forced", "ShuffledHashJoin"), ("broadcast_forced", "BroadcastHashJoin"), ("theta_join_count", "BroadcastNestedLoopJoin"), ("topk_orders", "TakeOrderedAndProject"), ("semi_join", "LeftSemi"), ("anti_join", "LeftAnti"), ("tpch_q1", "partial_")],
)
def test_node(spark, small, name, node):
    assert node in plan(plans.QUERIES[name](spark, small))


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(plans.QUERIES["point_lookup"](spark, small))
    assert "EqualTo(o_orderkey,42)" in text and "o_orderpriority" not in text
    assert "StringStartsWith(c_name,Customer#00000001)" in plan(plans.QUERIES["like_prefix"](spark, small))


def test_partitions_are_pruned(spark, small, tmp_path):
    tables.dump(tables.read(spark, small, "events").select("event_type", "event_id"), f"file://{tmp_path}/e", by=["event_type"])
    held = spark.read.parquet(f"file://{tmp_path}/e").filter(F.col("event_type") == "click")
    assert "PartitionFilters: [isnotnull(event_type" in plan(held)


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_dump_and_read_back(spark, small, tmp_path, kind):
    region = tables.read(spark, small, "region")
    tables.dump(region, f"file://{tmp_path}/r", kind)
    back = spark.read.format(kind).schema(region.schema).load(f"file://{tmp_path}/r")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, region.collect()))


def test_plan_text_and_costs(spark, small):
    from granary.operators import inspect

    df = tables.read(spark, small, "orders").filter("o_orderkey = 42").select("o_custkey")
    assert "PushedFilters" in inspect.plan_text(df) and "== Optimized Logical Plan ==" in inspect.plan_text(df, "cost")
    assert inspect.filtered_rows(10_000, ["=", "<"]) == pytest.approx(33)
    assert inspect.scan_cost(1024, True) == 11 and inspect.scan_cost(1024, False) == 1024
    assert inspect.join_cost((10, 100), (5, 50), True) == 165 and inspect.join_cost((10, 100), (5, 50), False) == 510


def test_analyze(spark, small):
    from granary.operators import inspect

    spark.sql("DROP TABLE IF EXISTS stats_region")
    tables.read(spark, small, "region").write.mode("overwrite").saveAsTable("stats_region")
    got = {(r.column, r.name): r.value for r in inspect.analyze(spark, "stats_region").collect()}
    assert got["r_regionkey", "distinct_count"] == "5" and got["r_regionkey", "max"] == "4"
    spark.sql("DROP TABLE stats_region")


def count(spark, small, name):
    df = plans.QUERIES[name](spark, small)
    return plan(df)


def test_shards_are_routed(spark, small):
    routed, all_ = count(spark, small, "routed_lookup"), count(spark, small, "fan_out")
    assert "PartitionFilters: [isnotnull(shard" in routed and "Exchange" not in routed
    assert "PartitionFilters: []" in all_ and "Exchange" not in all_


def test_stored_buckets_need_no_shuffle_to_join(spark, small):
    text = count(spark, small, "bucketed_merge_join")
    final = text.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final and final.count("Exchange hashpartitioning") == 1  # that of the count


@pytest.mark.parametrize("name, node", [("sort_aggregate", "SortAggregate"), ("object_aggregate", "ObjectHashAggregate"), ("group_one_key", "HashAggregate"), ("cached_scan", "InMemoryTableScan")])
def test_kinds_of_aggregates(spark, small, name, node):
    assert node in count(spark, small, name)


@pytest.mark.parametrize("name", ["lock_conflicts", "self_join_conflict"])
def test_self_joins_meet_by_key_and_hour(spark, small, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "_hour" in count(spark, small, name).split("SortMergeJoin")[1].split("\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_groups_are_skipped(spark, small, tmp_path):
    orders = tables.read(spark, small, "lineitem").select("l_orderkey", "l_comment" if "l_comment" in tables.read(spark, small, "lineitem").columns else "l_quantity").orderBy("l_orderkey").coalesce(1)
    orders.write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).option("parquet.page.row.count.limit", 100).parquet(f"file://{tmp_path}/o")
    found = spark.read.parquet(f"file://{tmp_path}/o").filter("l_orderkey < 50")
    wanted = len(found.collect())
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert wanted <= leaf.metrics().apply("numOutputRows").value() < orders.count() / 2


def test_shared_folder_is_asked_for(spark, monkeypatch):
    held = spark.conf.get("spark.checkpoint.dir")
    assert tables.scratch(spark, "x").startswith(held)


def test_embedded_database_takes_batches(spark):
    url = tables.embedded_database(spark)
    tables.bulk_load(spark.range(12_000).withColumnRenamed("id", "N"), url, "numbers")
    back = tables.jdbc(spark, url, "SELECT * FROM numbers WHERE \"N\" >= 10", "N", 0, 12_000, 3)
    assert back.count() == 11_990 and back.rdd.getNumPartitions() == 3


def test_embedded_database_on_a_cluster(small, tmp_path):
    home = tmp_path / "home"  # executors put their logs into a folder of Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
from pyspark.sql import SparkSession
from granary import plans
from granary.sources import tables
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").getOrCreate()
got = sorted(map(tuple, plans.QUERIES["jdbc_bulk_load"](spark, {small!r}).collect()))
assert got == sorted(map(tuple, tables.read(spark, {small!r}, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())) and len(got) == 25
url = tables.embedded_database(spark)
rows = spark.range(600).selectExpr("id AS N", "if(id % 3 = 0, null, string(id)) AS S", "id / 4 AS D", "timestamp_seconds(id) AS T")
tables.bulk_load(rows, url, "numbers", batch=250)
tables.bulk_load(rows, url, "numbers", batch=250)
back = tables.jdbc(spark, url, 'SELECT * FROM numbers WHERE "N" >= 10', "N", 0, 600, 3)
assert back.rdd.getNumPartitions() == 3 and sorted(map(str, back.collect())) == sorted(map(str, rows.filter("N >= 10").collect()))
print("all rows are back")
spark.stop()
"""
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all rows are back" in run.stdout, run.stderr[-3000:]


def test_declared_key_is_not_null(spark):
    declared = tables.schema({"id": "int", "name": "text"}, primary_key="id")
    with pytest.raises(Exception, match="NOT_NULL|None|null"):
        spark.createDataFrame([(None, "x")], declared).collect()
