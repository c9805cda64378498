from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attrition import session
from attrition.constants import REQUIRED_COLUMNS
from attrition.streaming import scoring


def test_a_replayed_batch_leaves_the_same_rows(spark, tmp_path):
    batch = spark.range(3)
    scoring.write_batch(batch, 0, str(tmp_path / "out"))
    scoring.write_batch(batch, 0, str(tmp_path / "out"))
    scoring.write_batch(spark.range(2), 1, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_an_event_time_bounds_the_state(spark):
    stream = spark.readStream.format("rate").load().select(
        F.col("timestamp").alias("at"), *[F.lit("0").alias(c) for c in REQUIRED_COLUMNS])
    out = scoring.clean_stream(stream, event_time="at")
    assert out.isStreaming and out.columns == stream.columns
    assert "WithinWatermark" in out._jdf.queryExecution().analyzed().toString()


class _Master:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def getConf(self):
        return {}

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master):
        self.sparkContext = _Master(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://https://host"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session(master))


def test_a_local_session_gets_a_folder_of_its_own():
    assert session.ensure_checkpoint_dir(_Session("local[4]"))


def test_a_table_that_was_written_is_read_by_columns(spark):
    wide = session.cut_lineage(spark.range(100).select("id", *[F.col("id").alias(f"c{i}") for i in range(20)]))
    plan = wide.groupBy("c3").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c3:bigint>" in plan


def test_a_streamed_part_is_written_by_many_tasks(spark, tmp_path):
    from attrition.plans.queries import streaming_dirty_customers

    spark.range(1, 401).selectExpr(
        "id AS c_custkey", "format_string('Customer#%09d', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey",
        "CAST(id * 17 % 3000 AS DOUBLE) AS c_acctbal", "'BUILDING' AS c_mktsegment",
    ).repartition(4).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1, 801).selectExpr(
        "id AS o_orderkey", "id % 400 + 1 AS o_custkey", "'F' AS o_orderstatus", "CAST(1 AS DOUBLE) AS o_totalprice",
        "timestamp'1997-03-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    folder = Path(session.ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("stream-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = streaming_dirty_customers(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (base,) = set(folder.glob("stream-*")) - before
    assert len(list(base.glob("incoming/*.parquet"))) > 4  # four parts
    ids = [r["customerID"] for r in out]
    assert len(ids) == len(set(ids)) and sum(i.startswith("Customer#") for i in ids) == 400
    assert all(r["tenure"] != 5 or not r["customerID"].startswith("Customer#") for r in out)  # no later copy
