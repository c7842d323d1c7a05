"""Session helpers: size-checked broadcast, partition sizing, checkpoint folder."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from scorecraft.session import bounded_broadcast, checkpoint_dir, row_bound_holds, suggested_partitions


def test_bounded_broadcast_falls_back_to_a_shuffle_join(spark):
    cust = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select("c_custkey", "c_name")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_custkey")
    small, hinted = bounded_broadcast(cust, max_rows=10 ** 6)
    big, not_hinted = bounded_broadcast(cust, max_rows=5)
    assert hinted and not not_hinted
    a = orders.join(small, orders["o_custkey"] == small["c_custkey"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = orders.join(big, orders["o_custkey"] == big["c_custkey"])
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert row_bound_holds(cust, cust.count()) and not row_bound_holds(cust, cust.count() - 1)


def test_partition_sizing_and_checkpoint_folder(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert suggested_partitions(docs) == base                    # small input: the configured count
    assert suggested_partitions(docs, target_bytes=1024) > base  # size-driven above it
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert docs.select(F.col("doc_id")).count() > 0


def test_partitions_of_a_table_of_unknown_size(spark):
    from pyspark.sql import functions as F
    from scorecraft.session import suggested_partitions
    df = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a", "b")]), "k long, text string, other string")
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert suggested_partitions(df) == suggested_partitions(df.select("k", F.coalesce("text", F.lit("")).alias("text"))) == base
