"""Hot keys: a third of all rows agree on the join key. The work of such a key must be spread, or
collapse before it is shuffled, and no row may be lost."""

import pytest
from pyspark.sql import functions as F

from coinbrook.operators.duplicates import duplicate_groups
from coinbrook.operators.lookup import absent_from, attach, seen_before
from coinbrook.operators.running_total import running_total
from coinbrook.operators.validation import check_file_rows

ROWS = 30_000


@pytest.fixture
def small_targets(spark):
    """Sizes at which Spark calls a partition skewed, scaled down to the test; no broadcasts."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def skewed(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    return spark.range(0, ROWS, 1, 12).select(
        hot.alias("key"), "id", F.md5(F.col("id").cast("string")).alias("payload")
    )


def final_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_attach_splits_a_hot_key(skewed, small_targets):
    per_key = skewed.groupBy("key").agg(F.count("*").alias("n"))
    got = attach(skewed, per_key, ["key"])
    rows = got.collect()
    assert len(rows) == ROWS
    assert all(r.n == (ROWS // 3 if r.key == -1 else 1) for r in rows)
    assert "skew=true" in final_plan(got)


def test_attach_splits_a_hot_key_before_an_aggregate(skewed, small_targets):
    per_key = skewed.groupBy("key").agg(F.count("*").alias("n"))
    attached = attach(skewed, per_key, ["key"])
    got = attached.groupBy("key").agg(F.max("n").alias("n"), F.max("payload").alias("payload"))
    rows = got.collect()
    assert len(rows) == ROWS * 2 // 3 + 1 and max(r.n for r in rows) == ROWS // 3
    assert "skew=true" in final_plan(got)


def test_history_with_a_hot_key(spark, skewed, small_targets):
    batch = spark.range(-1, 200).select(F.col("id").alias("key"))
    got = seen_before(skewed, batch, ["key"])
    expected = skewed.filter("key < 200").count()
    assert len(got.collect()) == expected
    assert "skew=true" in final_plan(got)


def test_batch_with_a_hot_key(spark, skewed, small_targets):
    history = spark.range(0, 100).select(F.col("id").alias("key"))
    assert absent_from(skewed, history, ["key"]).count() == ROWS - 66
    assert absent_from(skewed, history.limit(0), ["key"]).count() == ROWS


def test_a_small_batch_does_not_shuffle_the_history(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "history"))
    skewed.filter("id < 50").write.parquet(str(tmp_path / "batch"))
    history = spark.read.parquet(str(tmp_path / "history"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    plan = seen_before(history, batch, ["key"])._jdf.queryExecution().executedPlan().toString()
    history_side = plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
    assert "Exchange" not in history_side


def copies(skewed):
    """A third of the rows are copies of one row, all in one file."""
    return skewed.select(
        F.when(F.col("key") == -1, "hot.csv").otherwise("other.csv").alias("file"),
        F.lit("2025-01-01").alias("date"),
        F.lit("x").alias("description"),
        F.col("key").cast("string").alias("amount"),
        F.lit("a").alias("from_account"),
        F.lit("b").alias("towards"),
    )


def test_copies_collapse_before_the_shuffle(skewed):
    rows = copies(skewed)
    groups = duplicate_groups(rows, ["file"]).collect()
    assert [(r.file, r.occurrence_count) for r in groups] == [("hot.csv", ROWS // 3)]
    found = {r.file: r for r in check_file_rows(rows, ["file"]).collect()}
    assert (found["hot.csv"].row_count, found["hot.csv"].duplicate_groups) == (ROWS // 3, 1)
    assert (found["other.csv"].row_count, found["other.csv"].duplicate_groups) == (ROWS * 2 // 3, 0)


def test_a_busy_day_is_spread(spark, skewed):
    offset = (F.col("id") % 300).cast("int")
    rows = skewed.select(
        F.date_add(F.lit("2025-01-01"), F.when(F.col("key") == -1, 0).otherwise(offset)).alias("day"),
        F.col("id").cast("string").alias("id"),
        F.lit(1.0).alias("v"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        total = running_total(rows, "day", "id", "v", "total", rows_per_split=500)
        sizes = [r["count"] for r in total.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == ROWS and max(sizes) < ROWS / 4
        assert total.agg(F.max("total")).first()[0] == ROWS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
