import pytest
from pyspark.sql import functions as F

from streamscore.operators.features import rolling_user_features
from streamscore.operators.scoring import score_requests
from streamscore.plans import fixtures as fx
from streamscore.sources import storage, tables


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_by_date_are_pruned_by_folder_and_pushed_down(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    tables.append_events(fx.enriched(spark, sf_dir), path, by_date=True)
    week = tables.read_events(spark, path, "2024-01-24 00:00:00", fx.AS_OF)
    plan = physical(rolling_user_features(week, fx.AS_OF))
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(event_ts,2024-01-24T00:00)" in plan
    assert "conversion_value" not in plan.split("ReadSchema")[1]
    assert plan.count("Exchange") == 1
    assert "event_date" not in week.columns
    direct = rolling_user_features(fx.enriched(spark, sf_dir), fx.AS_OF)
    assert sorted(rolling_user_features(week, fx.AS_OF).collect()) == sorted(direct.collect())


def test_hot_user_is_split_in_the_request_join(spark):
    """Adaptive execution splits one user's requests over several tasks."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        requests = spark.range(0, 200_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, "HOT")
            .otherwise(F.concat(F.lit("U"), F.col("id") % 997))
            .alias("user_id"),
            "id",
        )
        features = spark.range(997).select(
            F.concat(F.lit("U"), F.col("id")).alias("user_id"),
            *[F.lit(1).alias(c) for c in (
                "clicks_1h", "clicks_24h", "clicks_7d", "impressions_1h",
                "impressions_24h", "paid_search_1h", "paid_search_24h", "conversions_7d")],
        )
        scored = score_requests(requests, features)
        assert len(scored.select("id", "propensity_score").collect()) == 200_000
        query = scored.select("id", "propensity_score")
        query.collect()
        assert "skew=true" in physical(query)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = storage.shared_dir(spark, "x"), storage.shared_dir(spark, "x")
    assert one.startswith(base) and one != two


def test_empty_tables_vanish_from_joins(spark):
    schema = spark.range(1).schema
    none = storage.empty(spark, schema)
    assert none.count() == 0
    joined = spark.range(5).join(none.withColumn("x", F.lit(1)), "id", "full_outer")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_read_table_by_name(spark, sf_dir):
    assert tables.read_table(spark, "events", sf_dir).count() == 1000
    fx.campaigns(spark).createOrReplaceTempView("dim_campaigns")
    assert tables.read_table(spark, "dim_campaigns").count() == 5


def test_campaigns_may_come_from_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "dim")
    fx.campaigns(spark).write.parquet(path)
    assert tables.load_campaigns(spark, path).count() == 5


def test_topic_start_is_checked(spark):
    with pytest.raises(ValueError):
        tables.read_topic(spark, "host:9092", "marketing_events", "middle")
