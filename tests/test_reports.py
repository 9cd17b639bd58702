import json

import pytest
from pyspark.sql import functions as F

from streamscore.functions.scalar import event_label, recommendation_count, score_bucket
from streamscore.operators import audience, campaigns, reports
from streamscore.plans import fixtures as fx
from streamscore.sources import tables


def scores_of(spark, rows):
    return spark.createDataFrame(
        [(u, s, None) for u, s in rows],
        "user_id string, propensity_score double, last_updated timestamp_ntz",
    ).withColumn("score_bucket", score_bucket("propensity_score"))


def test_bucket_edges(spark):
    rows = scores_of(spark, [("a", 0.4), ("b", 0.7), ("c", None), ("d", 0.39999)])
    assert {r["user_id"]: r["score_bucket"] for r in rows.collect()} == {
        "a": "MED", "b": "HIGH", "c": "LOW", "d": "LOW",
    }


def test_rates_without_a_base_are_null(events):
    ev = events([("1", "U1", "CN", "C001", "2024-01-01 10:00:00", 5.0)])
    row = campaigns.kpis(campaigns.campaign_performance(ev)).first()
    assert row["ctr"] is None and row["conversion_rate"] is None
    assert row["avg_order_value"] == 5.0


def test_total_reach_counts_distinct_hourly_counts(events):
    ev = events([(str(i), f"U{i}", "CL", "C001", f"2024-01-01 1{i}:00:00", None) for i in range(4)])
    assert campaigns.kpis(campaigns.campaign_performance(ev)).first()["total_reach"] == 1
    assert campaigns.reach_users(ev).first()["reach_users"] == 4


def test_tables_from_user_hours_equal_the_direct_ones(spark, sf_dir):
    ev = fx.enriched(spark, sf_dir)
    hours = campaigns.campaign_user_hours(ev)
    for derived, direct in [
        (campaigns.performance_from_user_hours(hours), campaigns.campaign_performance(ev)),
        (campaigns.reach_from_user_hours(hours), campaigns.reach_frequency(ev)),
    ]:
        assert sorted(map(str, derived.select(direct.columns).collect())) == sorted(
            map(str, direct.collect())
        )


def test_metrics_are_one_document_with_the_most_revenue_first(events):
    ev = events([
        ("1", "U1", "CN", "C001", "2024-01-01 10:00:00", 5.0),
        ("2", "U1", "CN", "C002", "2024-01-01 11:00:00", 7.0),
        ("3", "U2", "CL", "C009", "2024-01-01 12:00:00", None),
    ])
    summary = campaigns.campaign_summary(campaigns.campaign_performance(ev))
    rows = campaigns.metrics_json(summary).collect()
    assert len(rows) == 1 and list(rows[0].asDict()) == ["metrics"]
    metrics = json.loads(rows[0]["metrics"])
    assert [m["revenue"] for m in metrics] == [7.0, 5.0, 0.0]
    assert metrics[2]["campaign_name"] is None and metrics[2]["ctr"] is None
    assert metrics[2]["clicks"] == 1


def test_histogram_adds_up(spark, sf_dir):
    reach = campaigns.reach_frequency(fx.enriched(spark, sf_dir))
    report = campaigns.reach_report(reach).collect()
    bars = sum(r["freq_1"] + r["freq_2_3"] + r["freq_4_5"] + r["freq_6plus"] for r in report)
    assert bars == reach.count()


def test_funnel_looks_at_the_top_only_and_shows_empty_buckets(spark):
    rows = scores_of(spark, [(f"u{i}", 0.9 - i * 0.1) for i in range(6)])
    funnel = {r["score_bucket"]: r for r in reports.score_funnel(rows, 4).collect()}
    assert {b: r["users"] for b, r in funnel.items()} == {"HIGH": 3, "MED": 1, "LOW": 0}
    assert funnel["HIGH"]["bar_pct"] == 100.0 and funnel["LOW"]["total_users"] == 4
    full = {r["score_bucket"]: r["users"] for r in reports.score_distribution(rows).collect()}
    assert sum(full.values()) == 6


def test_labels_and_recommendations(spark):
    row = spark.range(1).select(
        event_label(F.lit("PS")).alias("known"),
        event_label(F.lit("XX")).alias("unknown"),
        recommendation_count(F.lit("1. more\n2. less")).alias("n"),
    ).first()
    assert (row["known"], row["unknown"], row["n"]) == ("Paid Search", "XX", 2)


FEATURES = "user_id string, clicks_24h long, conversions_total long"


@pytest.fixture
def people(spark):
    features = spark.createDataFrame([("a", 1, 0), ("b", 5, 1), ("c", 9, 0)], FEATURES)
    return features, scores_of(spark, [("a", 0.9), ("b", 0.5), ("c", 0.1)])


def users(df):
    return [r["user_id"] for r in df.collect()]


def test_rules_are_combined_and_unknown_ones_ignored(people):
    rules = [
        {"field": "clicks_24h", "op": ">=", "value": "5"},
        {"field": "clicks_24h", "op": "~", "value": "1"},
        {"field": "user_id", "op": "=", "value": "a"},
    ]
    assert users(audience.segment_preview(*people, rules)) == ["b", "c"]
    assert audience.segment_count(*people, rules).first()["cnt"] == 2
    assert users(audience.segment_preview(*people, [])) == ["a", "b", "c"]


def test_rule_values_are_data(people):
    quote = [{"field": "score_bucket", "op": "=", "value": "O'Neil' OR '1'='1"}]
    assert users(audience.segment_preview(*people, quote)) == []
    assert users(
        audience.segment_preview(*people, [{"field": "clicks_24h", "op": "<", "value": "5 clicks"}])
    ) == ["a"]
    with pytest.raises(ValueError):
        audience.segment_predicate([{"field": "clicks_24h", "op": ">", "value": "many"}])


def test_lookup_reaches_the_scan_of_the_serving_table(spark, tmp_path):
    rows = scores_of(spark, [(f"u{i:03d}", i / 100) for i in range(100)])
    tables.write_serving(rows, ["score_bucket", "user_id"], str(tmp_path / "s"), partitions=4)
    stored = spark.read.parquet(str(tmp_path / "s"))
    found = reports.lookup_user(stored, "u042")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,u042)" in plan


def test_latest_per_key(events):
    ev = events([
        ("1", "U1", "CL", "C001", "2024-01-01 10:00:00", None),
        ("2", "U1", "IM", "C001", "2024-01-01 11:00:00", None),
    ]).select("user_id", "event_ts", "event_id")
    assert tables.latest_per_key(ev, "user_id", "event_ts").first()["event_id"] == "2"
