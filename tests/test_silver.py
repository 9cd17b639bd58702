from pyspark.sql import functions as F

from streamscore.operators.silver import dedup_latest, enrich, unify_events
from streamscore.plans import fixtures as fx

ROWS = [
    ("a", "U1", "CL", "C001", "2024-01-01 10:00:00", None),
    ("a", "U1", "CL", "C001", "2024-01-01 09:00:00", None),
    ("b", "U1", "IM", "CAMP_001", "2024-01-01 11:00:00", None),
]
CONVERSIONS = [
    ("c", "U1", "CN", "C002", "2024-01-01 12:00:00", 5.0),
    ("c", "U1", "CN", "C002", "2024-01-01 12:30:00", 7.0),
    ("d", "U2", "CN", "C002", "2024-01-01 12:00:00", None),
    ("d", "U2", "CN", "C002", "2024-01-01 12:00:00", 3.0),
]


def test_later_copy_wins_and_a_value_beats_none(unified_rows):
    rows = {r["event_id"]: r for r in dedup_latest(unified_rows(ROWS + CONVERSIONS)).collect()}
    assert rows["a"]["event_ts"].hour == 10
    assert rows["c"]["conversion_value"] == 7.0
    assert rows["d"]["conversion_value"] == 3.0
    assert len(rows) == 4


def test_scope_decides_whether_marketing_is_deduplicated(unified_rows):
    marketing = unified_rows(ROWS).drop("conversion_value")
    conversions = unified_rows(CONVERSIONS)
    assert unify_events(marketing, conversions).count() == 5
    assert unify_events(marketing, conversions, "all").count() == 4


def test_copies_are_dropped_before_the_shuffle(unified_rows):
    plan = dedup_latest(unified_rows(ROWS))._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning(event_id")
    assert "WindowGroupLimit" in plan[:shuffle] and "WindowGroupLimit" in plan[shuffle:]


def test_unknown_campaign_is_kept_without_a_name(events):
    row = events(ROWS).filter(F.col("event_id") == "b").first()
    assert row["campaign_id"] == "CAMP_001"
    assert row["campaign_name"] is None and row["channel"] is None


def test_enriching_starts_no_job_and_a_hot_campaign_can_be_split(spark, unified_rows):
    rows = unified_rows(ROWS + CONVERSIONS + [("n", "U3", "CL", None, "2024-01-01 10:00:00", None)])
    assert enrich(rows, fx.campaigns(spark)).count() == rows.count()
    plain = enrich(rows, fx.campaigns(spark).hint("merge"))
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Aggregate" not in plan
    assert sorted(map(str, plain.collect())) == sorted(map(str, enrich(rows, fx.campaigns(spark)).collect()))


def test_dimension_key_is_unique(spark):
    dim = fx.campaigns(spark)
    assert dim.select("campaign_id").distinct().count() == dim.count() == 5


def test_fixture_ids_are_never_cut(spark):
    wide = spark.range(1).select(F.lit(123456789012).alias("n"))
    assert wide.select(fx._padded("E", "n", 8).alias("id")).first()["id"] == "E123456789012"
