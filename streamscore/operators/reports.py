"""Serving queries on scores and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamscore.functions.scalar import count_if, event_label
from streamscore.sources.storage import literal_rows

# Score buckets, highest first.
BUCKETS = ["HIGH", "MED", "LOW"]


def top_users(scores: DataFrame, n: int = 20) -> DataFrame:
    """Highest scores first."""
    return scores.orderBy(F.desc_nulls_last("propensity_score"), "user_id").limit(n)


def lookup_user(table: DataFrame, user_id: str) -> DataFrame:
    """Rows of one user; on a stored table the filter reaches the file scan."""
    return table.filter(F.col("user_id") == F.lit(user_id))


def recent_events(events: DataFrame, user_id: str | None = None, n: int = 50) -> DataFrame:
    """Newest events, of all users or of one, with display names."""
    if user_id is not None:
        events = lookup_user(events, user_id)
    return (
        events.select(
            "event_id",
            "user_id",
            "event_type",
            event_label("event_type").alias("event_label"),
            "campaign_name",
            "channel",
            "event_ts",
            "conversion_value",
        )
        .orderBy(F.desc("event_ts"), "event_id")
        .limit(n)
    )


def score_distribution(scores: DataFrame) -> DataFrame:
    """Users per score bucket."""
    return scores.groupBy("score_bucket").agg(F.count(F.lit(1)).alias("users"))


def score_funnel(scores: DataFrame, top_n: int = 100) -> DataFrame:
    """Buckets among the top users, their total, and bar length in percent.

    All three buckets are present; the longest bar is 100.
    """
    counts = top_users(scores, top_n).groupBy("score_bucket").agg(F.count(F.lit(1)).alias("users"))
    buckets = literal_rows(scores.sparkSession, "score_bucket", BUCKETS)
    everything = Window.partitionBy(F.lit(0))
    users = F.coalesce("users", F.lit(0))
    return buckets.join(counts, "score_bucket", "left").select(
        "score_bucket",
        users.alias("users"),
        F.sum(users).over(everything).alias("total_users"),
        (users * 100.0 / F.greatest(F.max(users).over(everything), F.lit(1))).alias("bar_pct"),
    )


def top_summary(scores: DataFrame, n: int = 15) -> DataFrame:
    """Rows, HIGH users and mean score among the top users."""
    return top_users(scores, n).agg(
        F.count(F.lit(1)).alias("users_scored"),
        F.coalesce(count_if(F.col("score_bucket") == "HIGH"), F.lit(0)).alias("high_users"),
        F.round(F.avg("propensity_score"), 3).alias("avg_score"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Events per type."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
