"""Union, deduplication and enrichment of raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamscore.schemas import EVENT_COLUMNS


def newest_first() -> list[Column]:
    """Order of the copies of an event; the first one counts."""
    return [
        F.desc("event_ts"),
        F.desc_nulls_last("conversion_value"),
        F.desc("event_type"),
        F.desc("user_id"),
        F.desc_nulls_last("campaign_id"),
    ]


def dedup_latest(events: DataFrame) -> DataFrame:
    """The newest row of every event_id.

    The rank filter lets Spark keep one row per key inside each map task, so an
    event with very many copies never travels whole to one reducer.
    """
    order = Window.partitionBy("event_id").orderBy(*newest_first())
    return (
        events.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def unify_events(
    marketing: DataFrame, conversions: DataFrame, dedup_scope: str = "conversions"
) -> DataFrame:
    """Both raw tables under one schema.

    `dedup_scope` is "conversions" (only that branch is deduplicated) or "all".
    """
    if dedup_scope not in ("conversions", "all"):
        raise ValueError(f"dedup_scope must be 'conversions' or 'all', not {dedup_scope!r}")
    left = marketing.withColumn("conversion_value", F.lit(None).cast("double")).select(
        EVENT_COLUMNS
    )
    right = conversions.select(EVENT_COLUMNS)
    if dedup_scope == "conversions":
        return left.unionByName(dedup_latest(right))
    return dedup_latest(left.unionByName(right))


def enrich(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Add campaign name and channel; events of unknown campaigns stay.

    Works on a stream of events as well as on a table. How the dimension is joined is
    left to its statistics; adaptive execution splits a campaign with very many events.
    """
    names = campaigns.select("campaign_id", "campaign_name", "channel")
    return events.join(names, "campaign_id", "left").select(
        "event_id",
        "user_id",
        "event_type",
        "campaign_id",
        "campaign_name",
        "channel",
        "event_ts",
        "conversion_value",
    )
