"""Campaign tables and the reports read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamscore.functions.scalar import count_if, count_if_type, hour_of, money_sum, ratio
from streamscore.schemas import CLICK, CONVERSION, IMPRESSION

CAMPAIGN = ["campaign_id", "campaign_name", "channel"]


def _conversion_value():
    return F.when(F.col("event_type") == CONVERSION, F.col("conversion_value")).otherwise(0)


def campaign_performance(events: DataFrame) -> DataFrame:
    """Hourly KPIs per campaign.

    Spark aggregates by campaign, hour and user before it counts users, so a hot
    campaign is spread by user.
    """
    return events.groupBy(*CAMPAIGN, hour_of("event_ts").alias("hour_ts")).agg(
        F.count(F.lit(1)).alias("total_events"),
        count_if_type(IMPRESSION).alias("impressions"),
        count_if_type(CLICK).alias("clicks"),
        count_if_type(CONVERSION).alias("conversions"),
        money_sum(_conversion_value()).alias("revenue"),
        F.countDistinct("user_id").alias("unique_users"),
    )


def campaign_user_hours(events: DataFrame) -> DataFrame:
    """Additive counts per campaign, user and hour.

    Two such tables can be added up, and the hourly KPIs as well as reach and
    frequency follow from them exactly.
    """
    touch = F.col("event_type").isin(CLICK, IMPRESSION)
    return events.groupBy(*CAMPAIGN, hour_of("event_ts").alias("hour_ts"), "user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        count_if_type(IMPRESSION).alias("impressions"),
        count_if_type(CLICK).alias("clicks"),
        count_if_type(CONVERSION).alias("conversions"),
        money_sum(_conversion_value()).alias("revenue"),
        F.min(F.when(touch, F.col("event_ts"))).alias("first_touch"),
        F.max(F.when(touch, F.col("event_ts"))).alias("last_touch"),
    )


def add_campaign_user_hours(*tables: DataFrame) -> DataFrame:
    """One table of campaign, user and hour counts out of several."""
    union, *others = tables
    for other in others:
        union = union.unionByName(other)
    return union.groupBy(*CAMPAIGN, "hour_ts", "user_id").agg(
        *[F.sum(c).alias(c) for c in ("total_events", "impressions", "clicks", "conversions")],
        money_sum("revenue").alias("revenue"),
        F.min("first_touch").alias("first_touch"),
        F.max("last_touch").alias("last_touch"),
    )


def performance_from_user_hours(user_hours: DataFrame) -> DataFrame:
    """Hourly KPIs; every input row is one distinct user of its hour."""
    return user_hours.groupBy(*CAMPAIGN, "hour_ts").agg(
        *[F.sum(c).alias(c) for c in ("total_events", "impressions", "clicks", "conversions")],
        money_sum("revenue").alias("revenue"),
        F.count("user_id").alias("unique_users"),
    )


def reach_from_user_hours(user_hours: DataFrame) -> DataFrame:
    """Reach and frequency; every input row with a touch is one active hour."""
    return (
        user_hours.filter(F.col("first_touch").isNotNull())
        .groupBy(*CAMPAIGN, "user_id")
        .agg(
            F.sum(F.col("impressions") + F.col("clicks")).alias("frequency"),
            F.min("first_touch").alias("first_touch"),
            F.max("last_touch").alias("last_touch"),
            F.count(F.lit(1)).alias("active_hours"),
        )
    )


def reach_frequency(events: DataFrame) -> DataFrame:
    """Clicks and impressions per campaign and user."""
    touches = events.filter(F.col("event_type").isin(CLICK, IMPRESSION))
    return touches.groupBy(*CAMPAIGN, "user_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min("event_ts").alias("first_touch"),
        F.max("event_ts").alias("last_touch"),
        F.countDistinct(hour_of("event_ts")).alias("active_hours"),
    )


def kpis(performance: DataFrame) -> DataFrame:
    """Totals and rates over all campaigns.

    `total_reach` counts distinct hourly user counts, as the dashboard does; see
    `reach_users` for people.
    """
    totals = performance.agg(
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("conversions").alias("total_conversions"),
        money_sum("revenue").alias("total_revenue"),
        F.countDistinct("unique_users").alias("total_reach"),
    )
    return totals.withColumns(
        {
            "ctr": ratio("total_clicks", "total_impressions"),
            "conversion_rate": ratio("total_conversions", "total_clicks"),
            "avg_order_value": ratio("total_revenue", "total_conversions"),
        }
    )


def reach_users(events: DataFrame) -> DataFrame:
    """Distinct users over all events."""
    return events.agg(F.countDistinct("user_id").alias("reach_users"))


def campaign_summary(performance: DataFrame) -> DataFrame:
    """Totals and rates per campaign, most revenue first."""
    return (
        performance.groupBy("campaign_name", "channel")
        .agg(
            F.sum("impressions").alias("impressions"),
            F.sum("clicks").alias("clicks"),
            F.sum("conversions").alias("conversions"),
            money_sum("revenue").alias("revenue"),
        )
        .withColumns(
            {"ctr": ratio("clicks", "impressions"), "conv_rate": ratio("conversions", "clicks")}
        )
        .orderBy(F.desc_nulls_last("revenue"), "campaign_name", "channel")
    )


def metrics_json(summary: DataFrame) -> DataFrame:
    """The campaign summary as one JSON document, most revenue first.

    One row per campaign and channel is gathered. Both names come from the campaign
    dimension, so its rows and one for unknown campaigns bound them, whatever the events.
    """
    record = F.struct(
        (-F.col("revenue")).alias("_order"),
        *["campaign_name", "channel", "impressions", "clicks", "conversions", "revenue", "ctr", "conv_rate"],
    )
    ordered = F.sort_array(F.collect_list(record))
    plain = F.transform(ordered, lambda r: r.dropFields("_order"))
    return summary.agg(F.to_json(plain, {"ignoreNullFields": "false"}).alias("metrics"))


def reach_report(reach: DataFrame) -> DataFrame:
    """Reach, mean frequency and frequency histogram per campaign."""
    frequency = F.col("frequency")
    return (
        reach.groupBy("campaign_name", "channel")
        .agg(
            F.countDistinct("user_id").alias("reach"),
            F.avg("frequency").alias("avg_frequency"),
            count_if(frequency == 1).alias("freq_1"),
            count_if(frequency.between(2, 3)).alias("freq_2_3"),
            count_if(frequency.between(4, 5)).alias("freq_4_5"),
            count_if(frequency >= 6).alias("freq_6plus"),
        )
        .orderBy(F.desc("reach"), "campaign_name", "channel")
    )


def hourly_channel_events(performance: DataFrame) -> DataFrame:
    """Rows behind the heatmap, by hour and channel."""
    return performance.select("hour_ts", "channel", "total_events").orderBy("hour_ts", "channel")


def channel_hour_heatmap(performance: DataFrame) -> DataFrame:
    """Events per channel and hour of day (UTC), with intensity in 0..1.

    Intensity is relative to the largest cell. At most 24 rows per channel reach
    the final window.
    """
    cells = (
        performance.filter(F.col("channel").isNotNull())
        .groupBy("channel", F.hour("hour_ts").cast("bigint").alias("hour_of_day"))
        .agg(F.sum("total_events").alias("events"))
    )
    largest = F.max("events").over(Window.partitionBy(F.lit(0)))
    return cells.withColumn("intensity", F.col("events") / F.greatest(largest, F.lit(1)))
