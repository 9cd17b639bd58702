"""Marketing events made from the `events` table.

The mapping gives every event a type and a campaign, and adds stale copies of
some events so that deduplication shows. Campaigns C006 and C007 are unknown to
the dimension. Ids are padded to a minimum width and never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamscore.operators.silver import enrich, unify_events
from streamscore.sources.tables import load_campaigns, read_table

CREATED_AT = "2024-01-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"

# Refreshes of the incremental features: event range and clock.
BATCHES = [
    (None, "2024-01-24 00:00:00", "2024-01-24 00:00:00"),
    ("2024-01-24 00:00:00", "2024-01-30 00:00:00", "2024-01-30 00:00:00"),
    ("2024-01-30 00:00:00", None, "2024-01-31 00:00:00"),
]


def _padded(prefix: str, number: str, width: int) -> Column:
    text = F.col(number).cast("string")
    return F.concat(
        F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))
    )


def _choice(number: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number + 1)


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    events = read_table(spark, "events", sf_dir).select(
        F.col("event_id").alias("n"), "user_id", "event_type", "ts", "value", k.alias("k")
    )
    kind = (
        F.when(F.col("event_type").isin("view", "error"), "IM")
        .when(F.col("event_type") == "click", "CL")
        .when(F.col("event_type") == "signup", "PS")
        .when(F.col("k") < 7, "CN")
        .otherwise("CL")
    )
    return events.select(
        _padded("E", "n", 8).alias("event_id"),
        _padded("U", "user_id", 4).alias("user_id"),
        kind.alias("event_type"),
        F.concat(F.lit("C00"), (F.col("k") % 7 + 1).cast("string")).alias("campaign_id"),
        F.col("ts").alias("event_ts"),
        "value",
        "n",
        "k",
    )


def _with_copies(base: DataFrame, copied: Column) -> DataFrame:
    """Every row, and a second, older one of some rows, in one scan."""
    ages = F.when(copied, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("age", F.explode(ages))


def raw_marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_events(spark, sf_dir).filter(F.col("event_type") != "CN")
    device = _choice(F.col("k") % 3, ["mobile", "desktop", "tablet"])
    channel = _choice(F.col("k") % 5, ["search", "social", "display", "video", "email"])
    return _with_copies(base, F.col("n") % 10 == 0).select(
        "event_id",
        "user_id",
        "event_type",
        "campaign_id",
        (F.col("event_ts") - F.make_dt_interval(mins="age")).alias("event_ts"),
        F.to_json(F.struct(channel.alias("channel"), device.alias("device"))).alias("properties"),
        "n",
    )


def raw_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_events(spark, sf_dir).filter(F.col("event_type") == "CN")
    order_type = _choice(F.col("k") % 2, ["new", "repeat"])
    return _with_copies(base, F.col("n") % 5 == 0).select(
        "event_id",
        "user_id",
        "event_type",
        "campaign_id",
        (F.col("event_ts") - F.make_dt_interval(hours="age")).alias("event_ts"),
        (F.col("value") + F.col("age")).alias("conversion_value"),
        F.to_json(F.struct(order_type.alias("order_type"))).alias("properties"),
        "n",
    )


def campaigns(spark: SparkSession) -> DataFrame:
    return load_campaigns(spark, created_at=CREATED_AT)


def unified(spark: SparkSession, sf_dir: str, scope: str = "all") -> DataFrame:
    return unify_events(raw_marketing(spark, sf_dir), raw_conversions(spark, sf_dir), scope)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(unified(spark, sf_dir), campaigns(spark))


def batch_of(events: DataFrame, batch: int) -> DataFrame:
    """Events of one refresh."""
    start, end, _ = BATCHES[batch]
    if start is not None:
        events = events.filter(F.col("event_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.filter(F.col("event_ts") < F.lit(end).cast("timestamp_ntz"))
    return events


def json_marketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketing events as flat JSON text."""
    return _as_json(raw_marketing(spark, sf_dir), [])


def json_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion events as flat JSON text."""
    return _as_json(raw_conversions(spark, sf_dir), ["conversion_value"])


def _as_json(raw: DataFrame, extra: list[str]) -> DataFrame:
    payload = F.struct(
        "event_id",
        "user_id",
        "event_type",
        "campaign_id",
        F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_ts"),
        *extra,
        F.parse_json("properties").alias("properties"),
    )
    return raw.select(F.to_json(payload).alias("value"), "n", "event_ts")


def envelopes(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    """Topic messages; some payloads are broken in known ways."""
    make = {"marketing_events": json_marketing, "conversion_events": json_conversions}[topic]
    n = F.col("n")
    text = (
        F.when(n % 50 == 0, F.regexp_replace("value", '"event_ts":"[^"]*"', '"event_ts":"soon"'))
        .when(n % 75 == 1, F.regexp_replace("value", '"event_id":"[^"]*",', ""))
        .when(n % 90 == 2, F.lit("not json"))
        .otherwise(F.col("value"))
    )
    envelope = F.struct(
        text.alias("data"),
        F.struct(
            F.lit(topic).alias("topic"),
            (n % 4).cast("int").alias("partition"),
            n.alias("offset"),
            F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        ).alias("metadata"),
    )
    return make(spark, sf_dir).select(F.to_json(envelope).alias("value"))
