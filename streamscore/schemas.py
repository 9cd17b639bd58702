"""Table schemas and the fixed codes used in them."""

from __future__ import annotations

from pyspark.sql import types as T

# Event type codes and their display names.
CLICK = "CL"
IMPRESSION = "IM"
PAID_SEARCH = "PS"
CONVERSION = "CN"
EVENT_LABELS = {
    "CL": "Click",
    "IM": "Impression",
    "PS": "Paid Search",
    "CN": "Conversion",
}

# The campaign dimension (id, name, channel, advertiser).
CAMPAIGNS = [
    ("C001", "Spring Sale Display", "display", "Acme Corp"),
    ("C002", "Brand Search", "search", "Acme Corp"),
    ("C003", "Retargeting Social", "social", "Acme Corp"),
    ("C004", "Email Nurture", "email", "Acme Corp"),
    ("C005", "Video Pre-roll", "display", "Acme Corp"),
]

CAMPAIGN_COLUMNS = ["campaign_id", "campaign_name", "channel", "advertiser", "created_at"]

EVENT_COLUMNS = [
    "event_id",
    "user_id",
    "event_type",
    "campaign_id",
    "event_ts",
    "conversion_value",
]

# Payload fields as they arrive in JSON. Scalars stay text so that a bad value is
# reported for its own field instead of voiding the whole record; so do properties,
# which only `extract_properties` looks into.
MARKETING_JSON = (
    "event_id string, user_id string, event_type string, campaign_id string, "
    "event_ts string, properties string, _corrupt_record string"
)
CONVERSION_JSON = (
    "event_id string, user_id string, event_type string, campaign_id string, "
    "event_ts string, conversion_value string, properties string, _corrupt_record string"
)
ENVELOPE_JSON = (
    "data string, metadata struct<topic: string, partition: int, "
    "offset: bigint, timestamp: string>"
)

ENRICHED = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("campaign_name", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("conversion_value", T.DoubleType()),
    ]
)

UNIFIED = T.StructType([ENRICHED[name] for name in EVENT_COLUMNS])

USER_FEATURES = T.StructType(
    [T.StructField("user_id", T.StringType())]
    + [
        T.StructField(f"{kind}_{span}", T.LongType())
        for kind in ("clicks", "impressions", "paid_search")
        for span in ("1h", "24h", "7d")
    ]
    + [
        T.StructField("conversions_total", T.LongType()),
        T.StructField("last_conversion_ts", T.TimestampNTZType()),
        T.StructField("time_since_last_conversion_hrs", T.DoubleType()),
        T.StructField("event_velocity_24h", T.DoubleType()),
        T.StructField("last_updated", T.TimestampNTZType()),
    ]
)
