"""JSON events into typed raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamscore.functions.scalar import ntz
from streamscore.schemas import CONVERSION_JSON, ENVELOPE_JSON, MARKETING_JSON

REQUIRED = ["event_id", "user_id", "event_type", "event_ts"]


def _parse(json_rows: DataFrame, schema: str, value_column: bool) -> DataFrame:
    """Typed fields plus `_error`, the first thing wrong with the record."""
    passed = [F.col(c) for c in json_rows.columns if c != "value"]
    event_ts = F.col("r.event_ts").try_cast("timestamp_ntz")
    amount = F.col("r.conversion_value").try_cast("double") if value_column else None

    checks: list[tuple[Column, str]] = [
        (F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "not a JSON object")
    ]
    checks += [(F.col(f"r.{c}").isNull(), f"missing {c}") for c in REQUIRED]
    checks.append((event_ts.isNull(), "bad event_ts"))
    if value_column:
        checks.append(
            (F.col("r.conversion_value").isNotNull() & amount.isNull(), "bad conversion_value")
        )
    error = F.coalesce(*[F.when(broken, F.lit(text)) for broken, text in checks])

    fields = [
        F.col("r.event_id").alias("event_id"),
        F.col("r.user_id").alias("user_id"),
        F.col("r.event_type").alias("event_type"),
        F.col("r.campaign_id").alias("campaign_id"),
        event_ts.alias("event_ts"),
    ]
    if value_column:
        fields.append(amount.alias("conversion_value"))
    # The generator keeps filters on the result from repeating the parse per field.
    record = F.explode(F.array(F.from_json("value", schema)))
    return json_rows.withColumn("r", record).select(
        *passed, *fields, F.col("r.properties").alias("properties"), error.alias("_error"), "value"
    )


def parse_marketing(json_rows: DataFrame) -> DataFrame:
    """Marketing events out of flat JSON text in column `value`.

    Other columns pass through. Use `split_valid` to part good rows from bad.
    """
    return _parse(json_rows, MARKETING_JSON, value_column=False)


def parse_conversion(json_rows: DataFrame) -> DataFrame:
    """Conversion events, which also carry a value."""
    return _parse(json_rows, CONVERSION_JSON, value_column=True)


def unwrap_envelope(messages: DataFrame) -> DataFrame:
    """Payload text of topic messages `{data, metadata}` held in column `value`."""
    parsed = messages.select(F.explode(F.array(F.from_json("value", ENVELOPE_JSON))).alias("m"))
    return parsed.select(
        F.col("m.data").alias("value"),
        F.col("m.metadata.topic").alias("topic"),
        F.col("m.metadata.partition").alias("partition"),
        F.col("m.metadata.offset").alias("offset"),
        F.col("m.metadata.timestamp").try_cast("timestamp_ntz").alias("timestamp"),
    )


def start_from(messages: DataFrame, offset: int | None = None, timestamp=None) -> DataFrame:
    """Messages at or after a position; without one, everything retained.

    This is the file-source counterpart of a topic's starting position. With a
    message broker use the source's own `startingOffsets`.
    """
    if offset is not None:
        messages = messages.filter(F.col("offset") >= offset)
    if timestamp is not None:
        messages = messages.filter(F.col("timestamp") >= ntz(timestamp))
    return messages


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the raw table, and the rest with their text and error."""
    valid = parsed.filter(F.col("_error").isNull()).drop("_error", "value")
    return valid, parsed.filter(F.col("_error").isNotNull())


def with_ingest_time(rows: DataFrame, ts=None) -> DataFrame:
    """Add `_ingested_at`; by default the time the query runs."""
    moment = F.localtimestamp() if ts is None else ntz(ts)
    return rows.withColumn("_ingested_at", moment)


def extract_properties(rows: DataFrame) -> DataFrame:
    """Channel, device and order type out of the semi-structured properties.

    Properties are JSON text, or a VARIANT as some raw tables keep them.
    """
    names = ("channel", "device", "order_type")
    if dict(rows.dtypes)["properties"] == "variant":
        fields = {n: F.try_variant_get("properties", f"$.{n}", "string") for n in names}
    else:
        fields = {n: F.get_json_object("properties", f"$.{n}") for n in names}
    return rows.withColumns(fields).drop("properties")


def ingest_health(parsed: DataFrame) -> DataFrame:
    """Last offset, good and bad rows, and the newest error, per partition.

    Counts come from a hash aggregate over all rows; only bad ones are ranked for the
    newest error.
    """
    bad = F.col("_error").isNotNull()
    keys = ["topic", "partition"]
    counts = parsed.groupBy(*keys).agg(
        F.max("offset").alias("committed_offset"),
        F.sum(F.when(bad, 0).otherwise(1)).alias("rows_inserted"),
        F.sum(F.when(bad, 1).otherwise(0)).alias("rows_error"),
    )
    newest = Window.partitionBy(*keys).orderBy(F.desc("offset"), F.desc("_error"))
    errors = (
        parsed.filter(bad)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .select(*keys, F.col("_error").alias("last_error"))
    )
    c, e = counts.alias("c"), errors.alias("e")
    same = F.col("c.topic").eqNullSafe(F.col("e.topic")) & F.col("c.partition").eqNullSafe(
        F.col("e.partition")
    )
    return c.join(e, same, "left").select("c.*", "e.last_error")
