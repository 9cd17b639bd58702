import json

from pyspark.sql import functions as F

from conftest import moment
from streamscore.sources import ingest

GOOD = {
    "event_id": "e1",
    "user_id": "U1",
    "event_type": "CN",
    "campaign_id": "CAMP_001",
    "event_ts": "2024-01-01 10:00:00.123456",
    "conversion_value": 12.5,
    "properties": {"order_type": "new"},
}


def texts(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows], "value string")


def test_fields_are_typed(spark):
    row = ingest.extract_properties(ingest.parse_conversion(texts(spark, [GOOD]))).first()
    assert row["event_ts"] == moment("2024-01-01 10:00:00.123456")
    assert row["conversion_value"] == 12.5
    assert (row["order_type"], row["device"], row["_error"]) == ("new", None, None)


def test_bad_rows_go_to_quarantine_with_their_text(spark):
    rows = [
        GOOD,
        {**GOOD, "event_ts": "yesterday"},
        {k: v for k, v in GOOD.items() if k != "event_id"},
        {**GOOD, "user_id": None},
        {**GOOD, "conversion_value": "lots"},
        "not json",
        "[1, 2]",
        None,
    ]
    valid, bad = ingest.split_valid(ingest.parse_conversion(texts(spark, rows)))
    assert valid.count() == 1 and "value" not in valid.columns
    assert sorted(r["_error"] for r in bad.collect()) == sorted([
        "bad event_ts",
        "missing event_id",
        "missing user_id",
        "bad conversion_value",
        "not a JSON object",
        "not a JSON object",
        "not a JSON object",
    ])
    assert bad.filter(F.col("value") == "not json").count() == 1


def test_campaign_and_value_may_be_missing(spark):
    row = {k: v for k, v in GOOD.items() if k not in ("campaign_id", "conversion_value", "properties")}
    valid, _ = ingest.split_valid(ingest.parse_conversion(texts(spark, [row])))
    got = valid.first()
    assert got["campaign_id"] is None and got["conversion_value"] is None


def envelope(offset, payload, ts="2024-01-01 10:00:00"):
    return {
        "data": payload if isinstance(payload, str) else json.dumps(payload),
        "metadata": {"topic": "t", "partition": 0, "offset": offset, "timestamp": ts},
    }


def test_payload_is_read_from_data_not_from_the_top(spark):
    wrapped = ingest.unwrap_envelope(texts(spark, [{**envelope(3, GOOD), "event_id": "top"}]))
    row = ingest.parse_conversion(wrapped).first()
    assert (row["event_id"], row["topic"], row["offset"]) == ("e1", "t", 3)


def test_start_position(spark):
    messages = ingest.unwrap_envelope(
        texts(spark, [envelope(i, GOOD, f"2024-01-01 1{i}:00:00") for i in range(4)])
    )
    assert ingest.start_from(messages).count() == 4
    assert ingest.start_from(messages, offset=2).count() == 2
    assert ingest.start_from(messages, timestamp="2024-01-01 13:00:00").count() == 1


def test_health_tells_last_offset_counts_and_newest_error(spark):
    rows = [envelope(0, GOOD), envelope(1, "junk"), envelope(2, {**GOOD, "event_ts": "x"}), envelope(3, GOOD)]
    parsed = ingest.parse_conversion(ingest.unwrap_envelope(texts(spark, rows)))
    row = ingest.ingest_health(parsed).first()
    assert (row["committed_offset"], row["rows_inserted"], row["rows_error"]) == (3, 2, 2)
    assert row["last_error"] == "bad event_ts"


def test_record_is_parsed_once(spark):
    valid, _ = ingest.split_valid(ingest.parse_conversion(texts(spark, [GOOD])))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_ingest_time(spark):
    rows = ingest.with_ingest_time(texts(spark, [GOOD]), "2024-01-02 00:00:00")
    assert rows.first()["_ingested_at"] == moment("2024-01-02 00:00:00")
