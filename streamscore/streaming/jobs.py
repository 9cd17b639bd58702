"""Running streams, and tables kept up to date by them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from streamscore.operators.features import rolling_user_features
from streamscore.operators.scoring import propensity_scores
from streamscore.operators.silver import dedup_latest, enrich, newest_first
from streamscore.schemas import UNIFIED
from streamscore.sources.increments import IncrementTable
from streamscore.sources.ingest import parse_conversion, parse_marketing, unwrap_envelope
from streamscore.sources.tables import latest_per_key, publish

DAY = "yyyyMMdd"
# Hours of events that scores are made of.
SCORED_HOURS = 168

# Batches that readers of a stream table combine at most, unless a job says otherwise.
COMPACT_EVERY = 32


def run(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a job: at a fixed interval, or once over all that is new, to its end."""
    writer = writer.option("checkpointLocation", checkpoint)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rates(query: StreamingQuery) -> dict[str, float]:
    """Rows per second of the last micro-batch and rows dropped as late."""
    last = query.lastProgress
    if last is None:
        return {}
    dropped = sum(op["numRowsDroppedByWatermark"] for op in last["stateOperators"])
    return {
        "batch_id": last["batchId"],
        "rows": last["numInputRows"],
        "input_rows_per_second": last["inputRowsPerSecond"],
        "processed_rows_per_second": last["processedRowsPerSecond"],
        "late_rows_dropped": dropped,
    }


def maintain(
    source: DataFrame,
    table: IncrementTable,
    prepare: Callable[[DataFrame, int], DataFrame],
    checkpoint: str,
    every: str | None = None,
    mode: str = "append",
    compact_every: int | None = COMPACT_EVERY,
) -> StreamingQuery:
    """Append what `prepare` makes of every micro-batch to a table.

    A batch writes no more than its own aggregated rows; one that is run again
    replaces them. The table is compacted after every `compact_every` batches.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        table.write(prepare(batch, batch_id), batch_id)
        if compact_every and len(table.batches()) >= compact_every:
            table.compact()

    return run(source.writeStream.outputMode(mode).foreachBatch(on_batch), checkpoint, every)


def backfill_then_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    table: IncrementTable,
    prepare: Callable[[DataFrame, int], DataFrame],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Fill a table from the files in `path` in one go, then follow new files.

    The backfill is the first micro-batch of the job itself, over all files that are there.
    So the hand-over is the source's own log in the checkpoint: a batch after the backfill
    opens new files only, and nothing is listed or joined to leave the old ones out. When an
    event happened plays no part, so late ones count whichever way they come. A job that has
    a checkpoint goes on where it stopped.
    """
    files = spark.readStream.schema(schema).parquet(path)
    filled = maintain(files, table, prepare, checkpoint)
    return filled if every is None else maintain(files, table, prepare, checkpoint, every)


def stream_ingest(
    messages: DataFrame, topic: str, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Topic messages into a raw table; bad ones land beside it, see `read_landed`.

    `messages` are envelopes in column `value`, or rows that carry topic and
    offset already, as from `read_topic`. Every micro-batch owns one folder and
    overwrites it when it is run again.
    """
    enveloped = "offset" not in messages.columns
    parse = {"marketing_events": parse_marketing, "conversion_events": parse_conversion}[topic]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        parsed = parse(unwrap_envelope(batch) if enveloped else batch)
        bad = F.col("_error").isNotNull()
        (
            parsed.withColumn("_state", F.when(bad, "quarantine").otherwise("valid"))
            .withColumn("value", F.when(bad, F.col("value")))
            .write.mode("overwrite")
            .partitionBy("_state")
            .parquet(f"{out}/batch={batch_id}")
        )

    return run(messages.writeStream.foreachBatch(on_batch), checkpoint, every)


def read_landed(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows and quarantine that `stream_ingest` wrote; each reads its own files."""
    landed = spark.read.parquet(out)
    valid = landed.filter(F.col("_state") == "valid").drop("_error", "value")
    bad = landed.filter(F.col("_state") == "quarantine")
    return valid.drop("_state", "batch"), bad.drop("_state", "batch")


def stream_enrich(
    events: DataFrame, campaigns: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append enriched events; later changes of a campaign leave old rows alone."""
    writer = enrich(events, campaigns).writeStream.outputMode("append").format("parquet")
    return run(writer.option("path", out), checkpoint, every)


def arrivals_table(spark: SparkSession, path: str) -> IncrementTable:
    """Events as they arrived, read as the first arrival of every event_id."""
    arrived = T.StructType([*UNIFIED.fields, T.StructField("arrival", T.LongType())])
    return IncrementTable(spark, path, arrived, combine=_first_arrivals)


def _first_arrivals(rows: DataFrame) -> DataFrame:
    """One row per event_id: of its first batch, and there the newest copy."""
    order = Window.partitionBy("event_id").orderBy("arrival", *newest_first())
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def stream_dedup(
    events: DataFrame, table: IncrementTable, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep the first arrival of every event, however far apart its copies come.

    Nothing is dropped for being late: copies are removed within a batch, and again
    when the table is read or compacted.
    """
    return maintain(
        events,
        table,
        prepare=lambda batch, i: dedup_latest(batch).withColumn("arrival", F.lit(i).cast("bigint")),
        checkpoint=checkpoint,
        every=every,
    )


def unified_table(spark: SparkSession, path: str) -> IncrementTable:
    """Newest copies of events, in folders by the day of the event."""
    day = F.date_format("event_ts", DAY)
    return IncrementTable(spark, path, UNIFIED, combine=dedup_latest, part=day)


def stream_unify(
    events: DataFrame, table: IncrementTable, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep the newest copy of every event, however late it comes."""
    return maintain(
        events, table, prepare=lambda batch, _: dedup_latest(batch), checkpoint=checkpoint, every=every
    )


def latest_table(
    spark: SparkSession, path: str, schema: T.StructType, key: str, ts: str
) -> IncrementTable:
    return IncrementTable(
        spark, path, schema, combine=lambda rows: latest_per_key(rows.drop("_batch"), key, ts)
    )


def stream_latest(
    rows: DataFrame,
    key: str,
    ts: str,
    table: IncrementTable,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Online snapshot: the newest row of every key."""
    return maintain(
        rows,
        table,
        prepare=lambda batch, _: latest_per_key(batch, key, ts),
        checkpoint=checkpoint,
        every=every,
    )


def stream_pipeline(
    events: DataFrame,
    unified: IncrementTable,
    campaigns: DataFrame,
    serving: str,
    clock: Callable[[int], datetime | str],
    checkpoint: str,
    every: str | None = None,
    score: Callable[[DataFrame, datetime | str], DataFrame] = propensity_scores,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Raw events to served scores in one job, refreshed by every micro-batch.

    New copies are appended to the unified events; events of the last seven days are
    enriched and aggregated into features, `score` scores them (the fixed scorer, or a
    registered model), and the scores replace the served ones without a gap for
    readers. A batch that is run again ends in the same scores.

    `unified` is cut by day, and a micro-batch opens the days that the last seven days
    touch and later ones: a copy is only ever replaced by one with a later time, which
    lies in these days, too. So what a batch reads does not grow with the history.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        as_of = clock(batch_id)
        unified.write(dedup_latest(batch), batch_id)
        recent = unified.read(since=first_day(as_of, SCORED_HOURS))
        features = rolling_user_features(enrich(recent, campaigns), as_of)
        publish(score(features, as_of), ["score_bucket", "user_id"], serving, batch_id)
        if len(unified.batches()) >= compact_every:
            unified.compact()

    return run(events.writeStream.foreachBatch(on_batch), checkpoint, every)


def first_day(as_of: datetime | str, hours: int) -> str:
    """The day folder in which a horizon starts."""
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return (moment - timedelta(hours=hours)).strftime("%Y%m%d")
