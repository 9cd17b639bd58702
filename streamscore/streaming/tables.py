"""Feature, campaign and journey tables maintained by streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from streamscore.functions.scalar import hour_of, hours_before, money, money_sum, ntz
from streamscore.operators.attribution import (
    add_journey_channels,
    decay_cells,
    journey_channels,
)
from streamscore.operators.campaigns import (
    add_campaign_user_hours,
    campaign_user_hours,
)
from streamscore.operators.features import (
    feature_delta,
    merge_user_features,
    window_measures,
)
from streamscore.schemas import ENRICHED, USER_FEATURES
from streamscore.sources.increments import IncrementTable
from streamscore.sources.storage import empty
from streamscore.streaming.jobs import COMPACT_EVERY, maintain, run

# How a time-partitioned table is cut: in Spark's notation and in Python's.
PART_FORMATS = {
    "hour": ("yyyyMMddHH", "%Y%m%d%H"),
    "day": ("yyyyMMdd", "%Y%m%d"),
    "month": ("yyyyMM", "%Y%m"),
}

# Resolutions of tiles, fine to coarse, and the folders their tables are cut into.
RESOLUTIONS = {"minute": "day", "hour": "day", "day": "month"}
FEATURE_HOURS = (1, 24, 168)
ONLINE_HOURS = (1, 24, 48)

TILES = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("tile", T.TimestampNTZType()),
        T.StructField("events", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("latest_ts", T.TimestampNTZType()),
    ]
)

_CAMPAIGN_KEYS = [ENRICHED[c] for c in ("campaign_id", "campaign_name", "channel")]
_HOUR = T.StructField("hour_ts", T.TimestampNTZType())
_COUNTS = [
    T.StructField(c, T.LongType()) for c in ("total_events", "impressions", "clicks", "conversions")
] + [T.StructField("revenue", T.DoubleType())]

USER_HOURS = T.StructType(
    _CAMPAIGN_KEYS
    + [_HOUR, ENRICHED["user_id"]]
    + _COUNTS
    + [T.StructField(c, T.TimestampNTZType()) for c in ("first_touch", "last_touch")]
)
_POSITION = T.StructType([ENRICHED["event_ts"], ENRICHED["event_id"]])
JOURNEY_CHANNELS = T.StructType(
    [
        ENRICHED["user_id"],
        ENRICHED["channel"],
        T.StructField("touches", T.LongType()),
        T.StructField("conversions", T.LongType()),
        T.StructField("value", T.DecimalType(38, 10)),
    ]
    + [
        T.StructField(c, _POSITION)
        for c in ("first_any", "last_any", "first_marketing", "last_marketing")
    ]
)

DECAY_CELLS = T.StructType(
    [ENRICHED["user_id"], _HOUR, ENRICHED["channel"]]
    + [T.StructField(c, T.LongType()) for c in ("touches", "conversions")]
    + [T.StructField("value", T.DecimalType(38, 10)), T.StructField("weight", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("last", "cell_touches")]
)


def user_features_table(
    spark: SparkSession, path: str, clock: Callable[[int], datetime | str]
) -> IncrementTable:
    """User features; `clock` gives the refresh time of a batch id.

    The merge depends on the order of batches, so the increments since the last
    compaction are merged one after the other.
    """
    return IncrementTable(
        spark,
        path,
        USER_FEATURES,
        follow=lambda state, delta, i: merge_user_features(state, delta, clock(i)),
        increment=feature_delta(empty(spark, ENRICHED), "1970-01-01 00:00:00").schema,
        key=["user_id"],
    )


def stream_user_features(
    events: DataFrame,
    table: IncrementTable,
    clock: Callable[[int], datetime | str],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Merge the events of every micro-batch into the user features.

    Late events count whenever they arrive.
    """
    return maintain(
        events,
        table,
        prepare=lambda batch, i: feature_delta(batch, clock(i)),
        checkpoint=checkpoint,
        every=every,
        compact_every=8,
    )


def _time_part(column: str, part: str):
    return F.date_format(column, PART_FORMATS[part][0])


def tiles_table(
    spark: SparkSession, path: str, part: str = "day", late: str = "accept"
) -> IncrementTable:
    """Tiles in folders by day or hour; see `stream_feature_tiles` for `late`."""
    combine = add_tiles if late == "accept" else newest_tiles
    return IncrementTable(spark, path, TILES, combine=combine, part=_time_part("tile", part))


def feature_tiles(events: DataFrame) -> DataFrame:
    """One-minute totals per user and event type."""
    tile = F.window("event_ts", "1 minute")["start"].cast("timestamp_ntz")
    return events.groupBy("user_id", "event_type", tile.alias("tile")).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(money("conversion_value")).cast("double").alias("value"),
        F.max("event_ts").alias("latest_ts"),
    )


def add_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles that batches counted apart, added up."""
    return tiles.groupBy("user_id", "event_type", "tile").agg(
        F.sum("events").alias("events"),
        money_sum("value").alias("value"),
        F.max("latest_ts").alias("latest_ts"),
    )


def newest_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles of which every batch wrote the total so far."""
    order = Window.partitionBy("user_id", "event_type", "tile").orderBy(F.desc("_batch"))
    ranked = tiles.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1)


def stream_feature_tiles(
    events: DataFrame,
    table: IncrementTable,
    checkpoint: str,
    every: str | None = None,
    late: str = "accept",
    delay: str = "1 hour",
) -> StreamingQuery:
    """Keep one-minute tiles from which all horizons are summed.

    With `late="accept"` late events are added whenever they come. With "drop"
    Spark keeps the open tiles as state, and events more than `delay` behind are
    left out and counted in the query's progress.
    """
    if late == "accept":
        return maintain(
            events,
            table,
            prepare=lambda batch, _: feature_tiles(batch),
            checkpoint=checkpoint,
            every=every,
        )
    if late != "drop":
        raise ValueError(f"late must be 'accept' or 'drop', not {late!r}")
    open_tiles = (
        events.withColumn("event_ts", F.col("event_ts").cast("timestamp"))
        .withWatermark("event_ts", delay)
        .groupBy("user_id", "event_type", F.window("event_ts", "1 minute").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(money("conversion_value")).cast("double").alias("value"),
            F.max("event_ts").alias("latest_ts"),
        )
        .select(
            "user_id",
            "event_type",
            F.col("w.start").cast("timestamp_ntz").alias("tile"),
            "events",
            "value",
            F.col("latest_ts").cast("timestamp_ntz").alias("latest_ts"),
        )
    )
    return maintain(
        open_tiles,
        table,
        prepare=lambda batch, _: batch,
        checkpoint=checkpoint,
        every=every,
        mode="update",
    )


def tile_parts(as_of: datetime, hours: int, part: str = "hour") -> list[str]:
    """Parts of the tile table that a horizon reaches."""
    moments = [as_of - timedelta(hours=h) for h in range(hours + 1)]
    return sorted({m.strftime(PART_FORMATS[part][1]) for m in moments})


def _inside(tiles: DataFrame, as_of, hours: int) -> DataFrame:
    tile = F.col("tile")
    return tiles.filter((tile >= hours_before(as_of, hours)) & (tile < ntz(as_of)))


def features_from_tiles(tiles: DataFrame, as_of) -> DataFrame:
    """Windowed features out of tiles; exact when `as_of` is a whole minute.

    The interval is [as_of - horizon, as_of).
    """
    return (
        _inside(tiles, as_of, 168)
        .groupBy("user_id")
        .agg(
            *window_measures(
                lambda hours: F.col("tile") >= hours_before(as_of, hours),
                F.col("event_type"),
                F.col("events"),
            )
        )
    )


def online_from_tiles(tiles: DataFrame, as_of) -> DataFrame:
    """Online features out of tiles."""
    tile = F.col("tile")
    return _online(_inside(tiles, as_of, 48), lambda hours: tile >= hours_before(as_of, hours))


def _online(tiles: DataFrame, within: Callable[[int], Column]) -> DataFrame:
    return tiles.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(within(1), F.col("events"))), F.lit(0)).alias("events_1h"),
        F.coalesce(F.sum(F.when(within(24), F.col("events"))), F.lit(0)).alias("events_24h"),
        F.sum(F.when(within(24), money("value"))).cast("double").alias("conversion_value_24h"),
        F.max(F.when(within(48), F.col("latest_ts"))).alias("latest_event_48h"),
    )


def tile_levels(spark: SparkSession, path: str) -> dict[str, IncrementTable]:
    """Tables of minute, hour and day tiles."""
    return {
        unit: tiles_table(spark, f"{path.rstrip('/')}/{unit}", part)
        for unit, part in RESOLUTIONS.items()
    }


def coarser_tiles(tiles: DataFrame, unit: str) -> DataFrame:
    """Tiles added up to hours or days."""
    start = F.date_trunc(unit, F.col("tile")).cast("timestamp_ntz")
    return add_tiles(tiles.withColumn("tile", start))


def stream_tile_levels(
    events: DataFrame,
    levels: dict[str, IncrementTable],
    checkpoint: str,
    every: str | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Keep tiles in all resolutions; late events are added whenever they come.

    A micro-batch reads its events once and rolls its own tiles up, so hours and days are
    increments as minutes are. A batch that is run again replaces its tiles.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        levels["minute"].write(feature_tiles(batch), batch_id)
        levels["hour"].write(coarser_tiles(levels["minute"].rows_of(batch_id), "hour"), batch_id)
        levels["day"].write(coarser_tiles(levels["hour"].rows_of(batch_id), "day"), batch_id)
        for table in levels.values():
            if len(table.batches()) >= compact_every:
                table.compact()

    return run(events.writeStream.foreachBatch(on_batch), checkpoint, every)


def horizon_cover(as_of: datetime | str, hours: int) -> list[tuple[str, datetime, datetime]]:
    """Whole tiles that make up [as_of - hours, as_of), as (resolution, from, to).

    Minutes lead from the start to a full hour, hours to a midnight, days to the last one,
    and then back down: for seven days 60 minutes, 24 hours and 7 days at most.
    """
    end = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    if end.second or end.microsecond:
        raise ValueError("tiles are exact at whole minutes only")
    start = end - timedelta(hours=hours)
    units = [("minute", timedelta(minutes=1)), ("hour", timedelta(hours=1)), ("day", timedelta(days=1))]
    zero, low, high, out = datetime(1970, 1, 1), start, end, []
    for (unit, _), (_, next_step) in zip(units, units[1:]):
        up = low + (zero - low) % next_step  # the next and the last full step of the coarser unit
        down = high - (high - zero) % next_step
        if up > down:
            break
        out += [(unit, a, b) for a, b in ((low, up), (down, high)) if a < b]
        low, high = up, down
    else:
        unit = "day"
    return sorted(out + ([(unit, low, high)] if low < high else []), key=lambda x: x[1])


def _covered(cover: list[tuple[str, datetime, datetime]], unit: Column) -> Column:
    tile = F.col("tile")
    inside = F.lit(False)
    for name, low, high in cover:
        inside |= (unit == name) & (tile >= ntz(low)) & (tile < ntz(high))
    return inside


def _levels_for(
    levels: dict[str, IncrementTable], as_of: datetime | str, horizons: tuple[int, ...]
) -> tuple[DataFrame, Callable[[int], Column]]:
    """Tiles of all resolutions that some horizons need, and the condition of each horizon."""
    covers = {hours: horizon_cover(as_of, hours) for hours in horizons}
    rows = None
    for unit, part in RESOLUTIONS.items():
        spans = [(low, high) for cover in covers.values() for u, low, high in cover if u == unit]
        parts = set()
        for low, high in spans:
            while low < high:
                parts.add(low.strftime(PART_FORMATS[part][1]))
                low += timedelta(hours=1 if unit != "day" else 24)
            parts.add((high - timedelta(minutes=1)).strftime(PART_FORMATS[part][1]))
        own = levels[unit].read(parts=sorted(parts)) if parts else empty(levels[unit].spark, TILES)
        own = own.withColumn("_unit", F.lit(unit))
        rows = own if rows is None else rows.unionByName(own)
    within = lambda hours: _covered(covers[hours], F.col("_unit"))
    wanted = F.lit(False)
    for hours in horizons:
        wanted |= within(hours)
    return rows.filter(wanted), within


def features_from_levels(levels: dict[str, IncrementTable], as_of: datetime | str) -> DataFrame:
    """Windowed features out of tiles of several resolutions, exact at whole minutes.

    A user and event type has at most 91 tiles in a horizon, whatever the number of events.
    """
    rows, within = _levels_for(levels, as_of, FEATURE_HOURS)
    return rows.groupBy("user_id").agg(
        *window_measures(within, F.col("event_type"), F.col("events"))
    )


def online_from_levels(levels: dict[str, IncrementTable], as_of: datetime | str) -> DataFrame:
    """Online features out of tiles of several resolutions, exact at whole minutes."""
    return _online(*_levels_for(levels, as_of, ONLINE_HOURS))


def user_hours_table(spark: SparkSession, path: str, part: str = "day") -> IncrementTable:
    """Counts per campaign, user and hour, from which KPIs and reach are read."""
    return IncrementTable(
        spark,
        path,
        USER_HOURS,
        combine=lambda rows: add_campaign_user_hours(rows.drop("_batch")),
        part=_time_part("hour_ts", part),
    )


def stream_campaign_performance(
    events: DataFrame, user_hours: IncrementTable, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep the counts that hourly KPIs are made of.

    The counts per user and hour make the distinct users exact without state of
    its own; `performance_from_user_hours` and `reach_from_user_hours` read them.
    """
    return maintain(
        events,
        user_hours,
        prepare=lambda batch, _: campaign_user_hours(batch),
        checkpoint=checkpoint,
        every=every,
    )


def journey_channels_table(spark: SparkSession, path: str) -> IncrementTable:
    return IncrementTable(
        spark,
        path,
        JOURNEY_CHANNELS,
        combine=lambda rows: add_journey_channels(rows.drop("_batch")),
    )


def stream_journeys(
    events: DataFrame, table: IncrementTable, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep what first, last and linear credit need, per user and channel."""
    return maintain(
        events,
        table,
        prepare=lambda batch, _: journey_channels(batch),
        checkpoint=checkpoint,
        every=every,
    )


def touches_table(spark: SparkSession, path: str, part: str = "day") -> IncrementTable:
    """Enriched events by day, as they came."""
    return IncrementTable(
        spark,
        path,
        ENRICHED,
        combine=lambda rows: rows.drop("_batch"),
        part=_time_part("event_ts", part),
    )


def decay_cells_table(spark: SparkSession, path: str, part: str = "day") -> IncrementTable:
    """Cells of `decay_cells`, of which the newest per user and hour count."""
    return IncrementTable(
        spark, path, DECAY_CELLS, combine=_newest_cells, part=_time_part("hour_ts", part)
    )


def _newest_cells(rows: DataFrame) -> DataFrame:
    newest = F.max("_batch").over(Window.partitionBy("user_id", "hour_ts"))
    return rows.withColumn("_newest", newest).filter(F.col("_batch") == F.col("_newest"))


def stream_time_decay(
    events: DataFrame,
    touches: IncrementTable,
    cells: IncrementTable,
    checkpoint: str,
    every: str | None = None,
    decay: float = 0.5,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Keep journeys and the cells that time decay is made of; late events count.

    A micro-batch stores its touches, and then makes the cells of the users and hours it
    touched anew out of all touches of these hours. It reads the days that its events lie
    in and nothing before or after them. `credit_from_cells` and `touchpoints_from_cells`
    read the result. `touches` and `cells` must be cut by day. A batch that is run again
    ends in the same rows.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        touches.write(batch, batch_id)
        new = touches.rows_of(batch_id).select(
            "user_id", hour_of("event_ts").alias("hour_ts"), _time_part("event_ts", "day").alias("day")
        )
        days = [r["day"] for r in new.select("day").distinct().collect()]  # calendar days
        touched = new.select("user_id", "hour_ts").distinct()
        rows = touches.read(parts=days).withColumn("hour_ts", hour_of("event_ts"))
        rows = rows.join(touched, ["user_id", "hour_ts"], "left_semi").drop("hour_ts")
        cells.write(decay_cells(rows, decay), batch_id)
        for table in (touches, cells):
            if len(table.batches()) >= compact_every:
                table.compact()

    return run(events.writeStream.foreachBatch(on_batch), checkpoint, every)
