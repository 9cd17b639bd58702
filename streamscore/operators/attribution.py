"""User journeys and the credit given to channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamscore.functions.scalar import count_if, hour_of, money, money_sum
from streamscore.operators.running import with_running
from streamscore.schemas import CONVERSION
from streamscore.sources.storage import literal_rows

MODELS = ["first_touch", "last_touch", "linear", "time_decay"]

# Channels listed in the model comparison.
COMPARED_CHANNELS = ["display", "search", "social", "email"]

SEGMENT_ROWS = 1000


def _converting(alias: str = "event_type") -> Column:
    return F.col(alias) == CONVERSION


def touchpoints(events: DataFrame) -> DataFrame:
    """Events of converted users with their position in the user's journey.

    Adds `touch_idx` (0 for the earliest), `touchpoint_count` and the user's
    total `conversion_value`. Ties in time are ordered by event_id.
    `_part` numbers bounded stretches of a journey, in its order.
    """
    rows = events.select(
        "user_id",
        "event_id",
        "event_ts",
        "channel",
        "campaign_name",
        "event_type",
        F.col("conversion_value").alias("event_value"),
    )
    numbered = with_running(
        rows,
        "user_id",
        measures={"touch_idx": F.lit(1)},
        totals={
            "touchpoint_count": F.count(F.lit(1)),
            "_conversions": F.count(F.when(_converting(), 1)),
            "conversion_value": F.sum(
                F.when(_converting(), money("event_value")).otherwise(0)
            ),
        },
        keep=F.col("_conversions") > 0,
        order=["event_ts", "event_id"],
    )
    return (
        numbered.withColumn("touch_idx", F.col("touch_idx") - 1)
        .withColumn("conversion_value", F.col("conversion_value").cast("double"))
        .drop("_conversions")
    )


def journeys(events: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Journeys of converted users as arrays of touchpoints in time order.

    One row per user, or several for a long journey: `segment` numbers the
    slices, each of at most `segment_rows` touchpoints, so no array grows without
    bound.
    """
    return journey_slices(touchpoints(events), segment_rows)


def journey_slices(touches: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The slices of `journeys` out of `touchpoints`."""
    touch = F.struct(
        "touch_idx",
        "channel",
        F.col("campaign_name").alias("campaign"),
        "event_type",
        F.col("event_ts").cast("string").alias("ts"),
    )
    return (
        touches.groupBy(
            "user_id", F.floor(F.col("touch_idx") / segment_rows).cast("bigint").alias("segment")
        )
        .agg(
            F.sort_array(F.collect_list(touch)).alias("touchpoints"),
            F.max("touchpoint_count").alias("touchpoint_count"),
            F.max("conversion_value").alias("conversion_value"),
        )
        .select(
            "user_id",
            "segment",
            F.col("touchpoints")[0]["touch_idx"].alias("first_idx"),
            F.transform("touchpoints", lambda t: t.dropFields("touch_idx")).alias("touchpoints"),
            "touchpoint_count",
            F.lit(1).alias("converted"),
            "conversion_value",
        )
    )


def explode_touchpoints(journey_rows: DataFrame) -> DataFrame:
    """Journey arrays back to one row per touchpoint, with its position."""
    return journey_rows.select(
        "user_id",
        "first_idx",
        "touchpoint_count",
        "conversion_value",
        F.posexplode("touchpoints").alias("_pos", "touch"),
    ).select(
        "user_id",
        "touchpoint_count",
        "conversion_value",
        (F.col("first_idx") + F.col("_pos")).alias("touch_idx"),
        F.col("touch.channel").alias("channel"),
        F.col("touch.campaign").alias("campaign"),
        F.col("touch.event_type").alias("event_type"),
        F.col("touch.ts").alias("ts"),
    )


def journey_channels(events: DataFrame) -> DataFrame:
    """What first, last and linear credit need, per user and channel.

    Counts, value and the first and last touch can be combined with those of
    later events, see `add_journey_channels`.
    """
    position = F.struct("event_ts", "event_id")
    marketing = F.when(~_converting(), position)
    return events.groupBy("user_id", "channel").agg(
        F.count(F.lit(1)).alias("touches"),
        count_if(_converting()).alias("conversions"),
        F.sum(F.when(_converting(), money("conversion_value")).otherwise(0))
        .cast("decimal(38,10)")
        .alias("value"),
        F.min(position).alias("first_any"),
        F.max(position).alias("last_any"),
        F.min(marketing).alias("first_marketing"),
        F.max(marketing).alias("last_marketing"),
    )


def add_journey_channels(*tables: DataFrame) -> DataFrame:
    """One journey_channels table out of several."""
    union = reduce(DataFrame.unionByName, tables)
    return union.groupBy("user_id", "channel").agg(
        F.sum("touches").alias("touches"),
        F.sum("conversions").alias("conversions"),
        F.sum("value").cast("decimal(38,10)").alias("value"),
        F.min("first_any").alias("first_any"),
        F.max("last_any").alias("last_any"),
        F.min("first_marketing").alias("first_marketing"),
        F.max("last_marketing").alias("last_marketing"),
    )


def credit_from_channels(
    channels: DataFrame,
    model: str,
    exclude_conversions: bool = False,
    denominator: str = "all",
) -> DataFrame:
    """First-touch, last-touch or linear credit per channel.

    A user has one row per channel here, so the window per user is short.
    Conversions count users. First and last touch look at all touches unless
    `exclude_conversions`; linear gives credit to marketing touches but divides
    by all touches unless `denominator` is "non_conversion".
    """
    user = Window.partitionBy("user_id")
    marketing = F.col("touches") - F.col("conversions")
    rows = channels.select(
        "*",
        F.sum("conversions").over(user).alias("_conversions"),
        F.sum("value").over(user).cast("double").alias("_value"),
        F.sum("touches").over(user).alias("_touches"),
        F.sum(marketing).over(user).alias("_marketing"),
        *[
            F.min(f"first_{k}").over(user).alias(f"_first_{k}") for k in ("any", "marketing")
        ],
        *[F.max(f"last_{k}").over(user).alias(f"_last_{k}") for k in ("any", "marketing")],
    ).filter(F.col("_conversions") > 0)

    if model in ("first_touch", "last_touch"):
        end = ("first_" if model == "first_touch" else "last_") + (
            "marketing" if exclude_conversions else "any"
        )
        credited = rows.filter(F.col(end) == F.col(f"_{end}")).withColumn(
            "_credit", F.col("_value")
        )
    elif model == "linear":
        count = F.col("_marketing" if denominator == "non_conversion" else "_touches")
        credited = rows.filter(marketing > 0).withColumn(
            "_credit", F.col("_value") / count * marketing
        )
    else:
        raise ValueError(f"no model {model!r} on channel counts")
    return _sum_credit(credited)


def _sum_credit(credited: DataFrame) -> DataFrame:
    """One input row per channel and converted user."""
    return (
        credited.groupBy("channel")
        .agg(
            F.count(F.lit(1)).alias("conversions"),
            F.sum("_credit").alias("attributed_revenue"),
        )
        .orderBy(F.desc_nulls_last("attributed_revenue"), "channel")
    )


def linear_from_touchpoints(touches: DataFrame) -> DataFrame:
    """Linear credit out of single touchpoints, as from `explode_touchpoints`."""
    return _sum_credit(
        touches.filter(~_converting())
        .groupBy("user_id", "channel")
        .agg(F.sum(F.col("conversion_value") / F.col("touchpoint_count")).alias("_credit"))
    )


def _channel_facts(touches: DataFrame, decay: float) -> DataFrame:
    """One row per user and channel out of `touchpoints`, with what any model needs.

    Weights fall by exp(-decay) with every touch before the user's last marketing
    touch. They are summed per part relative to the part's last marketing touch,
    then brought to the user's last one, so long journeys neither travel whole nor
    lose precision. Conversions take no weight but hold a position.
    """
    marketing = ~_converting()
    idx = F.col("touch_idx")
    in_part = Window.partitionBy("user_id", "_part")
    user = Window.partitionBy("user_id")
    flag = lambda condition: F.max(F.when(condition, 1).otherwise(0))
    carried = [F.max(c).alias(c) for c in ("_first", "_end", "_value", "_count")]
    per_part = (
        touches.withColumn("_last", F.max(F.when(marketing, idx)).over(in_part))
        .withColumn("_weight", F.when(marketing, F.exp((idx - F.col("_last")) * F.lit(decay))))
        .groupBy("user_id", "_part", "channel")
        .agg(
            F.sum("_weight").alias("_weight"),
            F.max("_last").alias("_last"),
            count_if(marketing).alias("_marketing"),
            flag(idx == 0).alias("_first"),
            flag(idx == F.col("touchpoint_count") - 1).alias("_end"),
            F.max("conversion_value").alias("_value"),
            F.max("touchpoint_count").alias("_count"),
        )
    )
    moved = F.col("_weight") * F.exp((F.col("_last") - F.col("_user_last")) * F.lit(decay))
    per_channel = (
        per_part.withColumn("_user_last", F.max("_last").over(user))
        .groupBy("user_id", "channel")
        .agg(F.sum(moved).alias("_weight"), F.sum("_marketing").alias("_marketing"), *carried)
    )
    return per_channel.withColumn("_share", F.col("_weight") / F.sum("_weight").over(user))


def time_decay_credit(touches: DataFrame, decay: float = 0.5) -> DataFrame:
    """Credit that falls by exp(-decay) with every touch before the last.

    `touches` come from `touchpoints`.
    """
    if decay < 0:
        raise ValueError("decay must not be negative")
    facts = _channel_facts(touches, decay).filter(F.col("_marketing") > 0)
    return _sum_credit(facts.withColumn("_credit", F.col("_value") * F.col("_share")))


def _in_cells(events: DataFrame) -> DataFrame:
    """Events with their position in the cell of their user and hour, and its touches."""
    cell = F.struct("user_id", hour_of("event_ts").alias("hour_ts"))
    numbered = with_running(
        events.withColumn("_cell", cell),
        "_cell",
        measures={"_idx": F.lit(1)},
        totals={"cell_touches": F.count(F.lit(1))},
        order=["event_ts", "event_id"],
    )
    return numbered.withColumn("_idx", F.col("_idx") - 1)


def decay_cells(events: DataFrame, decay: float = 0.5) -> DataFrame:
    """What time decay needs of every hour of a user: one row per channel.

    `weight` is relative to the hour's last marketing touch, whose position in the hour is
    `last`, so an hour is told apart from what comes before and after it: a touch that
    enters it late changes this hour's rows alone, see `credit_from_cells`.
    """
    marketing = ~_converting()
    idx = F.col("_idx")
    in_part, in_cell = Window.partitionBy("_cell", "_part"), Window.partitionBy("_cell")
    value = F.sum(F.when(_converting(), money("conversion_value")).otherwise(0))
    per_part = (
        _in_cells(events)
        .withColumn("_last", F.max(F.when(marketing, idx)).over(in_part))
        .withColumn("_weight", F.when(marketing, F.exp((idx - F.col("_last")) * F.lit(decay))))
        .groupBy("_cell", "_part", "channel")
        .agg(
            F.sum("_weight").alias("_weight"),
            F.max("_last").alias("_last"),
            F.count(F.lit(1)).alias("touches"),
            count_if(_converting()).alias("conversions"),
            value.cast("decimal(38,10)").alias("value"),
            F.max("cell_touches").alias("cell_touches"),
        )
        .withColumn("last", F.max("_last").over(in_cell))
    )
    moved = F.col("_weight") * F.exp((F.col("_last") - F.col("last")) * F.lit(decay))
    summed = per_part.groupBy("_cell", "channel").agg(
        F.sum("touches").alias("touches"),
        F.sum("conversions").alias("conversions"),
        F.sum("value").cast("decimal(38,10)").alias("value"),
        F.sum(moved).alias("weight"),
        F.max("last").alias("last"),
        F.max("cell_touches").alias("cell_touches"),
    )
    return summed.select("_cell.user_id", "_cell.hour_ts", *summed.columns[1:])


def _cell_starts(cells: DataFrame) -> DataFrame:
    """One row per user and hour of converted users: where the hour starts in the journey."""
    user = Window.partitionBy("user_id")
    earlier = user.orderBy("hour_ts").rowsBetween(Window.unboundedPreceding, -1)
    hours = cells.groupBy("user_id", "hour_ts").agg(
        F.max("cell_touches").alias("_touches"),
        F.max("last").alias("_last"),
        F.sum("conversions").alias("_conversions"),
        F.sum("value").alias("_value"),
    )
    placed = hours.select(
        "user_id",
        "hour_ts",
        F.coalesce(F.sum("_touches").over(earlier), F.lit(0)).alias("_start"),
        "_last",
        F.sum("_touches").over(user).alias("touchpoint_count"),
        F.sum("_conversions").over(user).alias("_conversions"),
        F.sum("_value").over(user).cast("double").alias("conversion_value"),
    )
    return placed.filter(F.col("_conversions") > 0).drop("_conversions")


def credit_from_cells(cells: DataFrame, decay: float = 0.5) -> DataFrame:
    """Time-decay credit out of `decay_cells` made with the same `decay`.

    Cells are brought to the user's last marketing touch by the number of touches between;
    a user has one row per hour and channel here, however many touches there were.
    """
    user = Window.partitionBy("user_id")
    starts = _cell_starts(cells)
    at = F.col("_start") + F.col("_last")
    starts = starts.withColumn("_behind", at - F.max(at).over(user))
    shares = (
        cells.join(starts, ["user_id", "hour_ts"])
        .groupBy("user_id", "channel")
        .agg(
            F.sum(F.col("weight") * F.exp(F.col("_behind") * F.lit(decay))).alias("_weight"),
            F.sum(F.col("touches") - F.col("conversions")).alias("_marketing"),
            F.max("conversion_value").alias("_value"),
        )
        .withColumn("_share", F.col("_weight") / F.sum("_weight").over(user))
        .filter(F.col("_marketing") > 0)
    )
    return _sum_credit(shares.withColumn("_credit", F.col("_value") * F.col("_share")))


def touchpoints_from_cells(events: DataFrame, cells: DataFrame) -> DataFrame:
    """`touchpoints` of some events, given the cells of all.

    Positions count the whole journey, so the touches of one day can be numbered from the
    events of that day.
    """
    rows = _in_cells(events.drop("conversion_value"))
    rows = rows.withColumn("hour_ts", F.col("_cell.hour_ts"))
    starts = _cell_starts(cells).drop("_last")
    return rows.join(starts, ["user_id", "hour_ts"]).select(
        "user_id",
        "event_id",
        "event_ts",
        "channel",
        "campaign_name",
        "event_type",
        (F.col("_start") + F.col("_idx")).alias("touch_idx"),
        "touchpoint_count",
        "conversion_value",
    )


def converted_users(events: DataFrame) -> DataFrame:
    """Touches, marketing touches and value of every user who converted."""
    return (
        events.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("_touches"),
            count_if(~_converting()).alias("_marketing"),
            money_sum(F.when(_converting(), F.col("conversion_value")).otherwise(0)).alias("_value"),
        )
        .filter(F.col("_touches") > F.col("_marketing"))
    )


def _end_touch(events: DataFrame, last: bool) -> DataFrame:
    """The first or last touch of every user; the rank filter starts in the map tasks."""
    turn = F.desc if last else F.asc
    order = Window.partitionBy("user_id").orderBy(turn("event_ts"), turn("event_id"))
    ranked = events.select("user_id", "channel", F.row_number().over(order).alias("_rank"))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def simple_credit(
    events: DataFrame, model: str, exclude_conversions: bool = False, denominator: str = "all"
) -> DataFrame:
    """First-touch, last-touch or linear credit, without the positions of all touches.

    First and last touch look at all touches unless `exclude_conversions`; linear
    gives credit to marketing touches but divides by all touches unless
    `denominator` is "non_conversion".
    """
    users = converted_users(events)
    marketing = events.filter(~_converting())
    if model == "linear":
        count = F.col("_marketing" if denominator == "non_conversion" else "_touches")
        touches = marketing.groupBy("user_id", "channel").agg(F.count(F.lit(1)).alias("_n"))
        credit = F.col("_value") / count * F.col("_n")
    else:
        touches = _end_touch(marketing if exclude_conversions else events, model == "last_touch")
        credit = F.col("_value")
    return _sum_credit(touches.join(users, "user_id").withColumn("_credit", credit))


def attribute(
    events: DataFrame,
    model: str = "linear",
    decay: float = 0.5,
    exclude_conversions: bool = False,
    denominator: str = "all",
) -> DataFrame:
    """Credit per channel for converted users; unknown models mean linear.

    Every touch counts, also those after the conversion and without lookback.
    """
    if model == "time_decay":
        return time_decay_credit(touchpoints(events), decay)
    if model not in MODELS:
        model = "linear"
    return simple_credit(events, model, exclude_conversions, denominator)


def credit_pct(credit: DataFrame) -> DataFrame:
    """Add each channel's percentage of all credit, to one decimal."""
    total = F.sum("attributed_revenue").over(Window.partitionBy(F.lit(0)))
    share = F.round(F.col("attributed_revenue") / total * 100, 1)
    return credit.withColumn("credit_pct", F.when(total > 0, share).otherwise(F.lit(0.0)))


def attribution_comparison(events: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Percentages of all four models side by side; no credit shows as 0."""
    listed = COMPARED_CHANNELS if channels is None else channels
    facts = _channel_facts(touchpoints(events), 0.5)
    value = F.col("_value")
    credits = {
        "first_touch": F.when(F.col("_first") == 1, value),
        "last_touch": F.when(F.col("_end") == 1, value),
        "linear": value / F.col("_count") * F.col("_marketing"),
        "time_decay": value * F.col("_share"),
    }
    summed = facts.groupBy("channel").agg(*[F.sum(c).alias(m) for m, c in credits.items()])
    whole = Window.partitionBy(F.lit(0))
    shares = {}
    for model in MODELS:
        total = F.sum(model).over(whole)
        share = F.round(F.col(model) / total * 100, 1)
        shares[model] = F.when(total > 0, share).otherwise(F.lit(0.0))
    rows = literal_rows(events.sparkSession, "channel", listed)
    wide = summed.withColumns(shares).filter(F.col("channel").isin(listed))
    return rows.join(wide, "channel", "left").fillna(0.0, subset=MODELS)


def journey_totals(events: DataFrame) -> DataFrame:
    """Length and value of the journeys of converted users."""
    return (
        events.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("touchpoint_count"),
            F.max(F.when(_converting(), 1).otherwise(0)).alias("converted"),
            money_sum(F.when(_converting(), F.col("conversion_value")).otherwise(0)).alias(
                "conversion_value"
            ),
        )
        .filter(F.col("converted") == 1)
    )
