"""Per-user features: incremental merge, exact windows, training frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamscore.functions.scalar import (
    count_if,
    count_if_type,
    hours_before,
    hours_crossed,
    money,
    ntz,
)
from streamscore.operators.running import with_running
from streamscore.schemas import CLICK, CONVERSION, IMPRESSION, PAID_SEARCH, USER_FEATURES
from streamscore.sources.storage import empty

KINDS = {"clicks": CLICK, "impressions": IMPRESSION, "paid_search": PAID_SEARCH}

HOURS = {"1h": 1, "24h": 24, "7d": 168}

# Inputs of the propensity model: engagement only, nothing derived from conversions.
MODEL_FEATURES = [f"{kind}_{span}" for kind in KINDS for span in HOURS] + ["event_velocity_24h"]

# Windowed features served online and used by the fixed scorer.
WINDOWED = {
    "clicks_1h": (CLICK, 1),
    "clicks_24h": (CLICK, 24),
    "clicks_7d": (CLICK, 168),
    "impressions_1h": (IMPRESSION, 1),
    "impressions_24h": (IMPRESSION, 24),
    "paid_search_1h": (PAID_SEARCH, 1),
    "paid_search_24h": (PAID_SEARCH, 24),
    "conversions_7d": (CONVERSION, 168),
    "event_count_24h": (None, 24),
}


def feature_delta(new_events: DataFrame, as_of) -> DataFrame:
    """Twelve measures per user over the events of one refresh.

    The 1h and 24h counts look back from `as_of` without an upper bound; the 7d
    counts have no time bound at all and are meant to be added up.
    """
    measures = [
        count_if_type(code, hours_before(as_of, HOURS[span])).alias(f"{kind}_{span}")
        for span in ("1h", "24h")
        for kind, code in KINDS.items()
    ]
    measures += [count_if_type(code).alias(f"{kind}_7d") for kind, code in KINDS.items()]
    return new_events.groupBy("user_id").agg(
        *measures,
        count_if_type(CONVERSION).alias("conversions"),
        F.max(F.when(F.col("event_type") == CONVERSION, F.col("event_ts"))).alias(
            "latest_conversion_ts"
        ),
        F.count(F.lit(1)).alias("batch_event_count"),
    )


def merge_user_features(
    state: DataFrame | None, delta: DataFrame, as_of, monotonic: bool = False
) -> DataFrame:
    """Fold one refresh into the stored features.

    Users without new events keep their row. For the others the 1h and 24h
    counts are replaced, the 7d counts and conversions grow, the last conversion
    is that of the new events if they hold one (with `monotonic`, the later of
    both), and velocity is new events per hour since the previous refresh.
    """
    if state is None:
        state = empty(delta.sparkSession, USER_FEATURES)
    now = ntz(as_of)
    joined = state.alias("t").join(delta.alias("s"), "user_id", "full_outer")
    touched = F.col("s.batch_event_count").isNotNull()
    known = F.col("t.last_updated").isNotNull()

    def choose(updated: Column, inserted: Column, kept: Column) -> Column:
        return F.when(~touched, kept).when(known, updated).otherwise(inserted)

    def replaced(name: str) -> Column:
        old, new = F.col(f"t.{name}"), F.col(f"s.{name}")
        return F.when(touched, new).otherwise(old)

    def added(name: str, source: str | None = None) -> Column:
        old, new = F.col(f"t.{name}"), F.col(f"s.{source or name}")
        return choose(old + new, new, old)

    old_last, new_last = F.col("t.last_conversion_ts"), F.col("s.latest_conversion_ts")
    last = F.greatest(new_last, old_last) if monotonic else F.coalesce(new_last, old_last)
    gap_hours = F.greatest(hours_crossed(F.col("t.last_updated"), now), F.lit(1))
    events = F.col("s.batch_event_count").cast("double")

    output = {"user_id": F.col("user_id")}
    for kind in KINDS:
        output[f"{kind}_1h"] = replaced(f"{kind}_1h")
        output[f"{kind}_24h"] = replaced(f"{kind}_24h")
        output[f"{kind}_7d"] = added(f"{kind}_7d")
    output["conversions_total"] = added("conversions_total", "conversions")
    output["last_conversion_ts"] = choose(last, new_last, old_last)
    output["time_since_last_conversion_hrs"] = choose(
        hours_crossed(last, now).cast("double"),
        hours_crossed(F.coalesce(new_last, now), now).cast("double"),
        F.col("t.time_since_last_conversion_hrs"),
    )
    output["event_velocity_24h"] = choose(
        events / gap_hours, events, F.col("t.event_velocity_24h")
    )
    output["last_updated"] = F.when(touched, now).otherwise(F.col("t.last_updated"))
    return joined.select(
        [output[f.name].cast(f.dataType).alias(f.name) for f in USER_FEATURES.fields]
    )


def window_measures(
    within: Callable[[int], Column], event_type: Column, weight: Column
) -> list[Column]:
    """The windowed features as aggregates; every row counts `weight` times.

    `within` gives the condition that a row lies in the window of so many hours.
    """
    measures = []
    for name, (code, hours) in WINDOWED.items():
        inside = within(hours)
        if code is not None:
            inside &= event_type == code
        measures.append(
            F.coalesce(F.sum(F.when(inside, weight)), F.lit(0)).cast("bigint").alias(name)
        )
    return measures


def rolling_user_features(events: DataFrame, as_of) -> DataFrame:
    """Exact 1h, 24h and 7d counts per user at one moment, in one aggregation."""
    recent = events.filter(
        (F.col("event_ts") >= hours_before(as_of, 168)) & (F.col("event_ts") <= ntz(as_of))
    )
    return recent.groupBy("user_id").agg(
        *window_measures(
            lambda hours: F.col("event_ts") >= hours_before(as_of, hours), F.col("event_type"), F.lit(1)
        )
    )


def online_user_features(events: DataFrame, as_of) -> DataFrame:
    """Event counts, conversion value and last event per user for online reads."""
    recent = events.filter(
        (F.col("event_ts") >= hours_before(as_of, 48)) & (F.col("event_ts") <= ntz(as_of))
    )
    last_hour = F.col("event_ts") >= hours_before(as_of, 1)
    last_day = F.col("event_ts") >= hours_before(as_of, 24)
    return recent.groupBy("user_id").agg(
        count_if(last_hour & F.col("event_type").isNotNull()).alias("events_1h"),
        count_if(last_day & F.col("event_type").isNotNull()).alias("events_24h"),
        F.sum(F.when(last_day, money("conversion_value")))
        .cast("double")
        .alias("conversion_value_24h"),
        F.max("event_ts").alias("latest_event_48h"),
    )


def rolling_history(events: DataFrame) -> DataFrame:
    """The windowed features as they stood right after every single event.

    Each event adds one to its windows when it happens and takes it off again just
    after the window's length, so every count is one running sum over moments. Events
    of a user that share a moment are counted together before anything is summed.
    """

    def lengths(code: str | None) -> Column:
        used = {h for c, h in WINDOWED.values() if c in (None, code)}
        return F.array(*[F.lit(h).cast("smallint") for h in [0, *sorted(used)]])

    moments = events.groupBy("user_id", "event_type", "event_ts").agg(
        F.count(F.lit(1)).alias("_n")
    )
    by_type = lengths(None)
    for code in sorted({c for c, _ in WINDOWED.values() if c is not None}):
        by_type = F.when(F.col("event_type") == code, lengths(code)).otherwise(by_type)
    changes = moments.withColumn("_left_after", F.explode(by_type)).withColumns(
        {
            "at": F.col("event_ts") + F.make_dt_interval(hours="_left_after"),
            # Whatever leaves a window just after a moment is not gone at the moment.
            "_gone": F.col("_left_after") > 0,
        }
    )
    steps = {}
    for name, (code, h) in WINDOWED.items():
        mine = F.lit(True) if code is None else F.col("event_type") == code
        step = F.when(mine & ~F.col("_gone"), F.col("_n")).when(
            mine & (F.col("_left_after") == h), -F.col("_n")
        )
        steps[name] = F.sum(step.otherwise(0)).alias(name)
    summed = changes.groupBy("user_id", "at", "_gone").agg(*steps.values())
    running = with_running(
        summed.withColumnsRenamed({name: f"_{name}" for name in WINDOWED}),
        "user_id",
        {name: F.col(f"_{name}") for name in WINDOWED},
        order=["at", "_gone"],
    )
    known = running.filter(~F.col("_gone")).select("user_id", F.col("at").alias("event_ts"), *WINDOWED)
    return events.select("event_id", "user_id", "event_type", "event_ts").join(
        known, ["user_id", "event_ts"]
    ).select("event_id", "user_id", "event_type", "event_ts", *WINDOWED)


def feature_group(*views: DataFrame) -> DataFrame:
    """Feature views side by side, keyed by user; the first one sets the users.

    Names are not prefixed, so a feature may occur in one view only.
    """
    first, *others = views
    seen = set(first.columns)
    group = first
    for view in others:
        names = set(view.columns) - {"user_id"}
        if clash := sorted(names & seen):
            raise ValueError(f"features occur in more than one view: {clash}")
        seen |= names
        group = group.join(view, "user_id", "left")
    return group


def label(features: DataFrame) -> Column:
    return F.when(F.col("conversions_total") > 0, 1).otherwise(0)


def label_cols(rows: DataFrame) -> DataFrame:
    """Predicted label from the score and actual label from the conversions."""
    return rows.withColumn(
        "predicted_label", F.when(F.col("propensity_score") >= 0.5, 1).otherwise(0)
    ).withColumn("actual_converted", F.when(F.col("conversions_total") > 0, 1).otherwise(0))


def training_frame(features: DataFrame) -> DataFrame:
    """Ten model inputs as DOUBLE, the label, and the user for the split."""
    return features.select(
        "user_id",
        *[F.col(name).cast("double").alias(name) for name in MODEL_FEATURES],
        label(features).alias("converted"),
    )


def label_stats(training: DataFrame) -> DataFrame:
    """Class counts and the share of positives."""
    return training.agg(
        F.count(F.lit(1)).alias("users"),
        count_if(F.col("converted") == 1).alias("positives"),
        count_if(F.col("converted") == 0).alias("negatives"),
        F.avg(F.col("converted").cast("double")).alias("positive_rate"),
    )
