"""Scalar and aggregate column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from streamscore.schemas import EVENT_LABELS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(moment: datetime | str | Column) -> Column:
    """A zone-free timestamp; strings are literals, not column names."""
    if isinstance(moment, datetime):
        moment = moment.isoformat(sep=" ")
    if isinstance(moment, str):
        moment = F.lit(moment)
    return moment.cast("timestamp_ntz")


def hours_before(moment: datetime | str | Column, hours: int) -> Column:
    return ntz(moment) - F.expr(f"INTERVAL {int(hours)} HOURS")


def hour_of(ts: Column | str) -> Column:
    """Start of the hour, still without a zone."""
    return F.date_trunc("hour", col(ts)).cast("timestamp_ntz")


def hours_crossed(start: Column, end: Column) -> Column:
    """Hour boundaries between two moments: 10:59 to 11:01 is one."""
    return F.timestamp_diff("HOUR", hour_of(start), hour_of(end))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is NULL, not zero, when the denominator is zero."""
    return col(numerator).cast("double") / F.nullif(
        col(denominator).cast("double"), F.lit(0.0)
    )


def money(value: Column | str) -> Column:
    """A value that adds up exactly: up to 28 digits before the point and 10 after it."""
    return col(value).cast("decimal(38,10)")


def money_sum(value: Column | str) -> Column:
    """Sum that does not depend on row order."""
    return F.sum(money(value)).cast("double")


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def count_if_type(event_type: str, since: Column | None = None) -> Column:
    """Events of one type, optionally only those at or after `since`."""
    condition = F.col("event_type") == event_type
    if since is not None:
        condition &= F.col("event_ts") >= since
    return count_if(condition)


def score_bucket(score: Column | str) -> Column:
    """HIGH from 0.7, MED from 0.4, else LOW; an unknown score is LOW."""
    s = col(score)
    return F.when(s >= 0.7, "HIGH").when(s >= 0.4, "MED").otherwise("LOW")


def event_label(event_type: Column | str) -> Column:
    """Display name of an event type; unknown codes are shown as they are."""
    code = col(event_type)
    label = code
    for key, text in EVENT_LABELS.items():
        label = F.when(code == key, text).otherwise(label)
    return label


def recommendation_count(text: Column | str) -> Column:
    """How many numbered items a recommendation text holds."""
    return F.regexp_count(col(text), F.lit(r"\d\.")).cast("bigint")


def version_number(name: Column | str) -> Column:
    """Number in a version name such as V12; NULL for any other name."""
    digits = F.regexp_extract(col(name), r"^[Vv](\d+)$", 1)
    return digits.try_cast("bigint")
