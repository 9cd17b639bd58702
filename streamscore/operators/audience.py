"""Rule-based audience segments."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields and comparisons a rule may use.
TEXT_FIELDS = {"score_bucket"}
NUMBER_FIELDS = {
    "propensity_score",
    "clicks_1h",
    "clicks_24h",
    "clicks_7d",
    "impressions_1h",
    "impressions_24h",
    "conversions_total",
    "event_velocity_24h",
}
COMPARISONS = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
}

_NUMBER_PREFIX = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def _number(value: object) -> float:
    """Leading number of a rule value, as in "24 clicks"."""
    match = _NUMBER_PREFIX.match(str(value))
    if match is None:
        raise ValueError(f"rule value {value!r} is not a number")
    return float(match.group(1))


def segment_predicate(rules: Iterable[Mapping[str, object]]) -> Column:
    """All rules combined; a rule with an unknown field or comparison is ignored.

    Values only ever become literals.
    """
    conditions = []
    for rule in rules:
        field, op, value = rule.get("field"), rule.get("op"), rule.get("value")
        if op not in COMPARISONS or field not in TEXT_FIELDS | NUMBER_FIELDS:
            continue
        literal = F.lit(str(value)) if field in TEXT_FIELDS else F.lit(_number(value))
        conditions.append(COMPARISONS[op](F.col(field), literal))
    return reduce(operator.and_, conditions, F.lit(True))


def segment(features: DataFrame, scores: DataFrame, rules) -> DataFrame:
    """Users with features and a score who meet all rules."""
    scored = features.join(
        scores.select("user_id", "propensity_score", "score_bucket"), "user_id"
    )
    return scored.filter(segment_predicate(rules)).select(
        "user_id", "propensity_score", "score_bucket", "clicks_24h", "conversions_total"
    )


def segment_preview(features: DataFrame, scores: DataFrame, rules, n: int = 50) -> DataFrame:
    """The segment's first users by score."""
    return (
        segment(features, scores, rules)
        .orderBy(F.desc_nulls_last("propensity_score"), "user_id")
        .limit(n)
    )


def segment_count(features: DataFrame, scores: DataFrame, rules) -> DataFrame:
    """The segment's size."""
    return segment(features, scores, rules).agg(F.count(F.lit(1)).alias("cnt"))
