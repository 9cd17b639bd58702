"""Scores computed by expression, without a trained model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamscore.functions.scalar import ntz, score_bucket

# Coefficients of the on-demand logistic scorer.
INTERCEPT = -2.1
COEFFICIENTS = {
    "clicks_1h": 0.8,
    "clicks_24h": 0.4,
    "clicks_7d": 0.1,
    "impressions_1h": 0.3,
    "impressions_24h": 0.15,
    "paid_search_1h": 0.2,
    "paid_search_24h": 1.2,
    "conversions_7d": 2.5,
}


def fixed_score() -> Column:
    """Logistic function of the windowed features; missing ones count as zero."""
    z = F.lit(INTERCEPT)
    for name, weight in COEFFICIENTS.items():
        z = z + F.lit(weight) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_fixed(features: DataFrame) -> DataFrame:
    return features.withColumn("propensity_score", fixed_score()).withColumn(
        "score_bucket", score_bucket("propensity_score")
    )


def propensity_scores(features: DataFrame, as_of) -> DataFrame:
    """Score table made by the fixed scorer."""
    return score_fixed(features).select(
        "user_id", "propensity_score", "score_bucket", ntz(as_of).alias("last_updated")
    )


def score_requests(
    requests: DataFrame,
    features: DataFrame,
    transformation_fn: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Score the user of every request; users without features get the base score.

    Requests of one user may be many: the join is left to adaptive execution,
    which splits hot users, and `features` has one row per user.
    """
    if transformation_fn is not None:
        requests = requests.transform(transformation_fn)
    return score_fixed(requests.join(features, "user_id", "left"))
