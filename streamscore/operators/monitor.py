"""Inference log and model monitor."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from streamscore.functions.scalar import count_if, ntz, ratio
from streamscore.operators.features import label_cols

SCORE_BINS = 10

# Cells of a score summary; its quantiles are exact to one cell.
SCORE_CELLS = 10_000

# Share given to an empty bin, so that drift stays finite.
MIN_SHARE = 0.0001


def inference_rows(
    scores: DataFrame, features: DataFrame, as_of, version: str = "V1"
) -> DataFrame:
    """Predictions beside the outcome known so far, one row per user."""
    joined = scores.select("user_id", "propensity_score").join(
        features.select("user_id", "conversions_total"), "user_id"
    )
    return label_cols(joined).select(
        "user_id",
        F.col("propensity_score").alias("predicted_score"),
        "predicted_label",
        "actual_converted",
        ntz(as_of).alias("scored_at"),
        F.lit(version).alias("model_version"),
    )


def log_inferences(
    scores: DataFrame, features: DataFrame, as_of, path: str, version: str = "V1"
) -> str:
    """Store one snapshot in the log; says how many rows it had.

    Every moment of scoring has a folder of its own, so a snapshot that is logged
    again replaces itself.
    """
    counted = Observation("inference_log")
    rows = inference_rows(scores, features, as_of, version).observe(
        counted, F.count(F.lit(1)).alias("rows")
    )
    (
        rows.withColumn("snapshot", F.date_format("scored_at", "yyyyMMddHHmmssSSSSSS"))
        .write.mode("overwrite")
        .partitionBy("snapshot")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
    return f"Logged {counted.get['rows']} inference rows"


def _bin_shares() -> Column:
    """Share of every score bin, empty bins included; NULL without any score."""
    n = F.nullif(F.count("predicted_score"), F.lit(0))
    slot = F.least(F.floor(F.col("predicted_score") * SCORE_BINS), F.lit(SCORE_BINS - 1))
    return F.array(
        *[
            F.when(n.isNotNull(), F.greatest(count_if(slot == b).cast("double") / n, F.lit(MIN_SHARE)))
            for b in range(SCORE_BINS)
        ]
    )


def monitor(log: DataFrame, baseline: DataFrame, window: str = "1 day") -> DataFrame:
    """Volume, quality and drift per time window.

    Drift is the population stability index of the scores against `baseline`, NULL if
    either side has no scores. Ratios are NULL when undefined, F1 is zero.
    """
    predicted, actual = F.col("predicted_label") == 1, F.col("actual_converted") == 1
    windows = log.groupBy(F.window("scored_at", window)["start"].cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("rows_scored"),
        count_if(predicted & actual).alias("true_positives"),
        count_if(predicted & ~actual).alias("false_positives"),
        count_if(~predicted & ~actual).alias("true_negatives"),
        count_if(~predicted & actual).alias("false_negatives"),
        F.avg("predicted_score").alias("mean_score"),
        F.avg(F.col("predicted_label").cast("double")).alias("predicted_positive_rate"),
        F.avg(F.col("actual_converted").cast("double")).alias("actual_positive_rate"),
        _bin_shares().alias("_shares"),
    )
    expected = baseline.agg(_bin_shares().alias("shares")).scalar()
    now, then = F.col("_shares"), F.col("_expected")
    drift = reduce(add, [(now[b] - then[b]) * F.log(now[b] / then[b]) for b in range(SCORE_BINS)])
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return windows.withColumn("_expected", expected).withColumns(
        {
            "accuracy": ratio(tp + F.col("true_negatives"), "rows_scored"),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
            "psi": drift,
        }
    ).drop("_shares", "_expected")


def _cell() -> Column:
    cell = F.floor(F.col("predicted_score") * SCORE_CELLS)
    return F.greatest(F.least(cell, F.lit(SCORE_CELLS - 1)), F.lit(0))


def score_summary(log: DataFrame) -> DataFrame:
    """How many scores fall into each cell of the unit interval: columns cell and n.

    Summaries of parts of a log add up to that of the whole, see `add_summaries`, so a
    baseline can be kept per day and put together for any range of days. A summary has at
    most `SCORE_CELLS` rows; missing scores do not count.
    """
    scored = log.filter(F.col("predicted_score").isNotNull())
    return scored.groupBy(_cell().alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def add_summaries(*summaries: DataFrame) -> DataFrame:
    union = reduce(DataFrame.unionByName, summaries)
    return union.groupBy("cell").agg(F.sum("n").alias("n"))


def _quantile_bin(cell: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda edge: edge <= cell))


def quantile_drift(
    log: DataFrame, baseline: DataFrame, window: str = "1 day", bins: int = SCORE_BINS
) -> DataFrame:
    """Population stability index per time window over bins that hold equal baseline shares.

    `baseline` is a summary of scores. Fixed bins see little of scores that crowd in one of
    them; here each bin starts at the first cell before which b / `bins` of the baseline lie.
    Where ties make bins empty on both sides, they add nothing. NULL if either side has no
    scores.
    """
    # At most one row per cell.
    placed = baseline.select(
        "cell",
        "n",
        (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("_before"),
        F.sum("n").over(Window.partitionBy()).alias("_total"),
    )
    edge = lambda b: F.min(F.when(F.col("_before") * bins >= b * F.col("_total"), F.col("cell")))
    edges = placed.agg(F.array_compact(F.array(*[edge(b) for b in range(1, bins)])).alias("_edges"))
    share = lambda b, weight, total: F.greatest(
        F.sum(F.when(F.col("_bin") == b, weight).otherwise(0)).cast("double") / total, F.lit(MIN_SHARE)
    )
    binned = baseline.crossJoin(F.broadcast(edges))  # one row
    binned = binned.withColumn("_bin", _quantile_bin(F.col("cell"), F.col("_edges")))
    total = F.nullif(F.sum("n"), F.lit(0))
    expected = binned.agg(F.array(*[share(b, F.col("n"), total) for b in range(bins)]).alias("_expected"))
    rows = log.crossJoin(F.broadcast(edges)).withColumn(
        "_bin", F.when(F.col("predicted_score").isNotNull(), _quantile_bin(_cell(), F.col("_edges")))
    )
    scored = F.nullif(F.count("predicted_score"), F.lit(0))
    windows = rows.groupBy(
        F.window("scored_at", window)["start"].cast("timestamp_ntz").alias("day")
    ).agg(
        F.count("predicted_score").alias("scores"),
        F.when(scored.isNotNull(), F.array(*[share(b, F.lit(1), scored) for b in range(bins)])).alias("_now"),
    )
    now, then = F.col("_now"), F.col("_expected")
    drift = reduce(add, [(now[b] - then[b]) * F.log(now[b] / then[b]) for b in range(bins)])
    known = baseline.agg(F.count(F.lit(1)).alias("_known"))
    one = expected.crossJoin(known)
    return windows.crossJoin(F.broadcast(one)).select(
        "day", "scores", F.when(F.col("_known") > 0, drift).alias("psi")
    )
