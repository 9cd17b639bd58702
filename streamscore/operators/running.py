"""Per-key running totals that never need a whole key, or a whole moment, in one task.

A window over one key would put all rows of that key into one task, and one over a key
and a second all rows of that second. Here the rows are dealt by ranges of (key, order):
the bounds are sampled from the rows, so a key, a second or a single moment with very
many rows spreads over as many parts as its share of all rows asks for, split by
whatever breaks its ties. The row-level window runs per key and part. A key that lies in
several parts is the last of one and the first of another, so there are fewer such keys
than parts; only theirs are summed up over their parts, to give what each part starts
from and the total of the whole key, and the few sums are sent to all tasks. The plan is
the same for all sizes, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamscore.sources.storage import stored


def with_running(
    rows: DataFrame,
    key: str,
    measures: Mapping[str, Column],
    order: list[str],
    totals: Mapping[str, Column] | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Add running sums, and totals of the whole key, to every row.

    `measures` maps a new column to what each row adds to it; the sums include the row
    itself. `totals` maps a new column to a plain count or sum over the rows of one part,
    which is added up over the key. `keep` is a condition on the totals that drops
    whole keys. The key must not be NULL; NULL comes first in `order`. Adds `_part`, the
    number of the row's part, as well: parts follow the order within a key.

    The dealt rows are written once to the shared folder, since both uses of them must
    see the same parts even if executors are lost in between.
    """
    totals = dict(totals or {})
    steps = {name: measure.cast("bigint") for name, measure in measures.items()}
    dealt = stored(
        rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "running"
    )

    ends = dealt.groupBy("_part").agg(F.min(key).alias("_first_key"), F.max(key).alias("_last_key"))
    split = ends.select(F.col("_last_key").alias(key)).distinct().join(
        ends.select(F.col("_first_key").alias(key)), key, "left_semi"
    )
    parts = dealt.join(F.broadcast(split), key, "left_semi").groupBy(key, "_part").agg(
        *[F.sum(step).alias(f"_sum_{n}") for n, step in steps.items()],
        *[t.alias(f"_sum_{n}") for n, t in totals.items()],
    )
    whole_key = Window.partitionBy(key)
    earlier = whole_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most two rows per part.
    starts = parts.select(
        key,
        "_part",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in steps],
        *[F.sum(f"_sum_{n}").over(whole_key).alias(f"_whole_{n}") for n in totals],
    )

    in_part = Window.partitionBy(key, "_part")
    running = in_part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What a row adds is computed after the shuffle, to move fewer bytes.
    numbered = dealt.filter(F.col(key).isNotNull()).select(
        *rows.columns,
        "_part",
        *[F.sum(s).over(running).alias(f"_run_{n}") for n, s in steps.items()],
        *[t.over(in_part).alias(f"_own_{n}") for n, t in totals.items()],
    )
    out = numbered.join(F.broadcast(starts), [key, "_part"], "left").select(
        *rows.columns,
        "_part",
        *[(F.coalesce(f"_from_{n}", F.lit(0)) + F.col(f"_run_{n}")).alias(n) for n in steps],
        *[F.coalesce(f"_whole_{n}", f"_own_{n}").alias(n) for n in totals],
    )
    return out if keep is None else out.filter(keep)
