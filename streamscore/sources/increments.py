"""Append-only tables for streams: one folder of rows per micro-batch.

A micro-batch only ever writes its own aggregated rows, to a folder named after it,
which a batch that is run again replaces. Readers combine the rows of all batches.

Compaction works in levels. The batches since the last one are combined into a run of
level 1, and `fan` runs of a level into one run of the next. A compaction rewrites the
runs it combines and nothing else, so most of them write what a few batches brought,
however large the table is, and a row is rewritten once per level. A folder counts once
Spark has marked it as complete; runs that a newer one contains stay until the next
compaction, for readers that have them open.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamscore.sources.storage import empty

Combine = Callable[[DataFrame], DataFrame]
Follow = Callable[[DataFrame, DataFrame, int], DataFrame]

# Runs of a level that make one run of the next.
FAN = 8


class Run(NamedTuple):
    """The rows of the batches from `first` to `last`; a single batch has level 0."""

    level: int
    first: int
    last: int

    def inside(self, other: Run) -> bool:
        return self.level < other.level and other.first <= self.first and self.last <= other.last


class IncrementTable:
    """Rows of `increment` per batch, read as rows of `schema`.

    Give `combine` if batches can be combined in any grouping; it gets rows with the last
    batch they came from in `_batch`. Give `follow` and `key` if they must be applied one
    after the other; it gets the state so far, the rows of a batch and its number, and
    returns the state. Runs then hold the rows of the keys that their batches touched, of
    which the newest counts. `part` is an optional folder of a row by which readers can
    prune, such as its day.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        combine: Combine | None = None,
        follow: Follow | None = None,
        increment: T.StructType | None = None,
        part: Column | None = None,
        key: Collection[str] = (),
        fan: int = FAN,
    ):
        if (combine is None) == (follow is None):
            raise ValueError("give either combine or follow")
        if (follow is None) == bool(key):
            raise ValueError("follow needs a key, combine none")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.combine, self.follow, self.part = combine, follow, part
        self.increment, self.key, self.fan = increment or schema, list(key), fan

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _folder(self, run: Run) -> str:
        return f"{self.path}/_level={run.level}/_run={run.first}_{run.last}"

    def _delete(self, run: Run) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(run))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _runs(self) -> list[Run]:
        """All complete runs, in the order of their batches."""
        runs = []
        for level in self._names(self.path):
            for name in self._names(f"{self.path}/{level}"):
                first, last = name.removeprefix("_run=").split("_")
                runs.append(Run(int(level.removeprefix("_level=")), int(first), int(last)))
        done = [r for r in runs if "_SUCCESS" in self._names(self._folder(r))]
        return sorted(done, key=lambda r: r.last)

    def runs(self) -> list[Run]:
        """The runs that make up the table now."""
        runs = self._runs()
        return [r for r in runs if not any(r.inside(other) for other in runs)]

    def batches(self) -> list[int]:
        """Batches that are not part of a compacted run."""
        return [r.last for r in self.runs() if r.level == 0]

    def holds_anything(self) -> bool:
        return bool(self._runs())

    def _write(self, rows: DataFrame, schema: T.StructType, run: Run) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
        if self.part is None:
            rows.select(columns).write.mode("overwrite").parquet(self._folder(run))
        else:
            placed = rows.select(*columns, self.part.alias("_part")).hint("rebalance", "_part")
            placed.write.mode("overwrite").partitionBy("_part").parquet(self._folder(run))

    def write(self, rows: DataFrame, batch: int) -> None:
        """Store the rows of a batch, in place of those it may have stored before."""
        self._write(rows, self.increment, Run(0, batch, batch))

    def _scan(
        self,
        runs: Collection[Run],
        schema: T.StructType,
        parts: Collection[str] | None = None,
        since: str | None = None,
    ) -> DataFrame:
        """Rows of some runs in one scan, with the last batch of their run."""
        if not runs:
            return empty(self.spark, schema).withColumn("_batch", F.lit(None).cast("bigint"))
        folders = ["_run"] if self.part is None else ["_run", "_part"]
        placed = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in folders]])
        reader = self.spark.read.option("basePath", self.path).schema(placed)
        rows = reader.parquet(*map(self._folder, runs))
        if self.part is not None and parts is not None:
            rows = rows.filter(F.col("_part").isin(*parts))
        if self.part is not None and since is not None:
            rows = rows.filter(F.col("_part") >= since)
        batch = F.split("_run", "_")[1].cast("bigint").alias("_batch")
        return rows.select(*[f.name for f in schema.fields], batch)

    def _newest(self, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*self.key).orderBy(F.desc("_batch"))
        ranked = rows.withColumn("_rank", F.row_number().over(order))
        return ranked.filter(F.col("_rank") == 1).drop("_rank", "_batch")

    def _followed(self, state: DataFrame, batches: Collection[Run], **where) -> DataFrame:
        for run in batches:
            rows = self._scan([run], self.increment, **where).drop("_batch")
            state = self.follow(state, rows, run.last)
        return state

    def read(self, parts: Collection[str] | None = None, since: str | None = None) -> DataFrame:
        """Current rows, optionally of some parts only, or of `since` and later ones."""
        where = {"parts": parts, "since": since}
        runs, names = self.runs(), [f.name for f in self.schema.fields]
        if self.combine is not None:
            return self.combine(self._scan(runs, self.schema, **where)).select(names)
        state = self._newest(self._scan([r for r in runs if r.level], self.schema, **where))
        return self._followed(state, [r for r in runs if not r.level], **where).select(names)

    def rows_of(self, batch: int) -> DataFrame:
        """The rows that a batch has stored, while it is not compacted."""
        return self._scan([Run(0, batch, batch)], self.increment).drop("_batch")

    def _merged(self, runs: list[Run]) -> DataFrame:
        """One run's rows out of several of one level that follow each other."""
        if self.combine is not None:
            return self.combine(self._scan(runs, self.schema))
        if runs[0].level:
            return self._newest(self._scan(runs, self.schema))
        older = [r for r in self.runs() if r.level]
        touched = self._scan(runs, self.increment).select(self.key).distinct()
        state = self._newest(self._scan(older, self.schema))
        return self._followed(state.join(touched, self.key, "left_semi"), runs)

    def compact(self) -> None:
        """Combine the newest batches, and then runs of a level of which there are enough."""
        runs = self.runs()
        replaced = [r for r in self._runs() if r not in runs]
        level = 0
        while True:
            own = [r for r in self.runs() if r.level == level]
            if len(own) < (self.fan if level else 1):
                break
            self._write(self._merged(own), self.schema, Run(level + 1, own[0].first, own[-1].last))
            level += 1
        for run in replaced if level else []:
            self._delete(run)
