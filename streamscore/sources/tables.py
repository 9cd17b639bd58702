"""Tables: dimension, scans by name, appends, clustered and latest-row copies."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamscore.functions.scalar import ntz
from streamscore.schemas import CAMPAIGN_COLUMNS, CAMPAIGNS

DATE_FOLDER = "event_date"


def load_campaigns(spark: SparkSession, path: str | None = None, created_at=None) -> DataFrame:
    """The campaign dimension, from a stored table or the seed rows."""
    if path is not None:
        return spark.read.parquet(path)
    rows = ", ".join(
        "('{}')".format("', '".join(v.replace("'", "''") for v in campaign))
        for campaign in CAMPAIGNS
    )
    seed = spark.sql(f"SELECT * FROM VALUES {rows}").toDF(*CAMPAIGN_COLUMNS[:-1])
    moment = F.localtimestamp() if created_at is None else ntz(created_at)
    return seed.withColumn("created_at", moment)


def read_table(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A table by name, from the catalog or from a folder of Parquet tables."""
    if folder is None:
        return spark.table(name)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def append_events(rows: DataFrame, path: str, by_date: bool = False) -> None:
    """Append a batch of events to a table, optionally in folders by event date."""
    writer = rows.write
    if by_date:
        writer = (
            rows.withColumn(DATE_FOLDER, F.to_date("event_ts"))
            .hint("rebalance", DATE_FOLDER)
            .write.partitionBy(DATE_FOLDER)
        )
    writer.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Events from `start` to `end`, both inclusive.

    On a table kept by date the bounds also select the folders, so that a week
    of features does not list or open the files of years.
    """
    events = spark.read.parquet(path)
    for bound, compare in ((start, operator.ge), (end, operator.le)):
        if bound is None:
            continue
        events = events.filter(compare(F.col("event_ts"), ntz(bound)))
        if DATE_FOLDER in events.columns:
            events = events.filter(compare(F.col(DATE_FOLDER), F.to_date(ntz(bound))))
    return events.drop(DATE_FOLDER)


def read_topic(
    spark: SparkSession, servers: str, topic: str, start_from: str = "earliest"
) -> DataFrame:
    """A topic as a stream, payload text in `value`; needs Spark's Kafka connector.

    `start_from` is "earliest" or "latest" and only matters to a job without a
    checkpoint.
    """
    if start_from not in ("earliest", "latest"):
        raise ValueError(f"start_from must be 'earliest' or 'latest', not {start_from!r}")
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start_from)
        .load()
    )
    return messages.select(
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
    )


def read_changes(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Rows appended to a table since the reading job last ran, as a stream.

    The job's checkpoint remembers which files were read.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_serving(
    rows: DataFrame, keys: Sequence[str], path: str, partitions: int | None = None
) -> None:
    """A copy laid out by `keys`, so that filters on them skip files and row groups.

    Ranges over all keys also part a hot leading value, such as one bucket that
    holds most users, over many files.
    """
    args = list(keys) if partitions is None else [partitions, *keys]
    rows.repartitionByRange(*args).sortWithinPartitions(*keys).write.mode("overwrite").parquet(
        path
    )


def publish(rows: DataFrame, keys: Sequence[str], path: str, version: int) -> None:
    """A clustered copy that replaces the served one as soon as it is complete.

    Every version has a folder of its own, so readers of the one before are not
    disturbed; a version that is published again is replaced, and versions older than
    the one before are dropped.
    """
    write_serving(rows, keys, f"{path.rstrip('/')}/version={version}")
    spark = rows.sparkSession
    for old in _versions(spark, path)[:-2]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={old}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, the newest last."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(
        int(status.getPath().getName().removeprefix("version="))
        for status in files.listStatus(folder)
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
    )


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete copy that `publish` wrote."""
    return spark.read.parquet(f"{path.rstrip('/')}/version={_versions(spark, path)[-1]}")


def latest_per_key(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest row of every key; the other columns break ties.

    The rank filter keeps one row per key inside each map task already.
    """
    rest = [c for c in rows.columns if c not in (key, ts)]
    newest_first = Window.partitionBy(key).orderBy(*[F.desc(c) for c in (ts, *rest)])
    ranked = rows.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.filter(F.col("_rank") == 1).select(key, *[c for c in rows.columns if c != key])
