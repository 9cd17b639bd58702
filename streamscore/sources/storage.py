"""Where intermediate tables live, and tables that need no storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name in the folder named by `spark.checkpoint.dir`.

    Sessions without that setting use their warehouse folder. Nothing is set or
    created here, and both are shared by the executors of a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/streamscore"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the folder of a table that `stored` returned, once nothing reads it any more."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, in a form the optimizer recognises and removes from joins."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).filter(F.lit(False)).select(columns)


def literal_rows(spark: SparkSession, column: str, values: list) -> DataFrame:
    """A one-column table of a few fixed values."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
