"""Session settings the package relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

# Timestamps are stored without a zone and mean UTC. Hot keys in joins are split
# by adaptive execution, so it must stay on.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator assumes to an existing session.

    Python workers look for this package where the driver found it. On a cluster
    whose machines do not have it there, ship it with the job as usual.
    """
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def local_session(cores: str | int = "*", app: str = "streamscore", **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
