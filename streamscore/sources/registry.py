"""Saved models with versions, metrics, runs and a default."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamscore.functions.scalar import version_number

VERSIONS = (
    "version string, champion string, roc_auc double, accuracy double, f1 double, "
    "training_rows bigint, run_tag string, comment string, registered_at timestamp_ntz"
)
PROMOTIONS = "version string, step bigint"
RUNS = (
    "run string, params map<string, string>, metrics map<string, double>, "
    "logged_at timestamp_ntz"
)


def next_version(names: DataFrame) -> str:
    """Name after the highest `V<n>` among column `version`; V1 to begin with."""
    used = names.agg(F.max(version_number("version")).alias("n")).first()["n"]
    return f"V{(used or 0) + 1}"


class ModelRegistry:
    """A folder with one saved pipeline per version and three small tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, name: str, row: tuple, schema: str, stamp: str | None = None) -> None:
        rows = self.spark.createDataFrame([row], schema)
        if stamp is not None:
            rows = rows.withColumn(stamp, F.localtimestamp())
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def versions(self) -> DataFrame:
        """All versions with their metrics, and which one is the default."""
        default = self.default_version()
        return self._read("versions", VERSIONS).withColumn(
            "is_default", F.col("version").eqNullSafe(F.lit(default))
        )

    def register(
        self,
        model: PipelineModel,
        champion: str,
        metrics: dict[str, float],
        training_rows: int,
        run_tag: str,
    ) -> str:
        """Save a model under the next free version."""
        version = next_version(self._read("versions", VERSIONS))
        model.write().overwrite().save(f"{self.path}/models/{version}")
        comment = f"{champion} had the best F1 of its race"
        values = [float(metrics[m]) for m in ("roc_auc", "accuracy", "f1")]
        row = (version, champion, *values, training_rows, run_tag, comment, None)
        self._append("versions", row, VERSIONS, stamp="registered_at")
        return version

    def promote(self, version: str) -> None:
        """Make a registered version the default."""
        known = self._read("versions", VERSIONS).filter(F.col("version") == version)
        if known.isEmpty():
            raise ValueError(f"version {version!r} is not registered")
        last = self._read("promotions", PROMOTIONS).agg(F.max("step").alias("step")).first()
        step = 0 if last["step"] is None else last["step"] + 1
        self._append("promotions", (version, step), PROMOTIONS)

    def default_version(self) -> str | None:
        latest = self._read("promotions", PROMOTIONS).agg(
            F.max_by("version", "step").alias("version")
        )
        return latest.first()["version"]

    def model_path(self, version: str | None = None) -> str:
        """Folder of a version's saved pipeline, of the default one if none is given."""
        version = version or self.default_version()
        if version is None:
            raise LookupError("no version has been promoted")
        return f"{self.path}/models/{version}"

    def load(self, version: str) -> PipelineModel:
        return PipelineModel.load(self.model_path(version))

    def load_default(self) -> PipelineModel:
        return PipelineModel.load(self.model_path())

    def log_run(self, run: str, params: dict[str, str], metrics: dict[str, float]) -> None:
        self._append("runs", (run, params, metrics, None), RUNS, stamp="logged_at")

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)
