"""Training, comparing and applying propensity models."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from streamscore.functions.scalar import count_if, ratio, score_bucket
from streamscore.operators.boosting import BoostedTrees
from streamscore.operators.features import MODEL_FEATURES, training_frame
from streamscore.sources.registry import ModelRegistry
from streamscore.sources.storage import drop_folder, shared_dir

SEED = 42
TRAIN_SHARE = 0.7

# A model this good has separated the classes outright and is not trusted.
MAX_AUC = 0.999

BOARD = "model string, roc_auc double, accuracy double, f1 double"


def stratified_split(
    training: DataFrame, share: float = TRAIN_SHARE, seed: int = SEED
) -> DataFrame:
    """Mark rows train or test, with the same share of each class to the row.

    Users are ordered by a hash within their class. Counts per leading hash
    digits tell where the cut falls, so rows are ranked only among the few that
    share those digits, never a whole class at once.
    """
    hashed = training.withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col("user_id")))
    ).withColumn("_head", F.substring("_hash", 1, 3))
    by_class = Window.partitionBy("converted")
    # At most 4096 rows per class.
    heads = (
        hashed.groupBy("converted", "_head")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "converted",
            "_head",
            (F.sum("_n").over(by_class.orderBy("_head")) - F.col("_n")).alias("_before"),
            F.floor(F.sum("_n").over(by_class) * F.lit(share) + 0.5).alias("_cut"),
        )
    )
    rank = F.row_number().over(
        Window.partitionBy("converted", "_head").orderBy("_hash", "user_id")
    )
    return (
        hashed.withColumn("_rank", rank)
        .join(F.broadcast(heads), ["converted", "_head"])
        .withColumn(
            "split",
            F.when(F.col("_before") + F.col("_rank") <= F.col("_cut"), "train").otherwise("test"),
        )
        .select(*training.columns, "split")
    )


def candidates(n_rows: int, rounds: int = 200, trees: int = 200) -> dict[str, Pipeline]:
    """Four model families over the same ten features.

    The two boosted families are one algorithm with the usual settings of two libraries:
    large steps with a penalty on leaves, and small ones with a fewest number of rows.
    """
    assemble = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="raw_features")
    scale = StandardScaler(
        inputCol="raw_features", outputCol="features", withMean=True, withStd=True
    )
    logreg = LogisticRegression(
        labelCol="converted",
        regParam=1.0 / (0.05 * max(n_rows, 1)),
        standardization=False,
        maxIter=2000,
    )
    tree_input = {"featuresCol": "raw_features", "labelCol": "converted", "seed": SEED}
    forest = RandomForestClassifier(numTrees=trees, **tree_input)
    boosted = {"inputCols": MODEL_FEATURES, "labelCol": "converted", "rounds": rounds, "maxDepth": 4}
    large_steps = BoostedTrees(stepSize=0.3, l2=1.0, minCurvature=1.0, minRows=1, maxLeaves=16, **boosted)
    small_steps = BoostedTrees(stepSize=0.1, l2=0.0, minCurvature=1e-3, minRows=20, maxLeaves=31, **boosted)
    return {
        "logreg_reg": Pipeline(stages=[assemble, scale, logreg]),
        "random_forest": Pipeline(stages=[assemble, forest]),
        "gbt_fast": Pipeline(stages=[large_steps]),
        "gbt_slow": Pipeline(stages=[small_steps]),
    }


def evaluate(predictions: DataFrame) -> dict[str, float]:
    """AUC, accuracy, and F1 of the positive class (zero when undefined)."""
    auc = BinaryClassificationEvaluator(
        labelCol="converted", rawPredictionCol="probability", numBins=0
    ).evaluate(predictions)
    predicted, actual = F.col("prediction") == 1, F.col("converted") == 1
    tp, wrong = count_if(predicted & actual), count_if(predicted != actual)
    scores = predictions.agg(
        F.avg((predicted == actual).cast("double")).alias("accuracy"),
        F.coalesce(ratio(2 * tp, 2 * tp + wrong), F.lit(0.0)).alias("f1"),
    ).first()
    return {"roc_auc": auc, "accuracy": scores["accuracy"], "f1": scores["f1"]}


def _side_by_side(spark: SparkSession, work: dict[str, Callable]) -> dict:
    """The results of independent pieces of work, each in a thread of its own."""
    with ThreadPoolExecutor(max(1, len(work))) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(do)) for name, do in work.items()}
        return {name: done.result() for name, done in running.items()}


def without_summary(spark: SparkSession, model: PipelineModel) -> PipelineModel:
    """The model without summaries of its training, which hold the session.

    Tasks carry the whole model, and a session that has ever had a tag or an observation
    cannot be serialised. Saved models have no summary, so the model is saved and read back.
    """
    if not any(getattr(stage, "hasSummary", False) for stage in model.stages):
        return model
    path = shared_dir(spark, "model")
    model.write().save(path)
    try:
        return PipelineModel.load(path)
    finally:
        drop_folder(spark, path)


def train_candidates(
    training: DataFrame, pipelines: dict[str, Pipeline]
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit all candidates on the train rows; models and leaderboard by AUC.

    The families are fitted and evaluated side by side, since the many short jobs of one
    leave most executors idle.
    """
    spark = training.sparkSession
    train = training.filter(F.col("split") == "train").persist(StorageLevel.MEMORY_AND_DISK)
    test = training.filter(F.col("split") == "test").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train.count()
        test.count()

        def raced(pipeline: Pipeline) -> tuple[PipelineModel, dict[str, float]]:
            model = without_summary(spark, pipeline.fit(train))
            return model, evaluate(model.transform(test))

        done = _side_by_side(spark, {name: partial(raced, p) for name, p in pipelines.items()})
        models = {name: model for name, (model, _) in done.items()}
        rows = [Row(model=name, **metrics) for name, (_, metrics) in done.items()]
    finally:
        train.unpersist()
        test.unpersist()
    board = spark.createDataFrame(
        [(r.model, r.roc_auc, r.accuracy, r.f1) for r in rows], BOARD
    )
    return models, board.orderBy(F.desc("roc_auc"), "model")


def select_champion(board: DataFrame) -> Row:
    """Best F1 among models that are not suspiciously perfect, if any is left."""
    suspicious = F.col("roc_auc") >= MAX_AUC
    return board.orderBy(suspicious, F.desc("f1"), F.desc("roc_auc"), "model").first()


def user_propensity(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Score table made by a trained model; the feature row's time is kept."""
    inputs = features.select(
        "user_id", "last_updated", *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES]
    )
    positive = vector_to_array("probability")[1]
    return (
        model.transform(inputs)
        .select("user_id", positive.alias("propensity_score"), "last_updated")
        .select(
            "user_id",
            "propensity_score",
            score_bucket("propensity_score").alias("score_bucket"),
            "last_updated",
        )
    )


def retrain(
    features: DataFrame,
    registry: ModelRegistry,
    run_tag: str,
    rounds: int = 200,
    trees: int = 200,
) -> str:
    """Train all families, log the runs, register and promote the champion."""
    training = stratified_split(training_frame(features)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_train = training.filter(F.col("split") == "train").count()
        pipelines = candidates(n_train, rounds, trees)
        models, board = train_candidates(training, pipelines)
    finally:
        training.unpersist()
    for row in board.collect():
        stages = pipelines[row["model"]].getStages()
        params = {
            f"{type(s).__name__}.{p.name}": str(v)
            for s in stages
            for p, v in s.extractParamMap().items()
        }
        metrics = {m: row[m] for m in ("roc_auc", "accuracy", "f1")}
        registry.log_run(f"{row['model']}_{run_tag}", params, metrics)
    champion = select_champion(board)
    version = registry.register(
        models[champion["model"]],
        champion=champion["model"],
        metrics={m: champion[m] for m in ("roc_auc", "accuracy", "f1")},
        training_rows=n_train,
        run_tag=run_tag,
    )
    registry.promote(version)
    return version
