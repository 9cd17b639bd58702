"""Saved model pipelines as one column expression.

A pipeline of an assembler, an optional scaler and a binary classifier (logistic
regression, random forest or boosted trees) is read from its folder and becomes SQL text
over the feature columns: a tree is a nested CASE, a forest a sum over an array of trees.
Scoring then runs in whole-stage code beside the rest of the query, without loading the
model into closures, and works on streams as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from streamscore.functions.scalar import score_bucket
from streamscore.operators.boosting import probability_sql


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _stages(spark: SparkSession, path: str) -> list[tuple[str, dict]]:
    """Folder and metadata of every stage, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stages")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    out = []
    for name in sorted(names, key=lambda n: int(n.split("_")[0])):
        stage = f"{path}/stages/{name}"
        out.append((stage, json.loads(spark.read.text(f"{stage}/metadata").first()["value"])))
    return out


def _param(metadata: dict, name: str):
    return metadata["paramMap"].get(name, metadata["defaultParamMap"].get(name))


def _scaled(inputs: list[str], data: Row, metadata: dict) -> list[str]:
    out = []
    for x, mean, std in zip(inputs, data["mean"], data["std"], strict=True):
        if _param(metadata, "withMean"):
            x = f"({x} - {_number(mean)})"
        if _param(metadata, "withStd"):
            x = f"({x} * {_number(1 / std if std else 0.0)})"
        out.append(x)
    return out


def _logistic(inputs: list[str], data: Row) -> str:
    if data["numClasses"] != 2 or data["isMultinomial"]:
        raise ValueError("only binary logistic regression can be compiled")
    weights = data["coefficientMatrix"].toArray()[0]
    terms = [f"{_number(w)} * {x}" for w, x in zip(weights, inputs, strict=True)]
    margin = " + ".join([_number(data["interceptVector"][0]), *terms])
    return f"1D / (1D + exp(-({margin})))"


def _tree(nodes: dict[int, Row], inputs: list[str], leaf: Callable[[Row], float], at: int = 0) -> str:
    node = nodes[at]
    if node["leftChild"] < 0:
        return _number(leaf(node))
    split = node["split"]
    if split["numCategories"] >= 0:
        raise ValueError("only splits of numbers can be compiled")
    threshold = _number(split["leftCategoriesOrThreshold"][0])
    left, right = (_tree(nodes, inputs, leaf, node[side]) for side in ("leftChild", "rightChild"))
    return f"CASE WHEN {inputs[split['featureIndex']]} <= {threshold} THEN {left} ELSE {right} END"


def _positive(node: Row) -> float:
    total = sum(node["impurityStats"])
    return node["impurityStats"][1] / total if total else 0.0


def _trees(spark: SparkSession, stage: str, inputs: list[str], leaf, weighted: bool) -> tuple[str, int]:
    """The sum of all trees and their number; the model, not the data, bounds what is collected."""
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{stage}/treesMetadata").collect()}
    nodes: dict[int, dict[int, Row]] = {}
    for row in spark.read.parquet(f"{stage}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    trees = []
    for number in sorted(nodes):
        weight = weights[number] if weighted else 1.0
        trees.append(_tree(nodes[number], inputs, lambda node, w=weight: w * leaf(node)))
    return f"aggregate(array({', '.join(trees)}), 0D, (total, tree) -> total + tree)", len(trees)


def compiled_probability(spark: SparkSession, path: str) -> Column:
    """Probability of the positive class, as the pipeline saved in `path` gives it.

    NULL or NaN in a feature makes the probability NULL, where the pipeline itself would fail.
    """
    columns: dict[str, list[str]] = {}
    names: list[str] = []
    for stage, metadata in _stages(spark, path.rstrip("/")):
        kind = metadata["class"].rpartition(".")[2]
        if kind == "VectorAssembler":
            names = _param(metadata, "inputCols")
            columns[_param(metadata, "outputCol")] = [f"CAST(`{c}` AS DOUBLE)" for c in names]
            continue
        if kind == "StandardScalerModel":
            data = spark.read.parquet(f"{stage}/data").first()
            inputs = columns[_param(metadata, "inputCol")]
            columns[_param(metadata, "outputCol")] = _scaled(inputs, data, metadata)
            continue
        if kind == "BoostedTreesModel":
            names = _param(metadata, "inputCols")
            columns["boosted"] = [f"CAST(`{c}` AS DOUBLE)" for c in names]
        inputs = columns.get("boosted") or columns.get(_param(metadata, "featuresCol"))
        if kind == "BoostedTreesModel":
            score = probability_sql(json.loads(_param(metadata, "ensemble")), inputs)
        elif kind == "LogisticRegressionModel":
            score = _logistic(inputs, spark.read.parquet(f"{stage}/data").first())
        elif kind == "RandomForestClassificationModel":
            votes, n = _trees(spark, stage, inputs, _positive, weighted=False)
            score = f"{votes} / {_number(n)}"
        elif kind == "GBTClassificationModel":
            margin, _ = _trees(spark, stage, inputs, lambda node: node["prediction"], weighted=True)
            score = f"1D / (1D + exp(-2D * {margin}))"
        else:
            raise ValueError(f"a pipeline with a {kind} cannot be compiled")
        missing = " OR ".join(f"`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE))" for c in names)
        return F.expr(f"CASE WHEN {missing} THEN NULL ELSE {score} END")
    raise ValueError("the pipeline has no classifier")


def compiled_scores(features: DataFrame, probability: Column) -> DataFrame:
    """Score table of `user_propensity`, with a compiled model instead of a loaded one."""
    scored = features.select("user_id", probability.alias("propensity_score"), "last_updated")
    return scored.select(
        "user_id", "propensity_score", score_bucket("propensity_score").alias("score_bucket"), "last_updated"
    )
