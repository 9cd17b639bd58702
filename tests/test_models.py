import random

import pytest
from pyspark.sql import functions as F

from streamscore.operators import ml, monitor
from streamscore.operators.features import MODEL_FEATURES
from streamscore.schemas import USER_FEATURES
from streamscore.sources.registry import ModelRegistry, next_version


@pytest.fixture(scope="module")
def features(spark):
    """Users whose conversions follow their clicks; impressions say nothing."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        clicks = rng.randint(0, 20)
        converted = int(clicks + rng.gauss(0, 4) > 11)
        row = {f.name: 0 for f in USER_FEATURES.fields}
        row |= {"user_id": f"U{i:04d}", "clicks_7d": clicks, "impressions_7d": rng.randint(0, 20)}
        row |= {"conversions_total": converted, "event_velocity_24h": 1.0}
        row |= {"last_conversion_ts": None, "time_since_last_conversion_hrs": None, "last_updated": None}
        rows.append(tuple(row[f.name] for f in USER_FEATURES.fields))
    return spark.createDataFrame(rows, USER_FEATURES)


def test_split_is_exact_per_class_and_repeatable(features):
    training = ml.training_frame(features)
    split = ml.stratified_split(training)
    counts = {
        (r["converted"], r["split"]): r["count"]
        for r in split.groupBy("converted", "split").count().collect()
    }
    for label in (0, 1):
        total = counts[label, "train"] + counts[label, "test"]
        assert counts[label, "train"] == int(total * 0.7 + 0.5)
    again = ml.stratified_split(training.repartition(5))
    assert sorted(split.select("user_id", "split").collect()) == sorted(
        again.select("user_id", "split").collect()
    )
    other = ml.stratified_split(training, seed=1)
    assert sorted(other.select("user_id", "split").collect()) != sorted(
        split.select("user_id", "split").collect()
    )


def test_four_families_with_the_published_settings():
    pipelines = ml.candidates(1000)
    assert len(pipelines) == 4
    logreg = pipelines["logreg_reg"].getStages()[-1]
    assert logreg.getRegParam() == pytest.approx(1 / 50)
    assert pipelines["random_forest"].getStages()[-1].getNumTrees() == 200
    assert pipelines["gbt_fast"].getStages()[-1].getMaxIter() == 200


def test_metrics(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(1, 1.0, 0.9), (1, 0.0, 0.4), (0, 0.0, 0.3), (0, 1.0, 0.8), (0, 0.0, 0.1)]
    data = [(y, p, Vectors.dense([1 - s, s])) for y, p, s in rows]
    got = ml.evaluate(spark.createDataFrame(data, ["converted", "prediction", "probability"]))
    assert got["accuracy"] == pytest.approx(3 / 5)
    assert got["f1"] == pytest.approx(0.5)
    assert got["roc_auc"] == pytest.approx(5 / 6)
    none = [(y, 0.0, v) for y, _, v in data]
    assert ml.evaluate(spark.createDataFrame(none, ["converted", "prediction", "probability"]))["f1"] == 0.0


@pytest.mark.parametrize(
    "board,champion",
    [
        ([("a", 0.9, 0.9, 0.5), ("b", 0.8, 0.9, 0.6)], "b"),
        ([("a", 0.999, 1.0, 1.0), ("b", 0.8, 0.9, 0.1)], "b"),
        ([("a", 1.0, 1.0, 0.9), ("b", 0.9995, 0.9, 1.0)], "b"),
        ([("a", 0.9, 0.9, 0.6), ("b", 0.8, 0.9, 0.6)], "a"),
    ],
)
def test_champion_rule(spark, board, champion):
    assert ml.select_champion(spark.createDataFrame(board, ml.BOARD))["model"] == champion


def test_next_version(spark):
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "version string")
    assert next_version(names()) == "V1"
    assert next_version(names("V1", "V9", "v10", "Vx", "best")) == "V11"


def test_retraining_registers_promotes_and_scores(spark, features, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "registry"))
    with pytest.raises(LookupError):
        registry.load_default()
    assert ml.retrain(features, registry, "t1", rounds=3, trees=5) == "V1"
    assert ml.retrain(features, registry, "t2", rounds=3, trees=5) == "V2"
    assert registry.default_version() == "V2"
    registry.promote("V1")
    listed = {r["version"]: r for r in registry.versions().collect()}
    assert listed["V1"]["is_default"] and not listed["V2"]["is_default"]
    assert 0.7 < listed["V1"]["roc_auc"] < 0.999
    assert registry.runs().count() == 8
    with pytest.raises(ValueError):
        registry.promote("V7")

    scores = ml.user_propensity(features, registry.load_default())
    assert scores.columns == ["user_id", "propensity_score", "score_bucket", "last_updated"]
    joined = scores.join(features, "user_id")
    by_clicks = joined.groupBy((F.col("clicks_7d") > 15).alias("many")).agg(
        F.avg("propensity_score").alias("s")
    )
    means = {r["many"]: r["s"] for r in by_clicks.collect()}
    assert means[True] > means[False] + 0.3


def test_models_train_and_score_in_sessions_with_tags_and_observations(spark, features):
    from pyspark.sql import Observation

    session = spark.newSession()
    session.addTag("weekly")
    counted = Observation("users")
    session.range(3).observe(counted, F.count(F.lit(1)).alias("n")).collect()
    assert counted.get == {"n": 3}
    rows = session.createDataFrame(features.collect(), features.schema)
    training = ml.stratified_split(ml.training_frame(rows))
    models, board = ml.train_candidates(training, ml.candidates(210, rounds=2, trees=3))
    assert sorted(r["model"] for r in board.collect()) == sorted(models)
    for model in models.values():
        assert ml.user_propensity(rows, model).agg(F.count("propensity_score")).first()[0] == 300


def test_retraining_in_a_tagged_session(spark, features, tmp_path):
    from streamscore.operators import compiled

    session = spark.newSession()
    session.addTag("weekly")
    rows = session.createDataFrame(features.collect(), features.schema)
    registry = ModelRegistry(session, str(tmp_path / "registry"))
    assert ml.retrain(rows, registry, "t1", rounds=2, trees=3) == "V1"
    scores = compiled.compiled_scores(rows, compiled.compiled_probability(session, registry.model_path()))
    assert scores.agg(F.count("propensity_score")).first()[0] == 300


@pytest.mark.parametrize("family", ["logreg_reg", "random_forest", "gbt_fast", "gbt_slow", "spark_gbt"])
def test_compiled_models_score_like_the_saved_pipeline(spark, features, tmp_path, family):
    from pyspark.ml import PipelineModel

    from streamscore.operators import compiled

    training = ml.training_frame(features)
    if family == "spark_gbt":
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        assemble = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="raw")
        boosted = GBTClassifier(featuresCol="raw", labelCol="converted", maxIter=5, maxDepth=3)
        pipeline = Pipeline(stages=[assemble, boosted])
    else:
        pipeline = ml.candidates(300, rounds=12, trees=25)[family]
    path = str(tmp_path / "model")
    pipeline.fit(training).save(path)
    probability = compiled.compiled_probability(spark, path)
    got = compiled.compiled_scores(features, probability)
    want = ml.user_propensity(features, PipelineModel.load(path))
    assert got.columns == want.columns and got.schema["propensity_score"].dataType.typeName() == "double"
    want = {r["user_id"]: r for r in want.collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 300
    for row in rows:
        assert row["propensity_score"] == pytest.approx(want[row["user_id"]]["propensity_score"], abs=1e-12)
        assert row["score_bucket"] == want[row["user_id"]]["score_bucket"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan
    odd = features.limit(2).withColumn("clicks_7d", F.lit(None).cast("long"))
    odd = compiled.compiled_scores(odd, probability).collect()
    assert [(r["propensity_score"], r["score_bucket"]) for r in odd] == [(None, "LOW")] * 2


def test_pipelines_that_cannot_be_compiled(spark, features, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    from streamscore.operators import compiled

    for name, stage in (
        ("sql", SQLTransformer(statement="SELECT 1 AS x FROM __THIS__")),
        ("none", VectorAssembler(inputCols=["clicks_7d"], outputCol="f")),
    ):
        Pipeline(stages=[stage]).fit(features).save(str(tmp_path / name))
        with pytest.raises(ValueError):
            compiled.compiled_probability(spark, str(tmp_path / name))


def log_of(spark, rows):
    return spark.createDataFrame(
        rows, "predicted_score double, predicted_label int, actual_converted int, ts string"
    ).select("predicted_score", "predicted_label", "actual_converted", F.col("ts").cast("timestamp_ntz").alias("scored_at"))


def test_monitor_per_day(spark):
    day_1, day_2 = "2024-01-01 05:00:00", "2024-01-02 23:00:00"
    log = log_of(spark, [(0.9, 1, 1, day_1), (0.2, 0, 0, day_1), (0.95, 1, 0, day_2), (1.0, 1, 0, day_2)])
    baseline = log.filter(F.col("scored_at") < "2024-01-02")
    rows = {r["day"].day: r for r in monitor.monitor(log, baseline).collect()}
    assert rows[1]["psi"] == pytest.approx(0.0) and rows[1]["f1"] == 1.0
    assert rows[2]["psi"] > 0.25 and rows[2]["f1"] == 0.0
    assert rows[2]["recall"] is None and rows[2]["precision"] == 0.0
    assert rows[2]["false_positives"] == 2


def test_quantile_drift_against_plain_python(spark):
    import math

    rng = random.Random(9)
    scores = [round(rng.choice([rng.random() ** 4, 0.05, 0.05, 1.0]), 4) for _ in range(700)]
    days = [[s for s in scores[:300]], [min(1.0, s * 1.3 + 0.001) for s in scores[300:]], [None, 0.5]]
    rows = [(s, 0, 0, f"2024-01-0{d + 1} 05:00:00") for d, some in enumerate(days) for s in some]
    log = log_of(spark, rows)
    base = days[0]
    parts = [log_of(spark, [(s, 0, 0, "2024-01-01 00:00:00") for s in base[a::3]]) for a in range(3)]
    summary = monitor.add_summaries(*map(monitor.score_summary, parts))
    cell = lambda s: min(math.floor(s * 10_000), 9_999)
    cells = sorted(map(cell, base))
    edges = []
    for b in range(1, 10):
        edges += [c for c in cells if sum(x < c for x in cells) * 10 >= b * len(cells)][:1]
    shares = lambda some: [
        max(sum(sum(e <= cell(s) for e in edges) == b for s in some) / len(some), 0.0001) for b in range(10)
    ]
    then = shares(base)
    got = {r["day"].day: r for r in monitor.quantile_drift(log, summary).collect()}
    for d, some in enumerate(days):
        some = [s for s in some if s is not None]
        want = sum((p - q) * math.log(p / q) for p, q in zip(shares(some), then))
        assert got[d + 1]["scores"] == len(some) and got[d + 1]["psi"] == pytest.approx(want, abs=1e-12)
    assert got[1]["psi"] == pytest.approx(0, abs=1e-12) and got[2]["psi"] > 0.05
    none = monitor.quantile_drift(log, monitor.score_summary(log.limit(0))).collect()
    assert len(none) == 3 and all(r["psi"] is None for r in none)
    assert monitor.quantile_drift(log.filter("predicted_score is null"), summary).first()["psi"] is None


def test_monitor_without_scores(spark):
    day_1, day_2 = "2024-01-01 05:00:00", "2024-01-02 23:00:00"
    log = log_of(spark, [(None, 0, 0, day_1), (0.95, 1, 0, day_2)])
    rows = {r["day"].day: r for r in monitor.monitor(log, log.filter("predicted_score > 0.9")).collect()}
    assert rows[1]["psi"] is None and rows[1]["mean_score"] is None
    assert rows[2]["psi"] == pytest.approx(0.0)
    rows = monitor.monitor(log, log.limit(0)).collect()
    assert len(rows) == 2 and all(r["psi"] is None for r in rows)


def test_a_snapshot_logged_again_replaces_itself(spark, features, tmp_path):
    scores = features.select("user_id", F.lit(0.5).alias("propensity_score"))
    path = str(tmp_path / "log")
    for _ in range(2):
        said = monitor.log_inferences(scores, features, "2024-01-01 00:00:00", path)
        assert said == "Logged 300 inference rows"
        monitor.log_inferences(scores, features, "2024-01-01 01:00:00", path, "V2")
    log = spark.read.parquet(path)
    assert log.groupBy("snapshot").count().count() == 2
    assert log.filter(F.col("predicted_label") == 1).count() == 600
    assert {r[0] for r in log.select("model_version").distinct().collect()} == {"V1", "V2"}
    assert len(MODEL_FEATURES) == 10


def boosting_rows(spark, n=1500, seed=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(6)), rng.choice([0.0, rng.random() * 50])
        rows.append((a, b, c, float(a * (b - 2) + c / 20 + rng.gauss(0, 0.7) > 0.5)))
    return spark.createDataFrame(rows, "a double, b double, `c d` double, label double"), rows


def numpy_boosting(rows, edges, rounds, depth, leaves, step, l2, min_h, min_n):
    """Leaf-wise growth over raw values; margins of all rows."""
    import math

    import numpy as np

    data = np.array(rows)
    x, y = data[:, :3], data[:, 3]
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * 2**24) / 2**24, np.rint(p * (1 - p) * 2**24) / 2**24

        def split(mask, g=g, h=h):
            best, whole = None, g[mask].sum() ** 2 / (h[mask].sum() + l2)
            for f in range(3):
                for e in edges[f]:
                    sides = [mask & (x[:, f] <= e), mask & (x[:, f] > e)]
                    if any(s.sum() < min_n or h[s].sum() < min_h for s in sides):
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in sides) - whole
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = gain, sides
            return best

        grown = [(np.ones(len(y), dtype=bool), 0)]
        found = [split(grown[0][0])]
        while len(grown) < leaves:
            options = [(f[0], -i) for i, f in enumerate(found) if f is not None]
            if not options:
                break
            i = -max(options)[1]
            level = grown[i][1] + 1
            sides = found[i][1]
            grown[i : i + 1] = [(s, level) for s in sides]
            found[i : i + 1] = [split(s) if level < depth else None for s in sides]
        for mask, _ in grown:
            margin = margin + np.where(mask, -step * g[mask].sum() / (h[mask].sum() + l2), 0.0)
    return margin


@pytest.mark.parametrize("leaves,step,l2,min_h,min_n", [(16, 0.3, 1.0, 1.0, 1), (5, 0.1, 0.0, 1e-3, 20)])
def test_boosted_trees_equal_leaf_wise_growth_in_numpy(spark, monkeypatch, leaves, step, l2, min_h, min_n):
    import json

    import numpy as np

    from streamscore.operators import boosting

    monkeypatch.setattr(boosting, "STORED_EVERY", 2)
    monkeypatch.setattr(boosting, "BINS", 24)
    table, rows = boosting_rows(spark)
    settings = dict(
        inputCols=["a", "b", "c d"], rounds=5, maxLeaves=leaves, stepSize=step, l2=l2, minCurvature=min_h, minRows=min_n
    )
    model = boosting.BoostedTrees(**settings).fit(table.repartition(3))
    ensemble = json.loads(model.getOrDefault("ensemble"))
    want = numpy_boosting(rows, ensemble["edges"], 5, 4, leaves, step, l2, min_h, min_n)
    scored = model.transform(table).select("a", "b", "c d", "probability", "prediction").collect()
    got = {(r["a"], r["b"], r["c d"]): (r["probability"][1], r["prediction"]) for r in scored}
    for row, m in zip(rows, want, strict=True):
        p = 1 / (1 + np.exp(-m))
        assert got[row[:3]][0] == pytest.approx(p, abs=1e-9) and got[row[:3]][1] == float(p > 0.5)
    used = [sum(f < 0 for f in t["feature"][:1]) for t in ensemble["trees"]]
    assert used == [0] * 5

    # However the rows are dealt, over how many tasks, the trees are the same to the last bit.
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 200)
    again = boosting.BoostedTrees(**settings).fit(table.repartition(7, "b"))
    assert again.getOrDefault("ensemble") == model.getOrDefault("ensemble")


def test_boosting_keeps_rows_in_chunks(spark):
    from streamscore.operators import boosting

    table, rows = boosting_rows(spark)
    inputs = ["a", "b", "c d"]
    edges, count = boosting.bin_edges(table, inputs)
    held = boosting._binned(table.repartition(3), inputs, "label", edges, 0.25)
    chunks = held.collect()
    assert len(chunks) == 3  # one per batch, so a pass hands over few values whatever the rows are
    assert sum(len(c["bins"]) for c in chunks) == 3 * count
    assert sum(len(c["label"]) + len(c["margin"]) for c in chunks) == 16 * count
    assert boosting.BoostedTrees(inputCols=inputs, rounds=7).getMaxIter() == 7


def test_rows_of_one_task_need_few_jobs(spark, monkeypatch):
    """Many jobs of 150 rows each made retraining last minutes; one job grows ten trees here."""
    import json

    from streamscore.operators import boosting

    def fitted(group):
        spark.sparkContext.setJobGroup(group, group)
        model = boosting.BoostedTrees(inputCols=["a", "b", "c d"], rounds=24, minRows=5).fit(table)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        return json.loads(model.getOrDefault("ensemble")), jobs

    table, _ = boosting_rows(spark, 300)
    try:
        one_task, jobs = fitted("boosting in one task")
        assert len(one_task["trees"]) == 24 and jobs < 24
        monkeypatch.setattr(boosting, "ROWS_PER_TASK", 100)
        several, jobs = fitted("boosting in several tasks")
        assert several == one_task and jobs > 24
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_boosted_trees_on_odd_tables(spark):
    from streamscore.operators.boosting import BoostedTrees

    table, _ = boosting_rows(spark, 60)
    boosted = BoostedTrees(inputCols=["a", "b", "c d"], rounds=3, minRows=5)
    one_class = table.withColumn("label", F.lit(1.0)).withColumn("_positive_rows", F.lit(1))
    scored = boosted.fit(one_class).transform(one_class)
    assert all(r["probability"][1] > 0.999 for r in scored.collect())
    empty = boosted.fit(table.limit(0)).transform(table.limit(3)).collect()
    assert [r["probability"][1] for r in empty] == [0.5] * 3
    constant = table.withColumns({"a": F.lit(1.0), "b": F.lit(2.0), "c d": F.lit(0.0)})
    share = constant.agg(F.avg("label")).first()[0]
    for r in boosted.fit(constant).transform(constant).limit(3).collect():
        assert r["probability"][1] == pytest.approx(share)
    for odd in (None, float("nan")):
        with pytest.raises(ValueError, match="c d"):
            boosted.fit(table.withColumn("c d", F.when(F.col("b") > 2, F.col("c d")).otherwise(F.lit(odd))))
    with pytest.raises(ValueError, match="missing"):
        boosted.fit(table.withColumn("label", F.when(F.col("b") > 2, F.col("label"))))
