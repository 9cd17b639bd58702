"""Every registered query: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamscore.functions import scalar
from streamscore.functions.scalar import score_bucket
from streamscore.operators import attribution as at
from streamscore.operators import audience, campaigns, compiled, features, ml, monitor, reports, scoring
from streamscore.plans import fixtures as fx
from streamscore.schemas import ENRICHED, PAID_SEARCH, UNIFIED
from streamscore.session import prepare
from streamscore.sources import ingest, tables
from streamscore.sources.registry import ModelRegistry, next_version
from streamscore.sources.storage import shared_dir, stored
from streamscore.streaming import jobs
from streamscore.streaming import tables as streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SEGMENT_RULES = [
    {"field": "propensity_score", "op": ">=", "value": "0.2"},
    {"field": "clicks_7d", "op": ">", "value": "5"},
    {"field": "score_bucket", "op": "!=", "value": "HIGH"},
    {"field": "shoe_size", "op": ">", "value": "44"},
]


def query(fn: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = prepared
    return fn


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolling = features.rolling_user_features(fx.enriched(spark, sf_dir), fx.AS_OF)
    return scoring.propensity_scores(rolling, fx.AS_OF)


def _states(events: DataFrame) -> list[DataFrame]:
    """User features after each refresh."""
    states: list[DataFrame] = []
    for batch, (_, _, clock) in enumerate(fx.BATCHES):
        delta = features.feature_delta(fx.batch_of(events, batch), clock)
        previous = states[-1] if states else None
        states.append(features.merge_user_features(previous, delta, clock))
    return states


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(fx.enriched(spark, sf_dir))[-1]


# Ingest


@query
def ingest_marketing(spark, sf_dir):
    valid, _ = ingest.split_valid(
        ingest.parse_marketing(fx.json_marketing(spark, sf_dir).select("value"))
    )
    return ingest.with_ingest_time(ingest.extract_properties(valid), fx.AS_OF).drop("order_type")


@query
def ingest_conversion(spark, sf_dir):
    valid, _ = ingest.split_valid(
        ingest.parse_conversion(fx.json_conversions(spark, sf_dir).select("value"))
    )
    return ingest.extract_properties(valid).drop("channel", "device")


def _topics(spark, sf_dir) -> list[DataFrame]:
    parsers = {
        "marketing_events": ingest.parse_marketing,
        "conversion_events": ingest.parse_conversion,
    }
    return [
        parse(ingest.unwrap_envelope(fx.envelopes(spark, sf_dir, topic)))
        for topic, parse in parsers.items()
    ]


@query
def ingest_envelope(spark, sf_dir):
    columns = [f.name for f in UNIFIED.fields] + ["topic", "partition", "offset"]
    valid = [ingest.split_valid(t)[0] for t in _topics(spark, sf_dir)]
    return valid[0].unionByName(valid[1], allowMissingColumns=True).select(columns)


@query
def ingest_start_position(spark, sf_dir):
    messages = ingest.unwrap_envelope(fx.envelopes(spark, sf_dir, "marketing_events"))
    return (
        ingest.start_from(messages, offset=100, timestamp=fx.BATCHES[0][2])
        .groupBy("partition")
        .agg(F.count(F.lit(1)).alias("messages"), F.min("offset").alias("first_offset"))
    )


@query
def ingest_quarantine(spark, sf_dir):
    bad = [ingest.split_valid(t)[1].select("topic", "_error") for t in _topics(spark, sf_dir)]
    return (
        bad[0]
        .unionByName(bad[1])
        .groupBy("topic", F.col("_error").alias("error"))
        .agg(F.count(F.lit(1)).alias("bad_rows"))
    )


@query
def ingest_health(spark, sf_dir):
    keys = ["topic", "partition", "offset", "_error"]
    marketing, conversions = (t.select(keys) for t in _topics(spark, sf_dir))
    return ingest.ingest_health(marketing.unionByName(conversions))


@query
def extract_properties(spark, sf_dir):
    raw = [
        table.select(
            "event_id", "event_ts", F.try_parse_json("properties").alias("properties")
        )
        for table in (fx.raw_marketing(spark, sf_dir), fx.raw_conversions(spark, sf_dir))
    ]
    return ingest.extract_properties(raw[0].unionByName(raw[1]))


# Silver


@query
def unify_conversion_scope(spark, sf_dir):
    return fx.unified(spark, sf_dir, "conversions")


@query
def unify_all(spark, sf_dir):
    return fx.unified(spark, sf_dir)


@query
def enrich(spark, sf_dir):
    return fx.enriched(spark, sf_dir)


# Features


@query
def feature_delta(spark, sf_dir):
    newest = fx.batch_of(fx.enriched(spark, sf_dir), 2)
    return features.feature_delta(newest, fx.BATCHES[2][2])


@query
def merge_user_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query
def rolling_features(spark, sf_dir):
    return features.rolling_user_features(fx.enriched(spark, sf_dir), fx.AS_OF)


@query
def online_features(spark, sf_dir):
    return features.online_user_features(fx.enriched(spark, sf_dir), fx.AS_OF)


@query
def rolling_history(spark, sf_dir):
    return features.rolling_history(fx.enriched(spark, sf_dir))


@query
def feature_group(spark, sf_dir):
    rolling = features.rolling_user_features(fx.enriched(spark, sf_dir), fx.AS_OF)
    scores = scoring.propensity_scores(rolling, fx.AS_OF).drop("last_updated")
    return _rounded(features.feature_group(rolling, scores), "propensity_score")


@query
def training_frame(spark, sf_dir):
    return features.training_frame(_features(spark, sf_dir))


@query
def label_stats(spark, sf_dir):
    return features.label_stats(features.training_frame(_features(spark, sf_dir)))


@query
def stratified_split(spark, sf_dir):
    training = features.training_frame(_features(spark, sf_dir))
    return ml.stratified_split(training.select("user_id", "converted"))


# Scoring and serving


@query
def score_fixed(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), "propensity_score").drop("last_updated")


@query
def score_requests(spark, sf_dir):
    events = fx.enriched(spark, sf_dir)
    requests = events.filter(F.col("event_type") == PAID_SEARCH).select(
        F.col("event_id").alias("request_id"), "user_id"
    )
    rolling = features.rolling_user_features(events, fx.AS_OF)
    scored = scoring.score_requests(requests, rolling, transformation_fn=lambda df: df)
    return _rounded(
        scored.select("request_id", "user_id", "propensity_score", "score_bucket"),
        "propensity_score",
    )


@query
def latest_per_key(spark, sf_dir):
    rows = fx.enriched(spark, sf_dir).select("user_id", "event_ts", "event_id", "event_type")
    return tables.latest_per_key(rows, "user_id", "event_ts")


@query
def serving_scores(spark, sf_dir):
    path = shared_dir(spark, "serving_scores")
    tables.write_serving(_scores(spark, sf_dir), ["score_bucket", "user_id"], path)
    return _rounded(spark.read.parquet(path), "propensity_score")


@query
def serving_campaigns(spark, sf_dir):
    path = shared_dir(spark, "serving_campaigns")
    performance = campaigns.campaign_performance(fx.enriched(spark, sf_dir))
    tables.write_serving(performance, ["channel", "campaign_id"], path)
    return spark.read.parquet(path)


@query
def top_users(spark, sf_dir):
    return _rounded(reports.top_users(_scores(spark, sf_dir), 20), "propensity_score")


@query
def lookup_user(spark, sf_dir):
    """A point lookup on a stored table clustered by user."""
    path = shared_dir(spark, "lookup_scores")
    tables.write_serving(_scores(spark, sf_dir), ["user_id"], path)
    return _rounded(reports.lookup_user(spark.read.parquet(path), "U0005"), "propensity_score")


@query
def lookup_features(spark, sf_dir):
    path = shared_dir(spark, "lookup_features")
    tables.write_serving(_features(spark, sf_dir), ["user_id"], path)
    return reports.lookup_user(spark.read.parquet(path), "U0005")


@query
def recent_events(spark, sf_dir):
    return reports.recent_events(fx.enriched(spark, sf_dir))


@query
def recent_user_events(spark, sf_dir):
    path = shared_dir(spark, "lookup_events")
    tables.write_serving(fx.enriched(spark, sf_dir), ["user_id", "event_ts"], path)
    return reports.recent_events(spark.read.parquet(path), "U0005", 20)


@query
def recommendation_count(spark, sf_dir):
    texts = tables.read_table(spark, "documents", sf_dir)
    return texts.select("doc_id", scalar.recommendation_count("text").alias("recommendations"))


@query
def score_distribution(spark, sf_dir):
    return reports.score_distribution(_scores(spark, sf_dir))


@query
def score_funnel(spark, sf_dir):
    return reports.score_funnel(_scores(spark, sf_dir), 100)


@query
def top_summary(spark, sf_dir):
    return reports.top_summary(_scores(spark, sf_dir), 15)


@query
def segment_preview(spark, sf_dir):
    preview = audience.segment_preview(
        _features(spark, sf_dir), _scores(spark, sf_dir), SEGMENT_RULES
    )
    return _rounded(preview, "propensity_score")


@query
def segment_count(spark, sf_dir):
    return audience.segment_count(
        _features(spark, sf_dir), _scores(spark, sf_dir), SEGMENT_RULES
    )


# Campaigns


@query
def load_campaigns(spark, sf_dir):
    """The dimension with the events of each campaign."""
    events = fx.unified(spark, sf_dir).groupBy("campaign_id").agg(F.count("*").alias("events"))
    return fx.campaigns(spark).join(events, "campaign_id", "left").fillna(0, subset=["events"])


@query
def event_counts(spark, sf_dir):
    raw = [fx.raw_marketing(spark, sf_dir), fx.raw_conversions(spark, sf_dir)]
    return reports.event_counts(reduce(DataFrame.union, [r.select("event_type") for r in raw]))


def _performance(spark, sf_dir):
    return campaigns.campaign_performance(fx.enriched(spark, sf_dir))


@query
def campaign_performance(spark, sf_dir):
    return _performance(spark, sf_dir)


@query
def kpis(spark, sf_dir):
    return campaigns.kpis(_performance(spark, sf_dir))


@query
def reach_users(spark, sf_dir):
    return campaigns.reach_users(fx.enriched(spark, sf_dir))


@query
def campaign_summary(spark, sf_dir):
    return campaigns.campaign_summary(_performance(spark, sf_dir))


@query
def metrics_json(spark, sf_dir):
    return campaigns.metrics_json(campaigns.campaign_summary(_performance(spark, sf_dir)))


@query
def hourly_channel_events(spark, sf_dir):
    return campaigns.hourly_channel_events(_performance(spark, sf_dir))


@query
def channel_hour_heatmap(spark, sf_dir):
    return campaigns.channel_hour_heatmap(_performance(spark, sf_dir))


@query
def reach_frequency(spark, sf_dir):
    return campaigns.reach_frequency(fx.enriched(spark, sf_dir))


@query
def reach_report(spark, sf_dir):
    return campaigns.reach_report(campaigns.reach_frequency(fx.enriched(spark, sf_dir)))


# Attribution


@query
def journeys(spark, sf_dir):
    arrays = at.journeys(fx.enriched(spark, sf_dir))
    return at.explode_touchpoints(arrays)


@query
def journey_totals(spark, sf_dir):
    return at.journey_totals(fx.enriched(spark, sf_dir))


def _attribution(model: str) -> Query:
    def run(spark, sf_dir):
        credit = at.credit_pct(at.attribute(fx.enriched(spark, sf_dir), model))
        return _rounded(credit, "attributed_revenue")

    run.__name__ = f"attr_{model}"
    return query(run)


for _model in at.MODELS:
    _attribution(_model)


@query
def attr_linear_from_arrays(spark, sf_dir):
    touches = at.explode_touchpoints(at.journeys(fx.enriched(spark, sf_dir)))
    credit = at.linear_from_touchpoints(touches)
    return _rounded(credit, "attributed_revenue")


@query
def attr_comparison(spark, sf_dir):
    return at.attribution_comparison(fx.enriched(spark, sf_dir))


# Models and monitoring


def _inference_log(spark, sf_dir, times: int = 1) -> DataFrame:
    """The stored log of three snapshots, each of which was logged so many times."""
    events, path = fx.enriched(spark, sf_dir), shared_dir(spark, "inference_log")
    for state, (_, _, clock) in zip(_states(events), fx.BATCHES):
        rolling = features.rolling_user_features(events, clock)
        scores = scoring.propensity_scores(rolling, clock)
        for _ in range(times):
            monitor.log_inferences(scores, state, clock, path)
    return spark.read.parquet(path).drop("snapshot")


@query
def inference_log(spark, sf_dir):
    """Snapshots that are logged again replace themselves."""
    return _rounded(_inference_log(spark, sf_dir, times=2), "predicted_score")


@query
def monitor_daily(spark, sf_dir):
    log = _inference_log(spark, sf_dir)
    baseline = log.filter(F.col("scored_at") == F.lit(fx.BATCHES[0][2]).cast("timestamp_ntz"))
    return _rounded(monitor.monitor(log, baseline), "mean_score", "psi")


@query
def monitor_drift(spark, sf_dir):
    """Drift over quantile bins; the baseline is put together from two summaries."""
    log = _inference_log(spark, sf_dir).withColumn("predicted_score", F.round("predicted_score", 6))
    first = log.filter(F.col("scored_at") == F.lit(fx.BATCHES[0][2]).cast("timestamp_ntz"))
    parts = [first.filter(F.col("user_id") < "U0050"), first.filter(F.col("user_id") >= "U0050")]
    baseline = monitor.add_summaries(*map(monitor.score_summary, parts))
    return _rounded(monitor.quantile_drift(log, baseline), "psi")


@query
def model_metrics(spark, sf_dir):
    """Metrics of the fixed scores against what users did."""
    rows = _scores(spark, sf_dir).join(_features(spark, sf_dir), "user_id")
    p = F.round("propensity_score", 6)  # so that ties do not depend on the last bits
    predictions = rows.select(
        array_to_vector(F.array(1 - p, p)).alias("probability"),
        F.when(p >= 0.5, 1.0).otherwise(0.0).alias("prediction"),
        features.label(rows).cast("double").alias("converted"),
    )
    names = ["roc_auc", "accuracy", "f1"]
    metrics = ml.evaluate(predictions)
    row = [tuple(float(metrics[n]) for n in names)]
    return _rounded(spark.createDataFrame(row, ", ".join(f"{n} double" for n in names)), *names)


@query
def champion(spark, sf_dir):
    """The rule over a board with ties and suspicious models, one per campaign."""
    n = F.col("n")
    board = (
        fx.unified(spark, sf_dir)
        .groupBy(F.col("campaign_id").alias("model"))
        .agg(F.count("*").alias("n"))
        .select(
            "model",
            (F.lit(0.9) + n % 3 * 0.05).alias("roc_auc"),
            F.lit(0.5).alias("accuracy"),
            (n % 2 / 2.0).alias("f1"),
        )
    )
    chosen = ml.select_champion(board).asDict()
    row = [tuple(chosen[c] for c in ("model", "roc_auc", "accuracy", "f1"))]
    return spark.createDataFrame(row, "model string, roc_auc double, accuracy double, f1 double")


@query
def registry_versions(spark, sf_dir):
    """The version that follows those named after events; other names do not count."""
    events = fx.base_events(spark, sf_dir)
    prefix = F.when(F.col("n") % 3 == 0, "V").when(F.col("n") % 3 == 1, "v").otherwise("model-V")
    names = events.select(F.concat(prefix, F.col("n") * 1_000_003).alias("version"))
    return spark.createDataFrame([(next_version(names),)], "next_version string")


@query
def leaderboard(spark, sf_dir):
    training = ml.stratified_split(features.training_frame(_features(spark, sf_dir)))
    n_train = training.filter(F.col("split") == "train").count()
    _, board = ml.train_candidates(training, ml.candidates(n_train))
    return board


@query
def user_propensity(spark, sf_dir):
    state = _features(spark, sf_dir)
    registry = ModelRegistry(spark, shared_dir(spark, "registry"))
    ml.retrain(state, registry, run_tag="weekly")
    probability = compiled.compiled_probability(spark, registry.model_path())
    return compiled.compiled_scores(state, probability)


@query
def registry_scores(spark, sf_dir):
    """Two models are logged, saved and registered; the more accurate one serves."""
    registry = ModelRegistry(spark, shared_dir(spark, "registry"))
    rolling = features.rolling_user_features(fx.enriched(spark, sf_dir), fx.AS_OF)
    z = " + ".join(f"{w}D * coalesce({c}, 0)" for c, w in scoring.COEFFICIENTS.items())
    scorers = {"nobody": "0D", "fixed": f"1D / (1D + exp(-({scoring.INTERCEPT}D + {z})))"}
    accuracy = {}
    for name, sql in scorers.items():
        step = SQLTransformer(statement=f"SELECT *, {sql} AS propensity_score FROM __THIS__")
        model = Pipeline(stages=[step]).fit(rolling)
        right = (F.col("propensity_score") >= 0.5) == (F.col("conversions_7d") > 0)
        share = model.transform(rolling).agg(F.avg(right.cast("double")).alias("x")).first().x
        metrics = {"roc_auc": 0.5, "accuracy": share, "f1": share}
        registry.log_run(name, {"scorer": sql}, metrics)
        accuracy[registry.register(model, name, metrics, rolling.count(), "registry")] = share
    registry.promote("V1")
    if accuracy["V2"] > accuracy["V1"]:
        registry.promote("V2")
    served = registry.versions().filter("is_default").select("version", "champion", "accuracy")
    logged = registry.runs().agg(F.count("*").alias("runs"))
    scored = registry.load_default().transform(rolling)
    scored = scored.withColumn("score_bucket", score_bucket("propensity_score"))
    rows = scored.select("user_id", "propensity_score", "score_bucket").crossJoin(
        F.broadcast(served.crossJoin(logged))  # one row
    )
    return _rounded(rows, "propensity_score", "accuracy")


# Streaming


def _stored_events(spark, sf_dir) -> str:
    """Enriched events as files for a stream to read."""
    path = shared_dir(spark, "enriched")
    tables.append_events(fx.enriched(spark, sf_dir), path)
    return path


@query
def stream_ingest(spark, sf_dir):
    landed = []
    for topic in ("marketing_events", "conversion_events"):
        source, out = shared_dir(spark, topic), shared_dir(spark, "landed")
        fx.envelopes(spark, sf_dir, topic).write.text(source)
        jobs.stream_ingest(
            spark.readStream.text(source), topic, out, shared_dir(spark, "progress")
        )
        valid, bad = jobs.read_landed(spark, out)
        columns = [F.lit(topic).alias("topic"), *[f.name for f in UNIFIED.fields]]
        if "conversion_value" not in valid.columns:
            valid = valid.withColumn("conversion_value", F.lit(None).cast("double"))
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in UNIFIED.fields]
        landed.append(valid.select(*columns, F.lit(None).cast("string").alias("error")))
        landed.append(bad.select("topic", *missing, F.col("_error").alias("error")))
    return reduce(DataFrame.unionByName, landed)


@query
def stream_enrich(spark, sf_dir):
    source, out = shared_dir(spark, "unified"), shared_dir(spark, "stream_enrich")
    tables.append_events(fx.unified(spark, sf_dir), source)
    jobs.stream_enrich(
        tables.read_changes(spark, source, UNIFIED),
        fx.campaigns(spark),
        out,
        shared_dir(spark, "progress"),
    )
    return spark.read.schema(ENRICHED).parquet(out)


def _arriving(spark, sf_dir):
    """Raw events in three batches; the copies of an event come in different ones."""
    marketing = fx.raw_marketing(spark, sf_dir).drop("properties")
    conversions = fx.raw_conversions(spark, sf_dir).drop("properties")
    both = marketing.unionByName(conversions, allowMissingColumns=True)
    arrival = F.pmod(F.col("n") + F.minute("event_ts") + F.hour("event_ts"), F.lit(len(fx.BATCHES)))
    columns = [f.name for f in UNIFIED.fields]
    for batch in range(len(fx.BATCHES)):
        yield both.filter(arrival == batch).select(columns)


@query
def stream_dedup(spark, sf_dir):
    """First arrivals, of which many are far behind the events that came before."""
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    table = jobs.arrivals_table(spark, shared_dir(spark, "stream_dedup"))
    for batch in _arriving(spark, sf_dir):
        tables.append_events(batch, source)
        jobs.stream_dedup(tables.read_changes(spark, source, UNIFIED), table, progress)
    return table.read()


@query
def stream_unify(spark, sf_dir):
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    table = jobs.unified_table(spark, shared_dir(spark, "stream_unify"))
    for batch in _arriving(spark, sf_dir):
        tables.append_events(batch, source)
        jobs.stream_unify(tables.read_changes(spark, source, UNIFIED), table, progress)
    return table.read()


@query
def stream_pipeline(spark, sf_dir):
    """Raw copies out of order in, served scores out."""
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    serving = shared_dir(spark, "serving")
    table = jobs.unified_table(spark, shared_dir(spark, "unified"))
    for batch in _arriving(spark, sf_dir):
        tables.append_events(batch, source)
        jobs.stream_pipeline(
            tables.read_changes(spark, source, UNIFIED),
            table,
            fx.campaigns(spark),
            serving,
            clock=lambda i: fx.AS_OF,
            checkpoint=progress,
        )
    return _rounded(tables.read_published(spark, serving), "propensity_score")


@query
def stream_user_features(spark, sf_dir):
    events = stored(fx.enriched(spark, sf_dir), "enriched")  # read by every batch
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    clock = lambda i: fx.BATCHES[i][2]
    table = streams.user_features_table(spark, shared_dir(spark, "user_features"), clock)
    for batch in range(len(fx.BATCHES)):
        tables.append_events(fx.batch_of(events, batch), source)
        streams.stream_user_features(
            tables.read_changes(spark, source, ENRICHED), table, clock, progress
        )
    return table.read()


def _tiles(spark, sf_dir, late: str) -> DataFrame:
    table = streams.tiles_table(spark, shared_dir(spark, "tiles"), late=late)
    source = tables.read_changes(spark, _stored_events(spark, sf_dir), ENRICHED)
    streams.stream_feature_tiles(source, table, shared_dir(spark, "progress"), late=late)
    return table.read(parts=streams.tile_parts(datetime.fromisoformat(fx.AS_OF), 168, "day"))


@query
def stream_tiles(spark, sf_dir):
    return streams.features_from_tiles(_tiles(spark, sf_dir, "accept"), fx.AS_OF)


@query
def stream_tiles_watermark(spark, sf_dir):
    return streams.features_from_tiles(_tiles(spark, sf_dir, "drop"), fx.AS_OF)


@query
def stream_online_features(spark, sf_dir):
    """A backfill, then a stream that brings events from before the backfill, too."""
    table = streams.tiles_table(spark, shared_dir(spark, "tiles"))
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    events = stored(fx.enriched(spark, sf_dir), "enriched")  # read by every batch
    number = F.regexp_extract("event_id", "([0-9]+)", 1).cast("bigint")
    for batch in range(4):
        tables.append_events(events.filter(number % 4 == batch), source)
        jobs.backfill_then_stream(
            spark,
            source,
            ENRICHED,
            table,
            prepare=lambda rows, _: streams.feature_tiles(rows),
            checkpoint=progress,
        )
    return streams.online_from_tiles(table.read(), fx.AS_OF)


def _levels(spark, sf_dir):
    levels = streams.tile_levels(spark, shared_dir(spark, "levels"))
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    events = stored(fx.enriched(spark, sf_dir), "enriched")  # read by every batch
    for batch in reversed(range(len(fx.BATCHES))):
        tables.append_events(fx.batch_of(events, batch), source)
        changes = tables.read_changes(spark, source, ENRICHED)
        streams.stream_tile_levels(changes, levels, progress, compact_every=2)
    return levels


@query
def stream_tile_levels(spark, sf_dir):
    """Windowed features from minute, hour and day tiles."""
    return streams.features_from_levels(_levels(spark, sf_dir), fx.AS_OF)


@query
def stream_online_levels(spark, sf_dir):
    return streams.online_from_levels(_levels(spark, sf_dir), fx.AS_OF)


def _user_hours(spark, sf_dir) -> DataFrame:
    user_hours = streams.user_hours_table(spark, shared_dir(spark, "user_hours"))
    events = stored(fx.enriched(spark, sf_dir), "enriched")  # read by every batch
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    for batch in range(len(fx.BATCHES)):
        tables.append_events(fx.batch_of(events, batch), source)
        streams.stream_campaign_performance(
            tables.read_changes(spark, source, ENRICHED), user_hours, progress
        )
    return user_hours.read()


@query
def stream_campaign_performance(spark, sf_dir):
    return campaigns.performance_from_user_hours(_user_hours(spark, sf_dir))


@query
def stream_reach_frequency(spark, sf_dir):
    return campaigns.reach_from_user_hours(_user_hours(spark, sf_dir))


@query
def stream_attribution(spark, sf_dir):
    table = streams.journey_channels_table(spark, shared_dir(spark, "journeys"))
    events = stored(fx.enriched(spark, sf_dir), "enriched")  # read by every batch
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    for batch in range(len(fx.BATCHES)):
        tables.append_events(fx.batch_of(events, batch), source)
        streams.stream_journeys(tables.read_changes(spark, source, ENRICHED), table, progress)
    credit = at.credit_pct(at.credit_from_channels(table.read(), "linear"))
    return _rounded(credit, "attributed_revenue")


def _decay_state(spark, sf_dir):
    """Journeys kept by a stream; its first batch brings the latest events."""
    touches = streams.touches_table(spark, shared_dir(spark, "touches"))
    cells = streams.decay_cells_table(spark, shared_dir(spark, "cells"))
    events = stored(fx.enriched(spark, sf_dir), "enriched")  # read by every batch
    source, progress = shared_dir(spark, "arriving"), shared_dir(spark, "progress")
    for batch in reversed(range(len(fx.BATCHES))):
        tables.append_events(fx.batch_of(events, batch), source)
        streams.stream_time_decay(
            tables.read_changes(spark, source, ENRICHED), touches, cells, progress, compact_every=2
        )
    return touches.read(), cells.read()


@query
def stream_time_decay(spark, sf_dir):
    _, cells = _decay_state(spark, sf_dir)
    return _rounded(at.credit_pct(at.credit_from_cells(cells)), "attributed_revenue")


@query
def stream_journeys(spark, sf_dir):
    touches = at.touchpoints_from_cells(*_decay_state(spark, sf_dir))
    return at.explode_touchpoints(at.journey_slices(touches))


@query
def stream_latest_events(spark, sf_dir):
    columns = ["user_id", "event_ts", "event_id", "event_type"]
    schema = T.StructType([ENRICHED[c] for c in columns])
    table = jobs.latest_table(spark, shared_dir(spark, "latest"), schema, "user_id", "event_ts")
    source = tables.read_changes(spark, _stored_events(spark, sf_dir), ENRICHED)
    jobs.stream_latest(
        source.select(columns), "user_id", "event_ts", table, shared_dir(spark, "progress")
    )
    return table.read()
