import math
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import moment
from streamscore.operators import attribution as at
from streamscore.operators.running import with_running
from streamscore.plans import fixtures as fx

CHANNEL = {"C001": "display", "C002": "search", "C003": "social", "C004": "email"}


def journey(user, steps, start="2024-01-01 00:00:00", gap=timedelta(minutes=7)):
    """steps: (type, campaign, value)"""
    rows = []
    for i, (kind, campaign, value) in enumerate(steps):
        ts = (moment(start) + i * gap).isoformat(" ")
        rows.append((f"{user}-{i:06d}", user, kind, campaign, ts, value))
    return rows


SIMPLE_STEPS = [("IM", "C001", None), ("CL", "C002", None), ("IM", "C004", None), ("CN", "C003", 30.0)]

SIMPLE = (
    journey("U1", [("IM", "C001", None), ("CL", "C002", None), ("CN", "C003", 30.0)])
    + journey("U2", [("CN", "C004", 11.0)])
    + journey("U3", [("CL", "C001", None)])
)


def credit(df):
    return {r["channel"]: r for r in df.collect()}


def test_first_and_last_touch_include_conversions(events):
    ev = events(SIMPLE)
    first, last = credit(at.attribute(ev, "first_touch")), credit(at.attribute(ev, "last_touch"))
    assert {c: r["attributed_revenue"] for c, r in first.items()} == {"display": 30.0, "email": 11.0}
    assert {c: r["attributed_revenue"] for c, r in last.items()} == {"social": 30.0, "email": 11.0}
    without = credit(at.attribute(ev, "last_touch", exclude_conversions=True))
    assert {c: r["attributed_revenue"] for c, r in without.items()} == {"search": 30.0}


def test_linear_divides_by_all_touches_and_skips_conversions(events):
    ev = events(SIMPLE)
    linear = credit(at.attribute(ev, "linear"))
    assert {c: r["attributed_revenue"] for c, r in linear.items()} == {"display": 10.0, "search": 10.0}
    full = credit(at.attribute(ev, "linear", denominator="non_conversion"))
    assert {c: r["attributed_revenue"] for c, r in full.items()} == {"display": 15.0, "search": 15.0}
    assert credit(at.attribute(ev, "no such model")) == linear


def test_time_decay_adds_up_and_drops_conversion_only_users(events):
    rows = credit(at.attribute(events(SIMPLE), "time_decay"))
    assert "email" not in rows
    share = 1 / (1 + math.exp(-0.5))
    assert rows["search"]["attributed_revenue"] == pytest.approx(30 * share)
    assert sum(r["attributed_revenue"] for r in rows.values()) == pytest.approx(30)


def brute_time_decay(rows, decay):
    by_user = defaultdict(list)
    for r in rows:
        by_user[r[1]].append(r)
    revenue, users = defaultdict(float), defaultdict(set)
    for user, steps in by_user.items():
        steps.sort(key=lambda r: (r[4], r[0]))
        value = sum(r[5] or 0 for r in steps if r[2] == "CN")
        if not any(r[2] == "CN" for r in steps):
            continue
        touches = [(i, r) for i, r in enumerate(steps) if r[2] != "CN"]
        if not touches:
            continue
        last = touches[-1][0]
        weights = [(math.exp(decay * (i - last)), CHANNEL[r[3]]) for i, r in touches]
        total = math.fsum(w for w, _ in weights)
        for w, channel in weights:
            revenue[channel] += value * w / total
            users[channel].add(user)
    return dict(revenue), {c: len(u) for c, u in users.items()}


@pytest.mark.parametrize("decay", [0.5, 0.001, 0.0])
def test_long_journey_with_many_trailing_conversions(events, decay):
    campaigns = list(CHANNEL)
    hot = [("CL" if i % 3 else "IM", campaigns[(i // 40) % 4], None) for i in range(2500)]
    # More trailing conversions than exp() can represent as a weight.
    hot += [("CN", "C003", 1.25)] * 1600
    rows = journey("HOT", hot) + SIMPLE
    got = credit(at.time_decay_credit(at.touchpoints(events(rows)), decay))
    revenue, users = brute_time_decay(rows, decay)
    assert {c: r["conversions"] for c, r in got.items()} == users
    for channel, r in got.items():
        assert r["attributed_revenue"] == pytest.approx(revenue[channel], rel=1e-9)


def test_journey_arrays_are_bounded_and_whole(events):
    rows = journey("HOT", [("CL", "C001", None)] * 250 + [("CN", "C002", 9.0)]) + SIMPLE
    arrays = at.journeys(events(rows), segment_rows=100)
    sizes = arrays.groupBy("user_id").agg(
        F.max(F.size("touchpoints")).alias("longest"), F.sum(F.size("touchpoints")).alias("all")
    )
    assert {r["user_id"]: (r["longest"], r["all"]) for r in sizes.collect()} == {
        "HOT": (100, 251),
        "U1": (3, 3),
        "U2": (1, 1),
    }
    flat = at.explode_touchpoints(arrays).filter(F.col("user_id") == "HOT").orderBy("touch_idx")
    assert [r["touch_idx"] for r in flat.collect()] == list(range(251))
    assert [r["ts"] for r in flat.collect()] == sorted(r["ts"] for r in flat.collect())


def test_array_and_channel_forms_agree(spark, sf_dir):
    ev = fx.enriched(spark, sf_dir)
    a = credit(at.linear_from_touchpoints(at.explode_touchpoints(at.journeys(ev, 7))))
    b = credit(at.attribute(ev, "linear"))
    for channel in a.keys() | b.keys():
        assert a[channel]["conversions"] == b[channel]["conversions"]
        assert a[channel]["attributed_revenue"] == pytest.approx(b[channel]["attributed_revenue"])


def test_channel_tables_add_up(events):
    half = len(SIMPLE) // 2
    split = at.add_journey_channels(
        at.journey_channels(events(SIMPLE[:half])), at.journey_channels(events(SIMPLE[half:]))
    )
    whole = at.journey_channels(events(SIMPLE)).select(split.columns)
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_credit_percent_of_no_revenue_is_zero(spark):
    rows = spark.createDataFrame([("display", 1, 0.0)], "channel string, conversions long, attributed_revenue double")
    assert at.credit_pct(rows).first()["credit_pct"] == 0.0


def test_positions_are_those_of_a_plain_window(spark, sf_dir):
    ev = fx.enriched(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("event_ts", "event_id")
    plain = ev.select("event_id", (F.row_number().over(order) - 1).alias("idx"))
    touches = at.touchpoints(ev).join(plain, "event_id")
    assert touches.count() > 0 and touches.filter("touch_idx <> idx").count() == 0


def test_a_user_whose_rows_share_one_minute_is_split_over_tasks(spark, events):
    rows = journey("HOT", [("CL", "C001", None)] * 300 + [("CN", "C002", 9.0)])
    rows = [(*r[:4], f"2024-01-01 10:00:{k % 60:02d}.{k:06d}", r[5]) for k, r in enumerate(rows)]
    # As with tables too large to broadcast or to put into one partition.
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        touches = at.touchpoints(events(rows))
        plan = touches._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())" in line]
        assert windows and all("_part" in line for line in windows)
        assert touches.select("touch_idx").distinct().count() == 301
        assert touches.select("_part").distinct().count() > 1
        tasks = touches.withColumn("task", F.spark_partition_id()).select("task").distinct()
        assert tasks.count() > 1
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_comparison_lists_channels_without_credit(events):
    rows = {r["channel"]: r for r in at.attribution_comparison(events(SIMPLE)).collect()}
    assert set(rows) == {"display", "search", "social", "email"}
    assert rows["email"]["time_decay"] == 0.0
    assert rows["display"]["first_touch"] == pytest.approx(73.2)


def test_one_moment_with_a_third_of_all_rows_spreads_over_parts(spark, events):
    hot = [
        (f"same-long-prefix-{i * 7919 % 4000:06d}", "HOT", "CL" if i % 5 else "IM", "C00%d" % (1 + i % 4),
         "2024-01-01 00:00:00.250000", None)
        for i in range(2000)
    ]
    hot.append(("zz", "HOT", "CN", "C002", "2024-01-01 00:00:00.250001", 8.0))
    rest = [row for u in range(400) for row in journey(f"U{u}", SIMPLE_STEPS)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        touches = at.touchpoints(events(hot + rest)).cache()
        parts = {r["_part"]: r["count"] for r in touches.groupBy("_part").count().collect()}
        of_hot = touches.filter("user_id = 'HOT'").groupBy("_part").count().collect()
        rows = touches.filter("user_id = 'HOT'").select("event_id", "touch_idx", "touchpoint_count").collect()
        got = credit(at.time_decay_credit(touches, 0.01))
        touches.unpersist()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(parts.values()) == len(hot) + len(rest)
    # Eight parts: the moment's rows fill about three of them, and no part holds many more than its share.
    assert len(of_hot) >= 3 and max(parts.values()) <= 2 * sum(parts.values()) / 8
    ordered = sorted(hot, key=lambda r: (r[4], r[0]))
    assert sorted((r["touch_idx"], r["event_id"]) for r in rows) == list(enumerate(r[0] for r in ordered))
    assert {r["touchpoint_count"] for r in rows} == {len(hot)}
    revenue, users = brute_time_decay(ordered + rest, 0.01)
    assert {c: r["conversions"] for c, r in got.items()} == users
    for channel, r in got.items():
        assert r["attributed_revenue"] == pytest.approx(revenue[channel], rel=1e-9)


def test_running_totals_of_moments_without_rows_or_ties(spark):
    schema = "k string, at int, tie string, n int"
    add = {"total": F.col("n")}
    none = with_running(spark.createDataFrame([], schema), "k", add, ["at", "tie"], {"rows": F.count("*")})
    assert none.collect() == [] and none.columns == ["k", "at", "tie", "n", "_part", "total", "rows"]
    data = [("a", 1, None, 1), ("a", 1, "x", 2), ("a", None, "y", 4), ("b", 0, "x", None), ("b", 1, "x", 3)]
    got = with_running(spark.createDataFrame(data, schema), "k", add, ["at", "tie"], {"rows": F.count("*")})
    assert sorted((r["k"], r["at"] or 0, r["tie"] or "", r["total"], r["rows"]) for r in got.collect()) == [
        ("a", 0, "y", 4, 3), ("a", 1, "", 5, 3), ("a", 1, "x", 7, 3), ("b", 0, "x", None, 2), ("b", 1, "x", 3, 2)
    ]


def test_only_keys_in_several_parts_are_summed_up_apart(spark):
    data = [("long", i) for i in range(3000)] + [(f"u{i:04d}", i) for i in range(3000)] + [(None, 1)]
    table = spark.createDataFrame(data, "k string, at int")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_running(table, "k", {"idx": F.lit(1)}, ["at"], {"rows": F.count(F.lit(1))})
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    # Totals of keys in one part come from the row-level window, without a join of all keys.
    assert "Join LeftOuter" in plan and "rightHint=(strategy=broadcast)" in plan
    long = sorted((r for r in rows if r["k"] == "long"), key=lambda r: r["at"])
    assert len({r["_part"] for r in long}) > 1
    assert [(r["idx"], r["rows"]) for r in long] == [(i + 1, 3000) for i in range(3000)]
    others = [r for r in rows if r["k"] != "long"]
    assert len(others) == 3000 and {(r["idx"], r["rows"]) for r in others} == {(1, 1)}
