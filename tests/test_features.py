from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import moment
from streamscore.functions.scalar import hours_crossed, ntz
from streamscore.functions import scalar
from streamscore.operators import features as ft
from streamscore.operators import scoring
from streamscore.schemas import USER_FEATURES


def delta_of(events, rows, as_of):
    return ft.feature_delta(events(rows), as_of)


FIRST = [("1", "U1", "CL", "C001", "2024-01-01 09:30:00", None)]
CLOCK_1, CLOCK_2 = "2024-01-01 10:00:00", "2024-01-01 13:00:00"


def one(df, user="U1"):
    return df.filter(F.col("user_id") == user).first()


def test_hour_boundaries_are_counted_not_elapsed_hours(spark):
    row = spark.range(1).select(
        hours_crossed(ntz("2024-01-01 10:59:00"), ntz("2024-01-01 11:01:00")).alias("h")
    )
    assert row.first()["h"] == 1


def test_first_sight_without_conversion_has_zero_hours_then_null(events):
    state = ft.merge_user_features(None, delta_of(events, FIRST, CLOCK_1), CLOCK_1)
    assert one(state)["time_since_last_conversion_hrs"] == 0.0
    again = [("2", "U1", "IM", "C001", "2024-01-01 12:30:00", None)]
    state = ft.merge_user_features(state, delta_of(events, again, CLOCK_2), CLOCK_2)
    row = one(state)
    assert row["time_since_last_conversion_hrs"] is None
    assert (row["clicks_1h"], row["clicks_24h"], row["clicks_7d"]) == (0, 0, 1)
    assert row["impressions_1h"] == 1
    assert row["event_velocity_24h"] == pytest.approx(1 / 3)
    assert row["last_updated"] == moment(CLOCK_2)


def test_users_without_new_events_keep_their_row(events):
    state = ft.merge_user_features(None, delta_of(events, FIRST, CLOCK_1), CLOCK_1)
    other = [("2", "U2", "CL", "C001", "2024-01-01 12:30:00", None)]
    merged = ft.merge_user_features(state, delta_of(events, other, CLOCK_2), CLOCK_2)
    assert one(merged) == one(state)
    assert merged.count() == 2


def test_late_conversion_moves_the_last_one_back_unless_monotonic(events):
    newer = [("1", "U1", "CN", "C001", "2024-01-01 09:00:00", 1.0)]
    older = [("2", "U1", "CN", "C001", "2024-01-01 07:00:00", 1.0)]
    state = ft.merge_user_features(None, delta_of(events, newer, CLOCK_1), CLOCK_1)
    late = delta_of(events, older, CLOCK_2)
    literal = one(ft.merge_user_features(state, late, CLOCK_2))
    assert literal["last_conversion_ts"] == moment("2024-01-01 07:00:00")
    assert literal["conversions_total"] == 2
    kept = one(ft.merge_user_features(state, late, CLOCK_2, monotonic=True))
    assert kept["last_conversion_ts"] == moment("2024-01-01 09:00:00")


def test_future_events_count_in_the_merge_but_not_in_windows(events):
    rows = [("1", "U1", "CL", "C001", "2024-01-01 11:00:00", None)]
    assert one(delta_of(events, rows, CLOCK_1))["clicks_1h"] == 1
    assert ft.rolling_user_features(events(rows), CLOCK_1).count() == 0


def test_window_edges_are_inclusive(events):
    as_of = "2024-01-08 00:00:00"
    rows = [
        ("1", "U1", "CL", "C001", "2024-01-01 00:00:00", None),
        ("2", "U1", "CL", "C001", "2023-12-31 23:59:59", None),
        ("3", "U1", "CL", "C001", "2024-01-07 23:00:00", None),
        ("4", "U1", "CL", "C001", "2024-01-08 00:00:00", None),
    ]
    row = one(ft.rolling_user_features(events(rows), as_of))
    assert (row["clicks_7d"], row["clicks_24h"], row["clicks_1h"]) == (3, 2, 2)


def test_state_schema(events):
    state = ft.merge_user_features(None, delta_of(events, FIRST, CLOCK_1), CLOCK_1)
    assert [(f.name, f.dataType) for f in state.schema.fields] == [
        (f.name, f.dataType) for f in USER_FEATURES.fields
    ]


def test_feature_group_rejects_a_feature_named_twice(events):
    rolling = ft.rolling_user_features(events(FIRST), CLOCK_1)
    with pytest.raises(ValueError, match="clicks_1h"):
        ft.feature_group(rolling, rolling.select("user_id", "clicks_1h"))


def test_training_frame_leaves_conversion_features_out(events):
    state = ft.merge_user_features(None, delta_of(events, FIRST, CLOCK_1), CLOCK_1)
    columns = ft.training_frame(state).columns
    assert len(ft.MODEL_FEATURES) == 10
    assert not any("conversion" in c for c in columns)
    assert columns[-1] == "converted"


def test_request_of_an_unknown_user_gets_the_base_score(spark, events):
    requests = spark.createDataFrame([("U1",), ("U9",)], "user_id string")
    rolling = ft.rolling_user_features(events(FIRST), CLOCK_1)
    scored = scoring.score_requests(requests, rolling)
    base = one(scored, "U9")
    assert base["propensity_score"] == pytest.approx(1 / (1 + 2.718281828459045**2.1))
    assert base["score_bucket"] == "LOW"


def brute_history(rows, horizon_hours, event_type):
    out = {}
    for e, u, _, _, ts, _ in rows:
        end, start = moment(ts), moment(ts) - timedelta(hours=horizon_hours)
        out[e] = sum(
            1
            for _, u2, t2, _, ts2, _ in rows
            if u2 == u and start <= moment(ts2) <= end and t2 == event_type
        )
    return out


def test_history_of_a_hot_user_equals_brute_force(events):
    base = moment("2024-01-01 00:00:00")
    kinds = ["CL", "IM", "PS", "CN"]
    rows = []
    for i in range(240):
        # One user holds most rows; many share a moment or lie one hour apart to the second.
        user = "HOT" if i % 4 else f"U{i % 7}"
        ts = base + timedelta(minutes=20 * (i // 2), seconds=(i % 3 == 0) * 30)
        rows.append((f"E{i:04d}", user, kinds[i % 4 if i % 5 else 0], "C001", ts.isoformat(" "), 1.0))
    history = {r["event_id"]: r for r in ft.rolling_history(events(rows)).collect()}
    assert len(history) == len(rows)
    for column, kind, hours in [("clicks_1h", "CL", 1), ("clicks_24h", "CL", 24), ("conversions_7d", "CN", 168)]:
        expected = brute_history(rows, hours, kind)
        assert {e: r[column] for e, r in history.items()} == expected


@pytest.mark.parametrize("values,total", [([0.004] * 3, 0.012), ([1e17, 1.0, -1e17], 1.0), ([0.1] * 10, 1.0)])
def test_money_adds_up_exactly(spark, values, total):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert rows.agg(scalar.money_sum("v")).first()[0] == total


@pytest.mark.parametrize("name,number", [("V12", 12), ("v1234567890123", 1234567890123), ("V", None), ("x1", None)])
def test_version_numbers_have_any_length(spark, name, number):
    row = spark.range(1).select(scalar.version_number(F.lit(name)).alias("n")).first()
    assert row["n"] == number
