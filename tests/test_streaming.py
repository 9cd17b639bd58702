import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamscore.operators import attribution as at
from streamscore.operators import features as ft
from streamscore.plans import fixtures as fx
from streamscore.schemas import ENRICHED, UNIFIED
from streamscore.sources import tables
from streamscore.sources.increments import IncrementTable
from streamscore.streaming import jobs
from streamscore.streaming import tables as st


def rows_of(df, columns=None):
    return sorted(map(str, df.select(columns or df.columns).collect()))


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("enriched") / "events")
    tables.append_events(fx.enriched(spark, sf_dir), path)
    return path


def clock(batch_id):
    return fx.BATCHES[batch_id][2]


def feed(spark, stored, source, batch):
    tables.append_events(fx.batch_of(spark.read.schema(ENRICHED).parquet(stored), batch), source)


def folded(spark, stored, batches=3):
    state = None
    for i in range(batches):
        rows = fx.batch_of(spark.read.schema(ENRICHED).parquet(stored), i)
        state = ft.merge_user_features(state, ft.feature_delta(rows, clock(i)), clock(i))
    return state


def test_incremental_merge_equals_folding_by_hand(spark, stored, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    table = st.user_features_table(spark, str(tmp_path / "state"), clock)
    for batch in range(3):
        feed(spark, stored, source, batch)
        st.stream_user_features(
            tables.read_changes(spark, source, ENRICHED), table, clock, progress
        )
        assert rows_of(table.read()) == rows_of(folded(spark, stored, batch + 1))


def test_a_batch_run_again_changes_nothing(spark, stored, tmp_path):
    table = st.user_features_table(spark, str(tmp_path / "state"), clock)
    events = spark.read.schema(ENRICHED).parquet(stored)

    def run(i):
        table.write(ft.feature_delta(fx.batch_of(events, i), clock(i)), i)

    run(0)
    run(1)
    once = rows_of(table.read())
    run(1)
    assert rows_of(table.read()) == once == rows_of(folded(spark, stored, 2))
    table.compact()
    assert rows_of(table.read()) == once and table.batches() == []
    run(2)
    assert rows_of(table.read()) == rows_of(folded(spark, stored, 3))


KEYED = "key string, n long"


def summed(rows):
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def test_a_small_batch_writes_a_small_folder(spark, tmp_path):
    schema = spark.createDataFrame([], KEYED).schema
    table = IncrementTable(spark, str(tmp_path / "t"), schema, combine=summed)
    key = F.concat(F.lit("k"), F.col("id")).alias("key")
    table.write(spark.range(10_000).select(key, F.lit(1).alias("n")), 0)
    before = set((tmp_path / "t").rglob("*.parquet"))
    table.write(spark.range(100).select(key, F.lit(1).alias("n")), 1)
    new = set((tmp_path / "t").rglob("*.parquet")) - before
    assert sum(spark.read.parquet(str(f)).count() for f in new) == 100
    assert table.read().agg(F.sum("n")).first()[0] == 10_100


def test_a_batch_that_died_half_way_does_not_count(spark, tmp_path):
    schema = spark.createDataFrame([], KEYED).schema
    table = IncrementTable(spark, str(tmp_path / "t"), schema, combine=summed)
    table.write(spark.createDataFrame([("a", 1)], KEYED), 0)
    table.write(spark.createDataFrame([("a", 10)], KEYED), 1)
    (tmp_path / "t" / "_level=0" / "_run=1_1" / "_SUCCESS").unlink()
    assert [r["n"] for r in table.read().collect()] == [1]
    table.write(spark.createDataFrame([("a", 10)], KEYED), 1)
    assert [r["n"] for r in table.read().collect()] == [11]


def test_compaction_keeps_the_content_and_drops_what_is_replaced(spark, tmp_path):
    schema = spark.createDataFrame([], KEYED).schema
    table = IncrementTable(spark, str(tmp_path / "t"), schema, combine=summed, part=F.col("key"))
    for batch in range(6):
        table.write(spark.createDataFrame([("a", 1), (f"k{batch % 2}", 1)], KEYED), batch)
        if batch in (1, 3):
            table.compact()
    assert table.batches() == [4, 5]
    assert sorted(p.name for p in (tmp_path / "t" / "_level=0").iterdir()) == [f"_run={b}_{b}" for b in (2, 3, 4, 5)]
    assert table.runs() == [(1, 0, 1), (1, 2, 3), (0, 4, 4), (0, 5, 5)]
    assert {r["key"]: r["n"] for r in table.read().collect()} == {"a": 6, "k0": 3, "k1": 3}
    assert [r["n"] for r in table.read(parts=["k0"]).collect()] == [3]
    assert IncrementTable(spark, str(tmp_path / "none"), schema, combine=summed).read().count() == 0


def rows_in(folder):
    """Rows of the Parquet files of each run, by the run's folder."""
    import pyarrow.parquet as pq

    runs = {}
    for file in folder.rglob("*.parquet"):
        run = "/".join(p for p in file.parts if p.startswith(("_level=", "_run=")))
        runs[run] = runs.get(run, 0) + pq.read_metadata(file).num_rows
    return runs


def test_a_compaction_writes_what_few_batches_brought(spark, tmp_path):
    """Rows written per compaction do not grow with the table, but for a merge of whole levels."""
    schema = spark.createDataFrame([], KEYED).schema
    table = IncrementTable(spark, str(tmp_path / "t"), schema, combine=summed, fan=4)
    written = []
    for batch in range(32):
        key = F.concat(F.lit(f"k{batch}-"), F.col("id")).alias("key")
        table.write(spark.range(10).select(key, F.lit(1).alias("n")).coalesce(1), batch)
        if batch % 2:
            before = set(table._runs())
            table.compact()
            new = rows_in(tmp_path / "t")
            made = sorted(r for r in table._runs() if r not in before)
            written.append([new[f"_level={r.level}/_run={r.first}_{r.last}"] for r in made])
    assert table.read().count() == 320 and table.read().agg(F.sum("n")).first()[0] == 320
    # Two batches each time; four runs of level 1 every fourth time, of level 2 every sixteenth.
    assert [w[0] for w in written] == [20] * 16
    assert [len(w) for w in written] == [1, 1, 1, 2, 1, 1, 1, 2, 1, 1, 1, 2, 1, 1, 1, 3]
    assert [w[1:] for w in written if len(w) > 1] == [[80], [80], [80], [80, 320]]
    assert table.runs() == [(3, 0, 31)]


def test_followed_tables_compact_the_touched_keys_only(spark, tmp_path):
    """Order matters here: a later value replaces, and the number of changes adds up."""
    schema = spark.createDataFrame([], "key string, n long, changes long").schema

    def follow(state, rows, batch):
        joined = state.alias("s").join(rows.alias("r"), "key", "full")
        changes = F.coalesce("s.changes", F.lit(0)) + F.when(F.col("r.n").isNull(), 0).otherwise(1)
        return joined.select("key", F.coalesce("r.n", "s.n").alias("n"), changes.alias("changes"))

    table = IncrementTable(
        spark,
        str(tmp_path / "t"),
        schema,
        follow=follow,
        key=["key"],
        increment=spark.createDataFrame([], KEYED).schema,
        fan=2,
    )
    want = {}
    for batch in range(12):
        rows = [(f"k{k}", batch) for k in range(100 if batch == 0 else 5 + batch)]
        want |= {k: (n, want.get(k, (0, 0))[1] + 1) for k, n in rows}
        table.write(spark.createDataFrame(rows, KEYED), batch)
        if batch % 2:
            table.compact()
        got = {r["key"]: (r["n"], r["changes"]) for r in table.read().collect()}
        assert got == want
    sizes = rows_in(tmp_path / "t")
    assert sizes["_level=1/_run=10_11"] == 16  # and not the 100 keys of the state


def test_jobs_compact_as_they_go(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    schema = spark.createDataFrame([], KEYED).schema
    table = IncrementTable(spark, str(tmp_path / "t"), schema, combine=summed)
    for _ in range(4):
        spark.createDataFrame([("a", 1)], KEYED).write.mode("append").parquet(source)
        rows = tables.read_changes(spark, source, schema)
        jobs.maintain(rows, table, lambda batch, _: summed(batch), progress, compact_every=2)
        assert len(table.batches()) < 2
    assert [r["n"] for r in table.read().collect()] == [4]


def test_tiles_equal_exact_windows_at_whole_minutes(spark, stored, tmp_path):
    events = spark.read.schema(ENRICHED).parquet(stored)
    for as_of in ("2024-01-20 12:34:00", fx.AS_OF):
        tiles = st.features_from_tiles(st.feature_tiles(events), as_of)
        exact = ft.rolling_user_features(events, as_of)
        assert rows_of(tiles) == rows_of(exact, tiles.columns)
        online = st.online_from_tiles(st.feature_tiles(events), as_of)
        assert rows_of(online) == rows_of(ft.online_user_features(events, as_of), online.columns)


def test_horizon_reads_only_its_parts(spark, stored, tmp_path):
    as_of = datetime(2024, 1, 31)
    table = st.tiles_table(spark, str(tmp_path / "tiles"))
    tiles = st.feature_tiles(spark.read.schema(ENRICHED).parquet(stored))
    table.write(tiles, 0)
    parts = st.tile_parts(as_of, 48, "day")
    assert len(parts) == 3
    some = table.read(parts=parts)
    assert set(r[0] for r in some.select(F.date_format("tile", "yyyyMMdd")).collect()) <= set(parts)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1][:200]
    assert rows_of(st.online_from_tiles(some, as_of)) == rows_of(
        st.online_from_tiles(table.read(), as_of)
    )


def event(i, ts, kind="CL"):
    return (f"e{i}", "U1", kind, "C001", "Spring Sale Display", "display", datetime.fromisoformat(ts), None)


@pytest.mark.parametrize("late,expected", [("accept", 3), ("drop", 2)])
def test_late_events(spark, tmp_path, late, expected):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    table = st.tiles_table(spark, str(tmp_path / "tiles"), late=late)
    arrivals = [event(1, "2024-01-01 10:00:00"), event(2, "2024-01-02 10:00:00"), event(3, "2024-01-01 09:00:00")]
    dropped = 0
    for row in arrivals:
        tables.append_events(spark.createDataFrame([row], ENRICHED), source)
        query = st.stream_feature_tiles(
            tables.read_changes(spark, source, ENRICHED), table, progress, late=late
        )
        dropped += sum(p["numRowsDroppedByWatermark"] for b in query.recentProgress for p in b["stateOperators"])
    assert dropped == 3 - expected
    assert jobs.rates(query)["batch_id"] >= 2
    assert table.read().agg(F.sum("events")).first()[0] == expected


def test_late_policy_is_checked(spark, stored, tmp_path):
    with pytest.raises(ValueError):
        st.stream_feature_tiles(
            tables.read_changes(spark, stored, ENRICHED), None, str(tmp_path), late="maybe"
        )


def test_newest_copy_wins_however_late(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    table = jobs.unified_table(spark, str(tmp_path / "t"))
    for ts, value in [("10:00", 1.0), ("12:00", 2.0), ("11:00", 3.0)]:
        row = ("e1", "U1", "CN", "C001", datetime.fromisoformat(f"2024-01-01 {ts}:00"), value)
        tables.append_events(spark.createDataFrame([row], UNIFIED), source)
        jobs.stream_unify(tables.read_changes(spark, source, UNIFIED), table, progress)
    assert [r["conversion_value"] for r in table.read().collect()] == [2.0]


def test_enriched_rows_are_appended_once(spark, sf_dir, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    tables.append_events(fx.unified(spark, sf_dir), source)
    for _ in range(2):
        jobs.stream_enrich(
            tables.read_changes(spark, source, UNIFIED), fx.campaigns(spark), out, progress
        )
    assert spark.read.parquet(out).count() == 1000


def test_history_then_stream_counts_every_event_once(spark, stored, tmp_path):
    """Events from before the backfill that arrive after it are counted, too."""
    source = str(tmp_path / "in")
    events = spark.read.schema(ENRICHED).parquet(stored)
    table = st.tiles_table(spark, str(tmp_path / "tiles"))
    for batch in (1, 0, 2, None):
        if batch is not None:
            tables.append_events(fx.batch_of(events, batch), source)
        jobs.backfill_then_stream(
            spark,
            source,
            ENRICHED,
            table,
            prepare=lambda rows, _: st.feature_tiles(rows),
            checkpoint=str(tmp_path / "progress"),
        )
    assert rows_of(table.read()) == rows_of(st.feature_tiles(events))


def test_distinct_events_are_kept_however_late(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    table = jobs.arrivals_table(spark, str(tmp_path / "t"))
    moments = ["2024-01-05 10:00:00", "2024-01-01 10:00:00", "2024-01-03 10:00:00"]
    for k, ts in enumerate(moments):
        rows = [(e, "U1", "CL", "C001", datetime.fromisoformat(ts), None) for e in (f"e{k}", "copy")]
        tables.append_events(spark.createDataFrame(rows, UNIFIED), source)
        jobs.stream_dedup(tables.read_changes(spark, source, UNIFIED), table, progress)
    got = {r["event_id"]: (str(r["event_ts"]), r["arrival"]) for r in table.read().collect()}
    assert got == {f"e{k}": (ts, k) for k, ts in enumerate(moments)} | {"copy": (moments[0], 0)}


def test_served_scores_are_replaced_without_a_gap(spark, tmp_path):
    path = str(tmp_path / "serving")
    tables.publish(spark.range(5), ["id"], path, 0)
    reader = tables.read_published(spark, path)
    tables.publish(spark.range(9), ["id"], path, 1)
    assert reader.count() == 5 and tables.read_published(spark, path).count() == 9
    (tmp_path / "serving" / "version=1" / "_SUCCESS").unlink()
    assert tables.read_published(spark, path).count() == 5


def test_jobs_can_run_at_an_interval(spark, stored, tmp_path):
    query = jobs.stream_enrich(
        tables.read_changes(spark, stored, ENRICHED).drop("campaign_name", "channel"),
        fx.campaigns(spark),
        str(tmp_path / "out"),
        str(tmp_path / "progress"),
        every="1 minute",
    )
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_copies_in_many_files_leave_one_row(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    table = jobs.arrivals_table(spark, str(tmp_path / "t"))
    for arrival in range(3):
        rows = spark.range(400).select(
            F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("event_id"),
            *[F.lit("x").alias(c) for c in ("user_id", "event_type", "campaign_id")],
            F.lit(f"2024-01-01 10:0{arrival}:00").cast("timestamp_ntz").alias("event_ts"),
            F.lit(None).cast("double").alias("conversion_value"),
        )
        tables.append_events(rows.repartition(4), source)
        jobs.stream_dedup(tables.read_changes(spark, source, UNIFIED), table, progress)
    kept = table.read()
    assert kept.count() == kept.select("event_id").distinct().count() == 400 - 134 + 1
    assert {r[0] for r in kept.select("arrival").distinct().collect()} == {0}


def test_ingest_lands_every_message_once(spark, sf_dir, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    messages = fx.envelopes(spark, sf_dir, "conversion_events")
    for arrival in range(2):
        messages.write.mode("append").text(source)
        for _ in range(2):
            jobs.stream_ingest(spark.readStream.text(source), "conversion_events", out, progress)
        valid, bad = jobs.read_landed(spark, out)
        assert valid.count() + bad.count() == (arrival + 1) * messages.count()
    assert bad.count() > 0 and bad.filter(F.col("value").isNull()).count() == 0
    assert valid.filter(F.col("event_ts").isNull()).count() == 0


def test_backfilled_files_are_not_opened_again(spark, stored, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    events = spark.read.schema(ENRICHED).parquet(stored)
    table = st.tiles_table(spark, str(tmp_path / "tiles"))
    follow = lambda: jobs.backfill_then_stream(
        spark, source, ENRICHED, table, lambda rows, _: st.feature_tiles(rows), progress
    )
    tables.append_events(fx.batch_of(events, 0).repartition(3), source)
    assert [p["numInputRows"] for p in follow().recentProgress if p["numInputRows"]] == [
        fx.batch_of(events, 0).count()
    ]
    for file in (tmp_path / "in").glob("part-*"):
        file.write_bytes(b"this file must not be opened again")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    tables.append_events(fx.batch_of(events, 1), source)
    follow()
    both = fx.batch_of(events, 0).unionByName(fx.batch_of(events, 1))
    assert rows_of(table.read()) == rows_of(st.feature_tiles(both))


def unified_row(i, ts, value=1.0):
    return (f"e{i}", f"U{i % 3}", "CN", "C001", datetime.fromisoformat(ts), value)


def test_a_refresh_opens_the_days_of_its_horizon_only(spark, tmp_path):
    source, progress, serving = (str(tmp_path / n) for n in ("in", "progress", "serving"))
    table = jobs.unified_table(spark, str(tmp_path / "unified"))

    def refresh(rows, as_of):
        tables.append_events(spark.createDataFrame(rows, UNIFIED), source)
        jobs.stream_pipeline(
            tables.read_changes(spark, source, UNIFIED),
            table,
            fx.campaigns(spark),
            serving,
            clock=lambda i: as_of,
            checkpoint=progress,
            compact_every=10,
        )

    early = [unified_row(i, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(9)]
    refresh(early, "2024-01-03 12:00:00")
    old = list((tmp_path / "unified").rglob("_part=2024010[123]/*.parquet"))
    assert len(old) >= 3
    for file in old:
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"this file must not be opened again")
    late = [unified_row(20, "2024-01-20 10:00:00"), unified_row(3, "2024-01-19 10:00:00", 5.0)]
    refresh(late, datetime(2024, 1, 20, 12))
    refresh([unified_row(20, "2024-01-20 11:00:00", 2.0)], "2024-01-20 12:00:00")
    scores = {r["user_id"] for r in tables.read_published(spark, serving).collect()}
    assert scores == {"U0", "U2"}
    assert sorted(p.name for p in (tmp_path / "serving").iterdir()) == ["version=1", "version=2"]
    with pytest.raises(Exception, match="must not be opened|not a Parquet|CANNOT_READ"):
        table.read().collect()


def test_money_below_a_cent_is_kept_in_streams(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    table = st.journey_channels_table(spark, str(tmp_path / "t"))
    for k in range(3):
        row = (f"e{k}", "U1", "CN", "C001", "x", "display", datetime(2024, 1, 1, k), 0.004)
        tables.append_events(spark.createDataFrame([row], ENRICHED), source)
        st.stream_journeys(tables.read_changes(spark, source, ENRICHED), table, progress)
        table.compact()
    assert float(table.read().first()["value"]) == 0.012


def decay_tables(spark, tmp_path):
    return st.touches_table(spark, str(tmp_path / "touches")), st.decay_cells_table(spark, str(tmp_path / "cells"))


def close(a, b):
    a, b = ({r["channel"]: (r["conversions"], r["attributed_revenue"]) for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], rel=1e-9)


def test_streamed_time_decay_takes_late_touches(spark, stored, tmp_path):
    """Every prefix of batches in any order gives what the batch operator gives."""
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    touches, cells = decay_tables(spark, tmp_path)
    events = spark.read.schema(ENRICHED).parquet(stored)
    number = F.pmod(F.xxhash64("event_id"), F.lit(4))  # neighbours in time come apart
    for batch in range(4):
        tables.append_events(events.filter(number == batch), source)
        st.stream_time_decay(
            tables.read_changes(spark, source, ENRICHED), touches, cells, progress, compact_every=2
        )
        so_far = events.filter(number <= batch)
        close(at.credit_from_cells(cells.read()), at.attribute(so_far, "time_decay"))
    columns = ["user_id", "event_id", "touch_idx", "touchpoint_count", "conversion_value", "channel", "event_type"]
    numbered = at.touchpoints_from_cells(touches.read(), cells.read())
    assert rows_of(numbered, columns) == rows_of(at.touchpoints(events), columns)
    day = F.to_date("event_ts") == F.lit("2024-01-15").cast("date")
    some = at.touchpoints_from_cells(touches.read(parts=["20240115"]), cells.read())
    assert rows_of(some, columns) == rows_of(at.touchpoints(events).filter(day), columns)


def touch(i, user, ts, kind="CL", channel="display", value=None):
    return (f"e{i:03d}", user, kind, "C001", "x", channel, datetime.fromisoformat(ts), value)


def test_decay_cells_of_ties_and_odd_rows(spark, tmp_path):
    touches, cells = decay_tables(spark, tmp_path)
    same = "2024-01-01 10:00:00"
    batches = [
        [touch(5, "U1", same), touch(9, "U1", same, "CN", "email", 10.0), touch(7, "U2", same)],
        [touch(1, "U1", same, "IM", None), touch(6, "U1", same, "CL", "search"), touch(2, "U3", same, "CN", "x", 3.0)],
        [touch(3, "U2", "2023-12-31 23:59:59", "CN", "email", None), touch(8, "U1", "2024-01-01 10:59:59.999", "PS")],
        [],
        [touch(k + 20, "U1", f"2024-01-02 10:{k:02d}:00", "CN", "email", 0.004) for k in range(40)],
    ]
    seen = []
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    for rows in batches:
        seen += rows
        tables.append_events(spark.createDataFrame(rows, ENRICHED), source)
        st.stream_time_decay(tables.read_changes(spark, source, ENRICHED), touches, cells, progress)
        events = spark.createDataFrame(seen, ENRICHED)
        close(at.credit_from_cells(cells.read()), at.attribute(events, "time_decay"))
    assert at.credit_from_cells(st.decay_cells_table(spark, str(tmp_path / "none")).read()).count() == 0


def test_a_touch_changes_its_own_hour_only(spark, stored, tmp_path):
    touches, cells = decay_tables(spark, tmp_path)
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    run = lambda: st.stream_time_decay(
        tables.read_changes(spark, source, ENRICHED), touches, cells, progress
    )
    events = spark.read.schema(ENRICHED).parquet(stored)
    tables.append_events(events, source)
    run()
    first = events.orderBy("event_ts", "event_id").first()
    late = [("late", *tuple(first)[1:])]
    tables.append_events(spark.createDataFrame(late, ENRICHED), source)
    run()
    changed = rows_in(tmp_path / "cells")["_level=0/_run=1_1"]
    hour = F.date_trunc("hour", "event_ts") == F.date_trunc("hour", F.lit(first["event_ts"]))
    own = events.filter((F.col("user_id") == first["user_id"]) & hour)
    assert changed == own.select("channel").distinct().count()
    both = events.unionByName(spark.createDataFrame(late, ENRICHED))
    close(at.credit_from_cells(cells.read()), at.attribute(both, "time_decay"))


def test_a_horizon_is_covered_by_few_whole_tiles():
    step = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1)}
    rng = random.Random(1)
    moments = [datetime(2024, 2, 28) + timedelta(minutes=rng.randint(0, 5000)) for _ in range(300)]
    moments += [datetime(2024, 3, 1), datetime(2024, 3, 1, 5), datetime(2024, 3, 1, 0, 1), datetime(2024, 3, 1, 23, 59)]
    for as_of in moments:
        for hours in (1, 2, 24, 48, 168):
            cover = st.horizon_cover(as_of, hours)
            at = as_of - timedelta(hours=hours)
            for unit, low, high in cover:
                assert low == at and low < high and not (low - datetime(1970, 1, 1)) % step[unit]
                assert not (high - low) % step[unit]
                at = high
            assert at == as_of
            assert sum((high - low) // step[unit] for unit, low, high in cover) <= 91
    with pytest.raises(ValueError):
        st.horizon_cover("2024-01-01 10:00:01", 1)


def test_levels_of_tiles_equal_exact_windows(spark, stored, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    levels = st.tile_levels(spark, str(tmp_path / "levels"))
    events = spark.read.schema(ENRICHED).parquet(stored)
    for batch in (2, 0, 1):
        feed(spark, stored, source, batch)
        changes = tables.read_changes(spark, source, ENRICHED)
        st.stream_tile_levels(changes, levels, progress, compact_every=2)
    for as_of in ("2024-01-20 12:34:00", "2024-01-21 00:00:00", datetime(2024, 1, 20, 0, 1)):
        exact = ft.rolling_user_features(events.filter(F.col("event_ts") < F.lit(str(as_of)).cast("timestamp_ntz")), as_of)
        got = st.features_from_levels(levels, as_of)
        assert rows_of(got) == rows_of(exact, got.columns)
        online = st.online_from_levels(levels, as_of)
        assert rows_of(online) == rows_of(ft.online_user_features(events, as_of), online.columns)
    for file in (tmp_path / "levels" / "minute").rglob("_part=2024011[5-8]/*.parquet"):
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"minutes inside the horizon are not opened")
    again = st.features_from_levels(levels, "2024-01-20 12:34:00")
    assert rows_of(again) == rows_of(ft.rolling_user_features(events, "2024-01-20 12:34:00"), again.columns)
