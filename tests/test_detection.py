from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemetry_lake.operators import detection
from telemetry_lake.operators.decode import accepted, decode_readings, quarantined, timed_readings
from telemetry_lake.operators.detection import ARRIVAL, EVENT, detect, detect_by_count, keyed_readings
from telemetry_lake.plans.replay import replay
from telemetry_lake.schemas import READING, STREAK, AlertRules
from telemetry_lake.streaming.detector import advance
from tests.samples import at, reading, topic

READINGS = "transformerId string, offset bigint, seconds double, score double"


def readings(spark, rows):
    """(transformer, offset, seconds, score) as decoded readings; arrival and event time agree."""
    data = spark.createDataFrame(
        [(t, o, at(s), float(score)) for t, o, s, score in rows],
        "transformerId string, offset bigint, eventTime timestamp, failureRiskScore double",
    )
    filled = {
        "sensorId": F.concat(F.lit("s-"), F.col("offset")), "timestamp": F.col("eventTime").cast("string"),
        "region": F.lit("R"), "voltage": F.lit(230.0), "current": F.lit(1.0), "temperature": F.lit(40.0),
        "load": F.lit(50.0), "status": F.lit("ONLINE"), "partition": F.lit(0),
        "kafkaTimestamp": F.col("eventTime"),
    }
    return data.withColumns(filled)


def brute_force(rows, window=30.0):
    """The rule, one reading at a time."""
    since, found = {}, set()
    for transformer, offset, seconds, score in rows:
        high = score >= 0.8
        since[transformer] = (since.get(transformer) if since.get(transformer) is not None else seconds) if high else None
        if high and (score >= 0.9 or seconds - since[transformer] >= window):
            found.add((transformer, offset, "CRITICAL" if score >= 0.9 else "WARNING"))
    return found


def found(alerts):
    rows = alerts.select("severity", "source.transformerId", "source.sensorId").collect()
    return {(r.transformerId, int(r.sensorId[2:]), r.severity) for r in rows}


# (seconds, score) per reading, and the readings that alert.
CASES = {
    "held": ([(1, 0.85)], {}),
    "kept": ([(1, 0.85), (2, 0.85)], {}),
    "sustained at exactly the window": ([(0, 0.85), (30, 0.85)], {1: "WARNING"}),
    "just short of the window": ([(0, 0.85), (29.999, 0.85)], {}),
    "critical at once": ([(0, 0.95)], {0: "CRITICAL"}),
    "reset": ([(0, 0.85), (5, 0.5), (31, 0.85)], {}),
    "critical starts a streak": ([(0, 0.95), (30, 0.8)], {0: "CRITICAL", 1: "WARNING"}),
    "gaps do not end it, alerts go on": ([(0, 0.8), (9000, 0.8), (9001, 0.8)], {1: "WARNING", 2: "WARNING"}),
    "nan ends it": ([(0, 0.85), (5, float("nan")), (31, 0.85)], {}),
    "another transformer does not": ([(0, 0.85), (30, 0.85), (31, 0.7), (32, 0.85)], {1: "WARNING"}),
}


@pytest.mark.parametrize("width", [1, 3, None])
@pytest.mark.parametrize("clock", [EVENT, ARRIVAL], ids=["event", "arrival"])
def test_rule(spark, clock, width):
    rows = [
        (case, offset, *step) for case, (steps, _) in CASES.items() for offset, step in enumerate(steps)
    ]
    expected = {(case, offset, word) for case, (_, words) in CASES.items() for offset, word in words.items()}
    assert found(detect(readings(spark, rows), clock, width=width)) == expected


def hot_rows(count, seed):
    """One transformer owns most readings, several share an instant, streaks are long."""
    rng = random.Random(seed)
    rows, score = [], 0.5
    for offset in range(count):
        transformer = "hot" if rng.random() < 0.7 else f"t{rng.randrange(5)}"
        if rng.random() < 0.2:
            score = rng.choice([0.1, 0.79, 0.8, 0.85, 0.9, 1.0])
        rows.append((transformer, offset, offset // 3, score if transformer == "hot" else rng.random()))
    return rows


@pytest.mark.parametrize("width", [1, 60, 10_000])
def test_slices_never_change_the_answer(spark, width):
    rows = hot_rows(1500, seed=width)
    expected = brute_force(rows, window=5.0)
    got = detect(readings(spark, rows), ARRIVAL, AlertRules(window_millis=5000), width)
    assert found(got) == expected and {s for _, _, s in expected} == {"CRITICAL", "WARNING"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 4), st.sampled_from([0.1, 0.8, 0.85, 0.95])), max_size=40),
    st.integers(1, 6),
)
def test_any_history(spark, steps, width):
    rows, now = [], 0
    for offset, (transformer, gap, score) in enumerate(steps):
        now += gap
        rows.append((transformer, offset, now, score))
    rules = AlertRules(window_millis=4000)
    assert found(detect(readings(spark, rows), ARRIVAL, rules, width)) == brute_force(rows, 4.0)


@pytest.mark.parametrize("levels", [1, 2])
def test_a_tree_of_slices_never_changes_the_answer(spark, monkeypatch, levels):
    monkeypatch.setattr(detection, "FAN", 4)
    for seed, width in ((21, 1), (22, 7)):
        rows = hot_rows(700, seed)
        got = detect(readings(spark, rows), ARRIVAL, AlertRules(window_millis=5000), width, levels)
        assert found(got) == brute_force(rows, 5.0)
    rows = [(t, o, o, s) for t, o, _, s in hot_rows(300, 23)]
    got = detect(readings(spark, rows), EVENT, AlertRules(window_millis=5000), 2_000_000, levels)
    assert found(got) == brute_force(rows, 5.0)


def test_all_readings_of_one_transformer_in_one_second(spark, tmp_path):
    rng = random.Random(31)
    scores = [rng.choice([0.85, 0.85, 0.85, 0.95, 0.1]) for _ in range(4000)]
    # A hundred readings to a millisecond, then a long quiet streak.
    rows = [("hot", n, n // 100 / 1000, s) for n, s in enumerate(scores)]
    rows += [("hot", 4000 + n, 0.9, 0.85) for n in range(500)] + [("t", 9000, 0.5, 0.95)]
    bronze = readings(spark, rows).withColumn("sensorId", F.format_string("s-%d", 10_000 + F.col("offset")))
    rules = AlertRules(window_millis=3)
    got = detect_by_count(bronze, str(tmp_path / "pieces"), 8, EVENT, rules, levels=1)
    assert {(t, n - 10_000, w) for t, n, w in found(got)} == brute_force(rows, 0.003)
    sizes = spark.read.parquet(str(tmp_path / "pieces")).groupBy("transformerId", "slice").count()
    hot = [r["count"] for r in sizes.where("transformerId = 'hot'").collect()]
    assert len(hot) >= 7 and max(hot) < 4500 / 3
    # By width they would all be one slice.
    assert keyed_readings(bronze, EVENT, rules).where("transformerId = 'hot'").select("slice").distinct().count() == 1


def test_hot_transformer_is_spread_over_slices(spark):
    rows = hot_rows(3000, seed=1)
    keyed = keyed_readings(readings(spark, rows), ARRIVAL, AlertRules(), 50)
    sizes = keyed.groupBy("transformerId", "slice").count()
    hot = sizes.filter("transformerId = 'hot'").agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert hot[0] == 60 and hot[1] <= 50 and hot[2] == sum(1 for r in rows if r[0] == "hot")


@pytest.mark.parametrize("width", [1, 7, 10**6])
def test_slices_follow_the_order(spark, width):
    rows = [("t", offset, offset - 5, 0.9) for offset in range(-3, 40)]
    for clock in (ARRIVAL, EVENT):
        got = keyed_readings(readings(spark, rows), clock, AlertRules(), width).orderBy("seq").collect()
        slices = [tuple(r.slice) for r in got]
        assert slices == sorted(slices)
        if clock is ARRIVAL:
            assert [s[1] for s in slices] == [offset // width for offset in range(-3, 40)]


def test_plan_shuffles_readings_once_and_by_slice(spark):
    keyed = keyed_readings(readings(spark, hot_rows(50, 3)), EVENT, AlertRules())
    plan = detect(readings(spark, hot_rows(50, 3)))._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("CartesianProduct", "BroadcastNestedLoopJoin", "aggregate(", "cuts"))
    assert "hashpartitioning(transformerId" in plan and "slice" in plan
    low = keyed.filter("level = 0").select(F.max(F.col("source").isNotNull())).first()[0]
    assert low is False


def test_ids_repeat_on_replay_and_differ_for_copies(spark):
    twice = topic(spark, [reading(failureRiskScore=0.95)] * 2)
    first = detect(timed_readings(decode_readings(twice))).select("alertId", "reason", "detectedAt", "source").collect()
    again = detect(timed_readings(decode_readings(twice))).select("alertId").collect()
    assert len({r.alertId for r in first}) == 2
    assert {r.alertId for r in first} == {r.alertId for r in again}
    assert first[0].reason == "failureRiskScore=0.95 -> CRITICAL (warn>=0.8, crit>=0.9)"
    assert first[0].detectedAt == 1801627200000 and first[0].source.status == "NORMAL"


def test_replay_job(spark, tmp_path):
    bronze = topic(spark, [reading(failureRiskScore=0.95), reading(failureRiskScore=None), "junk"])
    assert replay(bronze, str(tmp_path / "readings")).count() == 1
    assert spark.read.parquet(str(tmp_path / "readings")).count() == 2
    assert accepted(decode_readings(bronze)).count() == 2


def test_unreadable_timestamp_counts_at_the_record_time(spark):
    bronze = topic(spark, [reading(failureRiskScore=0.95, timestamp="zz")], start=7)
    (row,) = detect(timed_readings(decode_readings(bronze))).collect()
    assert row.detectedAt == 1801627207000 and row.source.timestamp == "zz"


def test_readings_without_the_clocks_instant_are_quarantined(spark):
    raw = topic(spark, [reading(timestamp="zz"), reading(), "junk"]).withColumn("kafkaTimestamp", F.lit(None).cast("timestamp"))
    decoded = decode_readings(raw)
    for clock, kept in ((EVENT, {1}), (ARRIVAL, set())):
        assert {r.offset for r in timed_readings(decoded, clock.instant).collect()} == kept
        assert {r.offset for r in quarantined(decoded, raw.columns, clock.instant).collect()} == {0, 1, 2} - kept


# ------------------------------------------------------------ micro-batches


def run_batches(spark, batches, clock, rules, width):
    streaks, got = spark.createDataFrame([], STREAK), set()
    for rows in batches:
        alerts, after = advance(readings(spark, rows), streaks, clock, rules, width, lambda d: d.persist())
        got |= found(alerts)
        streaks = spark.createDataFrame(after.collect(), STREAK)
    return got, {r.transformerId: (r.since, r.lastMillis) for r in streaks.collect()}


@pytest.mark.parametrize(("clock", "width"), [(EVENT, 20_000_000), (ARRIVAL, 20), (EVENT, None)])
def test_micro_batches_equal_the_replay(spark, clock, width):
    rows = hot_rows(600, seed=11)
    rows = [(t, o, o, s) for t, o, _, s in rows]
    batches = [rows[:150], rows[150:151], rows[151:400], rows[400:]]
    rules = AlertRules(window_millis=8000)
    got, _ = run_batches(spark, batches, clock, rules, width)
    assert got == brute_force(rows, 8.0)


def test_streak_is_carried_and_only_open_ones_are_kept(spark):
    batches = [[("a", 0, 0, 0.85), ("b", 1, 1, 0.85)], [("b", 2, 2, 0.1)], [("a", 3, 30, 0.85)]]
    got, state = run_batches(spark, batches, ARRIVAL, AlertRules(), 1000)
    assert got == {("a", 3, "WARNING")}
    assert set(state) == {"a"}


def test_late_reading_leaves_the_streak_alone(spark):
    batches = [
        [("a", 0, 100, 0.85)],
        [("a", 1, 90, 0.1), ("a", 2, 95, 0.95), ("a", 3, 50, 0.85)],
        [("a", 4, 130, 0.85)],
    ]
    got, state = run_batches(spark, batches, EVENT, AlertRules(), 1000)
    assert got == {("a", 2, "CRITICAL"), ("a", 4, "WARNING")}
    assert state["a"] == (1801627300000, 1801627330000)


def test_late_and_timely_readings_in_one_batch(spark):
    batches = [[("a", 0, 100, 0.85)], [("a", 1, 90, 0.1), ("a", 2, 131, 0.85), ("a", 3, 132, 0.2)]]
    got, state = run_batches(spark, batches, EVENT, AlertRules(), 1000)
    assert got == {("a", 2, "WARNING")} and state["a"][0] is None


def test_reading_schema_is_kept_in_the_envelope(spark):
    alerts = detect(readings(spark, [("t", 0, 0, 0.95)]))
    assert alerts.columns == ["alertId", "severity", "reason", "detectedAt", "source", "partition", "offset"]
    assert [(f.name, f.dataType) for f in alerts.schema["source"].dataType] == [(f.name, f.dataType) for f in READING]


def test_readings_behind_the_state_need_no_look_at_it(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), second, second, rng.choice([0.1, 0.85, 0.85, 0.85, 0.95])) for second in range(80)]
    start = spark.createDataFrame([], STREAK)
    _, state = advance(readings(spark, rows[:40]), start, EVENT, width=3_000_000)
    plain, ordered = (
        advance(readings(spark, rows[40:]), state, EVENT, width=3_000_000, closed=True, in_order=kept) for kept in (False, True)
    )
    assert found(ordered[0]) == found(plain[0])
    assert sorted(ordered[1].collect()) == sorted(plain[1].collect())
    # Two shuffles of readings less: the state is not joined to them.
    joins = [str(a._jdf.queryExecution().optimizedPlan()).count("Join") for a in (plain[0], ordered[0])]
    assert joins[1] < joins[0]
