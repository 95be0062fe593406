"""Late readings: after every batch, what holds is what the replay of the readings so far says."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from telemetry_lake.operators.decode import accepted, decode_alerts
from telemetry_lake.schemas import AlertRules
from telemetry_lake.sources import commits
from telemetry_lake.sources.lake import through_table
from telemetry_lake.sources.tables import read_table
from telemetry_lake.streaming import corrections
from telemetry_lake.streaming.corrections import WITHDRAWN, CorrectionPaths, holding, take_batch
from telemetry_lake.streaming.detector import MESSAGE_SCHEMA
from tests.test_detection import brute_force, found, readings

RULES = AlertRules(window_millis=4000)


def paths_in(tmp_path):
    return CorrectionPaths(*[str(tmp_path / name) for name in ("messages", "withdrawn", "quarantine", "table", "cp")])


def take(spark, paths, rows, batch, delay=60, width=None):
    return take_batch(spark, paths, through_table(spark, readings(spark, rows), "in"), "r", batch, delay * 1000, RULES, width)


def said(spark, paths):
    return accepted(decode_alerts(read_table(spark, paths.messages, MESSAGE_SCHEMA)))


def holds(spark, paths):
    columns = ["alertId", "severity", "reason", "detectedAt", "source"]
    return found(holding(said(spark, paths).select(*columns), read_table(spark, paths.withdrawn, WITHDRAWN)))


def in_time(rows):
    return sorted(rows, key=lambda r: r[2])


def test_shuffled_readings_end_as_the_replay_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corrections, "WHOLE", 2)
    rng, paths = random.Random(3), paths_in(tmp_path)
    rows = [
        (rng.choice(["hot", "hot", "b"]), second, second, rng.choice([0.1, 0.85, 0.85, 0.85, 0.85, 0.95]))
        for second in range(160)
    ]
    # Up to 25 seconds late.
    arrival = sorted(rows, key=lambda r: r[2] + rng.random() * 25)
    so_far = []
    for batch, (a, b) in enumerate([(0, 50), (50, 51), (51, 100), (100, 130), (130, 160)]):
        so_far += arrival[a:b]
        version = take(spark, paths, arrival[a:b], batch, 30, 3_000_000)
        assert holds(spark, paths) == brute_force(in_time(so_far), 4.0)
    assert read_table(spark, paths.withdrawn, WITHDRAWN).count() == 5
    # What is settled is let go of: only late parts still hold open readings.
    assert [part["open"] for part in version.parts].count(True) < 4
    assert version.number == 5 and sum(part["streaks"] for part in version.parts) <= 3


def test_a_late_reading_withdraws_and_restores(spark, tmp_path):
    paths = paths_in(tmp_path)
    take(spark, paths, [("a", 0, 10, 0.85), ("a", 5, 15, 0.85), ("b", 1, 10, 0.95)], 0)
    assert holds(spark, paths) == {("a", 5, "WARNING"), ("b", 1, "CRITICAL")}
    take(spark, paths, [("a", 2, 12, 0.1)], 1)
    assert holds(spark, paths) == {("b", 1, "CRITICAL")}
    version = take(spark, paths, [("a", 3, 11.9, 0.1), ("a", 4, 12.1, 0.85), ("a", 6, 17, 0.85)], 2)
    assert holds(spark, paths) == {("a", 6, "WARNING"), ("b", 1, "CRITICAL")}
    # Tried again, a batch neither says nor withdraws anything twice.
    messages = said(spark, paths).count()
    assert take(spark, paths, [("a", 9, 18, 0.95)], 2) == version and said(spark, paths).count() == messages


def test_behind_the_horizon_only_critical_readings_alert(spark, tmp_path):
    paths = paths_in(tmp_path)
    take(spark, paths, [("a", 0, 0, 0.85), ("a", 1, 100, 0.85)], 0, delay=20)
    # 100 was newest, so the horizon is 80: these change no streak.
    take(spark, paths, [("a", 2, 50, 0.1), ("a", 3, 60, 0.95), ("a", 4, 70, 0.85)], 1, delay=20)
    assert holds(spark, paths) == {("a", 1, "WARNING"), ("a", 3, "CRITICAL")}
    take(spark, paths, [("a", 5, 101, 0.85)], 2, delay=20)
    state = corrections.streaks_at(spark, paths.table, commits.latest(spark, paths.table)).collect()
    assert [(r.transformerId, r.since is not None) for r in state] == [("a", True)]
    assert ("a", 5, "WARNING") in holds(spark, paths)


def test_the_failed_batch_is_said_once(spark, tmp_path, monkeypatch):
    paths, rows = paths_in(tmp_path), [("a", 0, 0, 0.85), ("a", 1, 9, 0.85)]

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(commits, "commit", fails)
        with pytest.raises(OSError):
            take(spark, paths, rows, 0)
    assert commits.latest(spark, paths.table).number == 0
    take(spark, paths, rows, 0)
    assert holds(spark, paths) == {("a", 1, "WARNING")} and said(spark, paths).count() == 1


def test_empty_batches(spark, tmp_path):
    paths = paths_in(tmp_path)
    empty = readings(spark, [("a", 0, 0, 0.1)]).where(F.lit(False))
    assert take_batch(spark, paths, through_table(spark, empty, "in"), "r", 0, 1000, RULES).parts == ()
    take(spark, paths, [("a", 1, 5, 0.95)], 1)
    assert holds(spark, paths) == {("a", 1, "CRITICAL")}
