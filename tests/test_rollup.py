"""Gold by batches against gold of all readings at once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from telemetry_lake.operators.gold import to_gold
from telemetry_lake.operators.silver import parse_text_readings, to_silver
from telemetry_lake.sources import commits
from telemetry_lake.sources.gold_store import add_readings, read_gold
from telemetry_lake.sources.topics import file_stream
from telemetry_lake.streaming.landing import land
from telemetry_lake.streaming.rollup import roll_up
from tests.samples import reading, topic

RNG = random.Random(3)


def values(n, days=5):
    for _ in range(n):
        yield reading(
            transformerId=RNG.choice(["a", "B ", "c"]), region=RNG.choice(["R1", "r2"]),
            timestamp=f"2026-06-2{RNG.randrange(days)}T0{RNG.randrange(3)}:{RNG.randrange(60):02d}:00Z",
            voltage=RNG.choice([RNG.uniform(200, 250), 1e12, 0.1]), failureRiskScore=RNG.random(), status=RNG.choice(["ok", None, "alert"]),
        )


def silver_of(bronze):
    return to_silver(parse_text_readings(bronze))


def as_rows(gold):
    # Voltages beyond the decimals are added as doubles, whose last digits follow the order.
    return sorted(map(tuple, gold.withColumn("voltage", F.format_number("voltage", 3)).collect()), key=repr)


def test_batches_add_up_to_all_readings(spark, tmp_path):
    table, parts = str(tmp_path), [topic(spark, list(values(n))) for n in (40, 1, 0, 60, 25)]
    whole = None
    for batch, part in enumerate(parts):
        whole = part if whole is None else whole.union(part)
        version = add_readings(spark, table, silver_of(part), "q", batch)
        # A second try of the batch changes nothing.
        assert add_readings(spark, table, silver_of(part), "q", batch) == version
        assert as_rows(read_gold(spark, table)) == as_rows(to_gold(silver_of(whole)))
    held = commits.at(spark, table, 1)
    assert as_rows(read_gold(spark, table, held)) == as_rows(to_gold(silver_of(parts[0])))


def test_only_touched_days_are_written(spark, tmp_path):
    table = str(tmp_path)
    days = lambda *numbers: topic(spark, [reading(timestamp=f"2026-06-2{d}T01:00:00Z") for d in numbers])
    add_readings(spark, table, silver_of(days(0, 1, 2, 3)), "q", 0)
    add_readings(spark, table, silver_of(days(2, 4)), "q", 1)
    last = add_readings(spark, table, silver_of(days(1, 2, 2)), "other", 0)
    assert [len(part["days"]) for part in last.parts] == [2, 1, 2]
    owners = [day for part in last.parts for day in part["days"]]
    assert len(owners) == len(set(owners)) == 5
    written = {p.parent.name: {d.name for d in p.parent.glob("day=*")} for p in tmp_path.glob("states/part=*/_SUCCESS")}
    assert sorted(map(len, written.values())) == [2, 2, 4]
    counts = [r.measurementCount for r in read_gold(spark, table).orderBy("windowStart").collect()]
    assert counts == [1, 2, 4, 1, 1]


def test_two_writers_lose_no_reading(spark, tmp_path, monkeypatch):
    table, first, second = str(tmp_path), topic(spark, list(values(30))), topic(spark, list(values(30)))
    commit, done = commits.commit, []

    def slow(*arguments):
        if not done:
            done.append(1)
            add_readings(spark, table, silver_of(second), "second", 0)
        return commit(*arguments)

    monkeypatch.setattr(commits, "commit", slow)
    last = add_readings(spark, table, silver_of(first), "first", 0)
    assert last.number == 2 and as_rows(read_gold(spark, table)) == as_rows(to_gold(silver_of(first.union(second))))


def test_stream_from_landed_bronze(spark, tmp_path):
    bronze, gold, whole = str(tmp_path / "bronze"), str(tmp_path / "gold"), None
    for start in (0, 20, 40):
        part = topic(spark, [*values(19), "junk"], start=start)
        whole = part if whole is None else whole.union(part)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        land(file_stream(spark, str(tmp_path / "in")), bronze, str(tmp_path / "land"), bounded=True).awaitTermination()
        records = file_stream(spark, bronze)
        roll_up(records, gold, str(tmp_path / "roll"), bounded=True).awaitTermination()
    assert as_rows(read_gold(spark, gold)) == as_rows(to_gold(silver_of(whole)))
    assert read_gold(spark, str(tmp_path / "none")).count() == 0
