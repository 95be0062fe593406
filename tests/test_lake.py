from __future__ import annotations

import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from telemetry_lake.operators.questions import QUESTIONS
from telemetry_lake.operators.silver import parse_text_readings, to_silver
from telemetry_lake.plans.analytics import answer_all
from telemetry_lake.plans.datalake import build_layers, layer_counts
from telemetry_lake.schemas import GOLD, SILVER
from telemetry_lake.sources import bronze as bronze_module
from telemetry_lake.sources import commits, object_list
from telemetry_lake.sources.bronze import bound_of, first_records, object_stream, offset_gaps, read_bronze, read_objects, write_objects
from telemetry_lake.sources.lake import read_layer, through_table, write_layer, write_statistics
from telemetry_lake.streaming import landing
from telemetry_lake.streaming.landing import land
from tests.samples import reading, topic


def layers(spark, tmp_path, values):
    bronze = topic(spark, values)
    silver, gold = build_layers(bronze, str(tmp_path / "silver"), str(tmp_path / "gold"))
    return bronze, silver, gold


def test_layers_round_trip_and_counts(spark, tmp_path):
    values = [reading(region="A"), reading(region="B", timestamp="2026-06-25T14:00:00Z"), "junk"]
    bronze, silver, gold = layers(spark, tmp_path, values)
    assert (silver.schema.names, gold.schema.names) == (SILVER.names, GOLD.names)
    assert layer_counts(bronze, silver, gold) == {"bronze": 3, "silver": 2, "gold": 2}
    assert {p.name for p in (tmp_path / "gold").glob("region=*")} == {"region=a", "region=b"}


def test_rebuilding_replaces_the_layers(spark, tmp_path):
    layers(spark, tmp_path, [reading(region="old"), reading(region="both")])
    _, silver, _ = layers(spark, tmp_path, [reading(region="both")])
    assert [r.region for r in silver.collect()] == ["both"]


def test_numeric_region_stays_text_and_blank_reads_back_as_null(spark, tmp_path):
    _, silver, gold = layers(spark, tmp_path, [reading(region="075"), reading(region="  ")])
    assert {r.region for r in silver.collect()} == {"075", None}
    assert {r.region for r in gold.collect()} == {"075", None}


def test_pruning_and_pushdown_reach_the_scan(spark, tmp_path):
    _, silver, _ = layers(spark, tmp_path, [reading(region="A"), reading(region="B")])
    one = silver.filter("region = 'a' AND isAlert").select("load")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan and "EqualTo(isAlert,true)" in plan
    assert "ReadSchema: struct<load:double,isAlert:boolean>" in plan


def test_write_rebalances_by_region(spark, tmp_path):
    silver = to_silver(parse_text_readings(topic(spark, [reading()] * 50))).repartition(8)
    write_layer(silver, str(tmp_path / "layer"))
    assert len(list((tmp_path / "layer").glob("region=*/*.parquet"))) == 1
    assert read_layer(spark, str(tmp_path / "layer"), SILVER).count() == 50


def test_answers_are_saved_in_order(spark, tmp_path):
    _, _, gold = layers(spark, tmp_path, [reading(region=r, failureRiskScore=s) for r, s in (("a", 0.1), ("b", 0.9))])
    saved = answer_all(gold, str(tmp_path / "stats"))
    assert set(saved) == set(QUESTIONS)
    (part,) = Path(tmp_path / "stats" / "regions-highest-risk").glob("*.json")
    assert [json.loads(line)["region"] for line in part.read_text().splitlines()] == ["b", "a"]
    assert saved["average-load-by-hour"].first().asDict() == {"hour": 4, "averageLoad": 0.5}


def test_null_fields_are_left_out_of_json(spark, tmp_path):
    write_statistics(spark.createDataFrame([("a", None)], "k string, v double").coalesce(1), str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("*.json")
    assert json.loads(part.read_text()) == {"k": "a"}


def test_one_object_per_record_layout(spark, tmp_path):
    for partition, offset in ((0, 3), (0, 11), (4, 0)):
        folder = tmp_path / f"partition={partition}"
        folder.mkdir(exist_ok=True)
        (folder / f"offset={offset}.json").write_text(reading(sensorId=f"{partition}-{offset}"))
    bronze = read_objects(spark, str(tmp_path), "ST")
    rows = {(r.partition, r.offset, r.topic) for r in bronze.collect()}
    assert rows == {(0, 3, "ST"), (0, 11, "ST"), (4, 0, "ST")}
    silver = to_silver(parse_text_readings(bronze))
    assert {r.sensorId for r in silver.collect()} == {"0-3", "0-11", "4-0"}


def test_small_objects_share_tasks(spark, tmp_path, monkeypatch):
    for n in range(400):
        folder = tmp_path / "objects" / f"partition={n % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"offset={n}.json").write_bytes(f"\ufeff{n} \u00e9\n".encode())
    whole = {(r.offset, r.partition): r.value for r in read_objects(spark, str(tmp_path / "objects")).collect()}
    assert whole == {(n, n % 2): f"\ufeff{n} \u00e9\n" for n in range(400)}

    tasks, unlanded = [], landing.unlanded
    monkeypatch.setattr(landing, "unlanded", lambda rows, old: tasks.append(rows.rdd.getNumPartitions()) or unlanded(rows, old))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    records = object_stream(spark, str(tmp_path / "objects"), topic="ST")
    land(records, str(tmp_path / "bronze"), str(tmp_path / "cp"), bounded=True).awaitTermination()
    # Hardly more than cores: the default cost of opening a file gives 13.
    assert max(tasks) <= 6 and read_bronze(spark, str(tmp_path / "bronze")).count() == 400
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def places(rows):
    return sorted((r.partition, r.offset, r.value) for r in rows.collect())


def landed(spark, path, run, *parts):
    for batch, part in enumerate(parts):
        part.write.partitionBy("partition").parquet(f"{path}/run={run}/batch={batch}")


def test_copies_of_two_landings_are_taken_once(spark, tmp_path):
    path = str(tmp_path)
    landed(spark, path, "a", topic(spark, ["a0", "a1"]), topic(spark, ["a2", "a3"], start=2), topic(spark, ["x"], partition=5))
    alone = read_bronze(spark, path)
    assert alone.count() == 5 and "Join" not in alone._jdf.queryExecution().executedPlan().toString()
    landed(spark, path, "b", topic(spark, ["a3", "a4", "a4"], start=3).filter("value <> 'a4' OR offset = 4"), topic(spark, ["y"], partition=6))
    landed(spark, path, "c", topic(spark, ["a2", "a3", "a4"], start=2))
    once = read_bronze(spark, path)
    assert places(once) == [(0, n, f"a{n}") for n in range(5)] + [(5, 0, "x"), (6, 0, "y")]


def test_silver_of_landed_bronze_moves_no_payload(spark, tmp_path):
    path = str(tmp_path)
    landed(spark, path, "a", topic(spark, [reading()] * 5))
    landed(spark, path, "b", topic(spark, [reading()] * 5, start=3))
    silver = to_silver(parse_text_readings(read_bronze(spark, path)))
    assert silver.count() == 8
    plan = silver._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and " Exchange" not in plan.replace("BroadcastExchange", "")


def test_the_first_records(spark):
    rows = topic(spark, [f"p0-{n}" for n in range(30)]).union(topic(spark, [f"p3-{n}" for n in range(0, 20)], partition=3, start=5))
    rows = rows.union(topic(spark, ["far"], partition=1, start=5_000_000)).repartition(5)
    order = sorted(places(rows), key=lambda r: (r[1], r[0]))
    for count in (0, 1, 5, 6, 7, 31, 49, 50, 51, 52, 10**9):
        assert places(first_records(rows, count)) == sorted(order[:count])
    assert first_records(rows, None) is rows and first_records(rows, -3).count() == 0
    plan = first_records(rows, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "SinglePartition" not in plan
    assert [bound_of(t) for t in ("12", None, "", "many", "1.5", "-1")] == [12, None, None, None, None, -1]


def test_gaps_between_offsets(spark, monkeypatch):
    monkeypatch.setattr(bronze_module, "GAP_STRETCH", 8)
    there = [0, 1, 2, 7, 8, 9, 30, 31, 100]
    rows = topic(spark, ["v"] * 200).filter(F.col("offset").isin(there)).union(topic(spark, ["w"] * 20, partition=2, start=4))
    gaps = offset_gaps(rows.union(topic(spark, ["one"], partition=7, start=3)))
    assert sorted((r.partition, r.low, r.high) for r in gaps.collect()) == [(0, 3, 6), (0, 10, 29), (0, 32, 99)]


def test_objects_are_landed_a_batch_at_a_time(spark, tmp_path):
    def put(partition, offset):
        folder = tmp_path / "objects" / f"partition={partition}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"offset={offset}.json").write_text(f"{partition}\n-\r\n{offset}")

    def run():
        records = object_stream(spark, str(tmp_path / "objects"), 2, "ST")
        land(records, str(tmp_path / "bronze"), str(tmp_path / "cp"), bounded=True).awaitTermination()

    for offset in (0, 1, 3):
        put(0, offset)
    run()
    put(0, 2), put(4, 9)
    run()
    found = read_bronze(spark, str(tmp_path / "bronze"))
    assert places(found) == [(0, n, f"0-{n}") for n in range(4)] + [(4, 9, "4-9")]
    assert {r.topic for r in found.collect()} == {"ST"} and offset_gaps(found).count() == 0
    # The same layout written from records: once more over the same objects, and one beside them.
    rows = topic(spark, [f"0\n-{n}" for n in range(4)]).union(topic(spark, ["4-9"], partition=4, start=9))
    assert write_objects(rows, str(tmp_path / "objects")) == 5
    whole = read_bronze(spark, f"objects:{tmp_path / 'objects'}")
    assert places(whole) == places(found)
    assert whole.count() == 5 and whole.filter("value LIKE '%-%'").count() == 5


def put_objects(folder, *places):
    for partition, name, text in places:
        at = folder / f"partition={partition}"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_the_driver_follows_a_list_of_objects_not_each_of_them(spark, tmp_path, monkeypatch):
    put_objects(tmp_path / "objects", *[(n % 3, f"offset={n}.json", f"v{n}") for n in range(300)])
    cached, unlanded = [], landing.unlanded
    held = spark.sparkContext._jsc.getPersistentRDDs().size()

    def rows_of(rows, old):
        cached.append(spark.sparkContext._jsc.getPersistentRDDs().size() - held)
        return unlanded(rows, old)

    monkeypatch.setattr(landing, "unlanded", rows_of)
    for _ in range(2):
        records = object_stream(spark, str(tmp_path / "objects"), topic="ST")
        land(records, str(tmp_path / "bronze"), str(tmp_path / "cp"), bounded=True).awaitTermination()
    taken = [line for log in (tmp_path / "cp" / "sources" / "0").glob("[0-9]*") for line in log.read_text().splitlines()[1:]]
    assert 1 <= len(taken) <= 4 and cached == [0]
    assert places(read_bronze(spark, str(tmp_path / "bronze"))) == sorted((n % 3, n, f"v{n}") for n in range(300))
    assert not list((tmp_path / "bronze" / "_attempts").iterdir())
    # The list is not among the objects.
    assert read_objects(spark, str(tmp_path / "objects")).count() == 300


def test_objects_come_oldest_first_and_some_a_batch(spark, tmp_path):
    taken = []

    def run():
        records = object_stream(spark, str(tmp_path / "objects"), 3)
        step = lambda batch, number: taken.append([r.offset for r in batch.orderBy("offset").collect()])
        query = records.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()

    def put(times):
        put_objects(tmp_path / "objects", *[(n % 2, f"offset={n}.json", "v") for n in times])
        for n, time in times.items():
            os.utime(tmp_path / "objects" / f"partition={n % 2}" / f"offset={n}.json", (time, time))

    put({n: 1_000_000 - n for n in range(7)})
    run()
    assert taken == [[4, 5, 6], [1, 2, 3], [0]]
    put({8: 5, 9: 4, 10: 3, 11: 2})
    run()
    assert taken[3:] == [[9, 10, 11], [8]]
    run()
    assert len(taken) == 5


def test_streamed_objects_are_those_that_are_read(spark, tmp_path):
    odd = [(0, "offset=007.json", "a"), (0, "offset=None.json", "b"), (1, "notes.txt", "c"), (1, "_no.json", "d"), (1, ".no.json", "e")]
    odd += [(2, "offset=9.json", ""), (2, "offset=99999999999999999999.json", "f"), (2, "offset=3.json", b"\xff\n\xc3"), (2, "offset=4 %3D.json", "g")]
    put_objects(tmp_path / "objects", *odd)
    (tmp_path / "objects" / "partition=__HIVE_DEFAULT_PARTITION__").mkdir()
    (tmp_path / "objects" / "partition=__HIVE_DEFAULT_PARTITION__" / "offset=5.json").write_text("h")
    whole = read_objects(spark, str(tmp_path / "objects"), "ST")
    seen = []
    step = lambda batch, number: seen.extend(batch.withColumn("value", F.hex(F.encode("value", "utf-8"))).collect())
    records = object_stream(spark, str(tmp_path / "objects"), topic="ST")
    assert records.schema == whole.schema
    records.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    expected = whole.withColumn("value", F.hex(F.encode("value", "utf-8"))).collect()
    assert len(expected) == 7 and sorted(map(repr, seen)) == sorted(map(repr, expected))


def test_two_that_list_at_once_name_an_object_once(spark, tmp_path, monkeypatch):
    folder, listed, move = tmp_path / "objects", str(tmp_path / "objects" / "_listed" / "all"), object_list.move_if_absent
    put_objects(folder, (0, "offset=1.json", "a"), (4, "offset=2.json", "b"))
    others = []

    def after_another(*args):
        if not others:
            others.append(1)
            put_objects(folder, (0, "offset=3.json", "c"))
            assert object_list.take_stock(spark, str(folder), listed, 10, False)
        return move(*args)

    monkeypatch.setattr(object_list, "move_if_absent", after_another)
    assert not object_list.take_stock(spark, str(folder), listed, 10, False)
    names = spark.read.schema(object_list.NAMES).parquet(listed)
    assert sorted(r.name for r in names.collect()) == ["partition=0/offset=1.json", "partition=0/offset=3.json", "partition=4/offset=2.json"]
    # One that has gone is left out, but not a folder that this worker does not have.
    (folder / "partition=4" / "offset=2.json").unlink()
    got = object_list.opened(names, str(folder))
    assert sorted((r.partition, bytes(r.content)) for r in got.collect()) == [(0, b"a"), (0, b"c")]
    with pytest.raises(Exception, match="FileNotFoundError"):
        object_list.opened(names, str(tmp_path / "elsewhere")).collect()


def test_a_running_stream_finds_later_objects(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "200ms")
    try:
        put_objects(tmp_path / "objects", (0, "offset=1.json", "a"))
        records = object_stream(spark, str(tmp_path / "objects"), 5)
        put_objects(tmp_path / "objects", (0, "offset=2.json", "b"))
        query = land(records, str(tmp_path / "bronze"), str(tmp_path / "cp"))
        try:
            for offset in (3, 4):
                until = time.time() + 60
                while time.time() < until and len(list((tmp_path / "bronze").glob("run=*/batch=*"))) < offset - 2:
                    time.sleep(0.2)
                put_objects(tmp_path / "objects", (2, f"offset={offset}.json", f"{offset}"))
            until = time.time() + 60
            while time.time() < until and (not commits.exists(spark, str(tmp_path / "bronze")) or read_bronze(spark, str(tmp_path / "bronze")).count() < 4):
                time.sleep(0.5)
        finally:
            query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    assert places(read_bronze(spark, str(tmp_path / "bronze"))) == [(0, 1, "a"), (0, 2, "b"), (2, 3, "3"), (2, 4, "4")]


def test_through_table_reads_a_scan(spark):
    table = through_table(spark, topic(spark, ["a", "b"]), "t")
    assert "FileScan parquet" in table._jdf.queryExecution().executedPlan().toString()
    assert table.filter(F.col("value") == "a").count() == 1
