"""WARC archives and their index against the pages they were written from."""

from __future__ import annotations

import gzip
import hashlib

import duckdb

from telemetry_lake.llm import warc
from telemetry_lake.session import scratch_dir

LONG = "<html>" + "é" * 120
PAGES = [(i, f"http://Host{i % 5}.Example.org:80/p{i % 7}?q={i}#f", f"<p>{i % 11}" * 40) for i in range(80)] + [
    (100, "no scheme", "short"),
    (101, None, "short"),
    (102, "http://a.b/\r\nX: y", None),
    (103, "", ""),
    (90, "http://a.b", LONG),
    (104, "http://a.b", LONG),
    (None, "http://a.b/", LONG),
    (105, "https://u@x.y:443", LONG + "\r\n\r\nWARC/1.1"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")


def written(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    folder = scratch_dir(spark, "w")
    captures = warc.write_archives(pages(spark, rows).repartition(5), f"{folder}/a")
    return folder, captures, warc.build_index(captures, f"{folder}/i")


def test_every_page_comes_back(spark, monkeypatch):
    folder, captures, index = written(spark, PAGES, monkeypatch)
    keys = pages(spark, PAGES).select(warc.url_key().alias("key"))
    found = warc.lookup(index, keys)
    assert found.count() == len(PAGES)
    got = {r.page_id: r for r in warc.read_captures(found, f"{folder}/a").collect()}
    assert len(got) == len(PAGES)
    for page_id, url, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        again = len(data) >= 100 and page_id != min(same)
        row = got[page_id]
        assert (row.payload_bytes, row.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (row.record_type, row.refers_to) == (("revisit", min(same)) if again else ("response", None))
        assert row.payload == (None if again else data)
        assert row.url == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))


def test_lookup_reads_one_key(spark, monkeypatch):
    rows = [(i, "http://hot.org/", f"{i}") for i in range(60)] + [(100 + i, f"http://c{i}.org/", "x") for i in range(60)]
    _, captures, index = written(spark, rows, monkeypatch)
    keys = spark.createDataFrame([("org,hot)/",), ("org,c7)/",), ("org,none)/",), ("",), ("org,hot)/",)], "key string")
    got = warc.lookup(index, keys).collect()
    assert sorted(r.page_id for r in got) == [*range(60), 107]
    assert captures.count() == 120


def test_index_blocks_are_sorted(spark, monkeypatch):
    folder, captures, index = written(spark, PAGES, monkeypatch)
    every = []
    for row in sorted(index.files.collect(), key=lambda r: warc._order(r.first)):
        file = warc.IndexFile(index.folder, row.file)
        for k in range(len(file.directory)):
            every += [line[0] for line in file.block(k)]
            assert file.directory[k][0] == file.block(k)[0][0] and len(file.block(k)) <= 4
    assert every == sorted(every, key=warc._order) and len(every) == len(PAGES)


def test_archives_are_plain_gzip(spark, monkeypatch):
    folder, captures, _ = written(spark, PAGES[:3], monkeypatch)
    store, base = warc.file_store(f"{folder}/a")
    names = {r.file for r in captures.collect()}
    data = b"".join(gzip.decompress(store.open_input_file(f"{base}/{n}").read()) for n in names)
    assert data.count(b"WARC/1.1\r\n") == 3 and data.count(b"WARC-Type: response") == 3


def test_keys(spark):
    urls = ["http://Www.A.org:80/x/y?z#f", "https://u:p@b.c:8080", "mailto:x", None, "", "http://a.org?q=http://b/", "a.b/c"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key().alias("k")).collect()
    want = ["org,a,www)/x/y?z", "c:8080,b)/", "mailto:x", "", "", "org,a)?q=http://b/", "a.b/c"]
    assert [r.k for r in rows] == want


def test_sql_agrees(spark, monkeypatch, tmp_path):
    rows = [r for r in PAGES if r[0] is not None]
    folder, captures, index = written(spark, rows, monkeypatch)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(r) for r in rows])
    found = warc.read_captures(captures, f"{folder}/a")
    got = [tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == sorted(connection.execute(warc.OP8_SQL).fetchall(), key=repr)


def test_no_pages(spark, monkeypatch):
    folder, captures, index = written(spark, [], monkeypatch)
    found = warc.lookup(index, pages(spark, []).select(warc.url_key().alias("key")))
    assert warc.read_captures(found, f"{folder}/a").collect() == []
