from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.functions import records
from millrace.sources import readers, writers
from millrace.plans.errors import WriteFailedError


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_memory_readers(spark):
    assert rows(readers.ListReader([1, 2], "value int").to_df(spark)) == [(1,), (2,)]
    assert rows(readers.IterableReader((x for x in (3,)), "value int").to_df(spark)) == [(3,)]
    left = [1, 2, None]
    assert rows(readers.CallbackReader(lambda: left.pop(0), "value int").to_df(spark)) == [(1,), (2,)]


def test_csv_round_trip_and_quarantine(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('1,"x, ""y"""\n2,\nbad,z\n')
    good, bad = readers.CsvReader(str(path), "a int, b string").quarantine(spark)
    assert rows(good) == [(1, 'x, "y"'), (2, "")] and bad.count() == 1
    with pytest.raises(Exception):
        readers.CsvReader(str(path), "a int, b string").to_df(spark).collect()
    with pytest.raises(ValueError):
        readers.CsvReader("/etc/passwd", "a string", base=str(tmp_path)).to_df(spark)


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert rows(readers.JsonReader(str(tmp_path / "a.json"), "a int").to_df(spark)) == [(1,), (2,)]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n3\n')
    assert rows(readers.JsonLinesReader(str(tmp_path / "b.jsonl"), "a int", strict=False).to_df(spark)) == [(1,), (2,)]
    with pytest.raises(Exception):
        readers.JsonLinesReader(str(tmp_path / "b.jsonl"), "a int").to_df(spark).collect()


def test_fixed_width(spark, tmp_path):
    (tmp_path / "f.txt").write_text("ab 12\ncd 34\n")
    found = readers.FixedWidthReader(str(tmp_path / "f.txt"), records.FixedTokenizer(((0, 2), (3, 5)), ("k", "n"))).to_df(spark)
    assert rows(found) == [("ab", "12"), ("cd", "34")]


def test_pages_resume_inside_a_page(spark):
    spark.range(25).createOrReplaceTempView("paged")
    reader = readers.PagedReader(readers.PagingQuery("id", "paged", sort="id"), 10)
    assert [[r[0] for r in p.collect()] for p in reader.pages(spark, 7)] == [list(range(7, 10)), list(range(10, 20)), list(range(20, 25))]
    with pytest.raises(ValueError):
        reader.query.page(0, 0)


def test_multi_reader_passes_empty_resources(spark):
    parts = [readers.ListReader(x, "value int") for x in ([1], [], [], [2])]
    assert rows(readers.MultiReader(parts).to_df(spark)) == [(1, 0), (2, 3)]


def test_streams_close_all():
    class S:
        closed = 0

        def close(self):
            S.closed += 1
            raise KeyError(S.closed)

    with pytest.raises(KeyError, match="1"):
        readers.Streams(S(), S()).close()
    assert S.closed == 2


def test_line_writer_with_header(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.LineWriter(path, records.delimited_line(["id"]), ["id"], header="h", footer="f").write(spark.range(3))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "h\n0\n1\n2\nf\n"


def test_json_array_writer(spark, tmp_path):
    for n in (0, 2):
        writers.JsonArrayWriter(str(tmp_path / "a.json"), ["id"]).write(spark.range(n))
        assert json.loads((tmp_path / "a.json").read_text()) == [{"id": i} for i in range(n)]


def test_routing_tee_and_rolling(spark, tmp_path):
    a, b, c = writers.MemoryWriter(), writers.MemoryWriter(), writers.MemoryWriter()
    route = writers.RoutingWriter(F.when(F.col("id") % 2 == 0, "even").otherwise("odd"), {"even": a, "odd": b})
    writers.CompositeWriter([route, c]).write(spark.range(5))
    assert (len(a.items), len(b.items), len(c.items)) == (3, 2, 5)
    with pytest.raises(WriteFailedError):
        writers.RoutingWriter(F.lit("x"), {"y": a}).write(spark.range(1))
    with pytest.raises(ValueError):
        writers.CompositeWriter([])
    path = str(tmp_path / "rolled")
    writers.RollingWriter(path, "id", 4).write(spark.range(10))
    counts = spark.read.parquet(path).groupBy("resource_index").count()
    assert rows(counts) == [(0, 4), (1, 4), (2, 2)]


def test_database_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t.db")
    sqlite3.connect(path).execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)").connection.commit()
    writer = writers.DbApiWriter(lambda: sqlite3.connect(path), writers.upsert_statement("t", ["k", "v"], ["k"]), ["k", "v"])
    data = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").coalesce(1)
    writer.write(data)
    writer.write(data)
    assert sqlite3.connect(path).execute("SELECT * FROM t ORDER BY k").fetchall() == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="no row changed"):
        writers.DbApiWriter(lambda: sqlite3.connect(path), "UPDATE t SET v = ? WHERE k = 99", ["v"]).write(data)


def queue_client():
    class Client:
        def range(self, key, start, count):
            return [f"{key}{i}" for i in range(7)][start : start + count]

    return Client()


def test_queue_source_batch(spark):
    reader = readers.QueueSource({"client": "tests.test_sources.queue_client", "key": "q", "batch": "3"}).reader(None)
    reader.client = queue_client
    assert list(reader.read(reader.partitions()[0])) == [(i, f"q{i}") for i in range(7)]
    stream = readers._QueueStream(queue_client, "q", 3)
    got, at = stream.read(stream.initialOffset())
    assert (list(got), at) == ([(i, f"q{i}") for i in range(3)], {"at": 3})
    assert list(stream.readBetweenOffsets({"at": 3}, {"at": 5})) == [(3, "q3"), (4, "q4")]
