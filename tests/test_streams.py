"""Event-time counts with late rows, the sink of pieces over restarts, and what a write reports of itself."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lodeline.operators import html, kb
from lodeline.streaming import sink, updates

EVENTS = "i int, ts timestamp, kind string"
DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1, 12)


def test_late_rows_are_dropped_and_open_windows_are_read_from_the_state(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    first = [(i, START + DAY * (i % 10), "ab"[i % 2]) for i in range(100)]
    # of these the first is behind the watermark, the second still within
    second = [(200, START, "a"), (201, START + DAY * 8, "a"), (202, START + DAY * 11, "b")]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = updates.windowed_counts(updates.files(spark, source, spark.read.parquet(source).schema), "ts", ["kind"])
        updates.counted(stream, out, progress).awaitTermination()
        return {(r.window_start.day, r.kind): (r.n, r.closed) for r in updates.counts_so_far(spark, out, progress, ["kind"]).collect()}

    held = run(first)
    assert held == {(1 + i, "ab"[i % 2]): (10, i < 7) for i in range(10)}
    again = run(second)
    assert again == {(1 + i, "ab"[i % 2]): (10 + (i == 8), i < 9) for i in range(10)} | {(12, "b"): (1, False)}


def test_pieces_arrive_in_order_and_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    texts = {i: "가나다 abc\n\n" * (i % 4) + str(i) for i in range(30)}

    def run(ids):
        spark.createDataFrame([(i, texts[i]) for i in ids], "id int, t string").coalesce(2).write.mode("append").parquet(source)
        stream = updates.files(spark, source, spark.read.parquet(source).schema, 1)
        sink.send(updates.pieces(stream, "id", "t", 5), out, progress).awaitTermination()
        return sink.sent(spark, out, "id int, ord int, token string, done boolean").orderBy("batch", "file", "line").collect()

    run(range(20))
    # a task that failed, and a batch that was run again with other files, leave files that count for nothing
    (tmp_path / "out/files/000000-left.events").write_text('data: {"id": 1, "ord": 0, "token": "x", "done": false}\n\n')
    writer = sink.EventWriter(out, ["id"])
    batches = sorted((tmp_path / "out/batches").glob("*.json"))
    held = json.loads(batches[-1].read_text())
    writer.commit([sink.Written(i, name) for i, name in reversed(list(enumerate(held)))] + [sink.Written(9, None)], len(batches) - 1)
    rows = run(range(20, 30))
    said, ended = {}, {}
    for r in rows:
        assert r.ord == len(said.setdefault(r.id, [])) and r.id not in ended
        said[r.id].append(r.token)
        if r.done:
            ended[r.id] = True
    assert {i: "".join(t) for i, t in said.items()} == texts and set(ended) == set(texts)
    writer.abort([sink.Written(0, "000000-left.events"), None], 99)
    assert not (tmp_path / "out/files/000000-left.events").exists()


def test_a_write_reports_its_rows_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([("a", "xx"), ("b", None), ("a", "y"), (None, "zzz")], "layer string, content string")
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    once = rows.mapInArrow(counted, rows.schema)
    report = kb.run_report(once, "layer", ["a", "b", "c"], lambda df: df.write.parquet(str(tmp_path / "kb")))
    assert sorted(map(tuple, report.collect()), key=str) == sorted([("a", 2, 3), ("b", 1, 0), ("c", 0, 0), (None, 4, 6)], key=str)
    assert passes.value == 4 and spark.read.parquet(str(tmp_path / "kb")).count() == 4


# the examples of the standard's section on resolution, for the page http://a/b/c/d;p?q
STANDARD = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
    "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x",
}


def test_addresses_of_the_standard(spark):
    rows = spark.createDataFrame(list(STANDARD.items()), "href string, full string")
    found = {r.href: r.x for r in rows.select("href", html.resolved(F.col("href"), F.lit("http://a/b/c/d;p?q")).alias("x")).collect()}
    assert found == STANDARD
    deep = "../" * 40 + "x/" * 30 + "../" * 29 + "y"
    more = [("a", "http://h"), ("?q", "http://h"), (deep, "http://h/" + "p/" * 50), ("HTTPS://K/a/../b", "http://h/")]
    got = [r[0] for r in spark.createDataFrame(more, "href string, base string").select(html.resolve(F.col("href"), F.col("base"))).collect()]
    assert got == ["http://h/a", "http://h?q", "http://h/" + "p/" * 10 + "x/y", "HTTPS://K/b"]


@pytest.mark.parametrize("name", ["stream_watermark_counts", "stream_pieces_sent", "rebuild_run_report", "resolved_addresses"])
def test_their_queries_leave_nothing_behind(spark, sf_dir, name):
    from pathlib import Path

    from lodeline import catalog
    from lodeline.session import shared_folder

    folder = Path(shared_folder(spark))
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
    assert not [p for p in folder.glob("scratch-*")]


def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path):
    from lodeline import catalog

    for name in ("conversations", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_pieces_sent", "stream_watermark_counts", "stream_upsert_latest"):
        of = lambda folder: sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect()), key=repr)  # noqa: B023, E731
        assert of(str(tmp_path)) == of(sf_dir)


def test_a_task_begins_new_files_and_their_order_is_kept(spark, tmp_path, monkeypatch):
    from pyspark import TaskContext

    monkeypatch.setattr(sink, "FILE_BYTES", 20)
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    out = sink.EventWriter(str(tmp_path), ["i"])
    told = out.write(iter([{"i": i} for i in range(7)]))
    assert len(told.names()) > 1 and out.write(iter([])).names() == []
    out.commit([told], 0)
    rows = sink.sent(spark, str(tmp_path), "i int").orderBy("batch", "file", "line").collect()
    assert [r.i for r in rows] == list(range(7))
    out.abort([told], 0)
    assert not list((tmp_path / "files").glob("*.events"))
