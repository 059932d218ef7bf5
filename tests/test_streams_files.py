import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginalia.operators.incremental import Manifest
from marginalia.sources import files
from marginalia.streaming import watcher, windows


def test_windows_stream_equals_static(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.window_start, r.event_type, r.n) for r in spark.table("win").collect()}
    want = {(r.window_start, r.event_type, r.n) for r in windows.tumbling(events, "ts", "event_type", "1 day").collect()}
    assert got == want and want


def test_late_records_are_dropped(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h, tzinfo=dt.timezone.utc)
    schema = "ts timestamp, k string, value double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for i, rows in enumerate([[(t(1), "a", 1.0)], [(t(12), "a", 1.0)], [(t(1), "a", 1.0), (t(12), "a", 1.0)], [(t(23), "a", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = windows.tumbling(stream, "ts", "k", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(60)
    assert {r.n for r in spark.read.parquet(f"{tmp_path}/out").where("hour(window_start) = 1").collect()} == {1}
    assert {r.n for r in spark.read.parquet(f"{tmp_path}/out").where("hour(window_start) = 12").collect()} == {2}


def test_watcher(spark, tmp_path):
    (tmp_path / "in/.git").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# A")
    (tmp_path / "in/.git/b.md").write_text("# B")
    (tmp_path / "in/c.txt").write_text("c")
    seen = []
    for _ in range(2):
        q = watcher.follow(watcher.file_stream(spark, f"file://{tmp_path}/in"), f"{tmp_path}/cp", lambda df, n: seen.extend(r.text for r in df.collect()))
        q.awaitTermination(60)
    assert seen == ["# A"]
    errors = []
    (tmp_path / "in/d.md").write_text("# D")

    def broken(df, n):
        raise ValueError("hook")

    run = lambda handle, **more: watcher.follow(watcher.file_stream(spark, f"file://{tmp_path}/in"), f"{tmp_path}/cp", handle, lambda n, e: errors.append(str(e)), **more).awaitTermination(60)
    with pytest.raises(Exception):
        run(broken)
    assert errors == ["hook"]
    keep = lambda df, n: seen.extend(r.text for r in df.collect())
    run(keep)  # the failed batch comes again
    assert seen == ["# A", "# D"]
    (tmp_path / "in/e.md").write_text("# E")
    run(broken, parked=f"{tmp_path}/parked")
    assert watcher.parked_batches(spark, f"{tmp_path}/parked") and watcher.retry(spark, f"{tmp_path}/parked", broken) == 0
    assert watcher.retry(spark, f"{tmp_path}/parked", keep) == 1 and seen[-1] == "# E" and not watcher.parked_batches(spark, f"{tmp_path}/parked")


def test_changed_files_are_seen(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("v1")
    man, seen = Manifest(spark, f"file://{tmp_path}/man"), []

    def keep(df, n):
        seen.append([(r.path.rsplit("/", 1)[1], r.todo) for r in df.collect()])
        if len(seen) == 2:
            raise ValueError("hook")

    look = lambda: watcher.observe(spark, f"file://{tmp_path}/in", man, keep)
    assert look() == 1 and look() is None
    (tmp_path / "in/a.md").write_text("v2")
    with pytest.raises(ValueError):
        look()
    assert watcher.watch(spark, f"file://{tmp_path}/in", man, keep, seconds=0, rounds=2) == 1
    assert seen == [[("a.md", "new")], [("a.md", "changed")], [("a.md", "changed")]]


def test_path_states(spark, tmp_path):
    schema = "path string, hash string, at int, failed boolean"
    (tmp_path / "in").mkdir()
    got = []
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for i, row in enumerate([("p", "h1", 1, False), ("p", "h1", 2, False), ("p", "h2", 3, True), ("p", "h2", 4, False), ("p", "h2", 5, False)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = watcher.path_states(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, n: got.extend((r.todo, r.status) for r in df.collect())).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert got == [("new", "processed"), ("none", "processed"), ("changed", "error"), ("retry", "processed"), ("none", "processed")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "v/.obsidian").mkdir(parents=True)
    (tmp_path / "v/a.md").write_text("---\ntitle: T\n---\n\n# A\nx\n")
    (tmp_path / "v/learning.md").write_text("no front")
    (tmp_path / "v/.obsidian/c.md").write_text("hidden")
    v = {r.name: r for r in files.read_vault(spark, f"file://{tmp_path}/v").collect()}
    assert set(v) == {"a.md", "learning.md"} and v["a.md"].title == "T" and v["a.md"].body == "# A\nx\n" and v["learning.md"].title == "learning" and v["learning.md"].category == "learnings"
    df = spark.createDataFrame([("s/x.md", "hello"), ("../evil.md", "no")], "path string, content string")
    assert {r.path: r.written for r in files.write_notes(df, f"{tmp_path}/w").collect()} == {"s/x.md": True, "../evil.md": False}
    assert (tmp_path / "w/s/x.md").read_text() == "hello" and not (tmp_path / "evil.md").exists()
    for form in ("parquet", "json", "csv"):
        files.write_table(df, f"{tmp_path}/t_{form}", form=form)
    assert spark.read.option("header", "true").csv(f"{tmp_path}/t_csv").count() == 2
    assert {(r.table, r.rows) for r in files.backup(spark, {"n": df}, f"{tmp_path}/b").collect()} == {("n", 2)}
    (tmp_path / "e/1").mkdir(parents=True)
    (tmp_path / "e/1/essence.json").write_text('{"version":"1","extracted_at":"2024-01-01T00:00:00","essence":{"title":"T","keywords":["k"]}}')
    e = files.read_essences(spark, f"{tmp_path}/e").first()
    assert e.essence.title == "T" and e.extracted_at is not None
    assert files.ocr_pages(spark.createDataFrame([("a", b"x")], "path string, content binary")).count() == 1
    assert files.report_markdown("T", {"a": "b"}, ["x"]).startswith('---\na: "b"\n---\n\n# T')
