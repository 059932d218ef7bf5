import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import incremental as inc

SCHEMA = "scan_id long, path string, file_hash string, modified_at string, status string, version int"


def expected(rows):
    rows = {r[:5] for r in rows if r[0] is not None and r[1] is not None}
    norm = lambda h: (h.strip().lower().split(":")[-1].strip() or None) if h else None
    out = set()
    for scan, path, h, at, _ in rows:
        earlier = [r for r in rows if r[1] == path and r[0] < scan and r[4] == "processed"]
        if not earlier:
            out.add((scan, path))
            continue
        p = max(earlier)
        a, b = norm(h), norm(p[2])
        if (a and b and a != b) or (not (a and b) and at and p[3] and float(at) > float(p[3])):
            out.add((scan, path))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for path in ["a", "b", "hot", "d", None]:
        for scan in range(1, 200 if path == "hot" else 12):
            if rng.random() < 0.8:
                h = rng.choice([None, "x1", " X1 ", "sha256:x1", "MD5: x2", "x2", ""])
                rows.append((scan, path, h, rng.choice([None, "10", "20.5", "30"]), rng.choice(["processed", "error", "skipped", None]), 1))
    rows += rows[:20]
    got = inc.pending_observations(spark.createDataFrame(rows, SCHEMA))
    pairs = [(r.scan_id, r.path) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == expected(rows)


def test_instants(spark):
    cases = [
        ("1970-01-01T00:00:01", 1_000_000), ("1970-01-01 00:00:01.5", 1_500_000), ("1970-01-01T00:00:01Z", 1_000_000), ("1970-01-01T02:00:00+02:00", 0),
        ("1970-01-01T02:00:00+0200", 0), ("1969-12-31T19:00:00.25-05:00", 250_000), ("12", 12_000_000), ("12.000001", 12_000_001), (" 1970-01-01 ", 0),
        ("1970-01-01 00:00:01 UTC", 1_000_000), ("never", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(c, w) for c, w in cases], "c string, want long").select("c", "want", inc.instant(F.col("c")).alias("got"))
    assert [(r.c, r.got) for r in df.collect()] == cases


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert inc.pending_observations(empty).count() == 0
    clash = spark.createDataFrame([(1, "a", "h", "1", "processed", "x", "y")], "scan_id long, path string, file_hash string, modified_at string, status string, reason string, __key string")
    assert [(r.scan_id, r.path, r.reason) for r in inc.pending_observations(clash).collect()] == [(1, "a", "new")]


def test_last_before_blocks(spark):
    rows = [("k", i, i if i % 7 == 0 else None) for i in range(300)]
    df = inc.last_before(spark.createDataFrame(rows, "k string, v long, x long"), "k", "v", F.col("x"), "last", span=10)
    for r in df.collect():
        assert r["last"] == (None if r.v == 0 else (r.v - 1) // 7 * 7)


def test_replay_gives_the_same(spark):
    rng = random.Random(2)
    rows = [(scan, p, rng.choice([None, "x1", "sha256:X1", "x2", ""]), rng.choice([None, "10", "20.5", "30"]), rng.choice(["processed", "processed", "error", None]), 1)
            for p in "abcdefg" for scan in range(1, 14) if rng.random() < 0.8]
    rows += [*rows[:9], (None, "a", "x", "1", "processed", 1), (1, None, "x", "1", "processed", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L AS size", "2 AS batch", "3 AS checksum", "4 AS done")
    got = [(r.scan_id, r.path) for r in inc.replay(df, span=3).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows)
    assert {tuple(r) for r in inc.replay(df, span=100).select("scan_id", "path", "reason").collect()} == {tuple(r) for r in inc.pending_observations(df).select("scan_id", "path", "reason").collect()}
    assert inc.replay(df.limit(0)).count() == 0


def folders(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b c.txt").write_text("two")
    return src, f"file://{tmp_path}/out", f"file://{tmp_path}/manifest"


def plain(files):
    return files.select("path", "checksum")


def named(out):
    return sorted((r.batch, r.path.rsplit("/", 1)[1]) for r in out.collect())


def test_runs_survive_a_failure(spark, tmp_path, monkeypatch):
    src, sink, where = folders(tmp_path)
    man = inc.Manifest(spark, where, every=2)

    def dies(files):
        raise RuntimeError("lost")

    def dies_writing(files):
        return plain(files).withColumn("x", F.raise_error(F.lit("disk")))

    for broken in (dies, dies_writing):
        with pytest.raises(Exception):
            inc.run_batch(spark, f"file://{src}", sink, man, broken)
        assert man.batches() == [] and inc.committed_output(spark, sink, man) is None
    with monkeypatch.context() as m:  # dies after its output, before its commit
        m.setattr(inc.Manifest, "commit", dies)
        with pytest.raises(Exception):
            inc.run_batch(spark, f"file://{src}", sink, man, plain)
    assert man.batches() == []
    assert inc.run_batch(spark, f"file://{src}", sink, man, plain) == 1
    assert inc.run_batch(spark, f"file://{src}", sink, man, plain) is None
    (src / "b c.txt").write_text("2")
    (src / "c.txt").write_text("three")
    assert inc.run_batch(spark, f"file://{src}", sink, inc.Manifest(spark, where, every=2), plain) == 2  # with a snapshot
    (src / "a.txt").write_text("1")
    assert inc.run_batch(spark, f"file://{src}", sink, man, plain) == 3
    assert named(inc.committed_output(spark, sink, man)) == [(1, "a.txt"), (1, "b c.txt"), (2, "b c.txt"), (2, "c.txt"), (3, "a.txt")]
    assert man.entries().count() == 3
    import os

    os.utime(src / "a.txt", (1, 1))  # another time, the same content
    assert inc.run_batch(spark, f"file://{src}", sink, man, plain) is None
    with pytest.raises(inc.Overtaken):
        man.commit(2, None)


def test_overlapping_runs_lose_nothing(spark, tmp_path):
    src, sink, where = folders(tmp_path)
    slow, fast = inc.Manifest(spark, where), inc.Manifest(spark, where)

    def overtaken(files):
        if fast.batches() == []:  # another run starts and commits while this one works
            assert inc.run_batch(spark, f"file://{src}", sink, fast, plain) == 1
            (src / "d.txt").write_text("late")
        return plain(files)

    assert inc.run_batch(spark, f"file://{src}", sink, slow, overtaken) == 2
    assert named(inc.committed_output(spark, sink, slow)) == [(1, "a.txt"), (1, "b c.txt"), (2, "d.txt")]
    assert inc.run_batch(spark, f"file://{src}", sink, fast, plain) is None


def test_commits_by_renaming(spark, tmp_path, monkeypatch):
    """The way of distributed file systems, here on a local one."""
    from marginalia.operators import commits

    class Elsewhere:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def getUri(self):
            return self

        def getScheme(self):
            return "hdfs"

    real = commits.files_of
    monkeypatch.setattr(commits.FILE_CONTEXT, "of", lambda spark, fs: spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(real(spark, f"file://{tmp_path}")[0].getUri()))
    monkeypatch.setattr(commits, "files_of", lambda s, p: (Elsewhere(real(s, p)[0]), real(s, p)[1]))
    log = commits.CommitLog(spark, f"file://{tmp_path}/log")
    log.commit(1, {"a": 1})
    with pytest.raises(commits.Overtaken):
        log.commit(1, {"a": 2})
    assert commits.CommitLog(spark, f"file://{tmp_path}/log").get(1) == {"a": 1} and log.last() == 1
