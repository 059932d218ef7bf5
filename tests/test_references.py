import datetime as dt

import pytest

from marginalia.operators import references as ref
from marginalia.operators import skew

T = lambda m: dt.datetime(2024, m, 1)
RECORDS = "id long, section_id string, file_id string, created_at timestamp_ntz, reason string"
COLUMNS = {"file_sections": "section_id", "files": "file_id"}


def frames(spark):
    records = [
        (1, "s-1", "F1", T(3), "x"), (1, "s-1", "F1", T(3), "x"), (2, " S1 ", None, T(1), "x"), (3, "gone", "f9", None, "x"), (4, "", "  ", T(2), "x"),
        (5, "s2", "f1", T(1), None), (6, "s3", "f1", T(1), None),
    ]
    sections = spark.createDataFrame([("S1", T(2)), ("s2", None), ("s3", T(1))], "id string, created_at timestamp_ntz")
    files = spark.createDataFrame([("f1", T(2))], "id string, first_indexed_at timestamp_ntz")
    log = spark.createDataFrame([("file_sections", "GO-NE"), ("files", None), (None, "f9"), ("Files ", "s3")], "ref_table string, ref_id string")
    return spark.createDataFrame(records, RECORDS), {"file_sections": (sections, "id", "created_at"), "files": (files, "id", "first_indexed_at")}, log


EXPECTED = {
    (2, "file_sections", "2024-01", "late"), (3, "file_sections", "unknown", "deleted"), (3, "files", "unknown", "missing"), (5, "files", "2024-01", "late"), (6, "files", "2024-01", "late"),
}


def test_orphans(spark):
    records, parents, log = frames(spark)
    got = [tuple(r) for r in ref.orphans(records, COLUMNS, parents, log).collect()]
    assert len(got) == len(EXPECTED) and set(got) == EXPECTED


def test_split_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    records, parents, log = frames(spark)
    assert {tuple(r) for r in ref.orphans(records, COLUMNS, parents, log).collect()} == EXPECTED
    left = spark.createDataFrame([("h", i) for i in range(50)] + [(None, 99), ("z", 1)], "k string, v int")
    right = spark.createDataFrame([("h", "x"), ("y", "y")], "k string, w string")
    for how, n in (("left", 52), ("inner", 50), ("left_semi", 50), ("left_anti", 2)):
        assert skew.skew_join(left, right, ["k"], how).count() == n
    with pytest.raises(ValueError):
        skew.skew_join(left, right, ["k"], "full_outer")


def test_empty_tables(spark):
    records, parents, log = frames(spark)
    none = {k: (df.limit(0), a, b) for k, (df, a, b) in parents.items()}
    assert ref.orphans(records.limit(0), COLUMNS, parents, log).count() == 0
    got = ref.orphans(records, COLUMNS, none, log.limit(0))
    assert {r.reason for r in got.collect()} == {"missing"}
    assert sum(r.refs for r in ref.orphan_counts(got).collect()) == got.count()


def test_state_follows_batches(spark, tmp_path):
    records, parents, log = frames(spark)
    refs = ref.references(records, COLUMNS)
    no_refs, no_index = refs.limit(0), ref.parent_events(parents, log).limit(0)
    state = ref.OrphanState(spark, f"file://{tmp_path}/state", every=3)
    state.apply(refs, no_index, no_index)
    assert {r.reason for r in state.waiting().collect()} == {"missing"}
    state.apply(no_refs, ref.parent_events(parents, None), no_index)
    state.apply(no_refs, no_index, ref.parent_events({}, log), known=refs)
    # a removal log entry for a key that has a parent is an event here: the parent is gone
    got = {(r.id, r.ref_table, r.period, r.reason) for r in state.waiting().collect()}
    assert got == EXPECTED
    gone = ref.parent_events({}, spark.createDataFrame([("file_sections", "s1")], "ref_table string, ref_id string"))
    state.apply(no_refs, no_index, gone, known=refs)
    again = {(r.id, r.ref_table, r.reason) for r in state.waiting().collect()}
    assert (1, "file_sections", "deleted") in again and (2, "file_sections", "deleted") in again
    state.apply(no_refs, ref.parent_events(parents, None), no_index)
    assert {(r.id, r.ref_table, r.period, r.reason) for r in state.waiting().collect()} == EXPECTED
    before = state.snapshot().count()
    state.apply(refs, no_index, no_index)  # repeating a batch changes nothing; the sixth merges the logs
    assert state.snapshot().count() == before
    state.apply(no_refs, no_index, no_index)
    assert {(r.id, r.ref_table, r.period, r.reason) for r in state.waiting().collect()} == EXPECTED
    # only what waits is kept
    kept = spark.read.parquet(f"{state.log.get(6)['merged']}/refs")
    assert kept.where("reason IS NULL").count() == 0 and kept.count() == len(EXPECTED)


def test_a_batch_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    records, parents, log = frames(spark)
    refs = ref.references(records, COLUMNS)
    none = ref.parent_events(parents, log).limit(0)
    state = ref.OrphanState(spark, f"file://{tmp_path}/state")
    state.apply(refs, none, none)
    want = sorted(map(str, state.waiting().collect()))
    real = ref.classify
    for step in ("classify", "commit"):
        with monkeypatch.context() as m:
            if step == "classify":
                m.setattr(ref, "classify", lambda *a: real(*a).withColumn("reason", ref.F.raise_error(ref.F.lit("lost"))))
            else:
                m.setattr(ref.CommitLog, "commit", lambda *a: 1 / 0)
            with pytest.raises(Exception):
                state.apply(refs.limit(0), ref.parent_events(parents, None), none)
        assert sorted(map(str, ref.OrphanState(spark, f"file://{tmp_path}/state").waiting().collect())) == want
    other = ref.OrphanState(spark, f"file://{tmp_path}/state")
    with monkeypatch.context() as m:  # another run commits while this one works
        m.setattr(ref, "classify", lambda *a: (m.undo(), other.apply(refs.limit(0), ref.parent_events({}, log), none), real(*a))[2])
        with pytest.raises(ref.Overtaken):
            state.apply(refs.limit(0), ref.parent_events(parents, None), none)
    state.apply(refs.limit(0), ref.parent_events(parents, None), none)
    assert {(r.id, r.ref_table, r.period, r.reason) for r in state.waiting().collect()} == EXPECTED


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_slices_of_time_give_the_same(spark, batches):
    records, parents, log = frames(spark)
    got = [tuple(r) for r in ref.followed(records, COLUMNS, parents, log, batches).waiting().select("id", "ref_table", "period", "reason").distinct().collect()]
    assert set(got) == EXPECTED and len(got) == len(EXPECTED)
    assert ref.followed(records.limit(0), COLUMNS, parents, log.limit(0), batches).snapshot().count() == 0


def test_rank_within(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(100)], "g int, i int")
    out = skew.rank_within(df, ["g"], df["i"], "rank", slices=8).collect()
    assert len(out) == 100
    for g in (0, 1, 2, None):
        ranks = sorted(r["rank"] for r in out if r.g == g)
        assert ranks == list(range(len(ranks)))
