import datetime as dt

from pyspark.sql import functions as F

from marginalia.operators import knowledge, upkeep
from marginalia.plans import knowledge as plans


def test_delta(spark):
    old = spark.createDataFrame([("p1", "h1"), ("p2", "h2"), ("p3", "h3"), ("n", None)], "path string, hash string")
    new = spark.createDataFrame([("p1", "h1"), ("p2", "hX"), ("p4", "h4"), ("n", None)], "path string, hash string")
    plan = upkeep.delta_plan(old, new)
    assert {r.path: r.action for r in plan.collect()} == {"p1": "same", "p2": "changed", "p3": "removed", "p4": "new", "n": "same"}
    after = upkeep.apply_delta(old, new, plan)
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in new.collect()}
    assert {r.action for r in upkeep.delta_plan(after, new).collect()} == {"same"}
    assert upkeep.delta_plan(old, new, scope="q").where("action = 'removed'").count() == 0
    assert upkeep.delta_plan(old.limit(0), new.limit(0)).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 0, "z"), ("a", 2, "w"), ("c", 1, None)], "k string, t int, v string")
    assert {tuple(r) for r in upkeep.upsert_latest(old, new, ["k"], [F.col("t")]).collect()} == {("a", 2, "w"), ("b", 1, "y"), ("c", 1, None)}
    assert {tuple(r) for r in upkeep.insert_ignore(old, new.where("t < 2"), ["k"]).collect()} == {("a", 1, "x"), ("b", 1, "y"), ("c", 1, None)}
    counted = upkeep.upsert_counter(old.withColumn("scan_count", F.lit(3)), new, "k")
    assert {r.k: r.scan_count for r in counted.collect()} == {"a": 5, "b": 3, "c": 1}


def test_conflicts(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    kb = spark.createDataFrame([("Both", t(9)), ("Old", t(1)), ("only kb", t(1))], "title string, modified timestamp_ntz")
    vault = spark.createDataFrame([("both", t(8)), ("old", t(9)), ("only vault", t(1))], "title string, modified timestamp_ntz")
    at = F.lit("2024-01-05").cast("timestamp_ntz")
    got = {s: {r.title: r.action for r in upkeep.conflict_plan(kb, vault, at, s).collect()} for s in ("kb_wins", "vault_wins", "keep_both", "manual")}
    assert [got[s]["both"] for s in got] == ["kb_to_vault", "vault_to_kb", "keep_both", "manual"]
    assert {k: v for k, v in got["manual"].items() if k != "both"} == {"old": "vault_to_kb", "only kb": "kb_to_vault", "only vault": "insert"}


def test_issues_and_jobs(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "x")], "id int, p string")
    got = upkeep.issues(df, [("empty", "error", F.trim("p") == ""), ("null", "info", F.col("p").isNull())], "id")
    assert {tuple(r) for r in got.collect()} == {("empty", "error", "2"), ("null", "info", "1")}
    log = spark.createDataFrame([("j", "ok", 1, 1), ("j", "error", 2, 2), ("j", "ok", 2, 3), ("k", "failed", 1, 4)], "job string, status string, at int, i int")
    assert {tuple(r) for r in upkeep.job_state(log, "job", "status", "at", "i").collect()} == {("j", 3, 1, "ok"), ("k", 1, 1, "failed")}


def test_hotspots_and_graph(spark):
    rows = [(i, [f"keyword{i}", "shared-keyword"], [f"Entity {i}", "Shared Entity"]) for i in range(3)] + [(9, None, ["x", "X "])]
    e = spark.createDataFrame(rows, "id int, k array<string>, e array<string>")
    got = knowledge.hotspots(e, "id", {"keyword": F.col("k"), "entity": F.col("e")})
    assert [tuple(r) for r in got.collect()] == [("shared entity", "entity", 3), ("shared-keyword", "keyword", 3)]
    assert knowledge.hotspots(e, "id", {"entity": F.col("e")}, occurrences=True).where("topic = 'x'").first().n == 2
    nodes = knowledge.graph_nodes(e.where("id < 3"), "id", F.col("e"), F.col("k"))
    assert nodes.where("kind = 'entity'").count() == 4 and nodes.where("kind = 'keyword'").count() == 4
    assert knowledge.mention_edges(e, "id", F.col("k")).count() == 6


def test_diff_and_merge(spark):
    df = spark.createDataFrame([(["A", "b "], ["a", "c"], "long summary", "short")], "x array<string>, y array<string>, s string, t string")
    common, a, b = knowledge.diff_lists(F.col("x"), F.col("y"))
    r = df.select(common.alias("c"), a.alias("a"), b.alias("b"), knowledge.merge_lists(F.col("x"), F.col("y")).alias("m"), knowledge.merge_summary(F.col("s"), F.col("t")).alias("s"), knowledge.merge_summary(F.col("t"), F.col("s")).alias("t")).first()
    assert (r.c, r.a, r.b, r.m, r.s, r.t) == (["a"], ["b"], ["c"], ["A", "b ", "c"], "long summary", "long summary")
    docs = spark.createDataFrame([(1, "a\nb\nb", "a\nc")], "id int, p string, q string")
    lines = knowledge.line_diff(docs.select("id", F.col("p").alias("t")), docs.select("id", F.col("q").alias("t")), "id", "t")
    assert {tuple(r) for r in lines.collect()} == {(1, "-", "b", 2), (1, "+", "c", 1)}
    assert "+c" in knowledge.unified_diff(docs, "id", "p", "q").first()["diff"]
    sec = lambda rows: spark.createDataFrame(rows, "id int, title string, text string")
    merged = knowledge.merge_sections(sec([(1, "A", "x"), (1, "B", "y")]), sec([(1, "B", " y "), (1, "C", "z"), (1, "A", "w")]), "id")
    assert {(r.title, r.text) for r in merged.collect()} == {("A", "x\n[supplement]\nw"), ("B", "y"), ("C", "z")}


def test_cron():
    assert knowledge.cron_field("*/20", 0, 59) == [0, 20, 40] and knowledge.cron_field("*/12", 0, 23) == [0, 12]
    assert knowledge.cron_field("5/15", 0, 59) == [5, 20, 35, 50] and knowledge.cron_field("1-3,7", 0, 9) == [1, 2, 3, 7]


def test_cron_weekday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 4, 0),), (dt.datetime(2024, 1, 8, 4, 0),)], "t timestamp_ntz")  # Sunday, Monday
    assert [r.m for r in df.select(knowledge.cron_matches(F.col("t"), "0 4 * * 6").alias("m")).collect()] == [True, False]


def test_generator_errors_become_rows(spark):
    df = spark.createDataFrame([(1,)], "id long")

    def broken(pdf):
        raise ValueError("model is away")

    assert knowledge.generate(df, "id long, error string", broken).first().error == "model is away"


def test_report_merge_takes_whole_texts(spark, tmp_path):
    """Texts that differ only after the preview get a supplement; same-titled sections of a side are joined in order."""
    same = "x" * 200
    rows = [
        ("1", "f", 1, "A", same, same + " upper", 1), ("2", "f", 3, "A", same, same + " lower", 9), ("3", "f", 2, "B", "second", "second", 30), ("4", "f", 2, "B", "first", "first", 20),
        ("5", "f", 4, "C", None, "no preview", 40), ("6", "f", 4, "D", "cut", "cut and rest", 50), ("7", "f", 4, "D", None, None, 60), ("8", "f", 4, "E", None, None, 70),
    ]
    rows = [(*r[:2], None, *r[2:], None, dt.datetime(2024, 1, 1)) for r in rows + rows[:1]]  # a repeated row counts once
    schema = "id string, file_id string, parent_section_id string, section_level int, section_header string, content_preview string, content_full string, line_start int, keywords string, created_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/file_sections.parquet")
    got = {r.title: r.text for r in plans.report_merge(spark, str(tmp_path)).collect()}
    assert got == {"A": f"{same} upper\n[supplement]\n{same} lower", "B": "first\n\nsecond", "C": "no preview", "D": "cut and rest", "E": None}
