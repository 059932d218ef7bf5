import pytest
from pyspark.sql import functions as F

from marginalia.config import SearchConfig
from marginalia.operators import search


def test_bm25_figures(spark):
    rows = [("s1", "f1", "/a/x.md", "Vitamin D", "vitamin d mangel ursache vitamin", "vitamin d mangel"), ("s2", "f1", "/a/x.md", "Labor", "laborwerte vitamin", "laborwerte"),
            ("s3", "f2", "/a/y.md", "Sonstiges", "nichts hier zu sehen", "nichts"), ("s4", "f2", "/a/y.md", "Mehr", "gar nichts über ärger", "gar"), ("s5", "f2", "/a/z.md", "Ende", "schluss", "schluss")]
    df = spark.createDataFrame(rows, "id string, f string, p string, h string, c string, v string")
    text = F.concat_ws(" ", "id", "f", "p", "h", "c", "v", F.lit("0.5"), F.lit("[]"))
    got = {r.id: r["rank"] for r in search.bm25(df, "id", text, "vitamin").collect()}
    assert got == {"s1": pytest.approx(-0.5388147957494089), "s2": pytest.approx(-0.3570104816598853)}
    assert [r.id for r in search.bm25(df, "id", text, "arger").collect()] == ["s4"]
    assert search.bm25(df, "id", text, "md").first().id == "s5"
    assert search.bm25(df, "id", text, " ?! ").count() == 0 and search.bm25(df.limit(0), "id", text, "vitamin").count() == 0
    hits = search.bm25(df, "id", text, "vitamin")
    first = search.with_position_score(hits.withColumn("rank", F.lit(0.0))).orderBy("row_num").collect()
    assert [r.score for r in first] == [0.5, 0.0]
    assert [r.score for r in search.with_position_score(hits.withColumn("rank", F.lit(0.0)), 0).orderBy("row_num").collect()] == [1.0, 0.5]


def test_fusion(spark):
    pairs = lambda d: spark.createDataFrame(list(d.items()), "id string, score double")
    details = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.5, 1.0), ("c", 0.5, 1.0), ("d", 0.5, 1.0)], "id string, half double, one double")
    s, k = pairs({"a": 0.9, "b": 0.6}), pairs({"b": 0.5, "c": 0.25})
    got = [(r.id, r.combined, r.origin) for r in search.fuse(s, k, details, "id", "half").collect()]
    assert got == [("b", 0.8, "hybrid"), ("a", 0.6, "chroma"), ("c", 0.2, "sqlite")]
    assert [r.combined for r in search.fuse(s, k, details, "id", "one").collect()] == pytest.approx([1.2, 0.9, 0.3])
    assert search.fuse(None, None, details, "id").count() == 0
    assert [r.id for r in search.fuse(s, None, details, "id", limit=1).collect()] == ["a"]
    assert search.fuse(s, k, details, "id", cfg=SearchConfig(min_score=0.7)).count() == 1


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "id int, v array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [(r.id, r.score) for r in search.vector_topk(v, "id", "v", q, 3).collect()] == [(1, 1.0), (7, 1.0), (2, 0.0)]
    assert search.vector_topk(v, "id", "v", q, 1, "l2").first().score == 1.0


def test_like_rerank_refine(spark):
    rows = [(1, "Iron", "liver store", '["dose","liver","Iron"]'), (2, None, "iron deficit liver", '["deficit"]'), (3, "x", None, None)]
    df = spark.createDataFrame(rows, "id int, h string, c string, k string")
    assert [(r.id, r.score) for r in search.like(df, "id", F.col("h"), F.col("c"), "IRON liver").collect()] == [(1, 1.0), (2, 1.0)]
    assert search.like(df, "id", F.col("h"), F.col("c"), "a").count() == 0
    got = search.lexical_rerank(df, "id", "c", "iron liver", 2).collect()
    assert [(r.id, r.rerank_score, r.reason) for r in got] == [(2, 1.0, "iron, liver"), (1, 0.5, "liver")]
    hits = df.withColumn("score", F.lit(1.0))
    from marginalia.functions.text import keyword_array

    assert [r.suggestion for r in search.refinements(hits, "id", keyword_array(F.col("k")), "iron").orderBy("position").collect()] == ["dose", "liver", "deficit"]


def test_rerank_scores_whole_texts(spark):
    df = spark.createDataFrame([(1, "liver " + "x" * 3000 + " iron"), (2, "liver")], "id int, c string")
    got = search.lexical_rerank(df, "id", "c", "iron liver", 2).collect()
    assert [(r.id, r.rerank_score, r.reason) for r in got] == [(1, 1.0, "iron, liver"), (2, 0.5, "liver")]
    cut = search.lexical_rerank(df, "id", "c", "iron", 2, scorer=lambda text, terms: F.length(text).cast("double"))
    assert [r.rerank_score for r in cut.collect()] == [2000.0, 5.0]
