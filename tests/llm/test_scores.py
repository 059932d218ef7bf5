import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import distinctive, ranking


def walk(scores):
    n, m = scores.shape
    x = np.where(np.isnan(scores), -np.inf, scores)
    t = np.zeros((n, n))
    for k in range(m):
        for i in range(n):
            up = np.nonzero(x[:, k] > x[i, k])[0]
            if len(up):
                t[i, up] += 1 / m / len(up)
            else:
                t[i, i] += 1 / m
    p = np.full(n, 1 / n)
    for _ in range(400):
        p = ranking.DAMPING * p @ t + (1 - ranking.DAMPING) / n
    return p


def test_walk_is_the_matrix_walk():
    rng = np.random.default_rng(0)
    parts, lists = [], []
    for i, n in enumerate((1, 2, 7, 20)):
        s = rng.integers(0, 5, (n, 5)).astype(float)
        s[rng.random((n, 5)) < 0.2] = np.nan
        parts.append(s)
        lists += [i] * n
    got = ranking.rank_walk(np.array(lists), np.concatenate(parts))
    assert np.allclose(got, np.concatenate([walk(s) for s in parts]), atol=1e-9)


def rows(seed=1, lists=30):
    rng = random.Random(seed)
    out = []
    for s in range(lists):
        for i in range(rng.choice([1, 2, 5, 9])):
            for src in rng.sample(["chroma", "fts5", "tfidf"], rng.randint(1, 3)):
                out.append((s, f"i{i}", src, rng.choice([None, float(rng.randint(-3, 3)), float("nan")]), rng.choice([None, 0.5, 0.9]), None))
    return out + out[:5] + [(None, "x", "fts5", 1.0, 1.0, 1.0), (1, None, "fts5", 1.0, 1.0, 1.0)]


def results(spark, r):
    return spark.createDataFrame(r, "search_id long, section_id string, source string, score double, importance_score double, rerank_score double").selectExpr("*", "1 AS list", "2 AS p", "3 AS s0")


def winners(r):
    best = {}
    for s, i, src, score, imp, _ in r:
        if s is None or i is None:
            continue
        e = best.setdefault(s, {}).setdefault(i, [-math.inf] * 5)
        if score is not None and not math.isnan(score):
            k = ["chroma", "fts5", "tfidf"].index(src)
            e[k] = max(e[k], -score if src == "fts5" else score)
        if imp is not None:
            e[3] = max(e[3], imp)
    return {(s, i) for s, items in best.items() for i, a in items.items() if all(sum((x > y) - (x < y) for x, y in zip(a, b)) > 0 for j, b in items.items() if j != i)}


@pytest.mark.parametrize("long", [20_000, 4])
def test_ranking(spark, monkeypatch, long):
    monkeypatch.setattr(ranking, "LONG_LIST", long)
    r = rows()
    items, scores = ranking.combine(results(spark, r), {"chroma": False, "fts5": True, "tfidf": False})
    out = ranking.ranking(items, "search_id", "section_id", scores, winners=True).collect()
    assert {(x.list, x.item) for x in out if x.unbeaten} == winners(r)
    by = {}
    for x in out:
        by.setdefault(x.list, []).append(x)
    for group in by.values():
        group.sort(key=lambda x: x.place)
        assert [x.place for x in group] == list(range(1, len(group) + 1))
        assert abs(sum(x.stationary for x in group) - 1) < 1e-4
        assert all(a.stationary >= b.stationary - 1e-9 for a, b in zip(group, group[1:]))
    if long == 4:
        monkeypatch.setattr(ranking, "LONG_LIST", 20_000)
        near = {(x.list, x.item): x.stationary for x in ranking.ranking(items, "search_id", "section_id", scores).collect()}
        assert all(abs(near[x.list, x.item] - x.stationary) < 1e-4 for x in out)


def test_no_scale_dominates(spark):
    r = [(1, "a", "chroma", 0.9, 0.9, 9.0), (1, "b", "tfidf", 1e9, 0.1, 1.0), (1, "c", "chroma", 0.5, 0.5, 5.0)]
    items, scores = ranking.combine(results(spark, r), {"chroma": False, "fts5": True, "tfidf": False})
    assert ranking.ranking(items, "search_id", "section_id", scores).where("place = 1").first().item == "a"
    assert ranking.ranking(items.limit(0), "search_id", "section_id", scores, True).count() == 0


SECTIONS = [
    ("s1", "iron iron Iron liver", '["Iron", "store room"]'), ("s2", "iron liver liver", "liver, IRON"), ("s2", "iron liver liver", "liver, IRON"), ("s3", "liver x1y", None), ("s4", None, None), ("s5", "", "[broken"),
    (None, "iron", None),
]


def test_log_entropy(spark):
    df = spark.createDataFrame(SECTIONS, "id string, content_full string, keywords string").selectExpr("*", "1 AS term", "2 AS total")
    got = {(r.id, r.term): r for r in distinctive.distinctive_terms(df).collect()}
    tf = {("s1", "iron"): 4, ("s1", "liver"): 1, ("s1", "store"): 1, ("s1", "room"): 1, ("s2", "iron"): 2, ("s2", "liver"): 3, ("s3", "liver"): 1, ("s3", "x"): 1, ("s3", "y"): 1, ("s5", "broken"): 1}
    assert {k: r.tf for k, r in got.items()} == tf
    entropy = -sum(p * math.log(p) for p in (4 / 6, 2 / 6))
    assert got["s1", "iron"].weight == pytest.approx(math.log(5) * (1 - entropy / math.log(4)))
    assert got["s1", "store"].weight == pytest.approx(math.log(2)) and got["s3", "liver"].records == 3


def test_rare_keywords(spark):
    df = spark.createDataFrame(SECTIONS, "id string, content_full string, keywords string")
    assert [(r.id, r.term) for r in distinctive.rare_keywords(df).collect()] == [("s1", "iron")]
    assert distinctive.rare_keywords(df.limit(0)).count() == 0 and distinctive.distinctive_terms(df.where("id = 's1'")).count() == 4


def test_an_id_with_several_texts(spark):
    rows = [("a", "iron iron", "iron"), ("a", "iron", "iron"), ("a", "iron", "iron"), ("b", "iron", None), ("c", "x", None)]
    df = spark.createDataFrame(rows, "id string, content_full string, keywords string")
    assert {(r.id, r.term): r.tf for r in distinctive.distinctive_terms(df).collect()} == {("a", "iron"): 5, ("b", "iron"): 1, ("c", "x"): 1}
    assert [(r.id, r.term) for r in distinctive.rare_keywords(df).collect()] == [("a", "iron")]


def test_every_case_is_above_the_bound(spark):
    """Terms spread evenly over five texts weigh least of all cases."""
    rows = [(f"r{i}", " ".join([f"even{i // 5}"] * 3 + ["common"] * 9 + [f"own{i}"] * 4), f"even{i // 5}, common, own{i}") for i in range(40)]
    rows = [(a, b.translate(str.maketrans("0123456789", "abcdefghij")), c.translate(str.maketrans("0123456789", "abcdefghij"))) for a, b, c in rows]
    got = {(r.id, r.term) for r in distinctive.rare_keywords(spark.createDataFrame(rows, "id string, content_full string, keywords string")).collect()}
    assert got == {(f"r{i}", f"even{'abcdefghij'[i // 5]}") for i in range(40)}


def test_shuffled_statistics_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(SECTIONS, "id string, content_full string, keywords string")
    want = sorted(tuple(r) for r in distinctive.distinctive_terms(df).collect())
    monkeypatch.setattr(distinctive, "BROADCAST_TERMS", 0)
    assert sorted(tuple(r) for r in distinctive.distinctive_terms(df).select("id", "term", "tf", "records", "weight").collect()) == want


def test_terms():
    assert distinctive.terms_of("Ärger-2x µg_a ½b") == ["ärger", "x", "µg", "a", "b"]
    assert distinctive.keyword_list(' ["A", null, "B c "]') == ["a", "b c"] and distinctive.keyword_list("x, ,Y") == ["x", "y"] and distinctive.keyword_list(None) == []
    assert F is not None
