import random
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import graphs, nearcopies


def brute(rows, least=40, share=0.8):
    bags = {}
    for i, text in rows:
        if i is not None and text is not None and len(w := nearcopies.WORD.findall(text.lower())) >= least:
            bags.setdefault(i, []).append(Counter(w))
    ids, out = sorted(bags), set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(sum((p & q).values()) >= share * max(p.total(), q.total()) - 1e-9 for p in bags[a] for q in bags[b]):
                out.add((a, b))
    return out


def rows(seed=4, families=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for f in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(35, 90))] + ["the"] * 8
        for k in range(rng.randint(1, 5)):
            v = list(base)
            for _ in range(rng.randint(0, len(v) // 6)):
                v[rng.randrange(len(v))] = rng.choice(words)
            if rng.random() < 0.3:
                rng.shuffle(v)
            out.append((f"{f:03d}-{k}", rng.choice([" ", ", ", "\n"]).join(v).upper() if rng.random() < 0.2 else " ".join(v)))
    text = " ".join(f"copy{i % 45}" for i in range(60))
    out += [(f"c{i}", text) for i in range(7)] + [("c0", text), ("n", None), (None, text), ("e", ""), ("s", "short"), ("l", "long " * 30_000)]
    return out


def frame(spark, r):
    return spark.createDataFrame(r, "id string, content_full string").selectExpr("*", "1 AS key", "2 AS a", "3 AS n", "'x' AS words")


def test_pairs(spark):
    r = rows()
    got = [tuple(x) for x in nearcopies.NearCopies(frame(spark, r)).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(r) and len(got) > 40


def crowd(n=60, seed=1):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    r = [(f"{i:03d}", " ".join(base[: i % 80] + [f"x{rng.random()}"] + base[i % 80 + 1 :])) for i in range(n)]
    far = [w if i % 3 else f"y{i}" for i, w in enumerate(base)]  # shares bands with the others, but is no near-copy of them
    r += [(f"f{i:02d}", " ".join([*far[: i + 1], f"z{i}", *far[i + 2 :]])) for i in range(12)]
    return r + [("000b", r[0][1]), ("one", " ".join(base))]


@pytest.mark.parametrize("limits", [(3, 1024, 2_000_000), (3, 8, 2_000_000), (5, 16, 10)])
def test_crowds(spark, monkeypatch, limits):
    """Large buckets, cells of few texts, and buckets that are split over tasks: the links stay the same."""
    for name, value in zip(("CROWD", "CELL", "HOT_TEXTS"), limits):
        monkeypatch.setattr(nearcopies, name, value)
    r = crowd()
    found = nearcopies.NearCopies(frame(spark, r))
    assert found.labels is not None
    got = [tuple(x) for x in found.pairs().collect()]
    want = brute(r)
    assert len(got) == len(set(got)) and set(got) == want
    links = [tuple(x) for x in found.links.select("a", "other_a", "b", "other_b").collect()]
    assert len(links) == len({tuple(sorted(((a, b), (c, d)))) for a, b, c, d in links})
    classes = {x.id: x for x in found.classes().collect()}
    degree = Counter(i for p in want if "000b" not in p for i in p)
    assert {i: x.links for i, x in classes.items() if i != "000b"} == {i: degree[i] for i, _ in r if i != "000b"}
    assert classes["000b"].copy_of == "000" and len({x.group_id for i, x in classes.items() if i[0] != "f"}) == 1 and len({x.group_id for i, x in classes.items() if i[0] == "f"}) == 1


def test_classes(spark):
    r = rows()
    want, members = brute(r), {i for i, t in r if i and t and len(nearcopies.WORD.findall(t)) >= 40}
    got = {x.id: x for x in nearcopies.NearCopies(frame(spark, r)).classes().collect()}
    assert set(got) == members
    for a, b in want:
        assert got[a].group_id == got[b].group_id
    assert {got[f"c{i}"].copy_of for i in range(7)} == {"c0"} and got["c3"].copies == 7 and got["c3"].links == 0


def test_empty(spark):
    n = nearcopies.NearCopies(frame(spark, rows()).limit(0))
    assert n.pairs().count() == 0 and n.classes().count() == 0


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(1)
    base = nearcopies.BASE**nearcopies.COARSE
    for j in (0.2, 0.5, 0.8):
        union = rng.exponential(size=(3000, 300))
        both = int(300 * j)
        a, b = union[:, : both + (300 - both) // 2].min(axis=1), np.minimum(union[:, :both].min(axis=1), union[:, both + (300 - both) // 2 :].min(axis=1))
        x, y = (np.floor(1 - np.log(v) / np.log(base)) for v in (a, b))
        got = nearcopies.likely_similarity(*(np.array([(c).sum()]) for c in (x > y, x < y, x == y)), np.array([0.5]))
        assert abs(got[0] - j) < 0.05


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "y"), ("p", None), *[(f"h{i}", f"h{i + 1}") for i in range(10, 40)]], "a string, b string")
    got = {r.node: r.component for r in graphs.components(edges).collect()}
    assert got["c"] == got["a"] == "a" and got["y"] == "x" and {got[f"h{i}"] for i in range(10, 41)} == {"h10"} and "p" not in got
    assert graphs.components(edges.limit(0)).count() == 0


def test_one_equal_band_is_enough(spark):
    """Pairs with an equal band whose other registers agree in parity in fewer than 15 of 24 places."""
    rows = []
    for s in (1042, 1165, 1615, 2022, 2174, 2597):
        words = [f"s{s}w{i}" for i in range(72)]
        rows += [(f"{s}a", " ".join(words[:60])), (f"{s}b", " ".join(words[12:]))]
    df = spark.createDataFrame(rows, "id string, content_full string")
    assert {tuple(r) for r in nearcopies.NearCopies(df).pairs().collect()} == brute(rows)
