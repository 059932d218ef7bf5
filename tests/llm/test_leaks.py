import random

from marginalia.llm import leaks


def brute(docs, items, n):
    out = set()
    for d, text in docs:
        w = leaks.words(text or "")
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for item, q, p in items:
            for part in (q, p):
                v = leaks.words(part or "")
                if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                    out.add((d, item))
    return out


def fixture(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(8)), " ".join(word() for _ in range(30))) for i in range(6)] + [(7, None, "a b"), (8, "", None)]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(60)]
    docs += [(100, "Intro. " + items[2][2].upper().replace(" ", ",  ") + " end"), (100, "Intro. " + items[2][2].upper().replace(" ", ",  ") + " end"), (101, None), (102, ""), (103, items[1][2][:20]), (104, "x " * 150_000 + items[0][2])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS item_id", "'x' AS part")
    i = spark.createDataFrame(items, "item_id long, question string, passage string").selectExpr("*", "0 AS doc_id", "'y' AS text")
    return docs, items, d, i


def test_against_brute_force(spark, monkeypatch):
    docs, items, d, i = fixture(spark)
    want = brute(docs, items, 6)
    got = leaks.leaks(d, i, 6)
    assert {(r.id, r.item_id) for r in got.collect()} == want and (100, 2) in want and (104, 0) in want
    monkeypatch.setattr(leaks, "PASS_CHARS", 50)
    assert {(r.id, r.item_id) for r in leaks.leaks(d, i, 6).collect()} == want


def test_joined_grams_give_the_same(spark, monkeypatch):
    docs, items, d, i = fixture(spark)
    want = sorted(map(str, leaks.leaks(d, i, 6).collect()))
    monkeypatch.setattr(leaks, "PASS_CHARS", 0)
    assert sorted(map(str, leaks.leaks(d, i, 6).collect())) == want and want
    assert leaks.leaks(d.limit(0), i, 6).count() == 0


def test_spans_and_removal(spark):
    docs, items, d, i = fixture(spark)
    found = leaks.leaks(d.where("doc_id >= 100"), i, 12)
    r = found.where("id = 100").first()
    assert r.matched_words == r.longest_words == r.item_words == 30
    clean = {x.doc_id: x for x in leaks.without_leaks(d.where("doc_id in (100, 101, 102, 103, 104)"), found).collect()}
    assert clean[100].dropped and clean[100].text is None
    assert clean[101].text is None and not clean[101].dropped and clean[102].text == ""
    assert clean[103].text == items[1][2][:20] and clean[104].text == "x " * 150_000
    kept = leaks.without_leaks(d.where("doc_id = 100"), found, drop_share=1.1).first()
    assert kept.text == "Intro.  end"


def test_spans_where_lower_case_has_another_length(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    text = "İİ before İx. " + "filler " * 500 + passage.upper() + ". İ after " + "more " * 500
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    i = spark.createDataFrame([(1, None, passage), (2, "i̇stanbul a b c d e f g h i j k l", None)], "item_id long, question string, passage string")
    found = leaks.leaks(d, i, 12)
    spans = [(s.start, s.end) for r in found.collect() for s in r.spans]
    assert [text[a:b] for a, b in spans] == [passage.upper()]
    clean = leaks.without_leaks(d, found).first()
    assert not clean.dropped and clean.removed_chars == len(passage) and clean.text == text.replace(passage.upper(), "")


def test_removal_by_shuffle_gives_the_same(spark, monkeypatch):
    _, _, d, i = fixture(spark)
    found = leaks.leaks(d, i, 12)
    want = sorted(map(str, leaks.without_leaks(d, found).collect()))
    monkeypatch.setattr(leaks, "BROADCAST_DOCS", 0)
    assert sorted(map(str, leaks.without_leaks(d, found).collect())) == want


def test_empty(spark):
    _, _, d, i = fixture(spark)
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0
