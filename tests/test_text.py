import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import chunks, keywords


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("Ärger", "aerger"), ("Übung", "uebung"), ("Öl", "oel"), ("Straße", "strasse"), (None, None)])
def test_umlauts(spark, raw, want):
    assert one(spark, X.umlauts, raw) == want


def test_keywords_without_stopwords(spark):
    df = spark.createDataFrame([(1, "Der hund und die katze sind sehr nette tiere"), (2, None), (3, ""), (4, "wort2 wort_x a")], "id int, t string")
    got = keywords.top_keywords(df, "id", "t").orderBy("id", "rank").collect()
    assert [(r.id, r.word) for r in got] == [(1, "hund"), (1, "katze"), (1, "nette"), (1, "tiere")]


def test_keyword_ties_by_first_occurrence(spark):
    df = spark.createDataFrame([(1, "beta alpha beta alpha gamma")], "id int, t string")
    assert [r.word for r in keywords.top_keywords(df, "id", "t", 2).orderBy("rank").collect()] == ["beta", "alpha"]


@pytest.mark.parametrize(("raw", "want"), [('["a","b"]', ["a", "b"]), ("a, b,,c", ["a", "b", "c"]), ("[]", []), (None, []), ("", []), ("[broken", [])])
def test_keyword_array(spark, raw, want):
    assert one(spark, X.keyword_array, raw) == want


def test_embedding_text(spark):
    row = spark.createDataFrame([("H", "body", ["k1", "k2"]), (None, "", [])], "h string, c string, k array<string>")
    got = [r.e for r in row.select(X.embedding_text(F.col("h"), F.col("c"), F.col("k")).alias("e")).collect()]
    assert got == ["H | H | body | k1 k2", ""]


def test_sentences(spark):
    assert one(spark, X.sentences, "a b. c d! e") == ["a b.", "c d!", "e"]
    assert one(spark, X.sentences, "") == []


@pytest.mark.parametrize(("raw", "want"), [("Main Heading", "main-heading"), ("Hello! World?", "hello-world"), ("One   Two", "one-two"), ("Übung", "bung")])
def test_slug(spark, raw, want):
    assert one(spark, X.heading_slug, raw) == want


def test_small_functions(spark):
    assert one(spark, F.md5, "a") == "0cc175b9c0f1b6a831c399e269772661"
    assert one(spark, X.file_category, "notes/ADR-7.md") == "adr"
    assert one(spark, X.suffix, "a/b.Tar.GZ") == "gz" and one(spark, X.suffix, "a.b/c") == ""
    assert one(spark, X.preview, "x" * 201) == "x" * 200 + "..."
    assert one(spark, X.is_safe_query, "1; DROP TABLE x") is False and one(spark, X.is_safe_query, "iron") is True
    assert one(spark, X.size_text, 2048, "long") == "2.0 KB"
    assert one(spark, X.safe_name, 'a/b:"c"') == "a_b__c_"
    assert one(spark, X.importance, 0.0, "double") == 0.5


def test_expand(spark):
    df = spark.createDataFrame([(1, "Iron  iron test")], "id int, q string")
    assert keywords.expand(df, "q", {"iron": ["fe"]}).first().expanded == "iron fe test"


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(40)) + " " + "x" * 700
    df = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "id int, t string")
    got = chunks.sentence_chunks(df, "id", "t", 200, 50).orderBy("chunk_index").collect()
    first = [r for r in got if r.id == 1]
    assert {r.id for r in got} == {1, 3} and all(len(r.text) <= 250 for r in first[:-1]) and first[0].total_chunks == len(first)
    assert all(f"number {i} " in " ".join(r.text for r in first) for i in range(40))
    assert first[1].text.startswith(first[0].text.split(". ")[-1][:20]) and first[-1].text.endswith("x" * 700)
    plain = chunks.word_chunks(df.where("id = 1"), "id", "t", 90, 0).orderBy("chunk_index").collect()
    assert " ".join(r.text for r in plain).split()[:-1] == text.split()[:-1]


def test_display_forms(spark):
    for n, want in ((0.5, "0.5s"), (5.0, "5s"), (125.0, "2m 5s"), (7300.0, "2h 1m")):
        assert one(spark, X.duration_text, n, "double") == want
    assert one(spark, X.shown, " a\nb " + "x" * 90).startswith("a b xxx") and one(spark, X.shown, None) == ""
    row = spark.createDataFrame([("a/b.md", 7), ("a/b.md", None)], "p string, l int").select(X.location(F.col("p"), F.col("l")).alias("x")).collect()
    assert [r.x for r in row] == ["b.md:7", "b.md"]
    assert one(spark, X.safe_file_name, "a b/ü.md") == "a_b__.md" and one(spark, X.safe_file_name, "") == "unnamed" and len(one(spark, X.safe_file_name, "x" * 400 + ".md")) == 253
    assert one(spark, X.clean_query, " a\x00b\n ") == "ab"
    assert one(spark, X.path_category, "Gesundheit/x.pdf") == "gesundheit" and one(spark, lambda c: X.path_category(c, "image"), "fotos/x.png") == "bilder"
    assert one(spark, X.frontmatter_text, {"title": "T"}, "map<string,string>") == "---\ntitle: T\n---\n"
    body = spark.createDataFrame([(["a"], [], ["q"])], "c array<string>, d array<string>, q array<string>").select(X.essence_body(F.col("c"), F.col("d"), F.col("q")).alias("b")).first().b
    assert "- a" in body and "❓ q" in body and "Widersprüche" not in body


@pytest.mark.parametrize(("raw", "want"), [
    ('x ```json\n{"a": {"b": 1}}\n``` y', '{"a": {"b": 1}}'), ('text {"a": 1} more {"b": 2}', '{"a": 1}'), ("```\n{}\n```", "{}"), ("none", None), ('{"open": 1', '{"open": 1'), (None, None),
])
def test_json_object(spark, raw, want):
    assert one(spark, X.json_object, raw) == want


def test_hashed_vector(spark):
    df = spark.createDataFrame([("iron liver iron",), ("",)], "x string").select(X.hashed_vector(X.index_tokens(F.col("x")), 16).alias("v")).collect()
    assert len(df[0].v) == 16 and abs(sum(v * v for v in df[0].v) - 1) < 1e-6 and set(df[1].v) == {0.0}


def test_chunks_keep_long_units_whole(spark):
    long = "".join(f"{i:04d}" for i in range(300))
    df = spark.createDataFrame([(1, long), (2, f"Short one. {long}. Last one."), (3, "")], "id int, t string")
    got = {}
    for r in chunks.sentence_chunks(df, "id", "t", 500, 0).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got[1] == [long[:500], long[500:1000], long[1000:]] and set(got) == {1, 2}
    assert "".join(got[2]).replace(" ", "") == f"Shortone.{long}.Lastone." and all(len(t) <= 500 for t in got[2])
    words = chunks.word_chunks(df.where("id = 1"), "id", "t", 500, 0).collect()
    assert [r.text for r in words] == [long]
