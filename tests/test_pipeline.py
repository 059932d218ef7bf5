import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia import config, errors
from marginalia.functions import text as X
from marginalia.functions import yaml
from marginalia.operators import chunks, commits, frontmatter, keywords, knowledge, links, markdown, pipeline, reports, search
from marginalia.operators.incremental import Manifest
from marginalia.sources import files


def one(spark, column, *rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


YAML = [
    ("a: 1\nb: [x, 'y, z', {k: 2}]\nc:\n  - p\n  - q: 1\n    r: 2\n", {"a": 1, "b": ["x", "y, z", {"k": 2}], "c": ["p", {"q": 1, "r": 2}]}),
    ("t: \"quote: \\u00e4\\n\" # c\nd: 2024-1-5\nm: 2024-01-05 10:00:00Z\nn: ~\nf: 1.5\ny: yes\n", {"t": "quote: ä\n", "d": "2024-01-05", "m": "2024-01-05T10:00:00Z", "n": None, "f": 1.5, "y": True}),
    ("lit: |\n  a\n   b\n\nfold: >-\n  c\n  d\nlist:\n- 1\n- 2\n", {"lit": "a\n b\n", "fold": "c d", "list": [1, 2]}),
    ("plain: goes\n  on\nflow: [a,\n  b]\n", {"plain": "goes on", "flow": ["a", "b"]}), ("", None), ("# only\n", None), ("word", "word"), ("u: http://x/y#z\n", {"u": "http://x/y#z"}),
]


@pytest.mark.parametrize(("text", "value"), YAML)
def test_yaml(text, value):
    assert yaml.load(text) == value


@pytest.mark.parametrize("text", ["a: [1", "a: 'x", "a: b: c", "a: 1\n  b: 2\n c: 3", "a: *x", "a: {b: 1", "\t- x\n- y", "- a\nb: 1"])
def test_bad_yaml(text):
    with pytest.raises(yaml.BadYaml):
        yaml.load(text)


def test_front_of_notes(spark):
    rows = [("a", "---\ntags: [X, y]\nm:\n  n: 1\n---\n\n\n# H\n[[L]] #zed"), ("b", "---\n- 1\n---\nx"), ("c", "---\na: [\n---\nx"), ("d", "no front"), ("e", None), ("f", "")]
    got = {r.k: r for r in frontmatter.read_front(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert (got["a"].front, got["a"].body, got["a"].error) == ('{"tags": ["X", "y"], "m": {"n": 1}}', "# H\n[[L]] #zed", None)
    assert got["b"].error == "frontmatter is no mapping" and got["c"].error and got["c"].front == "{}" and got["d"].front == "{}" and got["e"].front is None and got["f"].body == ""
    p = {r.k: r for r in frontmatter.parse_notes(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}["a"]
    assert p.title == "H" and p.tags == ["x", "y", "zed"] and p.links[0].target == "L" and (p.links[0].start, p.links[0].end) == (4, 9) and p.headings[0].slug == "h"


def test_link_editing(spark):
    text = "see [[A]] and [[A#h|x]] ![[A]] [[AB]]\n\n\n\n[[A]]\n"
    c = F.col("t")
    assert one(spark, markdown.count_links(c, "A"), text, None) == [4, None]
    assert one(spark, markdown.remove_links(c, "A"), text, "plain\n\n\n\nx") == ["see  and  ![[A]] [[AB]]\n\n", "plain\n\n\n\nx"]
    assert one(spark, markdown.add_link(c, "B"), text, "x [[B|b]]", "") == [text.rstrip("\n") + "\n\n[[B]]", "x [[B|b]]", "\n\n[[B]]"]
    assert one(spark, markdown.append_text(c, "t", False), "---\na: 1\n---\nx", "x") == ["---\na: 1\n---\nt\n\nx", "t\n\nx"]
    notes = spark.createDataFrame([("d/old.md", "x [[other]]"), ("b.md", "[[old]] [[old#h|a]] [[older]]"), ("c.md", None)], "path string, content string")
    moved = {r.path: r for r in markdown.move_note(notes, "d/old.md", "d/new.md").collect()}
    assert moved["b.md"].content == "[[new]] [[new#h|a]] [[older]]" and moved["b.md"].links_changed == 2 and moved["d/new.md"].content == "x [[other]]" and moved["c.md"].content is None
    assert {r.path for r in markdown.move_note(notes, "d/old.md", "b.md").collect()} == {"d/old.md", "b.md", "c.md"}
    assert one(spark, markdown.title_sections(c), "a\n## T\nb\n## T\nc\n## U", "", None) == [{"_header": "a", "T": "c", "U": ""}, {"_header": ""}, None]


def test_mentions(spark):
    notes = spark.createDataFrame([("a.md", "Deep Sleep is [[deep sleep]] good. sleep, DEEP  sleep; deepsleep"), ("b.md", None), ("c.md", "")], "path string, content string")
    names = spark.createDataFrame([("deep sleep",), ("Sleep",), ("???",), (None,)], "name string")
    want = {("a.md", "deep sleep", 2), ("a.md", "Sleep", 3)}
    assert {tuple(r) for r in links.all_mentions(notes, names).collect()} == want
    links_limit, links.BROADCAST_KEYS = links.BROADCAST_KEYS, 0
    try:
        assert {tuple(r) for r in links.all_mentions(notes, names).collect()} == want
    finally:
        links.BROADCAST_KEYS = links_limit
    assert links.all_mentions(notes, names.limit(0)).count() == 0
    assert [r.context for r in links.mention_contexts(notes, "deep sleep", 3).collect()] == ["Deep Sleep is"]


def test_word_lists(tmp_path, spark):
    s = keywords.Stopwords(["a"])
    s.add("B ", "c")
    s.remove("A", "zz")
    assert s.list() == ["b", "c"] and s.count() == 2
    (tmp_path / "s.json").write_text('{"Deep Learning": ["DL"], "iron": ["fe", "fe"], "n": 1}')
    y = keywords.Synonyms.load(str(tmp_path / "s.json"))
    y.add("iron", "ferrum")
    assert y.get("IRON") == ["fe", "ferrum"] and y.has("deep  learning") and not y.has("n")
    df = spark.createDataFrame([("Iron deep learning iron",), ("",), (None,)], "q string")
    assert [r.expanded for r in y.expand(df, "q").collect()] == ["iron fe ferrum deep learning DL", "", None]


def test_reindex_and_hooks(spark, tmp_path):
    notes = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    before = notes(("r/a.md", "# A\nx\n## B\ny"), ("r/b.md", "# C"), ("other/o.md", "# O"), ("r2/x.md", "# X"))
    index, stored = pipeline.index_notes(before), before.select("path", F.md5("content").alias("hash"))
    events = []

    def broken(event, rows):
        raise ValueError("hook")

    now = notes(("r/a.md", "# A2"), ("r/n.md", "# N"))
    out, figures = pipeline.reindex(index, stored, now, "r", [broken, lambda event, rows: events.append((event, rows.count()))])
    assert sorted((r.path, r.header) for r in out.collect()) == [("other/o.md", "O"), ("r/a.md", "A2"), ("r/n.md", "N"), ("r2/x.md", "X")]
    assert (figures["updated"], figures["removed"]) == (2, 1) and len(figures["errors"]) == 3 and events == [("indexed", 2), ("removed", 1), ("complete", 4)]
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("# A\nx\n# B")
    run = lambda: pipeline.index_folders(spark, [f"file://{tmp_path}/n"], f"file://{tmp_path}/out", Manifest(spark, f"file://{tmp_path}/man"), hooks=[broken])
    assert run() == {"files": 1, "sections": 2, "errors": ["broken: hook"]} and run() == {"files": 0, "sections": 0, "errors": []}


def test_vectors(spark):
    s = spark.createDataFrame([("s1", "f1", "H", "text of some length", ["k"]), ("s2", "f2", None, "another text here", None), ("s3", "f2", "H", "short", None)], "id string, file_id string, header string, content string, keywords array<string>")
    model, schema = pipeline.offline_model(8), "id string, file_id string, mark string, embedding array<float>, failed boolean"
    none = spark.createDataFrame([], schema)
    full = pipeline.embedding_run(s, none, model, 8, "full")
    assert {r.id for r in full.collect()} == {"s1", "s2"}
    failing = lambda t: F.when(F.contains(t, F.lit("another")), None).otherwise(model(t))
    part = pipeline.embedding_run(s, none, failing, 8)
    assert {(r.id, r.failed, sum(r.embedding) == 0) for r in part.collect()} == {("s1", False, False), ("s2", True, True)}
    assert {(r.id, r.failed) for r in pipeline.embedding_run(s, part, model, 8).collect()} == {("s1", False), ("s2", False)}  # failed ones are tried again
    extra = full.unionByName(spark.createDataFrame([("gone", "f9", "m", [0.0] * 8, False)], schema))
    assert {(r.key, r.action) for r in pipeline.sync(s, extra, model, 8, "dry-run").collect()} == {("s1", "keep"), ("s2", "keep"), ("gone", "delete")}
    for mode in ("delta", "full", "delete-orphans"):
        assert {r.id for r in pipeline.sync(s, extra, model, 8, mode).collect()} == {"s1", "s2"}
    assert {r.id for r in pipeline.sync(s, extra.where("id <> 's2'"), model, 8, "file", "f2").collect()} == {"s1", "s2", "gone"}
    assert {r.id for r in pipeline.delete_vectors(extra, s.where("id = 's1'"), s.select("file_id").where("file_id = 'f2'")).collect()} == {"gone"}
    assert pipeline.queue_once(spark.createDataFrame([("f", 2), ("f", 1), ("g", 3)], "file_id string, at int")).count() == 2
    for bad in (lambda: pipeline.sync(s, extra, model, 8, "x"), lambda: pipeline.embedding_run(s, extra, model, 8, "x")):
        with pytest.raises(ValueError):
            bad()


def test_batches_with_error_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, t string").coalesce(1)

    def work(pdf):
        if (pdf["id"] == 7).any():
            raise ValueError("seven")
        return pd.DataFrame({"id": pdf["id"], "n": pdf["t"].str.len()})

    got = pipeline.in_batches(df, work, "id int, n long").collect()
    assert len(got) == 20 and [(r.id, r.n, r.error) for r in got if r.error] == [(7, None, "seven")]
    assert knowledge.generate(df.limit(0), "id int, n long", work).count() == 0
    waits = []
    with pytest.raises(errors.RunFailed):
        pipeline.with_retries(lambda: 1 / 0, 3, 0.5, waits.append)
    assert waits == [0.5, 1.0] and pipeline.with_retries(lambda: 5) == 5


def test_engines(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    engines = pipeline.Engines({"x": lambda df: df.select("id", F.when(F.col("id") == 1, "one").alias("answer"))}, "x")
    engines.register("y", lambda df: df.select("id", F.lit("y").alias("answer")))
    run = lambda *a: {(r.id, r.answer, r.engine) for r in engines.run(p, *a).collect()}
    assert run() == {(1, "one", "x")} and run("primary_first", "y") == {(1, "one", "x"), (2, "y", "y")}
    assert run("aggregate", "y") == {(1, "one\n\ny", "x+y"), (2, "y", "y")} and run("compare", "y") == {(1, "one", "x"), (1, "y", "y"), (2, "y", "y")}


def test_jobs_and_state(spark, tmp_path):
    minutes = spark.createDataFrame([(dt.datetime(2024, 1, 1, 8, m),) for m in range(0, 60, 10)], "m timestamp_ntz")
    last = {"watch": dt.datetime(2024, 1, 1, 8, 0)}
    assert {(r.minute.minute, r.job) for r in pipeline.due(minutes, "m", {"watch": "*/20 * * * *"}, last).collect()} == {(20, "watch"), (40, "watch")}
    state = pipeline.SyncState(spark, f"file://{tmp_path}/state")
    assert state.last("a") is None
    state.set("a", dt.datetime(2024, 1, 1))
    state.set("b", dt.datetime(2024, 1, 2))
    state.set("a", dt.datetime(2024, 1, 3))
    assert state.last("a") == dt.datetime(2024, 1, 3) and isinstance(state.log, commits.CommitLog)
    assert pipeline.schema_issues(spark.createDataFrame([], "a int, b string"), {"a": "int", "b": "int", "c": "int"}) == [("b", "string instead of int"), ("c", "missing")]
    assert pipeline.warm(minutes) == 6


def test_search_helpers(spark):
    df = spark.createDataFrame([(1, "B", "iron x"), (2, None, "iron"), (3, "A", "IRON"), (4, "Z", "none")], "id int, h string, c string")
    got = search.LikeProvider(df, "id", F.col("h"), F.col("c")).search("iron", 2).collect()
    assert [(r.id, r.score) for r in got] == [(2, 1.0), (3, 0.5)]
    assert search.LikeProvider(df, "id", F.col("h"), F.col("c")).search(" ").count() == 0
    cache, calls = search.QueryCache(2), []
    for q in ("a", "A ", "b", "c", "b", "a"):
        cache.get(q, 5, lambda: (calls.append(q), df)[1]).count()
    assert calls == ["a", "b", "c", "a"]
    assert config.from_environment(config.SearchConfig, {"MARGINALIA_FINAL_LIMIT": "7", "MARGINALIA_NORMALIZE": "no"}, b=0.5) == config.SearchConfig(final_limit=7, normalize=False, b=0.5)
    with pytest.raises(errors.ConfigError):
        config.from_environment(config.SearchConfig, {"MARGINALIA_FINAL_LIMIT": "x"})


def test_answers(spark):
    c = F.col("t")
    got = one(spark, X.json_object(c), 'a ```json\n{"x": "}{", "y": {"z": 1}} ```', '{"a": 1} {"b": 2}', '{"open": "', "none", None)
    assert got == ['{"x": "}{", "y": {"z": 1}}', '{"a": 1}', '{"open": "', None, None]
    v = one(spark, X.hashed_vector(X.words(c), 16), "a b a c", "", "a b a c")
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-6 and v[0] == v[2] and set(v[1]) == {0.0}


def test_summaries(spark):
    kind = "summary string, key_points array<string>, connections array<string>, contradictions array<string>, open_questions array<string>, entities array<string>, keywords array<string>, relationships array<struct<from:string,to:string,type:string>>"
    a = ("short", ["P", "q"], None, [], [], ["E"], ["k"], [("x", "y", "t")])
    b = ("quite a bit longer", ["p", "r"], ["c"], [], [], ["e"], None, [("x", "y", "t"), ("y", "z", "t")])
    df = spark.createDataFrame([(a, b), (None, None)], f"a struct<{kind.replace(' string', ':string').replace(' array', ':array')}>, b struct<{kind.replace(' string', ':string').replace(' array', ':array')}>")
    got = reports.compare_summaries(df).collect()
    assert (got[0].unchanged, got[0].complements, got[0].conflicts, got[0].can_merge) == (3, 5, 1, False)
    assert {d.field: d.kind for d in got[0].diffs} == {"summary": "changed", "key_points": "changed", "connections": "added", "keywords": "removed", "relationships": "added"}
    text = reports.compare_summaries(df).select(reports.diff_text(F.col("unchanged"), F.col("complements"), F.col("conflicts"), F.col("can_merge"), F.col("diffs"))).first()[0]
    assert "[+] connections\n      B: c" in text
    m = reports.merge_summaries(df).first().merged
    assert m.summary == "quite a bit longer" and m.key_points == ["P", "q", "r"] and m.relationships == ["x→t→y", "y→t→z"]


def test_chunk_dispatch(spark):
    df = spark.createDataFrame([(1, "One two. Three four. " * 40)], "id int, t string")
    assert chunks.chunk_document(df, "id", "t", 100, 0).count() == chunks.sentence_chunks(df, "id", "t", 100, 0).count()
    assert chunks.chunk_document(df, "id", "t", 100, 0, False).count() == chunks.word_chunks(df, "id", "t", 100, 0).count()
    assert chunks.chunk_document(df, "id", "t", 100, 0, splitter=lambda c: F.split(c, r"(?<=\.)\s")).count() > 1
    rows = chunks.sentence_chunks(df, "id", "t", 100, 30).join(chunks.chunk_offsets(df, "id", "t", 100, 30), ["id", "chunk_index"]).collect()
    joined = "One two. Three four. " * 40
    assert all(joined[r.start_at : r.end_at] == r.text for r in rows) and len(rows) > 3


def test_files(spark, tmp_path):
    listing = spark.createDataFrame([("a/x.MD", 10), ("a/x.MD", 10), ("a/y.exe", 10), ("skip/z.md", 10), ("b/big.pdf", 99), (None, 1), ("a/k.md", 5)], "path string, size long")
    known = spark.createDataFrame([("a/k.md",)], "path string")
    assert {r.path for r in files.ghost_scan(listing, known, excluded=("skip",), most=50).collect()} == {"a/x.MD"}
    q = files.Incoming(spark, f"file://{tmp_path}/in")
    assert q.waiting().count() == 0
    (tmp_path / "f.md").write_text("x")
    q.add(f"file://{tmp_path}/f.md")
    with pytest.raises(errors.SourceError):
        q.add(f"file://{tmp_path}/f.md")
    assert q.waiting().count() == 1
    q.clear()
    assert q.waiting().count() == 0
    files.export_json(listing, f"file://{tmp_path}/json")
    assert '"count":7' in spark.read.text(f"file://{tmp_path}/json/summary").first()[0]
    for _ in range(2):
        files.append_log(spark.createDataFrame([("e" * 900,)], "error string"), f"file://{tmp_path}/log")
    assert {r.n for r in spark.read.parquet(f"file://{tmp_path}/log").select(F.length("error").alias("n")).collect()} == {500} and spark.read.parquet(f"file://{tmp_path}/log").count() == 2
    audit = spark.createDataFrame([("info", "b", 1), ("error", "z", 2)], "severity string, issue string, n long")
    assert [r.line for r in files.audit_lines(audit).collect()] == ["| error | z | 2 |", "| info | b | 1 |"]
    e = spark.createDataFrame([("h", "T: x", "S", ["p"], None, None, None)], "hash string, title string, summary string, key_points array<string>, connections array<string>, contradictions array<string>, questions array<string>")
    notes = {r.path: r.content for r in files.essence_notes(e).collect()}
    assert notes["h/essence.md"].startswith('---\ntitle: "T: x"\nhash: h\n---\n\n# T: x\n\nS\n\n- p') and '"key_points":["p"]' in notes["h/essence.json"]
    assert files.graph_files(audit, audit.limit(1), f"file://{tmp_path}/g") == {"nodes": 2, "edges": 1}
    entries = spark.createDataFrame([("A b", "t"), ("a_b", "u"), ("C", "v"), (None, "w")], "title string, content string")
    exported = files.note_exports(entries, spark.createDataFrame([("c",)], "title string"), "title", "content").collect()
    assert [(r.path, r.content) for r in exported] == [("a_b.md", '---\ntitle: "a_b"\n---\n\nu')]
    pages = spark.createDataFrame([("p", 2, b"two"), ("p", 1, b"one"), ("q", 1, b"")], "path string, page_no int, content binary")
    upper = lambda df: df.select("path", F.upper(F.col("content").cast("string")).alias("text"))
    got = {r.path: (r.pages, r.text) for r in files.ocr_documents(pages, files.first_engine(lambda df: df.select("path", F.lit(None).cast("string").alias("text")), upper)).collect()}
    assert got == {"p": (2, "ONE\n\nTWO"), "q": (1, "")}
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop/n.md").write_text("note")
    seen = []
    stream = files.drop_folder_stream(spark, f"{tmp_path}/drop", f"{tmp_path}/archive")
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, n: seen.extend(r.text for r in df.collect())).start().awaitTermination(60)
    assert seen == ["note"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.PNG").write_bytes(b"x")
    (tmp_path / "img/b.txt").write_bytes(b"x")
    assert files.images(spark, f"file://{tmp_path}/img").count() == 1


def test_cli(spark, data, tmp_path, capsys):
    from marginalia import cli

    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("# A\nx")
    v = tmp_path / "v"
    spark.createDataFrame([("s1", "f", "H", "text of some length", ["k"])], "id string, file_id string, header string, content string, keywords array<string>").write.parquet(f"{v}/sections.parquet")
    spark.createDataFrame([], "id string, file_id string, mark string, embedding array<float>, failed boolean").write.parquet(f"{v}/vectors.parquet")
    for args, words in (
        (["search", data, "iron"], "combined"), (["search", data, "iron", "--like"], "combined"), (["audit", data], "issue"), (["coverage", data], "percent"), (["ghost", data, "--endings", ".md"], "path"),
        (["ghost", data, "--scan", f"file://{tmp_path}/n"], "a.md"), (["report", data], "prompt"), (["backup", data, "--tables", "region", "--to", f"{tmp_path}/b"], "region"), (["warm", data, "--tables", "nation"], "rows"),
        (["index", f"file://{tmp_path}/n", "--to", f"file://{tmp_path}/i"], "sections"), (["sync", str(v)], "embed"), (["sync", str(v), "--mode", "delta"], "vectors"),
    ):
        cli.main(args)
        assert words in capsys.readouterr().out


def test_repeated_ids_of_keywords(spark):
    df = spark.createDataFrame([(1, "zeta alpha zeta"), (1, "alpha alpha"), (2, "beta"), (None, "gamma"), (3, None), (4, "")], "id int, t string").selectExpr("*", "1 AS rank", "2 AS word")
    got = {(r.id, r["rank"], r.word, r.n) for r in keywords.top_keywords(df, "id", "t", 1).collect()}
    assert got == {(1, 1, "alpha", 3), (2, 1, "beta", 1), (None, 1, "gamma", 1)}
