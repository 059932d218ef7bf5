from pyspark.sql import functions as F

from marginalia.operators import links, markdown

#: A harbour that names a quay and a crane, a quay and a shed that name the harbour, a crane that names nothing.
VAULT = [
    ("Harbour.md", "# Harbour\nShips lie at the [[Quay]]; loads hang from the [[Crane]].\n"),
    ("Quay.md", "# Quay\nPart of the [[Harbour]].\n"),
    ("Crane.md", "# Crane\nLifts forty tonnes.\n"),
    ("yard/Shed.md", "# Shed\nBehind the [[Harbour]] wall.\n"),
]


def vault(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_sections(spark):
    df = vault(spark, [("t", "# Tides\nHigh at noon.\n\n## Springs\nTwice a month.\n"), ("no", "plain\n#NoSpace\n####### x\n"), ("n", None), ("pre", "dropped\n# A")])
    got = {(r.path, r.header, r.level, r.line_start, r.line_end) for r in markdown.sections(df, "path", "content").collect()}
    assert got == {("t", "Tides", 1, 1, 3), ("t", "Springs", 2, 4, 6), ("pre", "A", 1, 2, 2)}


def test_parents_by_level_and_by_position(spark):
    df = vault(spark, [("x", "# A\n### B\n### C\n")])
    fixed = {r.header: r.parent_header for r in markdown.parents(df, "path", "content").collect()}
    compat = {r.header: r.parent_header for r in markdown.parents(df, "path", "content", compat=True).collect()}
    assert fixed == {"A": None, "B": "A", "C": "A"} and compat == {"A": None, "B": "A", "C": "B"}


def test_links_tags_embeds(spark):
    df = vault(spark, [("x", "At [[Low Water]], or [[Low Water#Neaps|then]], ![[charts/bay.png]] with ![[pier.jpg]] #sea1 #sea/tide #SEA")])
    got = [(r.target, r.heading, r.alias, r.is_embed) for r in markdown.wikilinks(df, "path", "content").orderBy("link_no").collect()]
    assert got == [("Low Water", None, None, False), ("Low Water", "Neaps", "then", False), ("charts/bay.png", None, None, True), ("pier.jpg", None, None, True)]
    row = df.select(markdown.tags(F.col("content")).alias("t"), markdown.embeds(F.col("content")).alias("e")).first()
    assert row.t == ["neaps", "sea1", "sea/tide", "sea"] and row.e == ["charts/bay.png", "pier.jpg"]


def test_frontmatter(spark):
    df = vault(spark, [("x", '---\ntitle: A b\ntags: [x, "y"]\ntitle: C\n---\n\nbody'), ("y", "no block at all")])
    f = markdown.front_fields(F.col("content"))
    got = {r.path: (r.f, r.t, r.b) for r in df.select("path", f.alias("f"), markdown.front_list(f, "tags").alias("t"), markdown.body(F.col("content")).alias("b")).collect()}
    assert got["x"] == ({"title": "C", "tags": '[x, "y"]'}, ["x", "y"], "body") and got["y"] == ({}, None, "no block at all")


def test_rewriting(spark):
    df = vault(spark, [("x", "[[Old]] [[Old#H|a]] [[Older]]\n# H\nx")])
    assert df.select(markdown.relink(F.col("content"), "Old", "New").alias("t")).first().t == "[[New]] [[New#H|a]] [[Older]]\n# H\nx"
    assert df.select(markdown.insert_after_heading(F.col("content"), "H", "+").alias("t")).first().t.endswith("# H\n+\nx")
    assert df.select(markdown.insert_after_heading(F.col("content"), "None", "+").alias("t")).first().t.endswith("x\n+")


def test_context(spark):
    df = vault(spark, [("x", "a" * 5 + " [[L]] " + "b\nb" + " [[L]]")])
    got = [r.context for r in markdown.link_context(df, "path", "content", 3).orderBy("link_no").collect()]
    assert got == ["aa [[L]] b", "b [[L]]"]


def resolved(spark, rows):
    n = vault(spark, rows)
    found = markdown.wikilinks(n, "path", "content").where(~F.col("is_embed")).withColumnRenamed("path", "source_path")
    return n, links.resolve(found, n)


def test_backlinks(spark):
    n, r = resolved(spark, VAULT)
    got = {(b.target_path, b.source_path) for b in links.backlinks(r).collect()}
    assert got == {("Harbour.md", "Quay.md"), ("Harbour.md", "yard/Shed.md"), ("Quay.md", "Harbour.md"), ("Crane.md", "Harbour.md")}
    nodes = {x.path: (x.out_links, x.in_links) for x in links.graph_nodes(n, links.edges(r)).collect()}
    assert nodes == {"Harbour.md": (2, 2), "Quay.md": (1, 1), "Crane.md": (0, 1), "yard/Shed.md": (1, 0)}
    assert links.unlinked_mentions(n, "Quay").where("path = 'Harbour.md'").count() == 0
    assert links.broken(r).count() == 0


def test_resolver(spark):
    paths = ["Rope.md", "deck/Sail.md", "deck/aft/Rudder.md", "index.md", "SOS.md", "store/Rope.md", "Crew/index.md"]
    targets = {"Rope": "Rope.md", "rope": "Rope.md", "ROPE": "Rope.md", "deck/Sail": "deck/Sail.md", "Sail": "deck/Sail.md", "deck/aft/Rudder": "deck/aft/Rudder.md", "aft/rudder": "deck/aft/Rudder.md",
               "store/Rope": "store/Rope.md", "Anchor": None, "Crew": "Crew/index.md", "../deck/Sail": "deck/Sail.md", "sail.md": "deck/Sail.md", "sos": "SOS.md"}
    notes = spark.createDataFrame([(p,) for p in paths], "path string")
    asked = spark.createDataFrame([(t,) for t in targets], "target string")
    assert {r.target: r.target_path for r in links.resolve(asked, notes).collect()} == targets


def test_pages_and_paragraphs(spark):
    df = vault(spark, [("x", "## Page 1\n\nTitle\ntext\n## Page 2\n" + "y" * 120 + "\n## Page 3\n  \n"), ("n", None)])
    got = [(r.page_no, r.header, r.line_start, r.line_end) for r in markdown.page_sections(df, "path", "content").orderBy("page_no").collect()]
    assert got == [(1, "Title", 1, 100), (2, "Page 2", 101, 200)]
    p = vault(spark, [("x", "one two\n\n \nthree\n\n")])
    assert [(r.header, r.words) for r in markdown.paragraph_sections(p, "path", "content").orderBy("paragraph_no").collect()] == [("OCR Section 1", 2), ("OCR Section 2", 1)]


def test_vault_search(spark):
    rows = [("Log.md", "x", ""), ("Compass.md", "north", ""), ("z.md", "of the day", "title: log book"), ("no.md", "nothing", "")]
    n = spark.createDataFrame(rows, "path string, body string, front string")
    got = [(r.path, r.match_type) for r in links.vault_search(n, "log", front=F.col("front"), body=F.col("body")).collect()]
    assert got == [("Log.md", "name"), ("z.md", "frontmatter")]
