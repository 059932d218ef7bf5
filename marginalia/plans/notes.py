"""Queries over texts, keywords, notes and links.

``notes`` makes Markdown notes of the documents, by the same expressions here and in SQL: a frontmatter block, the text,
and links to the notes of half and a third of the document's number, one to a note that does not exist, an embed and tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions import wordlists
from marginalia.operators import chunks, keywords, links, markdown
from marginalia.session import table

_NOTE = """
'k' || (doc_id % 50) || '/note_' || doc_id || '.md' AS path,
'---' || {nl} || 'title: Note ' || doc_id || {nl} || 'tags: [' || coalesce(lang, 'xx') || ', kb]' || {nl} || '---' || {nl} || '# Note ' || doc_id || {nl} || coalesce(text, '') || {nl} || '## Links' || {nl}
|| 'See [[note_' || {half} || ']] and [[k' || ({third} % 50) || '/note_' || {third} || '#Links|the other one]] or [[Missing ' || (doc_id % 7) || ']].' || {nl}
|| '![[images/p' || (doc_id % 9) || '.png]] #kb/notes #Topic' || (doc_id % 5) || {nl} AS content"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    expr = _NOTE.format(nl="'\\n'", half="(doc_id div 2)", third="(doc_id div 3)")
    return table(spark, d, "documents", spread=True).selectExpr("doc_id", "created_at", *[e.strip() for e in _split(expr)])


def _split(expr: str) -> list[str]:
    at = expr.index("AS path,") + len("AS path,")
    return [expr[: at - 1], expr[at:]]


NOTES = "notes AS (SELECT doc_id, created_at, " + _NOTE.format(nl="chr(10)", half="(doc_id // 2)", third="(doc_id // 3)") + " FROM documents)"

# Synonyms of a few terms, as an example table for expansion.
SYNONYMS = {"eisen": ["ferrum", "fe"], "iron": ["ferrum", "fe"], "leber": ["hepar"], "liver": ["hepar"], "sleep": ["rest"], "schlaf": ["ruhe"], "note": ["notiz", "entry"]}

STOP = ", ".join(f"'{w}'" for w in wordlists.SECTION)
STOP_HANDLER = ", ".join(f"'{w}'" for w in wordlists.GERMAN + wordlists.FIELD)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", spread=True)


def _sections(spark: SparkSession, d: str, **columns) -> DataFrame:
    """What is asked of each section, made row by row; repeated rows count once, by their id and these columns."""
    return table(spark, d, "file_sections").select("id", *[c.alias(n) for n, c in columns.items()]).distinct()


def keywords_top10(spark, d):
    return keywords.top_keywords(_docs(spark, d), "doc_id", "text", 10)


def keywords_top15(spark, d):
    return keywords.top_keywords(_docs(spark, d), "doc_id", "text", 15)


def keywords_handler_top20(spark, d):
    return keywords.handler_keywords(_docs(spark, d), "doc_id", "text", n=20)


def keyword_dictionary(spark, d):
    return keywords.dictionary(keywords.top_keywords(_docs(spark, d), "doc_id", "text", 10))


def section_keywords(spark, d):
    return keywords.section_keywords(table(spark, d, "file_sections"), "id", X.keyword_array(F.col("keywords")))


def keyword_parse_json_csv(spark, d):
    return _sections(spark, d, keywords=F.array_join(X.keyword_array(F.col("keywords")), "|"))


def synonym_expand(spark, d):
    q = table(spark, d, "search_results").select("search_id", "query").distinct().where("query IS NOT NULL")
    return keywords.expand(q, "query", SYNONYMS).select("search_id", "query", "expanded")


def embedding_text(spark, d):
    return _sections(spark, d, embedding_text=X.embedding_text(F.col("section_header"), F.col("content_full"), X.keyword_array(F.col("keywords"))))


def content_hashes(spark, d):
    return _docs(spark, d).select("doc_id", F.md5("text").alias("md5"), X.short_hash(F.col("text")).alias("sha"))


def file_category(spark, d):
    return table(spark, d, "files").distinct().select("id", "file_path", X.file_category(F.col("file_path")).alias("category"), X.path_category(F.col("file_path")).alias("pdf_category"), X.suffix(F.col("file_path")).alias("suffix"))


def sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


def word_counts_preview(spark, d):
    return _docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("words"), X.preview(F.col("text")).alias("preview"))


def normalised_words(spark, d):
    words = _docs(spark, d).select(F.explode(X.keyword_tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", X.umlauts(F.col("word")).alias("normalized"), "n")


def chunks_sentence(spark, d):
    return chunks.sentence_chunks(_docs(spark, d), "doc_id", "text")


def chunks_simple(spark, d):
    return chunks.word_chunks(_docs(spark, d), "doc_id", "text")


def chunks_plain(spark, d):
    """Without overlap the chunks' words are the text's words."""
    c = chunks.word_chunks(_docs(spark, d), "doc_id", "text", 400, 0)
    return c.groupBy("doc_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.max(F.length("text") <= 400).alias("within"))


def md_sections(spark, d):
    return markdown.with_section_fields(markdown.sections(notes(spark, d), "path", "content"))


def md_section_parents(spark, d):
    return markdown.parents(notes(spark, d), "path", "content")


def md_section_parents_compat(spark, d):
    return markdown.parents(notes(spark, d), "path", "content", compat=True)


def page_sections(spark, d):
    return markdown.page_sections(_docs(spark, d).select("doc_id", F.concat(F.lit("## Page 1\n"), "text", F.lit("\n## Page 2\nlast page\n")).alias("t")), "doc_id", "t")


def paragraph_sections(spark, d):
    return markdown.paragraph_sections(_docs(spark, d), "doc_id", "text")


def frontmatter(spark, d):
    f = markdown.front_fields(F.col("content"))
    return notes(spark, d).select("path", F.try_element_at(f, F.lit("title")).alias("title"), F.array_join(markdown.front_list(f, "tags"), "|").alias("tags"), F.length(markdown.body(F.col("content"))).alias("body_length"))


def wikilinks(spark, d):
    return markdown.wikilinks(notes(spark, d), "path", "content")


def tags(spark, d):
    return notes(spark, d).select("path", F.posexplode(markdown.tags(F.col("content"))).alias("pos", "tag"))


def embeds(spark, d):
    return notes(spark, d).select("path", F.posexplode(markdown.embeds(F.col("content"))).alias("pos", "embed"))


def link_context(spark, d):
    return markdown.link_context(notes(spark, d), "path", "content", 40)


def headings_slug(spark, d):
    return markdown.headings(notes(spark, d), "path", "content")


def wikilink_rewrite(spark, d):
    text = markdown.relink(F.col("content"), "Missing 3", "Found/note$1")
    return notes(spark, d).select("path", F.md5(text).alias("text_hash"), (text != F.col("content")).alias("changed"))


def heading_insert(spark, d):
    text = markdown.insert_after_heading(F.col("content"), "Links", "- new line")
    return notes(spark, d).select("path", F.md5(text).alias("text_hash"))


def _resolved(spark, d):
    n = notes(spark, d)
    found = markdown.wikilinks(n, "path", "content").where(~F.col("is_embed")).withColumnRenamed("path", "source_path")
    return n, links.resolve(found, n)


def resolve_links(spark, d):
    return _resolved(spark, d)[1].select("source_path", "link_no", "target", "target_path")


def backlinks(spark, d):
    return links.backlinks(_resolved(spark, d)[1])


def broken_links(spark, d):
    return links.broken(_resolved(spark, d)[1])


def link_graph_edges(spark, d):
    return links.edges(_resolved(spark, d)[1])


def graph_nodes(spark, d):
    n, r = _resolved(spark, d)
    return links.graph_nodes(n, links.edges(r))


def vault_stats_top_linked(spark, d):
    return links.most_linked(links.edges(_resolved(spark, d)[1]))


def unlinked_mentions(spark, d):
    return links.unlinked_mentions(notes(spark, d), "iron")


def vault_search(spark, d):
    return links.vault_search(notes(spark, d), "note_12 links", front=F.array_join(F.map_values(markdown.front_fields(F.col("content"))), " "), body=markdown.body(F.col("content")))


QUERIES = {f.__name__: f for f in (
    keywords_top10, keywords_top15, keywords_handler_top20, keyword_dictionary, section_keywords, keyword_parse_json_csv, synonym_expand, embedding_text, content_hashes,
    file_category, sentences, word_counts_preview, normalised_words, chunks_sentence, chunks_simple, chunks_plain, md_sections, md_section_parents, md_section_parents_compat,
    page_sections, paragraph_sections, frontmatter, wikilinks, tags, embeds, link_context, headings_slug, wikilink_rewrite, heading_insert, resolve_links, backlinks,
    broken_links, link_graph_edges, graph_nodes, vault_stats_top_linked, unlinked_mentions, vault_search,
)}

_TOP = r"""
t AS (SELECT doc_id, w, pos FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS l FROM documents))),
"""


def _top(n: int, cond: str, stop: str = STOP) -> str:
    return _TOP + f"""c AS (SELECT doc_id, w AS word, count(*) AS n, min(pos) AS first FROM t WHERE {cond} AND w NOT IN ({stop}) GROUP BY 1, 2),
r AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c QUALIFY rank <= {n})"""


_LATIN = "regexp_full_match(w, '[a-zäöüß]{4,}')"
_UML = "replace(replace(replace(replace(lower({}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
_KEYS = """CASE WHEN keywords IS NULL OR trim(keywords) = '' THEN [] WHEN ltrim(keywords) LIKE '[%' THEN list_filter(list_transform(CAST(try_cast(keywords AS JSON) AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '')
  ELSE list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)), lambda x: x <> '') END"""
_SEC = f"s AS (SELECT DISTINCT id, section_header, content_full, {_KEYS} AS keys FROM file_sections)"
_SYN = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in SYNONYMS.items())
_LINES = f"WITH {NOTES}, l AS (SELECT path, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS no FROM (SELECT path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM notes)), h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY no) AS k, len(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1)) AS header, lead(no) OVER (PARTITION BY path ORDER BY no) AS next FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S'))"
_LINKS = f"""WITH {NOTES}, m AS (SELECT path, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS link_no FROM (SELECT path, regexp_extract_all(content, '!?\\[\\[[^\\]\\|#]+(?:#[^\\]\\|]+)?(?:\\|[^\\]]+)?\\]\\]') AS x FROM notes)),
wl AS (SELECT path, link_no, trim(regexp_extract(x, '\\[\\[([^\\]\\|#]+)', 1)) AS target, nullif(trim(regexp_extract(x, '#([^\\]\\|]+)', 1)), '') AS heading, nullif(trim(regexp_extract(x, '\\|([^\\]]+)', 1)), '') AS alias, x LIKE '!%' AS is_embed FROM m)"""
_RES = _LINKS + """,
p AS (SELECT path, lower(regexp_replace(path, '\\.md$', '')) AS low FROM notes),
rl AS (SELECT wl.path AS source_path, link_no, target, alias, (SELECT min_by(p.path, (CASE WHEN p.low = k THEN 0 ELSE 2 END) * 100000 + len(p.path)) FROM p WHERE p.low = k OR ends_with(p.low, '/' || k)) AS target_path
  FROM (SELECT *, lower(target) AS k FROM wl WHERE NOT is_embed) wl)"""
_EDGES = _RES + ", e AS (SELECT source_path, target_path, count(*) AS links FROM rl WHERE target_path IS NOT NULL AND target_path <> source_path GROUP BY 1, 2)"

SQL = {
    "keywords_top10": f"WITH {_top(10, _LATIN)} SELECT * FROM r",
    "keywords_top15": f"WITH {_top(15, _LATIN)} SELECT * FROM r",
    "keywords_handler_top20": f"WITH {_top(20, 'len(w) >= 2', STOP_HANDLER)} SELECT * FROM r",
    "keyword_dictionary": f"WITH {_top(10, _LATIN)} SELECT {_UML.format('word')} AS normalized, min(word) AS keyword, count(*) AS usage_count FROM r GROUP BY 1",
    "section_keywords": f"WITH {_SEC} SELECT DISTINCT id, {_UML.format('trim(k)')} AS normalized FROM (SELECT id, unnest(keys) AS k FROM s)",
    "keyword_parse_json_csv": f"WITH s AS (SELECT DISTINCT * FROM file_sections) SELECT id, array_to_string({_KEYS}, '|') AS keywords FROM s",
    "synonym_expand": f"""WITH q AS (SELECT DISTINCT search_id, query FROM search_results WHERE query IS NOT NULL),
x AS (SELECT search_id, query, flatten(list_transform(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> ''), lambda t: list_concat([t], CASE t {_SYN} ELSE []::VARCHAR[] END))) AS l FROM q)
SELECT search_id, query, coalesce(array_to_string(list_transform(list_filter(list_zip(l, range(len(l))), lambda p: list_position(l, p[1]) = p[2] + 1), lambda p: p[1]), ' '), '') AS expanded FROM x""",
    "embedding_text": f"""WITH s AS (SELECT DISTINCT * FROM file_sections), k AS (SELECT *, {_KEYS} AS keys FROM s)
SELECT id, concat_ws(' | ', nullif(section_header, ''), nullif(section_header, ''), CASE WHEN content_full <> '' THEN trim(left(content_full, 500)) END, nullif(array_to_string(keys[1:10], ' '), '')) AS embedding_text FROM k""",
    "content_hashes": "SELECT doc_id, md5(text) AS md5, 'sha256:' || left(sha256(text), 16) AS sha FROM documents",
    "file_category": """WITH f AS (SELECT DISTINCT *, lower(string_split(file_path, '/')[-1]) AS n, coalesce(string_split(file_path, '/')[-2], '') AS p, lower(file_path) AS l FROM (SELECT DISTINCT * FROM files))
SELECT id, file_path, CASE WHEN contains(p, 'learnings') OR contains(n, 'learning') THEN 'learnings' WHEN contains(n, 'adr') OR contains(p, 'architecture') THEN 'adr' WHEN contains(n, 'briefing') THEN 'briefing' WHEN contains(file_path, 'projektplanung') THEN 'projektplanung' ELSE 'dokumentation' END AS category,
 CASE WHEN contains(l, 'medizin_studien') OR contains(l, 'medizin-studien') THEN 'medizin_studien' WHEN contains(l, 'gesundheit') THEN 'gesundheit' WHEN contains(l, 'buecher') OR contains(l, 'bucher') THEN 'buecher' WHEN contains(l, 'aluminium') THEN 'aluminium' ELSE 'dokumentation' END AS pdf_category,
 lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) AS suffix FROM f""",
    "sentences": "SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents)",
    "word_counts_preview": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT AS words, CASE WHEN len(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents",
    "normalised_words": f"WITH {_TOP.rstrip().rstrip(',')} SELECT w AS word, {_UML.format('w')} AS normalized, count(*) AS n FROM t WHERE {_LATIN} GROUP BY 1, 2",
    "chunks_sentence": """WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text <> ''),
f AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [left(text, 500)] ELSE list_filter(string_split(list_reduce(list_prepend('', l), lambda acc, p: CASE
  WHEN acc[-1:] <> chr(1) AND acc <> '' AND len(string_split(acc, chr(1))[-1]) + len(p) > 500 THEN acc || chr(1) || (CASE WHEN contains(right(string_split(acc, chr(1))[-1], 50), '. ') AND string_split(right(string_split(acc, chr(1))[-1], 50), '. ')[-1] <> '' THEN string_split(right(string_split(acc, chr(1))[-1], 50), '. ')[-1] || ' ' || p
    WHEN contains(right(string_split(acc, chr(1))[-1], 50), '. ') THEN (CASE WHEN len(p) > 500 THEN array_to_string(list_transform(range(0, len(p), 500), lambda i: substring(p, i + 1, 500)), chr(1)) || chr(1) ELSE p END)
    WHEN contains(right(string_split(acc, chr(1))[-1], 50), '! ') THEN string_split(right(string_split(acc, chr(1))[-1], 50), '! ')[-1] || ' ' || p WHEN contains(right(string_split(acc, chr(1))[-1], 50), '? ') THEN string_split(right(string_split(acc, chr(1))[-1], 50), '? ')[-1] || ' ' || p
    WHEN len(p) > 500 THEN array_to_string(list_transform(range(0, len(p), 500), lambda i: substring(p, i + 1, 500)), chr(1)) || chr(1) ELSE p END)
  WHEN acc = '' OR acc[-1:] = chr(1) THEN acc || (CASE WHEN len(p) > 500 THEN array_to_string(list_transform(range(0, len(p), 500), lambda i: substring(p, i + 1, 500)), chr(1)) || chr(1) ELSE p END) ELSE acc || ' ' || p END), chr(1)), lambda x: x <> '') END AS c FROM s)
SELECT doc_id, unnest(range(len(c)))::INT AS chunk_index, len(c)::INT AS total_chunks, unnest(c) AS text FROM f""",
    "chunks_plain": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, true AS within FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 0",
    "md_sections": _LINES + """, b AS (SELECT h.path, h.k AS section_no, h.level, h.header, h.no AS line_start, coalesce(h.next - 1, (SELECT max(no) FROM l WHERE l.path = h.path)) AS line_end FROM h),
c AS (SELECT b.path, section_no, level, header, line_start, line_end, coalesce(string_agg(l.line, chr(10) ORDER BY l.no), '') AS content FROM b LEFT JOIN l ON l.path = b.path AND l.no > line_start AND l.no <= line_end GROUP BY ALL)
SELECT path, section_no, level, header, line_start, line_end, content, CASE WHEN len(content) > 200 THEN left(content, 200) || '...' ELSE content END AS content_preview, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS word_count FROM c""",
    "md_section_parents": _LINES + " SELECT path, k AS section_no, header, (SELECT max_by(p.header, p.k) FROM h p WHERE p.path = h.path AND p.k < h.k AND p.level < h.level AND NOT EXISTS (SELECT 1 FROM h q WHERE q.path = h.path AND q.k > p.k AND q.k < h.k AND q.level <= p.level)) AS parent_header FROM h",
    "page_sections": """WITH p AS (SELECT doc_id, unnest([text, 'last page']) AS t, unnest([1, 2]) AS n FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS page_no FROM p WHERE regexp_replace(t, '\\s+', '', 'g') <> '')
SELECT doc_id, page_no, coalesce((list_filter(list_transform(string_split(regexp_replace(t, '^\\s+', ''), chr(10))[1:5], lambda x: trim(x)), lambda x: x <> '' AND len(x) <= 100))[1], 'Page ' || page_no) AS header, (page_no - 1) * 100 + 1 AS line_start, page_no * 100 AS line_end FROM q""",
    "paragraph_sections": "SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS paragraph_no, 'OCR Section ' || unnest(range(1, len(l) + 1)) AS header, unnest(list_transform(l, lambda p: len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> ''))))::INT AS words FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '\\s+', '', 'g') <> '') AS l FROM documents)",
    "frontmatter": f"WITH {NOTES} SELECT n.path, 'Note ' || n.doc_id AS title, coalesce(nullif(trim(d.lang), ''), CASE WHEN d.lang IS NULL THEN 'xx' END) AS tags, len(regexp_replace(n.content, '^---\\n[\\s\\S]*?\\n---\\n+', '')) AS body_length FROM notes n JOIN documents d USING (doc_id)".replace("AS tags, len", "|| '|kb' AS tags, len"),
    "wikilinks": _LINKS + " SELECT * FROM wl",
    "tags": f"WITH {NOTES}, m AS (SELECT path, regexp_extract_all(content, '#([a-zA-Z][a-zA-Z0-9_/-]+)', 1) AS x FROM notes) SELECT path, unnest(range(len(x))) AS pos, lower(unnest(x)) AS tag FROM m",
    "embeds": f"WITH {NOTES}, m AS (SELECT path, regexp_extract_all(content, '!\\[\\[([^\\]]+)\\]\\]', 1) AS x FROM notes) SELECT path, unnest(range(len(x))) AS pos, unnest(x) AS embed FROM m",
    "link_context": f"""WITH {NOTES}, m AS (SELECT path, content, regexp_extract_all(content, '\\[\\[[^\\]]+\\]\\]') AS f, regexp_split_to_array(content, '\\[\\[[^\\]]+\\]\\]') AS b FROM notes),
i AS (SELECT path, content, f, b, unnest(range(1, len(f) + 1)) AS link_no FROM m),
s AS (SELECT path, content, link_no, len(f[link_no]) AS n, CAST(list_sum(list_transform(b[1:link_no], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:link_no - 1], lambda x: len(x))), 0) AS BIGINT) AS st FROM i)
SELECT path, link_no, trim(regexp_replace(substring(content, greatest(st - 40, 0) + 1, least(st + n + 40, len(content)) - greatest(st - 40, 0)), '\\s+', ' ', 'g')) AS context FROM s""",
    "headings_slug": f"""WITH {NOTES}, l AS (SELECT path, list_filter(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_matches(x, '^#+\\s*[^#\\s]')) AS x FROM notes),
h AS (SELECT path, unnest(range(1, len(x) + 1)) AS heading_no, unnest(x) AS x FROM l)
SELECT path, heading_no, len(regexp_extract(x, '^(#+)', 1)) AS level, trim(regexp_replace(x, '^#+', '')) AS text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(x, '^#+', ''))), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM h""",
    "wikilink_rewrite": f"WITH {NOTES}, r AS (SELECT path, content, regexp_replace(content, '\\[\\[Missing 3((?:#[^\\]\\|]+)?(?:\\|[^\\]]+)?)\\]\\]', '[[Found/note$1\\1]]', 'g') AS t FROM notes) SELECT path, md5(t) AS text_hash, t <> content AS changed FROM r",
    "heading_insert": f"WITH {NOTES} SELECT path, md5(regexp_replace(content, '(?m)^(#*\\s*Links *)$', '\\1' || chr(10) || '- new line')) AS text_hash FROM notes",
    "resolve_links": _RES + " SELECT source_path, link_no, target, target_path FROM rl",
    "backlinks": _RES + " SELECT DISTINCT target_path, source_path, coalesce(alias, target) AS link_text FROM rl WHERE target_path IS NOT NULL",
    "broken_links": _RES + " SELECT DISTINCT source_path, target FROM rl WHERE target_path IS NULL",
    "link_graph_edges": _EDGES + " SELECT * FROM e",
    "graph_nodes": _EDGES + " SELECT path, (SELECT count(*) FROM e WHERE source_path = n.path) AS out_links, (SELECT count(*) FROM e WHERE target_path = n.path) AS in_links FROM notes n",
    "vault_stats_top_linked": _EDGES + " SELECT target_path, count(DISTINCT source_path) AS sources FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "unlinked_mentions": f"WITH {NOTES}, p AS (SELECT path, regexp_replace(lower(content), '\\[\\[[^\\]]*\\]\\]', ' ', 'g') AS t FROM notes WHERE NOT ends_with(path, '/iron.md')) SELECT path, CAST((len(t) - len(replace(t, 'iron', ''))) / 4 AS INT) AS mentions FROM p WHERE contains(t, 'iron')",
    "vault_search": f"""WITH {NOTES}, v AS (SELECT path, lower(regexp_extract(path, '([^/]+?)(?:\\.md)?$', 1)) AS name, '' AS front, lower(regexp_replace(content, '^---\\n[\\s\\S]*?\\n---\\n+', '')) AS body FROM notes),
w AS (SELECT path, len(list_intersect(['note_12', 'links'], regexp_split_to_array(name, '[\\s_-]+'))) AS a, len(list_intersect(['note_12', 'links'], regexp_split_to_array(body, '\\s+'))) AS b, contains(name, 'note_12 links') AS c, contains(front, 'note_12 links') AS d, contains(body, 'note_12 links') AS e FROM v)
SELECT path, round(least(1.0, greatest(CASE WHEN c THEN 0.8 END, CASE WHEN a > 0 THEN 0.6 + 0.1 * a END, CASE WHEN d THEN 0.7 END, CASE WHEN e THEN 0.5 END, CASE WHEN b > 0 THEN 0.3 + 0.2 * b END)), 6)::DOUBLE AS score,
  CASE WHEN c THEN 'name' WHEN a > 0 THEN 'name' WHEN d THEN 'frontmatter' WHEN e THEN 'content' WHEN b > 0 THEN 'content' END AS match_type FROM w WHERE c OR a > 0 OR d OR e OR b > 0 ORDER BY score DESC, path LIMIT 20""",
}
