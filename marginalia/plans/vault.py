"""Queries over whole notes: YAML frontmatter, full parse, link editing, mentions, titles, answers of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import chunks, frontmatter, keywords, links, markdown
from marginalia.plans.notes import _RES, NOTES, _resolved, notes
from marginalia.session import table

# A note with nested frontmatter; every tenth one is malformed, every eleventh has none.
_YAML = """
CASE WHEN doc_id % 11 = 0 THEN '# Plain ' || doc_id || {nl}
ELSE '---' || {nl} || 'title: "Note: ' || doc_id || '"' || {nl} || 'tags:' || {nl} || '  - ' || coalesce(nullif(lower(trim(lang)), ''), 'xx') || {nl} || '  - KB # a comment' || {nl}
|| 'meta:' || {nl} || '  number: ' || doc_id || {nl} || '  done: ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || {nl} || '  list: [a, "b, c", ' || (doc_id % 3) || ']' || {nl}
|| 'date: 2024-1-' || (doc_id % 28 + 1) || {nl} || CASE WHEN doc_id % 10 = 0 THEN 'broken: [open' || {nl} ELSE '' END || '---' || {nl} || {nl} END
|| 'See [[A]] and ![[p.png]] #Topic' || (doc_id % 5) || {nl} || '## Über uns & mehr' || {nl} || 'end' AS content"""


def yaml_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", _YAML.format(nl="'\\n'").strip())


YAML = "y AS (SELECT doc_id, lang, " + _YAML.format(nl="chr(10)") + " FROM documents)"


def frontmatter_yaml(spark, d):
    f = frontmatter.read_front(yaml_notes(spark, d), "doc_id", "content")
    get = lambda p: frontmatter.field(F.col("front"), p)
    return f.select(
        "doc_id", get("title").alias("title"), F.array_join(frontmatter.items(F.col("front"), "tags"), "|").alias("tags"), get("meta.number").cast("bigint").alias("number"), get("meta.done").alias("done"),
        F.array_join(frontmatter.items(F.col("front"), "meta.list"), "|").alias("list"), get("date").alias("date"), F.col("error").isNotNull().alias("failed"), F.length("body").alias("body_length"),
    )


def note_parse(spark, d):
    p = frontmatter.parse_notes(yaml_notes(spark, d), "doc_id", "content")
    return p.select("doc_id", "title", F.size("links").alias("links"), F.get("links", F.lit(1))["start"].alias("second_start"), F.array_join("tags", "|").alias("tags"), F.array_join("embeds", "|").alias("embeds"),
                    F.get("headings", F.size("headings") - 1)["slug"].alias("slug"), F.col("error").isNotNull().alias("failed"))


def link_positions(spark, d):
    return markdown.link_positions(notes(spark, d), "path", "content")


def link_counts(spark, d):
    return notes(spark, d).select("path", markdown.count_links(F.col("content"), "Missing 3").alias("n")).where("n > 0")


def link_add(spark, d):
    """Links to a note that some texts name already, with heading and alias too."""
    text = markdown.add_link(F.col("content"), "Missing 3", "See also")
    return notes(spark, d).select("path", F.md5(text).alias("text_hash"), (text != F.col("content")).alias("changed"))


def link_remove(spark, d):
    text = markdown.remove_links(F.col("content"), "Missing 3")
    return notes(spark, d).select("path", F.md5(text).alias("text_hash"), (text != F.col("content")).alias("changed"))


def note_move(spark, d):
    moved = markdown.move_note(notes(spark, d), "k1/note_1.md", "k1/first.md")
    return moved.select("path", F.md5("content").alias("text_hash"), "links_changed")


def text_append(spark, d):
    c = F.col("content")
    return notes(spark, d).select("path", F.md5(markdown.append_text(c, "the end")).alias("at_end"), F.md5(markdown.append_text(c, "the start", False)).alias("at_start"))


def note_slugs(spark, d):
    h = markdown.headings(yaml_notes(spark, d), "doc_id", "content")
    return h.select("doc_id", "heading_no", "slug", X.note_slug(F.col("text")).alias("note_slug"))


def title_map(spark, d):
    """Texts below second-level headings by their titles, as rows."""
    return notes(spark, d).select("path", F.explode(markdown.title_sections(F.col("content"))).alias("title", "text")).select("path", "title", F.md5("text").alias("text_hash"))


def mention_contexts(spark, d):
    return links.mention_contexts(notes(spark, d), "iron", 20)


#: Names that the notes are searched for, of one word and of two.
NAMES = ["iron", "Sleep", "liver", "zinc", "the other", "iron in"]


def mentions_all(spark, d):
    return links.all_mentions(notes(spark, d), spark.createDataFrame([(n,) for n in NAMES], "name string"))


def backlinks_of(spark, d):
    n, r = _resolved(spark, d)
    return links.backlinks_of(r, n, "NOTE_3.md")


def vault_stats(spark, d):
    n, r = _resolved(spark, d)
    return links.vault_stats(n, r)


#: Synonyms with terms of several words.
TERMS = {"iron": ["ferrum", "Fe"], "deep sleep": ["slow wave", "N3"], "liver": ["hepar"], "data  set": ["corpus"]}


def synonym_phrases(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.element_at(F.array(F.lit("deep sleep"), F.lit("iron Deep  Sleep liver"), F.lit("deep iron"), F.lit("the data set")), F.pmod("doc_id", F.lit(4)).cast("int") + 1), F.col("doc_id").cast("string")).alias("q"))
    return keywords.Synonyms(TERMS).expand(q, "q").select("doc_id", "expanded")


def chunk_offsets(spark, d):
    return chunks.chunk_offsets(table(spark, d, "documents", spread=True), "doc_id", "text", 300, 0)


def model_answers(spark, d):
    """Answers with and without a fence, with braces in strings, cut off, and with fields that are missing or wrong."""
    head = "concat('Here: ', CASE WHEN doc_id % 2 = 0 THEN '```json\\n' ELSE '' END, '{\"title\": \"N{', doc_id, '\", \"keywords\": ', CASE WHEN doc_id % 3 = 0 THEN '[\"a\", \"b\"]' ELSE 'null' END"
    tail = ", CASE WHEN doc_id % 5 = 0 THEN '' ELSE '}' END, CASE WHEN doc_id % 2 = 0 THEN '\\n```' ELSE ' and {more}' END) AS raw"
    rows = table(spark, d, "documents").selectExpr("doc_id", head + tail)
    defaults = {"title": F.lit("Untitled"), "keywords": F.array().cast("array<string>"), "confidence": F.lit(0.5)}
    return rows.select("doc_id", X.answer_fields(F.col("raw"), "title string, keywords array<string>, confidence double", defaults).alias("a")).select("doc_id", "a.title", F.array_join("a.keywords", "|").alias("keywords"), "a.confidence")


def safe_paths(spark, d):
    p = table(spark, d, "files").select("file_path", F.explode(F.array(F.lit(""), F.lit("../"), F.lit("/"), F.lit("C:\\"))).alias("before"))
    return p.select(F.concat("before", "file_path").alias("path")).distinct().select("path", X.safe_path(F.col("path")).alias("safe"), X.safe_file_name(F.col("path")).alias("name"))


QUERIES = {f.__name__: f for f in (
    frontmatter_yaml, note_parse, link_positions, link_counts, link_add, link_remove, note_move, text_append, note_slugs, title_map, mention_contexts, mentions_all, backlinks_of, vault_stats,
    synonym_phrases, chunk_offsets, model_answers, safe_paths,
)}

_M3 = r"\[\[Missing 3(#[^\]\|]+)?(\|[^\]]+)?\]\]"
_TAG = "coalesce(nullif(lower(trim(lang)), ''), 'xx')"
_OK = "doc_id % 11 <> 0 AND doc_id % 10 <> 0"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

SQL = {
    "frontmatter_yaml": f"""WITH {YAML} SELECT doc_id, CASE WHEN {_OK} THEN 'Note: ' || doc_id END AS title, CASE WHEN {_OK} THEN {_TAG} || '|KB' ELSE '' END AS tags, CASE WHEN {_OK} THEN doc_id END AS number,
 CASE WHEN {_OK} THEN CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END END AS done, CASE WHEN {_OK} THEN 'a|b, c|' || (doc_id % 3) ELSE '' END AS list, CASE WHEN {_OK} THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS date,
 doc_id % 11 <> 0 AND doc_id % 10 = 0 AS failed, (CASE WHEN doc_id % 11 = 0 THEN len('# Plain ' || doc_id) + 1 ELSE 0 END + len('See [[A]] and ![[p.png]] #Topic0') + 1 + len('## Über uns & mehr') + 4)::INT AS body_length FROM y""",
    "note_parse": f"""WITH {YAML} SELECT doc_id, CASE WHEN {_OK} THEN 'Note: ' || doc_id WHEN doc_id % 11 = 0 THEN 'Plain ' || doc_id ELSE 'Über uns & mehr' END AS title, 2 AS links,
 (CASE WHEN doc_id % 11 = 0 THEN len('# Plain ' || doc_id) + 1 ELSE 0 END + 14)::INT AS second_start, CASE WHEN {_OK} THEN {_TAG} || '|kb|' ELSE '' END || 'topic' || (doc_id % 5) AS tags, 'p.png' AS embeds, 'ber-uns-mehr' AS slug,
 doc_id % 11 <> 0 AND doc_id % 10 = 0 AS failed FROM y""",
    "link_positions": f"""WITH {NOTES}, m AS (SELECT path, regexp_extract_all(content, '!?\\[\\[[^\\]\\|#]+(?:#[^\\]\\|]+)?(?:\\|[^\\]]+)?\\]\\]') AS f, regexp_split_to_array(content, '!?\\[\\[[^\\]\\|#]+(?:#[^\\]\\|]+)?(?:\\|[^\\]]+)?\\]\\]') AS b FROM notes),
i AS (SELECT path, f, b, unnest(range(1, len(f) + 1)) AS k FROM m),
s AS (SELECT path, k, f[k] AS l, (list_sum(list_transform(b[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: len(x))), 0))::INT AS st FROM i)
SELECT path, k AS link_no, trim(regexp_extract(l, '\\[\\[([^\\]\\|#]+)', 1)) AS target, st AS start_at, (st + len(l))::INT AS end_at FROM s""",
    "link_counts": f"WITH {NOTES}, c AS (SELECT path, len(regexp_extract_all(content, '{_M3}')) AS n FROM notes) SELECT * FROM c WHERE n > 0",
    "link_add": f"WITH {NOTES}, c AS (SELECT path, content, CASE WHEN regexp_matches(content, '{_M3}') THEN content ELSE regexp_replace(content, '\\n+$', '') || chr(10) || chr(10) || 'See also [[Missing 3]]' END AS t FROM notes) SELECT path, md5(t) AS text_hash, t <> content AS changed FROM c",
    "link_remove": f"WITH {NOTES}, c AS (SELECT path, content, CASE WHEN regexp_matches(content, '{_M3}') THEN regexp_replace(regexp_replace(content, '{_M3}', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') ELSE content END AS t FROM notes) SELECT path, md5(t) AS text_hash, t <> content AS changed FROM c",
    "note_move": f"""WITH {NOTES}, g AS (SELECT count(*) FILTER (path = 'k1/note_1.md') > 0 AND count(*) FILTER (path = 'k1/first.md') = 0 AS go FROM notes)
SELECT CASE WHEN go AND path = 'k1/note_1.md' THEN 'k1/first.md' ELSE path END AS path, md5(CASE WHEN go THEN regexp_replace(content, '\\[\\[note_1((?:#[^\\]\\|]+)?(?:\\|[^\\]]+)?)\\]\\]', '[[first\\1]]', 'g') ELSE content END) AS text_hash,
 CASE WHEN go THEN len(regexp_extract_all(content, '\\[\\[note_1(#[^\\]\\|]+)?(\\|[^\\]]+)?\\]\\]')) ELSE 0 END::INT AS links_changed FROM notes, g""",
    "text_append": f"""WITH {NOTES}, f AS (SELECT path, content, regexp_extract(content, '^(---\\n[\\s\\S]*?\\n---\\n+)', 1) AS front FROM notes)
SELECT path, md5(regexp_replace(content, '\\n+$', '') || chr(10) || chr(10) || 'the end' || chr(10)) AS at_end, md5(front || 'the start' || chr(10) || chr(10) || substring(content, len(front) + 1)) AS at_start FROM f""",
    "note_slugs": f"""WITH {YAML}, h AS (SELECT doc_id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^#+\\s*[^#\\s]')) AS l FROM y), u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS heading_no, trim(regexp_replace(unnest(l), '^#+', '')) AS t FROM h)
SELECT doc_id, heading_no, CASE WHEN t LIKE 'Plain%' THEN 'plain-' || doc_id ELSE 'ber-uns-mehr' END AS slug, CASE WHEN t LIKE 'Plain%' THEN 'plain-' || doc_id ELSE 'über-uns--mehr' END AS note_slug FROM u""",
    "title_map": f"""WITH {NOTES}, p AS (SELECT path, regexp_split_to_array(chr(10) || replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n##[ \\t]+') AS l FROM notes),
u AS (SELECT path, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM p), v AS (SELECT path, i, CASE WHEN i = 1 THEN '_header' ELSE {_STRIP.format("regexp_extract(t, '^([^\\n]*)', 1)")} END AS title, {_STRIP.format("CASE WHEN i = 1 THEN t ELSE regexp_replace(t, '^[^\\n]*', '') END")} AS text FROM u)
SELECT path, title, md5(max_by(text, i)) AS text_hash FROM v GROUP BY 1, 2""",
    "mention_contexts": f"""WITH {NOTES}, b AS (SELECT path, content, regexp_split_to_array(content, '\\[\\[[^\\]]*\\]\\]') AS b, regexp_extract_all(content, '\\[\\[[^\\]]*\\]\\]') AS l FROM notes WHERE contains(lower(content), 'iron')),
t AS (SELECT path, content, lower(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || repeat(chr(1), coalesce(len(l[i]), 0))), '')) AS t FROM b),
s AS (SELECT path, content, string_split(t, 'iron') AS p FROM t), i AS (SELECT path, content, p, unnest(range(1, len(p))) AS k FROM s),
a AS (SELECT path, content, k, (list_sum(list_transform(p[1:k], lambda x: len(x))) + 4 * (k - 1))::BIGINT AS st FROM i)
SELECT path, k AS mention_no, trim(regexp_replace(substring(content, greatest(st - 20, 0) + 1, least(st + 24, len(content)) - greatest(st - 20, 0)), '\\s+', ' ', 'g')) AS context FROM a""",
    "mentions_all": f"""WITH {NOTES}, w AS (SELECT path, regexp_extract_all(lower(regexp_replace(content, '\\[\\[[^\\]]*\\]\\]', ' ' || chr(1) || ' ', 'g')), '[\\p{{L}}\\p{{N}}_]+|\\x01') AS w FROM notes),
r AS (SELECT path, unnest(w) AS k FROM w UNION ALL SELECT path, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w), n AS (SELECT unnest([{', '.join(repr(x) for x in NAMES)}]) AS name)
SELECT path, name, count(*) AS mentions FROM r JOIN n ON k = lower(name) GROUP BY 1, 2""",
    "backlinks_of": _RES + " SELECT DISTINCT target_path, source_path, coalesce(alias, target) AS link_text FROM rl WHERE ends_with(target_path, '/note_3.md')",
    "vault_stats": _RES + " SELECT (SELECT count(*) FROM notes) AS notes, count(*) AS links, count(target_path) AS resolved, count(*) - count(target_path) AS broken, count(DISTINCT target_path) AS linked_notes FROM rl",
    "synonym_phrases": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'deep sleep ' || doc_id || ' slow wave N3' WHEN 1 THEN 'iron ferrum Fe deep sleep liver hepar ' || doc_id || ' slow wave N3' WHEN 2 THEN 'deep iron ferrum Fe ' || doc_id ELSE 'the data set ' || doc_id || ' corpus' END AS expanded FROM documents""",
    "chunk_offsets": """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text <> ''),
f AS (SELECT doc_id, list_reduce(list_prepend('', l), lambda acc, p: CASE WHEN acc = '' THEN CASE WHEN len(p) > 300 THEN array_to_string(list_transform(range(0, len(p), 300), lambda i: substring(p, i + 1, 300)), chr(3)) || chr(1) ELSE p END
  WHEN acc[-1:] = chr(1) THEN acc || CASE WHEN len(p) > 300 THEN array_to_string(list_transform(range(0, len(p), 300), lambda i: substring(p, i + 1, 300)), chr(3)) || chr(1) ELSE p END
  WHEN len(regexp_split_to_array(acc, chr(1))[-1]) + len(p) > 300 THEN acc || chr(1) || CASE WHEN len(p) > 300 THEN array_to_string(list_transform(range(0, len(p), 300), lambda i: substring(p, i + 1, 300)), chr(3)) || chr(1) ELSE p END ELSE acc || ' ' || p END) AS j FROM s WHERE len(l) > 0),
g AS (SELECT doc_id, regexp_split_to_array(regexp_replace(j, chr(1) || '$', ''), '[' || chr(1) || chr(3) || ']') AS c, regexp_extract_all(regexp_replace(j, chr(1) || '$', ''), '[' || chr(1) || chr(3) || ']') AS m FROM f),
i AS (SELECT doc_id, c, m, unnest(range(len(c))) AS k FROM g)
SELECT doc_id, k::INT AS chunk_index, (coalesce(list_sum(list_transform(c[1:k], lambda x: len(x))), 0) + len(list_filter(m[1:k], lambda x: x = chr(1))))::INT AS start_at, (coalesce(list_sum(list_transform(c[1:k + 1], lambda x: len(x))), 0) + len(list_filter(m[1:k], lambda x: x = chr(1))))::INT AS end_at FROM i""",
    "model_answers": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Untitled' ELSE 'N{' || doc_id END AS title, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'a|b' ELSE '' END AS keywords, 0.5::DOUBLE AS confidence FROM documents""",
    "safe_paths": """WITH p AS (SELECT DISTINCT b || file_path AS path FROM files, (SELECT unnest(['', '../', '/', 'C:\\']) AS b)),
n AS (SELECT path, regexp_replace(path, '[^a-zA-Z0-9._-]', '_', 'g') AS n FROM p)
SELECT path, coalesce(path <> '' AND NOT regexp_matches(path, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches(path, '^(?:[/\\\\~]|[A-Za-z]:)') AND NOT list_contains(string_split(replace(path, '\\', '/'), '/'), '..'), false) AS safe,
 CASE WHEN coalesce(path, '') = '' THEN 'unnamed' WHEN len(n) > 255 THEN left(regexp_replace(n, '\\.[^.]*$', ''), 250) || regexp_extract(n, '(\\.[^.]*)$', 1) ELSE n END AS name FROM n""",
}
