"""Queries of runs, synchronisation, searches beside the main ones, graphs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import knowledge, pipeline, reports, search
from marginalia.operators.references import ref_key
from marginalia.plans.knowledge import _E
from marginalia.plans.notes import NOTES, notes
from marginalia.session import table
from marginalia.sources import files as sources

_ROW = ["id", "file_id", "section_header", "keywords"]


def _sections(spark, d, *more):
    return table(spark, d, "file_sections").select(*_ROW, *more).distinct()


def _essences(spark, d):
    """Sections as summaries: their keywords dealt out to the list fields by their place, and relationships from each keyword to the next."""
    s = table(spark, d, "file_sections").select("id", "parent_section_id", "section_header", "content_preview", X.keyword_array(F.col("keywords")).alias("keys")).distinct()
    part = lambda n: F.filter("keys", lambda k, i: F.pmod(i, F.lit(6)) == n)
    pairs = F.transform(F.slice("keys", 1, F.greatest(F.size("keys") - 1, F.lit(0))), lambda k, i: F.struct(k.alias("from"), F.get("keys", i + 1).alias("to"), F.lit("next").alias("type")))
    return s.select("id", "parent_section_id", F.col("section_header").alias("title"), F.struct(F.col("content_preview").alias("summary"), *[part(n).alias(f) for n, f in enumerate(reports.LISTS)], pairs.alias("relationships")).alias("a"))


def _pairs(spark, d):
    e = _essences(spark, d)
    return e.join(e.select(F.col("id").alias("parent_section_id"), F.col("a").alias("b")), "parent_section_id")


def essence_compare(spark, d):
    """Every list and relationship of a section against its parent's."""
    c = reports.compare_summaries(_pairs(spark, d))
    return c.select("id", "parent_section_id", "unchanged", "complements", "conflicts", "can_merge", F.size("diffs").alias("fields"), F.md5(reports.diff_text(F.col("unchanged"), F.col("complements"), F.col("conflicts"), F.col("can_merge"))).alias("text_hash"))


def essence_combine(spark, d):
    m = reports.merge_summaries(_pairs(spark, d))
    return m.select("id", "parent_section_id", F.length("merged.summary").alias("summary_length"), *[F.array_join(f"merged.{f}", "|").alias(f) for f in ("key_points", "keywords", "relationships")])


def sections_like(spark, d):
    """Substring search in the order of the header, with scores by place."""
    s = table(spark, d, "file_sections").select("id", "section_header", "content_full").groupBy("id").agg(F.max("section_header").alias("section_header"), F.max("content_full").alias("content_full"))
    return search.LikeProvider(s, "id", F.col("section_header"), F.col("content_full")).search("iron a", 50).select("id", F.round("score", 6).alias("score"))


def sections_by_level(spark, d):
    s = table(spark, d, "file_sections").where(F.contains(F.lower("content_full"), F.lit("iron"))).select("id", "section_level", "section_header").distinct()
    return search.by_level(s, F.lit(True), "section_level", "id", 40)


def sections_with_file(spark, d):
    s = table(spark, d, "file_sections").select("id", ref_key(F.col("file_id")).alias("key")).distinct()
    f = table(spark, d, "files").select(ref_key(F.col("id")).alias("id"), "file_path")
    return search.with_file(s, f, "key", "id").select("id", "source_path")


def in_places(spark, d):
    s = table(spark, d, "file_sections").select("id", "section_level", "file_path").distinct()
    tags = F.array(F.concat(F.lit("Wing:"), F.split("file_path", "/")[0]), F.concat(F.lit("room:"), F.col("section_level").cast("string")))
    return search.in_places(s.where("file_path IS NOT NULL AND section_level IS NOT NULL"), tags, wing="vault", room="2").select("id")


def date_range(spark, d):
    start, end = knowledge.date_range("2024-05-01..2024-05-15")
    return knowledge.in_period(table(spark, d, "documents"), "created_at", start, end).select("doc_id", "created_at")


def topic_lookup(spark, d):
    s = _sections(spark, d)
    return knowledge.by_topic(s, "id", "Iron", F.col("section_header"), X.keyword_array(F.col("keywords")), F.array("file_id"), 100)


def job_errors(spark, d):
    j = table(spark, d, "embedding_jobs").select("job_id", "section_id", "error", "processed_at").distinct()
    return pipeline.recent_errors(j.where("section_id IS NOT NULL"), "section_id", "error", "processed_at").select("section_id", "errors", "last_error", "last_at")


def batch_rates(spark, d):
    w = table(spark, d, "watched_files").select("scan_id", "path", "status").distinct()
    return pipeline.rates(w, ["scan_id"], F.col("status") == "processed")


def sync_dry_run(spark, d):
    s = table(spark, d, "file_sections").where(F.length("content_full") > 10).select(ref_key(F.col("id")).alias("key"), F.substring(F.md5("content_full"), 1, 16).alias("mark"))
    e = table(spark, d, "embedding_records").select(ref_key(F.col("section_id")).alias("key"), F.col("embedding_hash").alias("mark"))
    return pipeline.sync_plan(s, e)


def _store(spark, d):
    """Sections as they are embedded, and a table of vectors: those of the sections below files, some of an old text, and some of sections that are gone."""
    s = table(spark, d, "file_sections").select("id", "file_id", F.col("section_header").alias("header"), F.col("content_full").alias("content"), X.keyword_array(F.col("keywords")).alias("keywords"), "section_level")
    old = s.where("section_level <= 3").withColumn("content", F.when(F.col("section_level") == 3, F.concat(F.lit("old "), "content")).otherwise(F.col("content")))
    vectors = pipeline.embedding_run(old, spark.createDataFrame([], "id string, file_id string, mark string, embedding array<float>, failed boolean"), pipeline.offline_model(16), 16, "reload")
    gone = vectors.where("length(id) > 0").select(F.concat(F.lit("gone-"), "id").alias("id"), "file_id", "mark", "embedding", "failed")
    return s, vectors.unionByName(gone)


def embedding_runs(spark, d):
    """The table after a synchronisation: every section has one vector of its present text, and nothing else is there."""
    s, v = _store(spark, d)
    out = pipeline.sync(s, v, pipeline.offline_model(16), 16, "delta")
    return out.select("id", "mark", F.size("embedding").alias("dimension"), "failed")


def embedding_sync_stats(spark, d):
    s, v = _store(spark, d)
    return pipeline.sync(s, v, pipeline.offline_model(16), 16, "stats")


def vector_hashes(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", X.vector_hash(F.col("embedding")).alias("vector_hash"))
    return v.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), X.essence_hash(F.col("file_path"), F.col("doc_type")).alias("essence_hash")), "vec_id")


def page_embedding_text(spark, d):
    s = _sections(spark, d, "content_preview")
    return s.select("id", X.page_embedding_text(F.col("section_header"), F.col("content_preview"), X.keyword_array(F.col("keywords"))).alias("text"))


def index_rebuilt(spark, d):
    """The section index after notes were changed, removed and added: as if all were indexed anew."""
    now = notes(spark, d).select("path", "content")
    before = now.where(F.pmod(F.xxhash64("path"), F.lit(5)) != 0).withColumn("content", F.when(F.pmod(F.xxhash64("path"), F.lit(3)) == 0, F.concat("content", F.lit("\n# Old\n"))).otherwise(F.col("content")))
    before = before.unionByName(spark.createDataFrame([("k0/gone.md", "# Gone\nx\n")], "path string, content string"))
    index = pipeline.index_notes(before)
    out, _ = pipeline.reindex(index, before.select("path", F.md5("content").alias("hash")), now)
    return out.select("path", "section_no", "header", "line_start", "line_end", "file_hash")


def postings_sync(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    p = search.postings(docs.where("doc_id % 10 <> 0"), "doc_id", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return pipeline.postings_status(docs, p, "doc_id", X.token_count(F.coalesce("text", F.lit(""))))


def ghost_scan(spark, d):
    f = table(spark, d, "files")
    known = table(spark, d, "watched_files").select(F.col("path"))
    listing = f.select(F.col("file_path").alias("path"), F.col("file_size").alias("size"))
    return sources.ghost_scan(listing, known.where("path LIKE 'vault/%'"), [".md", ".pdf"], ("archiv",), 1000, 500_000)


def note_exports(spark, d):
    entries = table(spark, d, "files").where("file_name IS NOT NULL").select(F.col("file_name").alias("title"), F.col("file_path").alias("content"))
    vault = table(spark, d, "watched_files").select(F.element_at(F.split("path", "/"), -1).alias("title"))
    return sources.note_exports(entries, vault, "title", "content")


def graph_full_nodes(spark, d):
    e = _essences(spark, d)
    return knowledge.knowledge_graph(e, "id", F.col("title"), F.col("a.entities"), F.col("a.relationships"))[0]


def graph_full_edges(spark, d):
    e = _essences(spark, d)
    return knowledge.knowledge_graph(e, "id", F.col("title"), F.col("a.entities"), F.col("a.relationships"))[1]


def graph_hotspots(spark, d):
    s = _sections(spark, d)
    keys = X.keyword_array(F.col("keywords"))
    top = knowledge.hotspots(s, "id", {"keyword": keys}, most=30)
    nodes = s.select(F.explode(keys).alias("label")).distinct()
    return knowledge.hotspot_nodes(nodes, top, F.col("label")).where("hotspot_count IS NOT NULL")


def report_list(spark, d):
    """Reports among notes made of the documents, newest first."""
    text = F.concat(F.lit("---\ntitle: Report "), "doc_id", F.lit("\nreport_type: "), F.element_at(F.array(F.lit("daily"), F.lit("weekly"), F.lit("monthly")), F.pmod("doc_id", F.lit(3)).cast("int") + 1),
                    F.when(F.col("created_at").isNotNull(), F.concat(F.lit("\ngenerated_at: "), F.date_format("created_at", "yyyy-MM-dd"))).otherwise(""), F.lit("\nsources:\n- a\n- b\n---\n\nbody"))
    rows = table(spark, d, "documents").select(F.concat(F.lit("r"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "_report.md").otherwise(".md")).alias("path"), text.alias("content"))
    return reports.report_files(rows, "weekly", 30)


def report_stats(spark, d):
    return reports.statistics(table(spark, d, "documents").select("doc_type", "created_at"), "doc_type", "created_at")


def reports_newest(spark, d):
    return reports.newest(table(spark, d, "documents").where("doc_type = 'report'").select("doc_id", "created_at"), "created_at", "doc_id", 25)


def report_weeks(spark, d):
    days = knowledge.per_period(table(spark, d, "documents"), "created_at", "day")
    return reports.roll_up(days, "weekly", "period")


def report_prompts(spark, d):
    docs = table(spark, d, "documents").select("created_at", "file_path", "text")
    return reports.prompts(docs, "monthly", "created_at", "file_path", "text", 5, 40)


def source_texts(spark, d):
    """The documents of each source put together up to a number of bytes."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", "text")
    return reports.concat_sources(docs, "source", "doc_id", "text", 5000).select("source", F.md5("text").alias("text_hash"), "truncated")


def gc_lists(spark, d):
    """What is archived and what is removed, as rows."""
    docs = table(spark, d, "documents").select("doc_id", "created_at")
    last = docs.agg(F.max("created_at").alias("last"))  # one row
    act = F.when(F.col("created_at") < F.col("last") - F.expr("INTERVAL 365 DAYS"), "remove").when(F.col("created_at") < F.col("last") - F.expr("INTERVAL 90 DAYS"), "archive")
    return docs.join(F.broadcast(last)).select("doc_id", act.alias("action")).where("action IS NOT NULL")


def embeddable_next(spark, d):
    """The hundred most important sections that lack a vector of their present text, those indexed first before others."""
    mark = F.substring(F.md5("content_full"), 1, 16).alias("mark")
    s = table(spark, d, "file_sections").where(F.length("content_full") > 10).select("id", "importance_score", "created_at", mark).distinct()
    e = table(spark, d, "embedding_records").select(ref_key(F.col("section_id")).alias("key"), F.col("embedding_hash").alias("mark"))
    need = s.withColumn("key", ref_key(F.col("id"))).join(e, ["key", "mark"], "left_anti")
    return need.select("id", F.round(X.importance(F.col("importance_score")), 6).alias("importance"), "created_at").orderBy(F.desc("importance"), F.col("created_at").asc_nulls_first(), "id").limit(100)


def due_jobs(spark, d):
    minutes = table(spark, d, "events").select(F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("m")).distinct()
    return pipeline.due(minutes, "m", {"watch": "*/20 * * * *", "daily": "0-30 8 * * *"})


QUERIES = {f.__name__: f for f in (
    essence_compare, essence_combine, sections_like, sections_by_level, sections_with_file, in_places, date_range, topic_lookup, job_errors, batch_rates, sync_dry_run, embedding_runs, embedding_sync_stats,
    vector_hashes, page_embedding_text, index_rebuilt, postings_sync, ghost_scan, note_exports, graph_full_nodes, graph_full_edges, graph_hotspots, report_list, report_stats, reports_newest,
    report_weeks, report_prompts, source_texts, gc_lists, embeddable_next, due_jobs,
)}


def _k(c: str) -> str:
    return f"nullif(regexp_replace(lower({c}), '[\\s\\-]+', '', 'g'), '')"


_PART = "list_filter(keys, lambda k, i: (i - 1) % 6 = {})"
_ESS = f"{_E}, x AS (SELECT DISTINCT id, parent_section_id, section_header, content_preview AS summary, keys, " + ", ".join(f"{_PART.format(n)} AS l{n}" for n in range(6)) + ", list_transform(range(1, len(keys)), lambda i: keys[i] || '→next→' || keys[i + 1]) AS l6 FROM e)"
_LOW = "list_transform({}, lambda v: lower(trim(v)))"
_SETS = ", ".join(f"{_LOW.format(f'p.l{n}')} AS a{n}, {_LOW.format(f'q.l{n}')} AS b{n}" for n in range(7))
_COMMON = " + ".join(f"len(list_distinct(list_filter(a{n}, lambda v: list_contains(b{n}, v))))" for n in range(7))
_APART = " + ".join(f"len(list_distinct(list_filter(a{n}, lambda v: NOT list_contains(b{n}, v)))) + len(list_distinct(list_filter(b{n}, lambda v: NOT list_contains(a{n}, v))))" for n in range(7))
_FIELDS = " + ".join(f"(len(list_filter(a{n}, lambda v: NOT list_contains(b{n}, v))) + len(list_filter(b{n}, lambda v: NOT list_contains(a{n}, v))) > 0)::INT" for n in range(7))


def _union(n: int) -> str:
    return f"coalesce(array_to_string(list_transform(list_filter(list_zip(l{n}, range(len(l{n}))), lambda z: list_position(list_transform(l{n}, lambda v: lower(trim(v))), lower(trim(z[1]))) = z[2] + 1), lambda z: z[1]), '|'), '')"


_TEXT = "concat_ws(' | ', nullif(section_header, ''), nullif(section_header, ''), CASE WHEN {c} <> '' THEN trim(left({c}, 500)) END, nullif(array_to_string(keys[1:10], ' '), ''))"
_KEYS = """CASE WHEN keywords IS NULL OR trim(keywords) = '' THEN [] WHEN ltrim(keywords) LIKE '[%' THEN list_filter(list_transform(CAST(try_cast(keywords AS JSON) AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '')
  ELSE list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)), lambda x: x <> '') END"""
_FULL = f"s AS (SELECT DISTINCT id, section_header, content_full, section_level, {_KEYS} AS keys FROM file_sections WHERE len(content_full) > 10)"

SQL = {
    "essence_compare": f"""WITH {_ESS}, z AS (SELECT p.id, p.parent_section_id, coalesce(p.summary, '') AS sx, coalesce(q.summary, '') AS sy, {_SETS} FROM x p JOIN x q ON p.parent_section_id = q.id),
c AS (SELECT id, parent_section_id, ((sx = sy)::INT + {_COMMON})::INT AS unchanged, (((sx = '') <> (sy = ''))::INT + {_APART})::INT AS complements, (sx <> sy AND sx <> '' AND sy <> '')::INT AS conflicts, ((sx <> sy)::INT + {_FIELDS})::INT AS fields FROM z)
SELECT *, conflicts = 0 AND complements > 0 AS can_merge, md5('Diff Summary: ' || unchanged || ' unchanged, ' || complements || ' complementary, ' || conflicts || ' conflicting' || chr(10) || '  Can merge: ' || (conflicts = 0 AND complements > 0) || chr(10) || '  Conflicts: ' || conflicts || chr(10) || '  Complementary: ' || complements || chr(10) || '  Unchanged: ' || unchanged) AS text_hash FROM c""",
    "essence_combine": f"""WITH {_ESS}, m AS (SELECT p.id, p.parent_section_id, CASE WHEN p.summary IS NULL OR len(q.summary) > 1.2 * len(p.summary) THEN coalesce(q.summary, p.summary) ELSE p.summary END AS s, list_concat(p.l0, q.l0) AS l0, list_concat(p.l5, q.l5) AS l5, list_concat(p.l6, q.l6) AS l6 FROM x p JOIN x q ON p.parent_section_id = q.id)
SELECT id, parent_section_id, len(s)::INT AS summary_length, {_union(0)} AS key_points, {_union(5)} AS keywords, {_union(6)} AS relationships FROM m""",
    "sections_like": """WITH s AS (SELECT id, max(section_header) AS h, max(content_full) AS c FROM file_sections GROUP BY 1), t AS (SELECT id, h FROM s WHERE (contains(lower(coalesce(h, '')), 'iron') OR contains(lower(coalesce(c, '')), 'iron')) AND (contains(lower(coalesce(h, '')), 'a') OR contains(lower(coalesce(c, '')), 'a')) ORDER BY h NULLS FIRST, id LIMIT 50)
SELECT id, round((count(*) OVER () - row_number() OVER (ORDER BY h NULLS FIRST, id) + 1)::DOUBLE / count(*) OVER (), 6) AS score FROM t""",
    "sections_by_level": "SELECT DISTINCT id, section_level, section_header FROM (SELECT DISTINCT id, section_level, section_header FROM file_sections WHERE contains(lower(content_full), 'iron') ORDER BY coalesce(section_level, 0) DESC, id LIMIT 40)",
    "sections_with_file": f"WITH s AS (SELECT DISTINCT id, {_k('file_id')} AS k FROM file_sections), f AS (SELECT {_k('id')} AS k, max(file_path) AS p FROM files GROUP BY 1) SELECT id, coalesce(p, '') AS source_path FROM s LEFT JOIN f USING (k)",
    "in_places": "SELECT DISTINCT id FROM file_sections WHERE lower(string_split(file_path, '/')[1]) = 'vault' AND section_level = 2",
    "date_range": "SELECT doc_id, created_at FROM documents WHERE created_at >= TIMESTAMP '2024-05-01' AND created_at < TIMESTAMP '2024-05-16'",
    "topic_lookup": f"WITH {_E}, k AS (SELECT id, CASE WHEN contains(lower(section_header), 'iron') THEN 1 WHEN list_contains(list_transform(keys, lambda v: lower(v)), 'iron') THEN 2 END AS k FROM e) SELECT id, CASE min(k) WHEN 1 THEN 'title' ELSE 'keyword' END AS match_type FROM k WHERE k IS NOT NULL GROUP BY id ORDER BY min(k), id LIMIT 100",
    "job_errors": "WITH j AS (SELECT DISTINCT job_id, section_id, error, processed_at FROM embedding_jobs WHERE error IS NOT NULL AND section_id IS NOT NULL) SELECT section_id, count(*)::BIGINT AS errors, first(error ORDER BY processed_at DESC NULLS LAST, error DESC) AS last_error, max(processed_at) AS last_at FROM j GROUP BY 1",
    "batch_rates": "WITH w AS (SELECT DISTINCT scan_id, path, status FROM watched_files) SELECT scan_id, count(*) AS total, count(*) FILTER (status = 'processed') AS success, count(*) FILTER (coalesce(status, '') <> 'processed') AS failed, round(100.0 * count(*) FILTER (status = 'processed') / count(*), 4) AS rate FROM w GROUP BY 1",
    "sync_dry_run": f"""WITH s AS (SELECT {_k('id')} AS key, max(left(md5(content_full), 16)) AS m FROM file_sections WHERE len(content_full) > 10 GROUP BY 1), e AS (SELECT {_k('section_id')} AS key, max(embedding_hash) AS m FROM embedding_records WHERE {_k('section_id')} IS NOT NULL GROUP BY 1)
SELECT key, CASE WHEN e.key IS NULL THEN 'embed' WHEN s.key IS NULL THEN 'delete' WHEN s.m IS NOT DISTINCT FROM e.m THEN 'keep' ELSE 'update' END AS action FROM s FULL JOIN e USING (key) WHERE key IS NOT NULL""",
    "embedding_runs": f"WITH {_FULL} SELECT id, left(md5({_TEXT.format(c='content_full')}), 16) AS mark, 16 AS dimension, false AS failed FROM s",
    "embedding_sync_stats": f"""WITH {_FULL}, n AS (SELECT id, left(md5({_TEXT.format(c='content_full')}), 16) AS m FROM s), o AS (SELECT DISTINCT id, section_header, section_level, keys, CASE WHEN section_level = 3 THEN 'old ' || content_full ELSE content_full END AS c FROM (SELECT DISTINCT id, section_header, content_full, section_level, {_KEYS} AS keys FROM file_sections) WHERE section_level <= 3 AND len(CASE WHEN section_level = 3 THEN 'old ' || content_full ELSE content_full END) > 10),
v AS (SELECT id, left(md5({_TEXT.format(c='c')}), 16) AS m FROM o UNION ALL SELECT 'gone-' || id, left(md5({_TEXT.format(c='c')}), 16) FROM o)
SELECT CASE WHEN v.id IS NULL THEN 'embed' WHEN n.id IS NULL THEN 'delete' WHEN n.m = v.m THEN 'keep' ELSE 'update' END AS action, count(*) AS n FROM n FULL JOIN v ON n.id = v.id GROUP BY 1""",
    "vector_hashes": "SELECT vec_id, CASE WHEN len(embedding) > 0 THEN sha256(array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ',')) END AS vector_hash, left(sha256(coalesce(file_path, '') || coalesce(doc_type, '')), 16) AS essence_hash FROM embeddings JOIN documents ON vec_id = doc_id",
    "page_embedding_text": f"WITH s AS (SELECT DISTINCT id, file_id, section_header, keywords, content_preview FROM file_sections), k AS (SELECT *, {_KEYS} AS keys FROM s) SELECT id, concat_ws(' | ', section_header, content_preview, 'Keywords: ' || left(coalesce(array_to_string(keys, ', '), ''), 100)) AS text FROM k",
    "index_rebuilt": f"""WITH {NOTES}, l AS (SELECT path, md5(content) AS file_hash, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM notes), u AS (SELECT path, file_hash, len(x) AS n, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS no FROM l),
h AS (SELECT *, row_number() OVER w AS k, lead(no) OVER w AS next FROM u WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S') WINDOW w AS (PARTITION BY path ORDER BY no))
SELECT path, k AS section_no, trim(regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1)) AS header, no AS line_start, coalesce(next - 1, n) AS line_end, file_hash FROM h""",
    "postings_sync": "WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')) AS n, text IS NULL AS no FROM documents) SELECT CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN CASE WHEN n = 0 THEN 'orphan' ELSE 'stale' END ELSE 'in_sync' END AS status, count(*) AS n FROM t WHERE n > 0 OR (doc_id % 10 = 1 AND NOT no) GROUP BY 1",
    "ghost_scan": "SELECT DISTINCT file_path AS path, file_size AS size FROM files WHERE '.' || lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) IN ('.md', '.pdf') AND file_size BETWEEN 1000 AND 500000 AND NOT contains('/' || file_path, '/archiv/') AND file_path NOT IN (SELECT path FROM watched_files WHERE path LIKE 'vault/%')",
    "note_exports": """WITH n AS (SELECT left(regexp_replace(trim(regexp_replace(trim(file_name), '[/\\\\:*?"<>|#]', '_', 'g')), '\\s+', '_', 'g'), 200) AS name, file_name, file_path FROM files WHERE file_name IS NOT NULL),
v AS (SELECT lower(left(regexp_replace(trim(regexp_replace(trim(string_split(path, '/')[-1]), '[/\\\\:*?"<>|#]', '_', 'g')), '\\s+', '_', 'g'), 200)) AS k FROM watched_files WHERE path IS NOT NULL),
m AS (SELECT lower(name) AS k, arg_max(struct_pack(a := file_name, b := file_path, c := name), file_name || chr(1) || file_path) AS r FROM n WHERE lower(name) NOT IN (SELECT k FROM v) GROUP BY 1)
SELECT r.c || '.md' AS path, '---' || chr(10) || 'title: "' || r.a || '"' || chr(10) || '---' || chr(10) || chr(10) || r.b AS content FROM m""",
    "graph_full_nodes": f"WITH {_ESS} SELECT id, 'essence' AS kind, coalesce(max(section_header), id) AS label FROM x GROUP BY id UNION ALL SELECT DISTINCT 'entity:' || v, 'entity', v FROM (SELECT unnest(l4) AS v FROM x)",
    "graph_full_edges": f"""WITH {_ESS}, r AS (SELECT id, unnest(range(1, len(keys))) AS i, keys FROM x)
SELECT DISTINCT 'entity:' || keys[i] AS source, 'entity:' || keys[i + 1] AS target, 'next' AS relation, id AS essence FROM r UNION SELECT id, 'entity:' || unnest(l4), 'mentions', id FROM x""",
    "graph_hotspots": f"WITH {_E}, k AS (SELECT DISTINCT id, lower(trim(t)) AS topic FROM (SELECT id, unnest(keys) AS t FROM e)), h AS (SELECT topic, count(*) AS n FROM k WHERE topic <> '' GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, topic LIMIT 30) SELECT DISTINCT label, n AS hotspot_count FROM (SELECT unnest(keys) AS label FROM e) JOIN h ON lower(label) = topic",
    "report_list": """SELECT 'r' || doc_id || '_report.md' AS path, 'Report ' || doc_id AS title, 'weekly' AS report_type, strftime(created_at, '%Y-%m-%d') AS generated_at, '' AS query, 2 AS sources FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 1 ORDER BY 4 DESC NULLS LAST, 1 LIMIT 30""",
    "report_stats": "SELECT doc_type, count(*) AS reports, max(created_at) AS last FROM documents GROUP BY 1",
    "reports_newest": "SELECT doc_id, created_at FROM documents WHERE doc_type = 'report' ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 25",
    "report_weeks": "WITH d AS (SELECT created_at::DATE AS d, count(*) AS n FROM documents WHERE created_at IS NOT NULL GROUP BY 1) SELECT strftime(d, '%G-W%V') AS period, count(*) AS days, sum(n)::BIGINT AS n, max(n) AS busiest FROM d GROUP BY 1",
    "report_prompts": """WITH t AS (SELECT strftime(created_at, '%Y-%m') AS period, created_at, file_path, left(text, 40) AS s FROM documents WHERE created_at IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY created_at DESC, file_path NULLS FIRST, s NULLS FIRST) AS i FROM t)
SELECT period, 'Write a monthly report on what follows. Name topics, connections and open questions.' || chr(10) || chr(10) || 'Period: ' || period || chr(10) || string_agg('- ' || coalesce(file_path, 'Untitled') || ': ' || coalesce(s, ''), chr(10) ORDER BY i) AS prompt FROM r WHERE i <= 5 GROUP BY 1""",
    "gc_lists": "WITH l AS (SELECT max(created_at) AS m FROM documents) SELECT doc_id, CASE WHEN created_at < m - INTERVAL 365 DAYS THEN 'remove' ELSE 'archive' END AS action FROM documents, l WHERE created_at < m - INTERVAL 90 DAYS",
    "embeddable_next": f"""SELECT id, round(CASE WHEN importance_score IS NULL OR importance_score = 0 THEN 0.5 ELSE importance_score END, 6) AS importance, created_at FROM (SELECT DISTINCT id, importance_score, created_at, left(md5(content_full), 16) AS mark FROM file_sections WHERE len(content_full) > 10) s
WHERE NOT EXISTS (SELECT 1 FROM embedding_records e WHERE {_k('e.section_id')} = {_k('s.id')} AND embedding_hash = s.mark) ORDER BY importance DESC, created_at NULLS FIRST, id LIMIT 100""",
    "due_jobs": "WITH m AS (SELECT DISTINCT date_trunc('minute', ts) AS m FROM events) SELECT m AS minute, 'watch' AS job FROM m WHERE minute(m) % 20 = 0 UNION ALL SELECT m, 'daily' FROM m WHERE hour(m) = 8 AND minute(m) <= 30",
}
