"""Queries that keep stores consistent: deltas, upserts, orphans, audits, job state."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import upkeep
from marginalia.operators.incremental import hash_key
from marginalia.operators.references import ref_key
from marginalia.session import table


def _scans(spark, d, shift):
    """Each scan's paths, named by scan and path; with ``shift`` 1 each scan stands for the one after it. All scans but the first (or, shifted, the last)."""
    w = table(spark, d, "watched_files").where("path IS NOT NULL")
    ends = w.agg(F.min("scan_id").alias("first"), F.max("scan_id").alias("last"))  # one row
    w = w.join(F.broadcast(ends)).where(F.col("scan_id") < F.col("last") if shift else F.col("scan_id") > F.col("first"))
    name = F.concat_ws("/", F.col("scan_id") + shift, "path")
    return w.groupBy(name.alias("path")).agg(F.max(hash_key(F.col("file_hash"))).alias("hash"))


def _sections(spark, d, *columns):
    """Columns of the sections; repeated rows count once, by their id and these columns."""
    return table(spark, d, "file_sections").select("id", *columns).distinct()


def _keys(spark, d):
    s = table(spark, d, "file_sections").select(ref_key(F.col("id")).alias("key"))
    e = table(spark, d, "embedding_records").select(ref_key(F.col("section_id")).alias("key")).where("key IS NOT NULL")
    return s, e


def delta_plan(spark, d):
    return upkeep.delta_plan(_scans(spark, d, 1), _scans(spark, d, 0))


def delta_plan_scoped(spark, d):
    return upkeep.delta_plan(_scans(spark, d, 1), _scans(spark, d, 0), scope="12")


def delta_applied(spark, d):
    old, new = _scans(spark, d, 1), _scans(spark, d, 0)
    return upkeep.apply_delta(old, new, upkeep.delta_plan(old, new))


def delta_twice(spark, d):
    """After a plan was applied, the next one has nothing to do."""
    return upkeep.delta_plan(delta_applied(spark, d), _scans(spark, d, 0)).groupBy("action").agg(F.count("*").alias("n"))


def remove_cascade(spark, d):
    gone = table(spark, d, "removal_log").where("lower(trim(ref_table)) = 'files'").select(ref_key(F.col("ref_id")).alias("key"))
    kept = upkeep.cascade(gone, _sections(spark, d, "file_id").withColumn("key", ref_key(F.col("file_id"))), "key")
    return kept.groupBy("file_id").agg(F.count("*").alias("sections"))


def sync_missing(spark, d):
    return upkeep.missing_and_orphans(*_keys(spark, d), "key").where("side = 'missing'").select("key")


def sync_orphans(spark, d):
    return upkeep.missing_and_orphans(*_keys(spark, d), "key").where("side = 'orphan'").select("key")


def sync_coverage(spark, d):
    s, e = _keys(spark, d)
    both = s.distinct().join(e.distinct().withColumn("there", F.lit(1)), "key", "left")
    return both.agg(F.count("*").alias("sections"), F.count("there").alias("embedded"), F.round(100 * F.count("there") / F.count("*"), 4).alias("percent"))


def orphan_sections(spark, d):
    s = _sections(spark, d, "file_id").withColumn("key", ref_key(F.col("file_id")))
    return upkeep.without_parent(s, table(spark, d, "files").select(ref_key(F.col("id")).alias("key")), "key").select("id", "file_id")


def ghost_files(spark, d):
    w = table(spark, d, "watched_files").select(F.col("path").alias("file_path")).distinct()
    return w.join(table(spark, d, "files").select("file_path"), "file_path", "left_anti").orderBy("file_path")


def fk_cleanup(spark, d):
    e = table(spark, d, "embedding_records").distinct().withColumn("key", ref_key(F.col("section_id")))
    return e.join(table(spark, d, "file_sections").select(ref_key(F.col("id")).alias("key")), "key", "left_semi").groupBy("model").agg(F.count("*").alias("kept"))


def _issues(spark, d):
    files = upkeep.issues(table(spark, d, "files").distinct(), [
        ("empty_path", "error", F.col("file_path").isNull() | (F.trim("file_path") == "")),
        ("no_hash", "error", F.col("file_hash").isNull()),
        ("not_indexed", "warning", F.coalesce(F.lower(F.trim("index_status")), F.lit("")) != "indexed"),
        ("no_size", "info", F.col("file_size").isNull() | (F.col("file_size") == 0)),
    ], "id")
    # the checks are made row by row, so that of a section only what failed is shuffled
    sections = upkeep.issues(table(spark, d, "file_sections"), [
        ("no_content", "error", F.col("content_full").isNull() | (F.trim("content_full") == "")),
        ("bad_lines", "warning", F.col("line_end") < F.col("line_start")),
        ("no_keywords", "info", F.size(X.keyword_array(F.col("keywords"))) == 0),
        ("zero_importance", "info", F.col("importance_score") == 0),
    ], "id").distinct()
    return files.unionByName(sections)


def audit_issues(spark, d):
    return _issues(spark, d)


def audit_counts(spark, d):
    return _issues(spark, d).groupBy("severity", "issue").agg(F.count("*").alias("n"))


def kb_validator(spark, d):
    return upkeep.issues(table(spark, d, "documents").where("doc_type = 'essence'"), [
        ("no_text", "error", F.col("text").isNull() | (F.trim("text") == "")),
        ("no_title", "warning", ~F.coalesce(F.col("text"), F.lit("")).startswith("# ")),
        ("no_source", "warning", F.col("source").isNull()),
        ("no_language", "info", F.col("lang").isNull() | (F.trim("lang") == "")),
    ], "doc_id")


def upsert_latest(spark, d):
    e = table(spark, d, "embedding_records").withColumn("section_id", ref_key(F.col("section_id"))).where("section_id IS NOT NULL")
    out = upkeep.upsert_latest(e.where("model = 'notes-mini-v1'"), e.where("model <> 'notes-mini-v1'"), ["section_id"], [F.col("created_at"), F.col("id")])
    return out.select("section_id", "id", "model", "embedding_hash")


def insert_ignore(spark, d):
    w = table(spark, d, "watched_files").select("path").distinct()
    f = table(spark, d, "files").select(F.col("file_path").alias("path")).distinct()
    return upkeep.insert_ignore(f, w, ["path"])


def upsert_counter(spark, d):
    w = table(spark, d, "watched_files").distinct()
    old = w.where("scan_id <= 20").groupBy("path").agg(F.max("scan_count").cast("bigint").alias("scan_count"))
    return upkeep.upsert_counter(old, w.where("scan_id > 20"), "path")


def conflict_plan(spark, d):
    name = F.lower(F.regexp_extract("file_path", r"([^/]+)\.\w+$", 1))
    kb = table(spark, d, "files").where("file_path IS NOT NULL").select(name.alias("title"), F.col("last_modified").alias("modified"))
    vault = table(spark, d, "documents").select(F.regexp_extract("file_path", r"([^/]+?)-\d+\.\w+$", 1).alias("title"), F.col("created_at").alias("modified"))
    kb = kb.select(F.regexp_replace("title", r"-\d+$", "").alias("title"), "modified")
    return upkeep.conflict_plan(kb, vault, F.lit("2024-06-01").cast("timestamp_ntz"), "kb_wins")


def status_counts(spark, d):
    return table(spark, d, "watched_files").distinct().groupBy("status").agg(F.count("*").alias("n"))


def job_state(spark, d):
    j = table(spark, d, "embedding_jobs").select("job_id", "section_id", "status", "processed_at").distinct()
    return upkeep.job_state(j, "section_id", "status", "processed_at", "job_id")


def latest_observation(spark, d):
    w = table(spark, d, "watched_files").groupBy("path").agg(F.max(F.struct("scan_id", "status")).alias("r"))
    return w.select("path", "r.scan_id", "r.status")


def pending_files(spark, d):
    w = table(spark, d, "watched_files").distinct().where("status IN ('pending', 'error')")
    return w.select("path", "scan_id", "last_scanned_at").orderBy("last_scanned_at", "path", "scan_id").limit(50)


def embeddable(spark, d):
    """Sections that lack an embedding of their present text."""
    mark = F.substring(F.md5("content_full"), 1, 16).alias("mark")
    s = table(spark, d, "file_sections").where(F.length("content_full") > 10).select("id", "importance_score", mark).distinct()
    e = table(spark, d, "embedding_records").select(ref_key(F.col("section_id")).alias("key"), F.col("embedding_hash").alias("mark"))
    need = s.withColumn("key", ref_key(F.col("id"))).join(e, ["key", "mark"], "left_anti")
    return need.select("id", F.round(X.importance(F.col("importance_score")), 6).alias("importance"), "mark")


def embedding_models(spark, d):
    e = table(spark, d, "embedding_records").distinct()
    return e.groupBy("model", "dimension").agg(F.count("*").alias("records"), F.countDistinct("section_id").alias("sections"), F.count_if(F.col("created_at").isNull()).alias("undated"))


QUERIES = {f.__name__: f for f in (
    delta_plan, delta_plan_scoped, delta_applied, delta_twice, remove_cascade, sync_missing, sync_orphans, sync_coverage, orphan_sections, ghost_files, fk_cleanup, audit_issues,
    audit_counts, kb_validator, upsert_latest, insert_ignore, upsert_counter, conflict_plan, status_counts, job_state, latest_observation, pending_files, embeddable, embedding_models,
)}


def _k(c: str) -> str:
    return f"nullif(regexp_replace(lower({c}), '[\\s\\-]+', '', 'g'), '')"


_H = "nullif(regexp_replace(lower(trim(file_hash)), '^[a-z][a-z0-9_/.\\-]*\\s*:\\s*', ''), '')"
_PLAN = f"""WITH a AS (SELECT (scan_id + 1) || '/' || path AS path, max({_H}) AS h FROM watched_files WHERE scan_id < (SELECT max(scan_id) FROM watched_files WHERE path IS NOT NULL) AND path IS NOT NULL GROUP BY 1), b AS (SELECT scan_id || '/' || path AS path, max({_H}) AS h FROM watched_files WHERE scan_id > (SELECT min(scan_id) FROM watched_files WHERE path IS NOT NULL) AND path IS NOT NULL GROUP BY 1),
p AS (SELECT path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'removed' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'same' ELSE 'changed' END AS action FROM a FULL JOIN b USING (path))"""
_ISS = """f AS (SELECT DISTINCT * FROM files), s AS (SELECT DISTINCT * FROM file_sections),
i AS (SELECT 'empty_path' AS issue, 'error' AS severity, id FROM f WHERE file_path IS NULL OR trim(file_path) = '' UNION ALL SELECT 'no_hash', 'error', id FROM f WHERE file_hash IS NULL
 UNION ALL SELECT 'not_indexed', 'warning', id FROM f WHERE coalesce(lower(trim(index_status)), '') <> 'indexed' UNION ALL SELECT 'no_size', 'info', id FROM f WHERE file_size IS NULL OR file_size = 0
 UNION ALL SELECT 'no_content', 'error', id FROM s WHERE content_full IS NULL OR trim(content_full) = '' UNION ALL SELECT 'bad_lines', 'warning', id FROM s WHERE line_end < line_start
 UNION ALL SELECT 'no_keywords', 'info', id FROM s WHERE keywords IS NULL OR trim(keywords) IN ('', '[]') UNION ALL SELECT 'zero_importance', 'info', id FROM s WHERE importance_score = 0)"""

SQL = {
    "delta_plan": _PLAN + " SELECT * FROM p",
    "delta_plan_scoped": _PLAN + " SELECT * FROM p WHERE action <> 'removed' OR string_split(path, '/')[1] = '12'",
    "delta_applied": _PLAN + " SELECT path, h AS hash FROM b",
    "delta_twice": _PLAN + " SELECT 'same' AS action, count(*) AS n FROM b",
    "remove_cascade": f"WITH s AS (SELECT DISTINCT * FROM file_sections) SELECT file_id, count(*) AS sections FROM s WHERE {_k('file_id')} IS NULL OR {_k('file_id')} NOT IN (SELECT {_k('ref_id')} FROM removal_log WHERE lower(trim(ref_table)) = 'files' AND {_k('ref_id')} IS NOT NULL) GROUP BY 1",
    "sync_missing": f"SELECT {_k('id')} AS key FROM file_sections EXCEPT SELECT {_k('section_id')} FROM embedding_records",
    "sync_orphans": f"SELECT {_k('section_id')} AS key FROM embedding_records WHERE {_k('section_id')} IS NOT NULL EXCEPT SELECT {_k('id')} FROM file_sections",
    "sync_coverage": f"WITH s AS (SELECT DISTINCT {_k('id')} AS k FROM file_sections), e AS (SELECT DISTINCT {_k('section_id')} AS k FROM embedding_records) SELECT count(*) AS sections, count(e.k) AS embedded, round(100 * count(e.k) / count(*), 4) AS percent FROM s LEFT JOIN e USING (k)",
    "orphan_sections": f"SELECT id, file_id FROM (SELECT DISTINCT * FROM file_sections) WHERE {_k('file_id')} IS NOT NULL AND {_k('file_id')} NOT IN (SELECT {_k('id')} FROM files WHERE id IS NOT NULL)",
    "ghost_files": "SELECT DISTINCT path AS file_path FROM watched_files WHERE path NOT IN (SELECT file_path FROM files WHERE file_path IS NOT NULL)",
    "fk_cleanup": f"SELECT model, count(*) AS kept FROM (SELECT DISTINCT * FROM embedding_records) WHERE {_k('section_id')} IN (SELECT {_k('id')} FROM file_sections) GROUP BY 1",
    "audit_issues": f"WITH {_ISS} SELECT * FROM i",
    "audit_counts": f"WITH {_ISS} SELECT severity, issue, count(*) AS n FROM i GROUP BY 1, 2",
    "kb_validator": """WITH e AS (SELECT *, doc_id::VARCHAR AS id FROM documents WHERE doc_type = 'essence')
SELECT 'no_text' AS issue, 'error' AS severity, id FROM e WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT 'no_title', 'warning', id FROM e WHERE NOT starts_with(coalesce(text, ''), '# ')
UNION ALL SELECT 'no_source', 'warning', id FROM e WHERE source IS NULL UNION ALL SELECT 'no_language', 'info', id FROM e WHERE lang IS NULL OR trim(lang) = ''""",
    "upsert_latest": f"""WITH e AS (SELECT *, {_k('section_id')} AS k, (model <> 'notes-mini-v1')::INT AS fresh FROM embedding_records WHERE model IS NOT NULL)
SELECT k AS section_id, id, model, embedding_hash FROM e WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY fresh DESC, created_at DESC NULLS LAST, id DESC) = 1""",
    "insert_ignore": "SELECT DISTINCT file_path AS path FROM files UNION ALL (SELECT DISTINCT path FROM watched_files WHERE path NOT IN (SELECT file_path FROM files WHERE file_path IS NOT NULL))",
    "upsert_counter": """WITH w AS (SELECT DISTINCT * FROM watched_files), o AS (SELECT path, max(scan_count) AS c FROM w WHERE scan_id <= 20 GROUP BY 1), n AS (SELECT path, count(*) AS n FROM w WHERE scan_id > 20 GROUP BY 1)
SELECT path, coalesce(c, 0) + coalesce(n, 0) AS scan_count FROM o FULL JOIN n USING (path)""",
    "conflict_plan": """WITH k AS (SELECT regexp_replace(lower(regexp_extract(file_path, '([^/]+)\\.\\w+$', 1)), '-\\d+$', '') AS title, max(last_modified) AS k FROM files WHERE file_path IS NOT NULL GROUP BY 1),
v AS (SELECT lower(regexp_extract(file_path, '([^/]+?)-\\d+\\.\\w+$', 1)) AS title, max(created_at) AS v FROM documents GROUP BY 1)
SELECT title, CASE WHEN k.title IS NULL OR k IS NULL THEN 'insert' WHEN v IS NULL THEN 'kb_to_vault' WHEN k > TIMESTAMP '2024-06-01' AND v > TIMESTAMP '2024-06-01' THEN 'kb_to_vault' ELSE 'vault_to_kb' END AS action,
 left(regexp_replace(trim(regexp_replace(title, '[<>:"/\\\\|?*#]', '_', 'g')), '\\s+', '_', 'g'), 200) AS file_name FROM k FULL JOIN v USING (title) WHERE title IS NOT NULL""",
    "status_counts": "SELECT status, count(*) AS n FROM (SELECT DISTINCT * FROM watched_files) GROUP BY 1",
    "job_state": """WITH j AS (SELECT DISTINCT job_id, section_id, status, processed_at FROM embedding_jobs), l AS (SELECT section_id, status FROM j QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY processed_at DESC NULLS LAST, job_id DESC) = 1)
SELECT j.section_id, count(*) AS runs, count(*) FILTER (j.status IN ('error', 'failed')) AS failed, any_value(l.status) AS last_status FROM j JOIN l ON j.section_id IS NOT DISTINCT FROM l.section_id GROUP BY 1""",
    "latest_observation": "SELECT path, scan_id, status FROM watched_files QUALIFY row_number() OVER (PARTITION BY path ORDER BY scan_id DESC, status DESC NULLS LAST) = 1",
    "pending_files": "SELECT path, scan_id, last_scanned_at FROM (SELECT DISTINCT * FROM watched_files WHERE status IN ('pending', 'error')) ORDER BY last_scanned_at NULLS FIRST, path, scan_id LIMIT 50",
    "embeddable": f"""SELECT id, round(CASE WHEN importance_score IS NULL OR importance_score = 0 THEN 0.5 ELSE importance_score END, 6) AS importance, left(md5(content_full), 16) AS mark FROM (SELECT DISTINCT * FROM file_sections) s
WHERE len(content_full) > 10 AND NOT EXISTS (SELECT 1 FROM embedding_records e WHERE {_k('e.section_id')} = {_k('s.id')} AND embedding_hash = left(md5(s.content_full), 16))""",
    "embedding_models": "SELECT model, dimension, count(*) AS records, count(DISTINCT section_id) AS sections, count(*) FILTER (created_at IS NULL) AS undated FROM (SELECT DISTINCT * FROM embedding_records) GROUP BY 1, 2",
}
