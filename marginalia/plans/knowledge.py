"""Queries over derived knowledge: hotspots, graph, periods, diff and merge, cron, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import knowledge
from marginalia.operators.skew import distinct_rows
from marginalia.session import table
from marginalia.streaming import windows


def _essences(spark, d, *more):
    """Sections as essences: keywords as they are, the header as entity, and what else is asked for; repeated rows count once, by their id and these columns."""
    s = table(spark, d, "file_sections").select("id", "section_header", "keywords", *more).distinct()
    return s.select("id", "section_header", *more, X.keyword_array(F.col("keywords")).alias("keys"),
                    F.when(F.col("section_header").isNotNull(), F.array("section_header")).otherwise(F.array().cast("array<string>")).alias("entities"))


def hotspots(spark, d):
    return knowledge.hotspots(_essences(spark, d), "id", {"keyword": F.col("keys"), "entity": F.col("entities")})


def hotspots_mentions(spark, d):
    return knowledge.hotspots(_essences(spark, d), "id", {"keyword": F.col("keys")}, occurrences=True)


def hotspot_score(spark, d):
    """How many files name each hotspot."""
    e = _essences(spark, d, "file_id")
    top = knowledge.hotspots(e, "id", {"keyword": F.col("keys")})
    named = e.select("file_id", F.explode("keys").alias("k")).select("file_id", F.lower(F.trim("k")).alias("topic")).distinct()
    return named.join(F.broadcast(top.select("topic")), "topic").groupBy("topic").agg(F.count("file_id").alias("files"))  # at most 20 topics


def kg_nodes(spark, d):
    return knowledge.graph_nodes(_essences(spark, d), "id", F.col("entities"), F.col("keys"))


def kg_edges(spark, d):
    return knowledge.mention_edges(_essences(spark, d), "id", F.col("keys"))


def essences_per_day(spark, d):
    return knowledge.per_period(table(spark, d, "documents"), "created_at", "day")


def essences_per_week(spark, d):
    return knowledge.per_period(table(spark, d, "documents"), "created_at", "week")


def report_rollup(spark, d):
    """Months from days, so that a month's report needs the daily counts only."""
    days = essences_per_day(spark, d)
    return days.groupBy(F.substring("period", 1, 7).alias("month")).agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.max("n").alias("busiest"))


def period_filter(spark, d):
    return knowledge.in_period(table(spark, d, "documents"), "created_at", "2024-05-01", "2024-06-01").select("doc_id", "created_at")


def essence_gc(spark, d):
    docs = table(spark, d, "documents")
    last = docs.agg(F.max("created_at").alias("last"))
    act = F.when(F.col("created_at") < F.col("last") - F.expr("INTERVAL 365 DAYS"), "remove").when(F.col("created_at") < F.col("last") - F.expr("INTERVAL 90 DAYS"), "archive").otherwise("keep")
    return docs.join(F.broadcast(last)).groupBy(act.alias("action")).agg(F.count("*").alias("n"))  # one row


def _pairs(spark, d):
    e = _essences(spark, d, "parent_section_id", "content_preview")
    p = e.select(F.col("id").alias("parent_section_id"), F.col("keys").alias("parent_keys"), F.col("content_preview").alias("parent_text"))
    return e.join(p, "parent_section_id")


def essence_diff(spark, d):
    """Keywords and previews of a section against its parent's: what both have, what one has, and whether they can be merged."""
    common, a, b = knowledge.diff_lists(F.col("keys"), F.col("parent_keys"))
    here, there = F.coalesce("content_preview", F.lit("")), F.coalesce("parent_text", F.lit(""))
    alone = ((here == "") != (there == "")).cast("int")
    out = _pairs(spark, d).select(
        "id", "parent_section_id", (F.size(common) + (here == there).cast("int")).alias("unchanged"), (F.size(a) + F.size(b) + alone).alias("complements"),
        ((here != there) & (here != "") & (there != "")).cast("int").alias("conflicts"), F.array_join(a, "|").alias("only_here"), F.array_join(b, "|").alias("only_parent"),
    )
    return out.withColumn("can_merge", (F.col("conflicts") == 0) & (F.col("complements") > 0))


def essence_merge(spark, d):
    return _pairs(spark, d).select(
        "id", "parent_section_id", F.array_join(knowledge.merge_lists(F.col("keys"), F.col("parent_keys")), "|").alias("keys"),
        knowledge.merge_summary(F.col("content_preview"), F.col("parent_text")).alias("summary"),
    )


def report_line_diff(spark, d):
    a = table(spark, d, "documents").select("doc_id", "text")
    return knowledge.line_diff(a, a.withColumn("text", F.regexp_replace("text", "iron", "steel")), "doc_id", "text")


def report_unified_diff(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.col("text").alias("a"), F.regexp_replace("text", "iron", "steel").alias("b"))
    return knowledge.unified_diff(a, "doc_id", "a", "b").where("diff <> ''")


def report_merge(spark, d):
    """Upper and lower sections of a file merged by title, with their whole texts; same-titled sections of a side are joined in the order of their lines."""
    rows = table(spark, d, "file_sections").where("section_header IS NOT NULL").select("file_id", F.col("section_header").alias("title"), "section_level", "line_start", "id", F.col("content_full").alias("text"))
    e = distinct_rows(rows, "id")
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line_start", "id", "text"))))["text"]
    part = lambda c: e.where(c).groupBy("file_id", "title").agg(F.when(F.count("text") > 0, F.array_join(texts, "\n\n")).alias("text"))
    return knowledge.merge_sections(part("section_level <= 2"), part("section_level > 2"), "file_id")


def cron_matches(spark, d):
    return table(spark, d, "documents").where(knowledge.cron_matches(F.col("created_at"), "*/20,7 8-18 * 1-6,9 0-4")).select("doc_id", "created_at")


def event_windows(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "event_type", "1 day")


def event_windows_sliding(spark, d):
    return windows.sliding(table(spark, d, "events"), "ts", "event_type", "7 days", "1 day")


def event_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")


QUERIES = {f.__name__: f for f in (
    hotspots, hotspots_mentions, hotspot_score, kg_nodes, kg_edges, essences_per_day, essences_per_week, report_rollup, period_filter, essence_gc, essence_diff, essence_merge,
    report_line_diff, report_unified_diff, report_merge, cron_matches, event_windows, event_windows_sliding, event_sessions,
)}

_KEYS = """CASE WHEN keywords IS NULL OR trim(keywords) = '' THEN [] WHEN ltrim(keywords) LIKE '[%' THEN list_filter(list_transform(CAST(try_cast(keywords AS JSON) AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '')
  ELSE list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)), lambda x: x <> '') END"""
_E = f"e AS (SELECT id, file_id, parent_section_id, section_header, content_preview, section_level, {_KEYS} AS keys FROM (SELECT DISTINCT * FROM file_sections))"
_HOT = "k AS (SELECT id, lower(trim(t)) AS topic, 'keyword' AS kind FROM (SELECT id, unnest(keys) AS t FROM e) UNION ALL SELECT id, lower(trim(section_header)), 'entity' FROM e WHERE section_header IS NOT NULL)"
_PAIR = "p AS (SELECT e.*, q.keys AS pk, q.content_preview AS pt FROM e JOIN e q ON e.parent_section_id = q.id)"
_LOW = "list_transform({}, lambda x: lower(trim(x)))"

SQL = {
    "hotspots": f"WITH {_E}, {_HOT} SELECT topic, kind, count(DISTINCT id) AS n FROM k WHERE topic <> '' GROUP BY 1, 2 HAVING n >= 2 ORDER BY n DESC, topic, kind LIMIT 20",
    "hotspots_mentions": f"WITH {_E}, {_HOT} SELECT topic, kind, count(*) AS n FROM k WHERE topic <> '' AND kind = 'keyword' GROUP BY 1, 2 HAVING n >= 2 ORDER BY n DESC, topic, kind LIMIT 20",
    "hotspot_score": f"WITH {_E}, {_HOT}, h AS (SELECT topic, count(DISTINCT id) AS n FROM k WHERE topic <> '' AND kind = 'keyword' GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, topic LIMIT 20) SELECT topic, count(DISTINCT file_id) AS files FROM (SELECT file_id, lower(trim(unnest(keys))) AS topic FROM e) JOIN h USING (topic) GROUP BY 1",
    "kg_nodes": f"WITH {_E} SELECT id, kind, count(*) AS weight FROM (SELECT 'essence:' || id AS id, 'essence' AS kind FROM e UNION ALL SELECT section_header, 'entity' FROM e WHERE section_header IS NOT NULL UNION ALL SELECT 'kw:' || unnest(keys), 'keyword' FROM e) GROUP BY 1, 2",
    "kg_edges": f"WITH {_E} SELECT DISTINCT 'essence:' || id AS source, 'kw:' || k AS target, 'mentions' AS relation FROM (SELECT id, unnest(keys) AS k FROM e)",
    "essences_per_day": "SELECT strftime(created_at, '%Y-%m-%d') AS period, count(*) AS n FROM documents WHERE created_at IS NOT NULL GROUP BY 1",
    "essences_per_week": "SELECT strftime(created_at, '%G-W%V') AS period, count(*) AS n FROM documents WHERE created_at IS NOT NULL GROUP BY 1",
    "report_rollup": "WITH a AS (SELECT strftime(created_at, '%Y-%m-%d') AS p, count(*) AS n FROM documents WHERE created_at IS NOT NULL GROUP BY 1) SELECT left(p, 7) AS month, count(*) AS days, sum(n)::BIGINT AS n, max(n) AS busiest FROM a GROUP BY 1",
    "period_filter": "SELECT doc_id, created_at FROM documents WHERE created_at >= TIMESTAMP '2024-05-01' AND created_at < TIMESTAMP '2024-06-01'",
    "essence_gc": "WITH l AS (SELECT max(created_at) AS m FROM documents) SELECT CASE WHEN created_at < m - INTERVAL 365 DAYS THEN 'remove' WHEN created_at < m - INTERVAL 90 DAYS THEN 'archive' ELSE 'keep' END AS action, count(*) AS n FROM documents, l GROUP BY 1",
    "essence_diff": f"""WITH {_E}, {_PAIR}, q AS (SELECT id, parent_section_id, {_LOW.format('keys')} AS a, {_LOW.format('pk')} AS b, coalesce(content_preview, '') AS here, coalesce(pt, '') AS there FROM p),
r AS (SELECT id, parent_section_id, here, there, len(list_distinct(list_filter(a, lambda x: list_contains(b, x))))::INT AS common, len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) + len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS apart, coalesce(array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), '|'), '') AS only_here,
 coalesce(array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), '|'), '') AS only_parent FROM q)
SELECT id, parent_section_id, common + (here = there)::INT AS unchanged, apart + ((here = '') <> (there = ''))::INT AS complements, (here <> there AND here <> '' AND there <> '')::INT AS conflicts, only_here, only_parent,
 NOT (here <> there AND here <> '' AND there <> '') AND apart + ((here = '') <> (there = ''))::INT > 0 AS can_merge FROM r""",
    "essence_merge": f"""WITH {_E}, {_PAIR}, m AS (SELECT id, parent_section_id, content_preview, pt, list_concat(keys, pk) AS l FROM p)
SELECT id, parent_section_id, coalesce(array_to_string(list_transform(list_filter(list_zip(l, range(len(l))), lambda z: list_position({_LOW.format('l')}, lower(trim(z[1]))) = z[2] + 1), lambda z: z[1]), '|'), '') AS keys,
 CASE WHEN content_preview IS NULL OR len(pt) > 1.2 * len(content_preview) THEN coalesce(pt, content_preview) ELSE content_preview END AS summary FROM m""",
    "report_line_diff": """WITH a AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2),
b AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(text, 'iron', 'steel'), chr(10))) AS line FROM documents) GROUP BY 1, 2),
c AS (SELECT doc_id, line, coalesce(b.n, 0) - coalesce(a.n, 0) AS d FROM a FULL JOIN b USING (doc_id, line)) SELECT doc_id, CASE WHEN d > 0 THEN '+' ELSE '-' END AS side, line, abs(d) AS n FROM c WHERE d <> 0""",
    "report_merge": f"""WITH e AS (SELECT DISTINCT id, file_id, section_header, section_level, line_start, content_full AS t FROM file_sections WHERE section_header IS NOT NULL),
a AS (SELECT file_id, section_header AS title, string_agg(t, chr(10) || chr(10) ORDER BY line_start NULLS FIRST, id) AS x FROM e WHERE section_level <= 2 GROUP BY 1, 2),
b AS (SELECT file_id, section_header AS title, string_agg(t, chr(10) || chr(10) ORDER BY line_start NULLS FIRST, id) AS y FROM e WHERE section_level > 2 GROUP BY 1, 2)
SELECT file_id, title, CASE WHEN x IS NULL THEN y WHEN y IS NULL OR trim(x) = trim(y) THEN x ELSE x || chr(10) || '[supplement]' || chr(10) || y END AS text FROM a FULL JOIN b USING (file_id, title)""",
    "cron_matches": "SELECT doc_id, created_at FROM documents WHERE (minute(created_at) % 20 = 0 OR minute(created_at) = 7) AND hour(created_at) BETWEEN 8 AND 18 AND (month(created_at) <= 6 OR month(created_at) = 9) AND isodow(created_at) <= 5",
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "event_windows_sliding": "SELECT date_trunc('day', ts) - to_days(k::INT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(7) r(k) WHERE ts IS NOT NULL GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
}
