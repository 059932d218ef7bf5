"""Queries of the general corpus problems: incremental processing (p1) and dangling references (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import incremental, references
from marginalia.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.replay(table(spark, d, "watched_files")).select("scan_id", "path")


def p1_scan_plan(spark: SparkSession, d: str) -> DataFrame:
    found = incremental.replay(table(spark, d, "watched_files"))
    return found.groupBy("scan_id", "reason").agg(F.count("*").alias("paths"))


def p1_pending(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``p1_found`` with their reason, decided for all scans in one pass over the log."""
    return incremental.pending_observations(table(spark, d, "watched_files")).select("scan_id", "path", "reason")


def _state(spark: SparkSession, d: str) -> references.OrphanState:
    parents = {
        "file_sections": (table(spark, d, "file_sections"), "id", "created_at"),
        "files": (table(spark, d, "files"), "id", "first_indexed_at"),
    }
    columns = {"file_sections": "section_id", "files": "file_id"}
    return references.followed(table(spark, d, "embedding_records"), columns, parents, table(spark, d, "removal_log"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).waiting().select("id", "ref_table", "period", "reason").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).snapshot()


_P1 = r"""
w AS (SELECT DISTINCT path, scan_id, nullif(regexp_replace(lower(trim(file_hash)), '^[a-z][a-z0-9_/.\-]*\s*:\s*', ''), '') AS h,
  CASE WHEN regexp_full_match(trim(modified_at), '[+-]?\d+(\.\d*)?') THEN CAST(CAST(trim(modified_at) AS DECIMAL(28,6)) * 1000000 AS BIGINT)
       WHEN regexp_matches(trim(modified_at), '(Z|:\d\d(\.\d+)?[+-]\d\d:\d\d)$') THEN epoch_us(try_cast(trim(modified_at) AS TIMESTAMPTZ))
       ELSE epoch_us(try_cast(trim(modified_at) || 'Z' AS TIMESTAMPTZ)) END AS t, status
  FROM watched_files WHERE path IS NOT NULL AND scan_id IS NOT NULL),
m AS (SELECT path, scan_id, h, t, row_number() OVER (PARTITION BY path, scan_id ORDER BY t DESC NULLS LAST, h DESC NULLS LAST) AS n FROM w WHERE status = 'processed'),
p AS (SELECT path, scan_id, h, t, coalesce(lead(scan_id) OVER (PARTITION BY path ORDER BY scan_id), 9000000000000000000) AS till FROM m WHERE n = 1),
f AS (SELECT w.scan_id, w.path, max(CASE WHEN p.path IS NULL THEN 'new' ELSE 'changed' END) AS reason
  FROM w LEFT JOIN p ON w.path = p.path AND w.scan_id > p.scan_id AND w.scan_id <= p.till
  WHERE p.path IS NULL OR (w.h <> p.h) OR ((w.h IS NULL OR p.h IS NULL) AND w.t > p.t) GROUP BY 1, 2)"""

_P3 = r"""
r AS (SELECT DISTINCT id, ref_table, key, period, seen FROM (
  SELECT id, 'file_sections' AS ref_table, regexp_replace(lower(section_id), '[\s\-]+', '', 'g') AS key, coalesce(strftime(created_at, '%Y-%m'), 'unknown') AS period, created_at AS seen FROM embedding_records
  UNION ALL SELECT id, 'files', regexp_replace(lower(file_id), '[\s\-]+', '', 'g'), coalesce(strftime(created_at, '%Y-%m'), 'unknown'), created_at FROM embedding_records)
  WHERE key <> ''),
q AS (SELECT ref_table, key, min(born) AS born, count(*) - count(born) AS undated FROM (
  SELECT 'file_sections' AS ref_table, regexp_replace(lower(id), '[\s\-]+', '', 'g') AS key, created_at AS born FROM file_sections
  UNION ALL SELECT 'files', regexp_replace(lower(id), '[\s\-]+', '', 'g'), first_indexed_at FROM files) GROUP BY 1, 2),
g AS (SELECT DISTINCT lower(trim(ref_table)) AS ref_table, regexp_replace(lower(ref_id), '[\s\-]+', '', 'g') AS key FROM removal_log),
o AS (SELECT DISTINCT r.id, r.ref_table, r.period, CASE WHEN q.key IS NULL AND g.key IS NOT NULL THEN 'deleted' WHEN q.key IS NULL THEN 'missing' ELSE 'late' END AS reason
  FROM r LEFT JOIN q USING (ref_table, key) LEFT JOIN g USING (ref_table, key) WHERE q.key IS NULL OR (undated = 0 AND q.born > r.seen))"""

QUERIES = {"p1_found": p1_found, "p1_scan_plan": p1_scan_plan, "p1_pending": p1_pending, "p3_found": p3_found, "p3_report": p3_report}
SQL = {
    "p1_found": f"WITH {_P1} SELECT scan_id, path FROM f",
    "p1_scan_plan": f"WITH {_P1} SELECT scan_id, reason, count(*) AS paths FROM f GROUP BY 1, 2",
    "p1_pending": f"WITH {_P1} SELECT scan_id, path, reason FROM f",
    "p3_found": f"WITH {_P3} SELECT id, ref_table, period, reason FROM o",
    "p3_report": f"WITH {_P3} SELECT ref_table, period, reason, count(*) AS refs FROM o GROUP BY 1, 2, 3",
}
