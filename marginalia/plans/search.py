"""Search queries over documents, sections and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.text import FOLD_FROM, FOLD_TO
from marginalia.operators import search
from marginalia.operators.skew import distinct_rows
from marginalia.session import table

QUERY = "iron sleep"
TERMS = QUERY.split()


def _docs(spark, d):
    return table(spark, d, "documents", spread=True)


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def keyword_bm25(spark, d):
    hits = search.with_position_score(search.bm25(_docs(spark, d), "doc_id", F.col("text"), QUERY))
    return hits.select("doc_id", "row_num", F.round("rank", 6).alias("rank"), F.round("score", 6).alias("score"))


def keyword_provider_score(spark, d):
    hits = search.Bm25Provider(_docs(spark, d), "doc_id", F.col("text")).search(QUERY)
    return hits.select("doc_id", "row_num", F.round("score", 6).alias("score"))


def sections_bm25(spark, d):
    s = distinct_rows(table(spark, d, "file_sections").select("id", "section_header", "content_full"), "id")
    hits = search.bm25(s, "id", F.concat_ws(" ", "section_header", "content_full"), "zinc check")
    return hits.select("id", "row_num", F.round("rank", 6).alias("rank"))


def keyword_like(spark, d):
    hits = search.like(_docs(spark, d), "doc_id", F.col("file_path"), F.col("text"), "Iron liver")
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def keyword_like_provider(spark, d):
    hits = search.like(_docs(spark, d), "doc_id", F.col("file_path"), F.col("text"), "a iron", least=1)
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def postings_stats(spark, d):
    p = search.postings(_docs(spark, d), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


def vector_topk(spark, d):
    hits = search.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d))
    return hits.select("vec_id", F.round("score", 5).alias("score"))


def vector_topk_l2(spark, d):
    hits = search.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), metric="l2")
    return hits.select("vec_id", F.round("score", 5).alias("score"))


def _legs(spark, d, docs):
    vectors = table(spark, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("doc_id"), "embedding")
    semantic = search.VectorProvider(vectors, "doc_id", "embedding", lambda q: _query_vector(spark, d))
    return semantic, search.Bm25Provider(docs, "doc_id", F.col("text"))


def hybrid_fused(spark, d):
    docs = _docs(spark, d)
    semantic, keyword = _legs(spark, d, docs)
    out = search.hybrid(QUERY, docs, "doc_id", semantic, keyword)
    return out.select("doc_id", F.round("combined", 5).alias("combined"), "origin")


def hybrid_filtered(spark, d):
    docs = search.filter_records(_docs(spark, d), "file_path", ["md"], "2024-03-01", "2025-06-30", "created_at", "text", ["the"])
    semantic, keyword = _legs(spark, d, docs)
    out = search.hybrid(QUERY, docs, "doc_id", semantic, keyword, limit=50)
    return out.select("doc_id", F.round("combined", 5).alias("combined"), "origin")


def semantic_only(spark, d):
    docs = _docs(spark, d)
    return search.hybrid(QUERY, docs, "doc_id", _legs(spark, d, docs)[0], None).select("doc_id", F.round("combined", 5).alias("combined"), "origin")


def rerank_lexical(spark, d):
    return search.lexical_rerank(_docs(spark, d), "doc_id", "text", "iron sleep liver", 20)


def refinements(spark, d):
    s = distinct_rows(table(spark, d, "file_sections").select("id", "section_header", "content_full", "keywords"), "id")
    hits = search.like(s, "id", F.col("section_header"), F.col("content_full"), "iron", limit=5)
    return search.refinements(s.join(F.broadcast(hits), "id"), "id", X.keyword_array(F.col("keywords")), "iron")


def filters_dates_types(spark, d):
    f = search.filter_records(table(spark, d, "files").distinct(), "file_path", ["md", ".PDF"], "2024-06-01", "2025-01-31 12:00:00", "last_modified")
    return f.select("id", "file_path")


def safe_query(spark, d):
    q = table(spark, d, "search_results").select("search_id", "query").distinct()
    return q.select("search_id", "query", X.is_safe_query(F.col("query")).alias("safe"))


def search_stats(spark, d):
    s = table(spark, d, "file_sections").agg(F.countDistinct("id").alias("sections"), F.countDistinct("file_id").alias("files"), F.round(F.avg(X.importance(F.col("importance_score"))), 6).alias("mean_importance"))
    return s.join(table(spark, d, "embedding_records").agg(F.countDistinct("section_id").alias("embedded")))  # one row each


def display_lines(spark, d):
    s = table(spark, d, "file_sections")
    return s.select("id", X.location(F.col("file_path"), F.col("line_start")).alias("location"), X.shown(F.col("content_full")).alias("line")).distinct()


QUERIES = {f.__name__: f for f in (
    keyword_bm25, keyword_provider_score, sections_bm25, keyword_like, keyword_like_provider, postings_stats, vector_topk, vector_topk_l2, hybrid_fused, hybrid_filtered,
    semantic_only, rerank_lexical, refinements, filters_dates_types, safe_query, search_stats, display_lines,
)}


def _bm25(source: str, key: str, text: str, terms: list[str]) -> str:
    f = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len_ / avg_))" for i in range(len(terms)))
    hit = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""x AS (SELECT {key}, regexp_extract_all(translate(lower(coalesce({text}, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
y AS (SELECT {key}, len(t) AS len_, {f} FROM x), z AS (SELECT count(*) AS n, avg(len_) AS avg_, {n} FROM y),
hits AS (SELECT {key}, -({score}) AS rank FROM y, z WHERE {hit} ORDER BY 2, 1 LIMIT 100),
kw AS (SELECT *, row_number() OVER (ORDER BY rank, {key}) AS row_num, count(*) OVER () AS total FROM hits)"""


def _score(base: int) -> str:
    p = f"((total - (row_num - 1 + {base})) / total)"
    return f"CASE WHEN rank < -0.001 THEN 0.7 * {p} + 0.3 * least(1.0, greatest(0.0, 0.5 + abs(rank) / 20)) ELSE {p} END"


_VEC = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _hybrid(docs: str, limit: int, keyword: bool = True) -> str:
    kw = f"{_bm25('docs', 'doc_id', 'text', TERMS)}, k AS (SELECT doc_id, {_score(0)} AS score FROM kw)" if keyword else "k AS (SELECT doc_id, 0.0::DOUBLE AS score FROM docs WHERE false)"
    return f"""WITH docs AS ({docs}), {_VEC}, {kw},
s AS (SELECT vec_id AS doc_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], q)), 9) AS score FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM docs) ORDER BY 2 DESC, 1 LIMIT 100),
f AS (SELECT doc_id, s.score AS a, k.score AS b, max(s.score) OVER () AS ma, max(k.score) OVER () AS mb FROM s FULL JOIN k USING (doc_id)),
c AS (SELECT doc_id, round(0.6 * coalesce(a / nullif(ma, 0), 0) + 0.4 * coalesce(b / nullif(mb, 0), 0), 6) AS combined, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'hybrid' WHEN a IS NOT NULL THEN 'chroma' ELSE 'sqlite' END AS origin FROM f)
SELECT doc_id, round(combined, 5) AS combined, origin FROM c WHERE combined >= 0.05 ORDER BY c.combined DESC, doc_id LIMIT {limit}"""


def _like(least: int, query: str) -> str:
    terms = [t for t in query.lower().split() if len(t) >= least]
    has = " AND ".join(f"(coalesce(contains(lower(file_path), '{t}'), false) OR coalesce(contains(lower(text), '{t}'), false))" for t in terms)
    return f"SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE {has} ORDER BY doc_id LIMIT 100"


SQL = {
    "keyword_bm25": f"WITH {_bm25('documents', 'doc_id', 'text', TERMS)} SELECT doc_id, row_num::INT AS row_num, round(rank, 6) AS rank, round({_score(1)}, 6) AS score FROM kw",
    "keyword_provider_score": f"WITH {_bm25('documents', 'doc_id', 'text', TERMS)} SELECT doc_id, row_num::INT AS row_num, round({_score(0)}, 6) AS score FROM kw",
    "sections_bm25": "WITH s AS (SELECT DISTINCT * FROM file_sections), " + _bm25("s", "id", "concat_ws(' ', section_header, content_full)", ["zinc", "check"]) + " SELECT id, row_num::INT AS row_num, round(rank, 6) AS rank FROM kw",
    "keyword_like": _like(2, "Iron liver"),
    "keyword_like_provider": _like(1, "a iron"),
    "postings_stats": f"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY 1, 2) SELECT term, count(*) AS docs, sum(tf)::BIGINT AS total, max(tf) AS most FROM p GROUP BY 1",
    "vector_topk": f"WITH {_VEC}, s AS (SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], q)), 9) AS s FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 100) SELECT vec_id, round(s, 5) AS score FROM s",
    "vector_topk_l2": f"WITH {_VEC}, s AS (SELECT vec_id, round(greatest(0, 1 - list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) ** 2))), 9) AS s FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 100) SELECT vec_id, round(s, 5) AS score FROM s",
    "hybrid_fused": _hybrid("SELECT * FROM documents", 20),
    "hybrid_filtered": _hybrid("SELECT * FROM documents WHERE lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) = 'md' AND (created_at IS NULL OR created_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2025-06-30') AND contains(lower(text), 'the')", 50),
    "semantic_only": _hybrid("SELECT * FROM documents", 20, False),
    "rerank_lexical": """WITH t AS (SELECT doc_id, list_filter(['iron', 'sleep', 'liver'], lambda w: contains(lower(text), w)) AS f FROM documents)
SELECT doc_id, CASE WHEN f IS NULL THEN NULL ELSE round(len(f) / 3.0, 6)::DOUBLE END AS rerank_score, array_to_string(f[1:5], ', ') AS reason FROM t ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20""",
    "refinements": """WITH s AS (SELECT DISTINCT id, section_header, content_full, CASE WHEN keywords IS NULL OR trim(keywords) = '' THEN [] WHEN ltrim(keywords) LIKE '[%' THEN list_filter(list_transform(CAST(try_cast(keywords AS JSON) AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> '')
  ELSE list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)), lambda x: x <> '') END AS keys FROM file_sections),
h AS (SELECT id, keys FROM s WHERE contains(lower(section_header), 'iron') OR contains(lower(content_full), 'iron') ORDER BY id LIMIT 5), t AS (SELECT keys, row_number() OVER (ORDER BY id) AS n FROM h ORDER BY id LIMIT 3),
k AS (SELECT n, unnest(range(len(keys))) AS i, lower(unnest(keys)) AS k FROM t), m AS (SELECT k, min(n * 1000 + i) AS o FROM k WHERE k <> 'iron' GROUP BY 1 ORDER BY o LIMIT 5)
SELECT k AS suggestion, row_number() OVER (ORDER BY o)::INT AS position FROM m""",
    "filters_dates_types": "SELECT DISTINCT id, file_path FROM files WHERE lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) IN ('md', 'pdf') AND (last_modified IS NULL OR last_modified BETWEEN TIMESTAMP '2024-06-01' AND TIMESTAMP '2025-01-31 12:00:00')",
    "safe_query": "SELECT DISTINCT search_id, query, coalesce(query <> '' AND len(query) <= 1000 AND NOT (" + " OR ".join(f"contains(lower(query), '{m}')" for m in X.UNSAFE) + "), false) AS safe FROM search_results",
    "display_lines": """WITH s AS (SELECT DISTINCT id, file_path, line_start, regexp_replace(replace(coalesce(content_full, ''), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT DISTINCT * FROM file_sections))
SELECT id, string_split(file_path, '/')[-1] || CASE WHEN line_start > 0 THEN ':' || line_start ELSE '' END AS location, CASE WHEN len(t) > 80 THEN left(t, 77) || '...' ELSE t END AS line FROM s""",
    "search_stats": "SELECT sections, files, mean_importance, embedded FROM (SELECT count(DISTINCT id) AS sections, count(DISTINCT file_id) AS files, round(avg(CASE WHEN importance_score IS NULL OR importance_score = 0 THEN 0.5 ELSE importance_score END), 6) AS mean_importance FROM file_sections), (SELECT count(DISTINCT section_id) AS embedded FROM embedding_records)",
}
