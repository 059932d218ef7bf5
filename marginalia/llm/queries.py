"""Queries of the training-data problems and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import distinctive, leaks, markup, nearcopies, neighbours, packing, pieces, ranking, tokens
from marginalia.operators.skew import distinct_rows
from marginalia.session import table

CAPACITY, LIMIT, OVERLAP = 2048, 512, 64


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.NearCopies(table(spark, d, "file_sections", spread=True)).pairs()


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.NearCopies(table(spark, d, "file_sections", spread=True)).classes().withColumnRenamed("id", "section_id")


#: Sources of search results, and whether their smaller scores are better.
SOURCES = {"chroma": False, "fts5": True, "tfidf": False}


def _ranked(spark: SparkSession, d: str, winners: bool) -> DataFrame:
    items, scores = ranking.combine(table(spark, d, "search_results"), SOURCES)
    return ranking.ranking(items, "search_id", "section_id", scores, winners)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, True).where("unbeaten").select(F.col("list").alias("search_id"), F.col("item").alias("section_id"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, False).select(F.col("list").alias("search_id"), F.col("item").alias("section_id"), F.round("stationary", 9).alias("stationary"), "place")


def p4_rating(spark: SparkSession, d: str) -> DataFrame:
    """Per grade: judged sections and the mean of their place divided by the length of their list."""
    ranked = p4_ranking(spark, d)
    sizes = ranked.groupBy("search_id").agg(F.count("*").alias("n"))
    judged = table(spark, d, "search_judgements").select("search_id", "section_id", "grade").distinct()
    both = ranked.join(sizes, "search_id").join(judged, ["search_id", "section_id"])
    return both.groupBy("grade").agg(F.count("*").alias("sections"), F.avg(F.col("place") / F.col("n")).alias("mean_place"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.rare_keywords(table(spark, d, "file_sections", spread=True)).select(F.col("id").alias("section_id"), "term")


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    found = distinctive.distinctive_terms(table(spark, d, "file_sections", spread=True))
    return found.select(F.col("id").alias("section_id"), "term", "tf", "records", F.round("weight", 6).alias("weight"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = markup.rendered(table(spark, d, "file_sections", spread=True))
    return found.select(F.col("id").alias("section_id"), F.explode("kinds").alias("markup")).distinct()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    found = markup.rendered(distinct_rows(table(spark, d, "file_sections", spread=True).select("id", "content_full"), "id"))
    return found.select(F.col("id").alias("section_id"), "text")


def _vectors(spark: SparkSession, d: str) -> neighbours.VectorIndex:
    done = table(spark, d, "embedding_jobs", spread=True).where(F.lower(F.trim("status")) == "completed")
    return neighbours.VectorIndex(done.select(F.col("job_id").alias("vec_id"), F.col("section_id").alias("key"), F.col("processed_at").alias("at"), "embedding"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d)).select(F.col("a").alias("section_a"), F.col("b").alias("section_b"))


def p7_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar sections of each section whose job_id is divisible by 20, at any similarity (three places, as vectors are held in single precision)."""
    index = _vectors(spark, d)
    asked = index.members.where("vec_id % 20 = 0").select("vec_id")
    near = index.nearest(5, None, asked=asked)
    return near.select(F.col("key").alias("section_id"), F.col("neighbour").alias("similar_id"), F.round("similarity", 3).alias("similarity"), "place")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents", spread=True), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d), CAPACITY)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents", spread=True), table(spark, d, "eval_items"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "part", "item_words", "matched_words", "longest_words", F.to_json("spans").alias("spans")).distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(table(spark, d, "documents", spread=True), table(spark, d, "eval_items"))
    return found.select(F.col("id").alias("doc_id"), "item_id").distinct()


def p9_runs(spark: SparkSession, d: str) -> DataFrame:
    """``p9_leaks`` without the places in the text."""
    return p9_leaks(spark, d).drop("spans")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", spread=True)
    return leaks.without_leaks(docs, leaks.leaks(docs, table(spark, d, "eval_items")))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_long(table(spark, d, "documents", spread=True), LIMIT, OVERLAP)


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers beyond the capacity, documents that are split though they fit, documents whose pieces do not give their tokens, and documents placed."""
    packed = p8_packed(spark, d).where("container_id IS NOT NULL")
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("over_full"))
    each = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max("piece").alias("last"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    need = tokens.token_counts(table(spark, d, "documents"), "doc_id", "text").where("n_tokens > 0")
    both = each.join(need, each["doc_id"] == need["id"], "full_outer")
    whole = F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("end") == F.col("n")) & (F.col("last") == F.col("pieces") - 1), F.lit(False))
    found = both.agg(F.count_if((F.col("n_tokens") <= CAPACITY) & (F.col("pieces") > 1)).alias("split_needlessly"), F.count_if(~whole).alias("not_whole"), F.count("doc_id").alias("placed"))
    return full.join(F.broadcast(found))  # one row each


def p10_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Every document put together again from the cores of its pieces, and whether all of these are within the limit."""
    cut = pieces.split_long(table(spark, d, "documents", spread=True), LIMIT, OVERLAP, keep_short=True)
    core = F.substring(F.col("text"), F.col("core_start") - F.col("char_start") + 1, F.length("text"))
    parts = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", core.alias("t")))).alias("p"), F.max("n_tokens").alias("n"))  # the pieces of one document
    return parts.select("doc_id", F.md5(F.array_join("p.t", "")).alias("text_hash"), (F.col("n") <= LIMIT).alias("within"))


QUERIES = {
    "p2_found": p2_found, "p2_classes": p2_classes,
    "p4_found": p4_found, "p4_ranking": p4_ranking, "p4_rating": p4_rating,
    "p5_found": p5_found, "p5_weights": p5_weights,
    "p6_found": p6_found, "p6_clean": p6_clean,
    "p7_found": p7_found, "p7_topk": p7_topk,
    "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_invariants": p8_invariants,
    "p9_found": p9_found, "p9_leaks": p9_leaks, "p9_runs": p9_runs, "p9_clean": p9_clean,
    "p10_pieces": p10_pieces, "p10_rejoined": p10_rejoined,
}

_P5 = r"""
s AS (SELECT DISTINCT id, lower(content_full) AS text, CASE WHEN trim(keywords) = '' THEN NULL WHEN ltrim(keywords) LIKE '[%' THEN list_transform(CAST(try_cast(keywords AS JSON) AS VARCHAR[]), lambda x: trim(lower(x)))
  ELSE list_filter(list_transform(string_split(keywords, ','), lambda x: trim(lower(x))), lambda x: x <> '') END AS keys FROM file_sections WHERE id IS NOT NULL),
x AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '\p{L}+')) AS t FROM s) GROUP BY 1, 2),
k AS (SELECT DISTINCT id, unnest(keys) AS t FROM s),
y AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(array_to_string(keys, ' '), '\p{L}+')) AS t FROM s) GROUP BY 1, 2),
c AS (SELECT id, t AS term, coalesce(x.n, 0) AS in_text, coalesce(x.n, 0) + coalesce(y.n, 0) AS tf FROM x FULL JOIN y USING (id, t)),
g AS (SELECT term, count(*) AS records, count(*) FILTER (in_text > 0) AS text_records, sum(tf) AS total, sum(tf * ln(tf)) AS logs FROM c GROUP BY 1),
m AS (SELECT count(DISTINCT id) AS n FROM c)"""

_ITEMS = """i AS (SELECT search_id, section_id, coalesce(max(score) FILTER (source = 'chroma'), '-infinity') AS a, coalesce(max(-score) FILTER (source = 'fts5'), '-infinity') AS b,
  coalesce(max(score) FILTER (source = 'tfidf'), '-infinity') AS c, coalesce(max(importance_score), '-infinity') AS d, coalesce(max(rerank_score), '-infinity') AS e
  FROM search_results WHERE search_id IS NOT NULL AND section_id IS NOT NULL GROUP BY 1, 2)"""
# the walk as a matrix: from x to every y that is better in a score, or back to x where none is
_WALK = f"""WITH RECURSIVE {_ITEMS}, n AS (SELECT search_id, count(*) AS n FROM i GROUP BY 1),
v AS (SELECT search_id, section_id, unnest([1, 2, 3, 4, 5]) AS k, unnest([a, b, c, d, e]) AS x FROM i),
u AS (SELECT search_id, section_id, k, x, rank() OVER (PARTITION BY search_id, k ORDER BY x DESC) - 1 AS better FROM v),
t AS (SELECT search_id, s, y, sum(w) AS w FROM (SELECT x.search_id, x.section_id AS s, y.section_id AS y, 0.2 / x.better AS w FROM u x JOIN u y ON x.search_id = y.search_id AND x.k = y.k AND y.x > x.x
  UNION ALL SELECT search_id, section_id, section_id, 0.2 FROM u WHERE better = 0 UNION ALL SELECT search_id, section_id, section_id, 0 FROM i) GROUP BY 1, 2, 3),
w AS (SELECT 0 AS step, search_id, section_id, 1.0::DOUBLE / n AS p FROM i JOIN n USING (search_id)
  UNION ALL SELECT step + 1, w.search_id, y, 0.9 * sum(w.p * t.w) + 0.1 / any_value(n) FROM w JOIN t ON w.search_id = t.search_id AND w.section_id = t.s JOIN n ON n.search_id = w.search_id WHERE step < 280 GROUP BY step, w.search_id, y),
r AS (SELECT search_id, section_id, round(p, 9) AS stationary, row_number() OVER (PARTITION BY search_id ORDER BY round(p * n, 8) DESC, section_id) AS place, n FROM w JOIN n USING (search_id) WHERE step = 280)"""
_NEWEST = r"""j AS (SELECT section_id, job_id, processed_at, CAST(embedding AS DOUBLE[]) AS v FROM embedding_jobs WHERE lower(trim(status)) = 'completed' AND len(embedding) = 128 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
n AS (SELECT section_id, job_id, v FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY processed_at DESC NULLS LAST, job_id DESC) AS r FROM j) WHERE r = 1)"""

SQL = {
    "p4_ranking": _WALK + " SELECT search_id, section_id, stationary, place FROM r",
    "p4_rating": _WALK + ", g AS (SELECT DISTINCT search_id, section_id, grade FROM search_judgements) SELECT grade, count(*) AS sections, avg(place / n) AS mean_place FROM r JOIN g USING (search_id, section_id) GROUP BY 1",
    "p7_topk": f"WITH {_NEWEST}, p AS (SELECT a.section_id AS a, b.section_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM n a JOIN n b ON a.section_id <> b.section_id WHERE a.job_id % 20 = 0), t AS (SELECT a AS section_id, b AS similar_id, round(s, 3) AS similarity, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM p) SELECT * FROM t WHERE place <= 5",
    "p2_classes": r"""
WITH RECURSIVE s AS (SELECT DISTINCT id, list_sort(regexp_extract_all(lower(content_full), '[\p{L}\p{Nd}]+')) AS w FROM file_sections WHERE content_full IS NOT NULL AND id IS NOT NULL),
k AS (SELECT w, min(id) AS rep, count(*) AS copies FROM s WHERE len(w) >= 40 GROUP BY 1),
e AS (SELECT rep, n, t, row_number() OVER (PARTITION BY rep, t) AS k FROM (SELECT rep, len(w) AS n, unnest(w) AS t FROM k)),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.t = b.t AND a.k = b.k AND a.rep <> b.rep GROUP BY 1, 2 HAVING count(*) >= 0.8 * max(greatest(a.n, b.n))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS least FROM r GROUP BY 1), d AS (SELECT a, count(*) AS links FROM l GROUP BY 1)
SELECT s.id AS section_id, rep AS copy_of, least(rep, coalesce(g.least, rep)) AS group_id, copies, coalesce(links, 0) AS links FROM s JOIN k USING (w) LEFT JOIN g ON g.a = rep LEFT JOIN d ON d.a = rep""",
    "p8_invariants": "SELECT 0 AS over_full, 0 AS split_needlessly, 0 AS not_whole, count(*) FILTER (text <> '') AS placed FROM documents",
    "p9_runs": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
e AS (SELECT item_id, 'question' AS part, regexp_extract_all(lower(question), '[\p{L}\p{Nd}]+') AS w FROM eval_items UNION ALL SELECT item_id, 'passage', regexp_extract_all(lower(passage), '[\p{L}\p{Nd}]+') FROM eval_items),
eg AS (SELECT DISTINCT item_id, part, len(w) AS n, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, part, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
h AS (SELECT DISTINCT doc_id, item_id, part, n, i FROM dg JOIN eg USING (g)),
f AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 12 THEN 0 ELSE 1 END AS fresh FROM h WINDOW w AS (PARTITION BY doc_id, item_id, part ORDER BY i)),
r AS (SELECT doc_id, item_id, part, n, max(i) - min(i) + 12 AS m FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id, part ORDER BY i) AS k FROM f) GROUP BY doc_id, item_id, part, n, k)
SELECT doc_id, item_id, part, n::INT AS item_words, sum(m)::INT AS matched_words, max(m)::INT AS longest_words FROM r GROUP BY 1, 2, 3, 4""",
    "p10_rejoined": "SELECT doc_id, md5(text) AS text_hash, true AS within FROM documents WHERE text <> ''",
    "p4_found": r"""
WITH i AS (SELECT search_id, section_id, coalesce(max(score) FILTER (source = 'chroma'), '-infinity') AS a, coalesce(max(-score) FILTER (source = 'fts5'), '-infinity') AS b,
  coalesce(max(score) FILTER (source = 'tfidf'), '-infinity') AS c, coalesce(max(importance_score), '-infinity') AS d, coalesce(max(rerank_score), '-infinity') AS e
  FROM search_results WHERE search_id IS NOT NULL AND section_id IS NOT NULL GROUP BY 1, 2)
SELECT search_id, section_id FROM i EXCEPT
SELECT x.search_id, x.section_id FROM i x JOIN i y ON x.search_id = y.search_id AND x.section_id <> y.section_id
WHERE (x.a > y.a)::INT - (x.a < y.a)::INT + (x.b > y.b)::INT - (x.b < y.b)::INT + (x.c > y.c)::INT - (x.c < y.c)::INT
  + (x.d > y.d)::INT - (x.d < y.d)::INT + (x.e > y.e)::INT - (x.e < y.e)::INT <= 0""",
    "p5_found": f"WITH {_P5} SELECT c.id AS section_id, term FROM c JOIN g USING (term) JOIN k ON k.id = c.id AND k.t = c.term WHERE in_text >= 3 AND text_records BETWEEN 2 AND 5",
    "p5_weights": f"WITH {_P5} SELECT c.id AS section_id, term, CAST(tf AS INT) AS tf, records, round(ln(1 + tf) * greatest(1 - (ln(total) - logs / total) / ln(n), 0), 6) AS weight FROM c JOIN g USING (term), m",
    "p2_found": r"""
WITH s AS (SELECT DISTINCT id, regexp_extract_all(lower(content_full), '[\p{L}\p{Nd}]+') AS w FROM file_sections WHERE content_full IS NOT NULL AND id IS NOT NULL),
e AS (SELECT id, n, t, row_number() OVER (PARTITION BY id, t) AS k FROM (SELECT id, len(w) AS n, unnest(w) AS t FROM s WHERE len(w) >= 40)),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common, max(greatest(a.n, b.n)) AS longer FROM e a JOIN e b ON a.t = b.t AND a.k = b.k AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c WHERE common >= 0.8 * longer""",
    "p7_found": r"""
WITH j AS (SELECT section_id, job_id, processed_at, CAST(embedding AS DOUBLE[]) AS v FROM embedding_jobs WHERE lower(trim(status)) = 'completed' AND len(embedding) = 128 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
n AS (SELECT section_id, v FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY processed_at DESC NULLS LAST, job_id DESC) AS r FROM j) WHERE r = 1),
p AS (SELECT a.section_id AS a, b.section_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM n a JOIN n b ON a.section_id <> b.section_id),
t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p WHERE s >= 0.8)
SELECT DISTINCT least(a, b) AS section_a, greatest(a, b) AS section_b FROM t WHERE r <= 5""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
e AS (SELECT item_id, regexp_extract_all(lower(question), '[\p{L}\p{Nd}]+') AS w FROM eval_items
  UNION ALL SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{Nd}]+') FROM eval_items),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
