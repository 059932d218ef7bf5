"""Keyword, vector and hybrid search, filters, re-ranking and suggestions.

A search is answered by one scan: the query's terms are literals, term frequencies and lengths are computed inside
the row, and corpus statistics are a one-row aggregate joined back. Only top-k rows move. ``postings`` builds the
inverted table for workloads with many queries.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marginalia.config import SearchConfig
from marginalia.functions.text import FOLD_FROM, FOLD_TO, cosine, importance, index_tokens, suffix, term_frequency, token_count
from marginalia.operators.skew import skew_join
from marginalia.session import release, stored


def query_terms(query: str) -> list[str]:
    """The query cut as the corpus is: folded runs of letters and digits, each once."""
    folded = query.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return list(dict.fromkeys(re.findall(r"[^\W_]+", folded)))


def bm25(df: DataFrame, id_col: str, text: Column, query: str, limit: int = 100, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(id, rank, row_num): rows with all terms, best (most negative) rank first, ties by id.

    rank = -sum idf f (k1 + 1) / (f + k1 (1 - b + b len / avg)), idf = max(ln((N - n + 0.5) / (n + 0.5)), 1e-6). Null texts count
    as empty documents; a query without terms finds nothing. One pass over the texts: the corpus statistics are observed
    while the rows with all terms (id, length, frequencies) are written to the shared folder.
    """
    terms = query_terms(query)
    if not terms:
        return df.select(F.col(id_col), F.lit(0.0).alias("rank"), F.lit(0).alias("row_num")).limit(0)
    low = df.select(F.col(id_col), F.coalesce(F.lower(text), F.lit("")).alias("__x"))
    base = low.select(id_col, token_count(F.col("__x")).alias("__len"), *[term_frequency(F.col("__x"), t).alias(f"__f{i}") for i, t in enumerate(terms)])
    seen = Observation("bm25")
    counted = base.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("__len").alias("total"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    hit = stored(counted.where(" AND ".join(f"__f{i} > 0" for i in range(len(terms)))), "hits")
    stats = seen.get
    n, average = stats["n"], max(1, stats["total"] or 0) / max(1, stats["n"])
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"__f{i}"), stats[f"d{i}"]
        idf = max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6)
        score = score + idf * f * (cfg.k1 + 1) / (f + cfg.k1 * (1 - cfg.b + cfg.b * F.col("__len") / average))
    top = hit.select(id_col, (-score).alias("rank")).orderBy("rank", id_col).limit(limit)
    return top.withColumn("row_num", F.row_number().over(W.orderBy("rank", id_col)))  # at most ``limit`` rows


def with_position_score(hits: DataFrame, base: int = 1) -> DataFrame:
    """Add ``score``: (N - position) / N with positions from ``base``, mixed with a boost where the rank is telling."""
    n = F.count("*").over(W.partitionBy())  # top-k rows
    position = (n - (F.col("row_num") - 1 + base)) / n
    boost = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.abs("rank") / 20))
    return hits.withColumn("score", F.when(F.col("rank") < -0.001, 0.7 * position + 0.3 * boost).otherwise(position))


def postings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, tf, length): the inverted table, to be written bucketed by term."""
    rows = df.select(F.col(id_col), F.coalesce(index_tokens(text), F.array().cast("array<string>")).alias("t")).withColumn("length", F.size("t"))
    return rows.select(id_col, "length", F.explode("t").alias("term")).groupBy("term", id_col, "length").agg(F.count("*").alias("tf"))


def like(df: DataFrame, id_col: str, header: Column, content: Column, query: str, limit: int = 100, least: int = 2) -> DataFrame:
    """(id, score): rows that hold every term (``least`` characters or more) in header or content, ignoring case.

    score is matched / all terms, times 1.5 if every term is a word of the text, at most 1. Ordered by score, then id.
    """
    terms = [t for t in query.lower().split() if len(t) >= least]
    if not terms:
        return df.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    both = F.lower(F.concat_ws(" ", header, content))
    has = [F.coalesce(F.contains(F.lower(header), F.lit(t)), F.lit(False)) | F.coalesce(F.contains(F.lower(content), F.lit(t)), F.lit(False)) for t in terms]
    words = F.split(both, r"\s+")
    whole = F.lit(True)
    for t in terms:
        whole = whole & F.array_contains(words, t)
    matched = sum((h.cast("int") for h in has), F.lit(0)) / len(terms)
    score = F.least(F.lit(1.0), matched * F.when(whole, 1.5).otherwise(1.0))
    keep = has[0]
    for h in has[1:]:
        keep = keep & h
    return df.where(keep).select(F.col(id_col), score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def vector_topk(vectors: DataFrame, id_col: str, vector_col: str, query: DataFrame, limit: int = 100, metric: str = "cosine") -> DataFrame:
    """(id, score): the vectors most similar to the one row of ``query`` (column ``q``), at least 0.

    ``metric`` is cosine, or l2 for max(0, 1 - squared distance). Null, zero or otherwise long vectors are left out. The
    query is one row and goes to every task; the scan keeps the best ``limit``.
    """
    joined = vectors.select(F.col(id_col), F.col(vector_col).alias("__v")).join(F.broadcast(query.select(F.col("q").alias("__q")).limit(1)))
    if metric == "l2":
        gap = F.aggregate(F.zip_with("__v", "__q", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
        raw = F.when(F.size("__v") == F.size("__q"), 1 - gap)
    else:
        raw = cosine(F.col("__v"), F.col("__q"))
    scored = joined.select(id_col, F.round(F.greatest(F.lit(0.0), raw), 9).alias("score")).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def fuse(semantic: DataFrame | None, keyword: DataFrame | None, details: DataFrame, id_col: str, importance_col: str | None = None, cfg: SearchConfig = SearchConfig(), limit: int | None = None) -> DataFrame:
    """(id, combined, semantic_score, keyword_score, origin) of both legs, each with (id, score).

    Scores are divided by their leg's best, weighted, added and multiplied by 0.5 + importance. A leg that is None is empty.
    ``origin`` is hybrid, chroma or sqlite. Ordered by combined, then id; results below ``min_score`` are left out.
    """
    empty = lambda: details.select(F.col(id_col), F.lit(None).cast("double").alias("score")).limit(0)
    s = (semantic if semantic is not None else empty()).select(F.col(id_col), F.col("score").alias("semantic_score"))
    k = (keyword if keyword is not None else empty()).select(F.col(id_col), F.col("score").alias("keyword_score"))
    both = s.join(k, id_col, "full_outer")
    whole = W.partitionBy()  # at most the sum of both limits
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(whole), F.lit(0.0)) if cfg.normalize else F.col(c), F.lit(0.0))
    scored = both.withColumn("__base", cfg.semantic_weight * share("semantic_score") + cfg.keyword_weight * share("keyword_score"))
    weight = importance(F.col(importance_col)) if importance_col else F.lit(0.5)
    full = details.join(F.broadcast(scored), id_col)
    origin = F.when(F.col("semantic_score").isNotNull() & F.col("keyword_score").isNotNull(), "hybrid").when(F.col("semantic_score").isNotNull(), "chroma").otherwise("sqlite")
    out = full.select(
        id_col, F.round(F.col("__base") * (0.5 + weight), 6).alias("combined"), F.round(F.coalesce("semantic_score", F.lit(0.0)), 6).alias("semantic_score"),
        F.round(F.coalesce("keyword_score", F.lit(0.0)), 6).alias("keyword_score"), origin.alias("origin"),
    )
    return out.where(F.col("combined") >= cfg.min_score).orderBy(F.desc("combined"), id_col).limit(limit or cfg.final_limit)


def filter_records(df: DataFrame, path_col: str, types: list[str] | None = None, since: str | None = None, until: str | None = None, time_col: str | None = None, text_col: str | None = None, words: list[str] | None = None) -> DataFrame:
    """Restrict what is searched, before any top-k: file types, an inclusive time range, words that must occur.

    A null time is kept, as a record without a file is; a null path has no type.
    """
    if types:
        df = df.where(suffix(F.col(path_col)).isin([t.lower().lstrip(".") for t in types]))
    if since:
        df = df.where(F.col(time_col).isNull() | (F.col(time_col) >= F.lit(since).cast("timestamp_ntz")))
    if until:
        df = df.where(F.col(time_col).isNull() | (F.col(time_col) <= F.lit(until).cast("timestamp_ntz")))
    for w in words or []:
        df = df.where(F.contains(F.lower(F.col(text_col)), F.lit(w.lower())))
    return df


def lexical_rerank(df: DataFrame, id_col: str, text_col: str, query: str, limit: int = 20, scorer: Callable[[Column, list[str]], Column] | None = None) -> DataFrame:
    """(id, rerank_score, reason): share of the query's terms in the text, and up to five of them.

    ``scorer`` may give another score from the first 2,000 characters and the terms, for instance a model's pandas UDF.
    """
    terms = [t for t in dict.fromkeys(query.lower().split())]
    text = F.lower(F.col(text_col))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))
    score = scorer(F.lower(F.substring(F.col(text_col), 1, 2000)), terms) if scorer else F.size(found) / F.lit(float(max(1, len(terms))))
    out = df.select(F.col(id_col), F.round(score, 6).alias("rerank_score"), F.array_join(F.slice(found, 1, 5), ", ").alias("reason"))
    return out.orderBy(F.desc("rerank_score"), id_col).limit(limit)


def refinements(hits: DataFrame, id_col: str, keywords: Column, query: str, top: int = 3, most: int = 5) -> DataFrame:
    """(suggestion, position): keywords of the best ``top`` hits that the query lacks, in order, each once."""
    first = hits.orderBy(F.desc("score"), id_col).limit(top).withColumn("__n", F.row_number().over(W.orderBy(F.desc("score"), id_col)))
    rows = first.select("__n", F.posexplode(F.transform(keywords, lambda k: F.lower(k))).alias("__i", "suggestion")).where(~F.col("suggestion").isin(query.lower().split()))
    best = rows.groupBy("suggestion").agg(F.min(F.struct("__n", "__i")).alias("o")).orderBy("o").limit(most)
    return best.select("suggestion", F.row_number().over(W.orderBy("o")).alias("position"))


class Provider(Protocol):
    """A leg of hybrid search: rows (id, score) for a query."""

    def search(self, query: str, limit: int) -> DataFrame: ...


class Bm25Provider:
    def __init__(self, df: DataFrame, id_col: str, text: Column):
        self.df, self.id_col, self.text = df, id_col, text

    def search(self, query: str, limit: int = 100) -> DataFrame:
        return with_position_score(bm25(self.df, self.id_col, self.text, query, limit), base=0)


class LikeProvider:
    """Rows that hold all terms of a query (one character or more), in the order of their header, then id; the score falls evenly from 1 with the place."""

    def __init__(self, df: DataFrame, id_col: str, header: Column, content: Column):
        self.df, self.id_col, self.header, self.content = df, id_col, header, content

    def search(self, query: str, limit: int = 100) -> DataFrame:
        terms = query.lower().split()
        if not terms:
            return self.df.select(F.col(self.id_col), F.lit(0.0).alias("score")).limit(0)
        keep = F.lit(True)
        for t in terms:
            keep = keep & (F.coalesce(F.contains(F.lower(self.header), F.lit(t)), F.lit(False)) | F.coalesce(F.contains(F.lower(self.content), F.lit(t)), F.lit(False)))
        order = [F.col("__h").asc_nulls_first(), F.col(self.id_col)]
        top = self.df.where(keep).select(F.col(self.id_col), self.header.alias("__h")).orderBy(*order).limit(limit)
        n, place = F.count("*").over(W.partitionBy()), F.row_number().over(W.orderBy(*order)) - 1  # at most ``limit`` rows
        return top.select(F.col(self.id_col), ((n - place) / n).alias("score"))


class VectorProvider:
    """``embed`` turns the query into a one-row frame with a vector ``q``."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, embed: Callable[[str], DataFrame]):
        self.vectors, self.id_col, self.vector_col, self.embed = vectors, id_col, vector_col, embed

    def search(self, query: str, limit: int = 100) -> DataFrame:
        return vector_topk(self.vectors, self.id_col, self.vector_col, self.embed(query), limit)


class QueryCache:
    """Results of the last ``size`` different searches, kept as rows on disk (``stored``); the one put in first is dropped first.

    A key is the query as it is searched, with its limit.
    """

    def __init__(self, size: int = 100):
        self.size, self.kept = size, {}

    def get(self, query: str, limit: int, run: Callable[[], DataFrame]) -> DataFrame:
        key = (query.strip().lower(), limit)
        if key not in self.kept:
            while len(self.kept) >= self.size:
                release(self.kept.pop(next(iter(self.kept))))
            self.kept[key] = stored(run(), "search")
        return self.kept[key]


def by_level(df: DataFrame, keep: Column, level: str, id_col: str, limit: int = 100) -> DataFrame:
    """Rows that are kept, those of the highest level number first (a missing one counts as 0), ties by id."""
    return df.where(keep).orderBy(F.desc(F.coalesce(F.col(level), F.lit(0))), id_col).limit(limit)


def in_places(df: DataFrame, tags: Column, **places: str) -> DataFrame:
    """Rows whose tags name every given place (``wing="lab"`` asks for the tag ``wing:lab``), ignoring case."""
    for kind, value in places.items():
        df = df.where(F.array_contains(F.transform(tags, lambda t: F.lower(F.trim(t))), f"{kind}:{value}".lower()))
    return df


def with_file(sections: DataFrame, files: DataFrame, key: str = "file_id", file_key: str = "id", path_col: str = "file_path") -> DataFrame:
    """Sections with the path of their file as ``source_path``, empty where there is none; of several rows of a file the greatest path counts."""
    one = files.groupBy(F.col(file_key).alias(key)).agg(F.max(path_col).alias("source_path"))
    return skew_join(sections, one, [key], "left").withColumn("source_path", F.coalesce("source_path", F.lit("")))


def hybrid(query: str, details: DataFrame, id_col: str, semantic: Provider | None, keyword: Provider | None, cfg: SearchConfig = SearchConfig(), importance_col: str | None = None, limit: int | None = None) -> DataFrame:
    """Hybrid search through providers; a blank query or no provider gives an empty result."""
    s = semantic.search(query, cfg.semantic_limit) if semantic and query.strip() else None
    k = keyword.search(query, cfg.keyword_limit) if keyword and query.strip() else None
    return fuse(s, k, details, id_col, importance_col, cfg, limit)
