"""The link graph of a vault: resolution, backlinks, broken links, graph, mentions and search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.skew import BROADCAST_KEYS, skew_join
from marginalia.session import stored


def candidate_keys(notes: DataFrame, path_col: str = "path") -> DataFrame:
    """(key, target_path, priority): every key under which a note can be linked.

    Priority 0: the path; 1: the folder of an ``index`` note; 2: each shorter suffix of the path. So suffix matching
    becomes an equi-join instead of a comparison of every link with every path.
    """
    low = F.lower(F.regexp_replace(F.col(path_col), r"\.md$", ""))
    parts = F.split(low, "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("key"), F.when(i == 1, 0).otherwise(2).alias("priority")))
    index = F.when(low.endswith("/index"), F.array(F.struct(F.regexp_replace(low, "/index$", "").alias("key"), F.lit(1).alias("priority")))).otherwise(F.array().cast("array<struct<key:string,priority:int>>"))
    return notes.select(F.col(path_col).alias("target_path"), F.explode(F.concat(keys, index)).alias("k")).select("k.key", "target_path", "k.priority")


def resolve(links: DataFrame, notes: DataFrame, path_col: str = "path", target_col: str = "target") -> DataFrame:
    """Links with ``target_path``, null where nothing matches.

    A target matches ignoring case and an ``.md`` ending: exactly, then an index note, then as a suffix; of several
    the best priority, then the shortest path, then the first in order. Keys are reduced to their best note before the join,
    which is one row per key, so the number of links never grows; a note that very many links name is split.
    """
    best = candidate_keys(notes, path_col).groupBy("key").agg(F.min(F.struct("priority", F.length("target_path").alias("n"), "target_path")).alias("b"))
    best = best.select("key", F.col("b.target_path").alias("target_path"))
    key = F.lower(F.regexp_replace(F.regexp_replace(F.col(target_col), r"^(?:\.\.?/)+", ""), r"\.md$", ""))
    return skew_join(links.withColumn("key", key), best, ["key"], "left").drop("key")


def backlinks(resolved: DataFrame, source_col: str = "source_path") -> DataFrame:
    """(target_path, source_path, link_text): resolved links inverted, each once."""
    return resolved.where(F.col("target_path").isNotNull()).select("target_path", F.col(source_col).alias("source_path"), F.coalesce("alias", "target").alias("link_text")).distinct()


def broken(resolved: DataFrame, source_col: str = "source_path") -> DataFrame:
    return resolved.where(F.col("target_path").isNull()).select(F.col(source_col).alias("source_path"), "target").distinct()


def edges(resolved: DataFrame, source_col: str = "source_path") -> DataFrame:
    """(source_path, target_path, links) between different notes."""
    return resolved.where(F.col("target_path").isNotNull() & (F.col("target_path") != F.col(source_col))).groupBy(F.col(source_col).alias("source_path"), "target_path").agg(F.count("*").alias("links"))


def graph_nodes(notes: DataFrame, graph: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, out_links, in_links) of every note."""
    out = graph.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("out_links"))
    into = graph.groupBy(F.col("target_path").alias("path")).agg(F.count("*").alias("in_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return notes.select(F.col(path_col).alias("path")).distinct().join(out, "path", "left").join(into, "path", "left").select("path", zero("out_links"), zero("in_links"))


def most_linked(graph: DataFrame, n: int = 10) -> DataFrame:
    return graph.groupBy("target_path").agg(F.countDistinct("source_path").alias("sources")).orderBy(F.desc("sources"), "target_path").limit(n)


def unlinked_mentions(notes: DataFrame, name: str, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, mentions): how often a note's text names ``name``, ignoring case, outside of links; the named note is left out."""
    plain = F.regexp_replace(F.lower(F.col(text_col)), r"\[\[[^\]]*\]\]", " ")
    count = (F.length(plain) - F.length(F.replace(plain, F.lit(name.lower()), F.lit("")))) / F.lit(len(name))
    stem = F.lower(F.regexp_extract(F.col(path_col), r"([^/]+?)(?:\.md)?$", 1))
    return notes.where(stem != name.lower()).select(F.col(path_col).alias("path"), count.cast("int").alias("mentions")).where("mentions > 0")


def backlinks_of(resolved: DataFrame, notes: DataFrame, name: str, path_col: str = "path", source_col: str = "source_path") -> DataFrame:
    """``backlinks`` of the one note that ``name`` stands for: its path, its path without ending, its name or any suffix, ignoring case."""
    asked = resolve(notes.sparkSession.createDataFrame([(name,)], "target string"), notes, path_col).select("target_path")  # one row
    return backlinks(resolved.join(F.broadcast(asked), "target_path", "left_semi"), source_col)


def vault_stats(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: notes, links, resolved, broken, linked_notes (notes that any link resolves to)."""
    n = notes.agg(F.count("*").alias("notes"))
    found = F.col("target_path").isNotNull()
    return n.join(F.broadcast(resolved.agg(F.count("*").alias("links"), F.count_if(found).alias("resolved"), F.count_if(~found).alias("broken"), F.countDistinct("target_path").alias("linked_notes"))))


def mention_contexts(notes: DataFrame, name: str, reach: int = 100, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, mention_no, context): each place outside of links where a text names ``name``, ignoring case, with ``reach`` characters on both sides, white space collapsed.

    Links are blanked out to their own length before the search, so places are those of the text itself.
    """
    text = F.col(text_col)
    links, between = F.regexp_extract_all(text, F.lit(r"(\[\[[^\]]*\]\])"), F.lit(1)), F.split(text, r"\[\[[^\]]*\]\]")
    blank = F.array_join(F.transform(F.arrays_zip(between.alias("b"), links.alias("l")), lambda x: F.concat(x["b"], F.coalesce(F.repeat(F.lit("\u0001"), F.length(x["l"])), F.lit("")))), "")
    parts = F.split(F.lower(blank), re.escape(name.lower()))
    lengths = F.transform(parts, lambda p: F.length(p))
    step = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast("struct<at:int,out:array<int>>"),
                       lambda s, n: F.struct((s["at"] + n + len(name)).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out")), lambda s: s["out"])
    rows = notes.where(F.contains(F.lower(text), F.lit(name.lower()))).select(F.col(path_col).alias("path"), text.alias("__t"), F.posexplode(F.slice(step, 1, F.size(parts) - 1)).alias("i", "at"))
    begin = F.greatest(F.col("at") - reach, F.lit(0))
    end = F.least(F.col("at") + len(name) + reach, F.length("__t"))
    return rows.select("path", (F.col("i") + 1).alias("mention_no"), F.trim(F.regexp_replace(F.substring(F.col("__t"), begin + 1, end - begin), r"\s+", " ")).alias("context"))


def all_mentions(notes: DataFrame, names: DataFrame, path_col: str = "path", text_col: str = "content", name_col: str = "name") -> DataFrame:
    """(path, name, mentions): how often each note names any of ``names`` outside of links, as whole words, ignoring case.

    Names are compared word by word: a text's runs of as many words as some name has are joined with the names, so neither texts nor names are
    compared one by one; up to BROADCAST_KEYS names are broadcast, beyond runs are counted per note and shuffled. Names without words are left out.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    keyed = names.select(F.col(name_col).alias("name"), words(F.col(name_col)).alias("w")).where(F.size("w") > 0).select("name", F.array_join("w", " ").alias("key"), F.size("w").alias("n")).distinct()
    sizes = sorted(r[0] for r in keyed.select("n").distinct().collect())  # as many numbers as there are lengths of names
    if not sizes:
        return notes.select(F.col(path_col).alias("path"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("mentions")).limit(0)
    plain = F.regexp_replace(F.col(text_col), r"\[\[[^\]]*\]\]", " \u0001 ")
    rows = notes.select(F.col(path_col).alias("path"), F.regexp_extract_all(F.lower(plain), F.lit(r"([\p{L}\p{N}_]+|\u0001)"), F.lit(1)).alias("w"))
    def grams(n: int) -> Column:
        out = F.col("w")
        for k in range(1, n):
            left = F.greatest(F.size("w") - k, F.lit(0))
            out = F.zip_with(F.slice(out, 1, left), F.slice("w", k + 1, left), lambda x, y: F.concat_ws(" ", x, y))
        return out

    runs = F.flatten(F.array(*map(grams, sizes)))
    found, wanted = rows.select("path", F.explode(runs).alias("key")), keyed.select("name", "key")
    if wanted.count() <= BROADCAST_KEYS:
        return found.join(F.broadcast(wanted), "key").groupBy("path", "name").agg(F.count("*").alias("mentions"))
    counted = stored(found.groupBy("path", "key").agg(F.count("*").alias("mentions")), "runs")
    return skew_join(counted, wanted, ["key"], "inner").groupBy("path", "name").agg(F.max("mentions").alias("mentions"))


def vault_search(notes: DataFrame, query: str, path_col: str = "path", front: Column | None = None, body: Column | None = None, limit: int = 20) -> DataFrame:
    """(path, score, match_type): by name 0.8, n words of the name 0.6 + 0.1 n, frontmatter values 0.7, body 0.5, n words of the body 0.3 + 0.2 n.

    The greatest counts, at most 1; the type (name, frontmatter, content) is that of the first rule that holds. Ordered by score, then path.
    """
    q = query.lower().strip()
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(q.split())])

    def counted(x: Column) -> Column:
        in_name = F.size(F.array_intersect(terms, F.split(x["name"], r"[\s_-]+")))
        in_body = F.size(F.array_intersect(terms, F.split(x["text"], r"\s+")))
        has = lambda c: F.contains(c, F.lit(q))
        return F.struct(has(x["name"]).alias("name"), in_name.alias("in_name"), has(x["front"]).alias("front"), has(x["text"]).alias("text"), in_body.alias("in_body"))

    def judged(x: Column) -> Column:
        rules = [
            (x["name"], F.lit(0.8), "name"),
            (x["in_name"] > 0, 0.6 + 0.1 * x["in_name"], "name"),
            (x["front"], F.lit(0.7), "frontmatter"),
            (x["text"], F.lit(0.5), "content"),
            (x["in_body"] > 0, 0.3 + 0.2 * x["in_body"], "content"),
        ]
        best = F.greatest(*[F.when(c, s) for c, s, _ in rules])
        return F.struct(F.round(F.when(best.isNotNull(), F.least(F.lit(1.0), best)), 6).alias("score"), F.coalesce(*[F.when(c, F.lit(k)) for c, _, k in rules]).alias("match_type"))

    # bound to a variable, so that name, frontmatter and text, and what they hold, are made once for all rules
    parts = F.struct(
        F.lower(F.regexp_extract(F.col(path_col), r"([^/]+?)(?:\.md)?$", 1)).alias("name"), F.lower(F.coalesce(front, F.lit(""))).alias("front") if front is not None else F.lit("").alias("front"),
        F.lower(F.coalesce(body, F.lit(""))).alias("text") if body is not None else F.lit("").alias("text"),
    )
    out = notes.select(F.col(path_col).alias("path"), F.explode(F.transform(F.transform(F.array(parts), counted), judged)).alias("j")).select("path", "j.score", "j.match_type").where(F.col("score").isNotNull())
    return out.orderBy(F.desc("score"), "path").limit(limit)
