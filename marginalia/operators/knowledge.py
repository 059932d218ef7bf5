"""Derived knowledge: hotspots, knowledge graph, periods, diff and merge of summaries, cron."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hotspots(essences: DataFrame, id_col: str, parts: dict[str, Column], least: int = 2, most: int = 20, occurrences: bool = False) -> DataFrame:
    """(topic, kind, n): topics of ``least`` essences or more, most frequent first, ties by topic and kind.

    ``parts`` names arrays of topics (keywords, entities). Each essence counts once per topic; with ``occurrences`` every
    mention does. Pairs are reduced before the count, so a topic that all essences share is no hot key.
    """
    rows = None
    for kind, array in parts.items():
        part = essences.select(F.col(id_col), F.explode(array).alias("t")).select(id_col, F.lower(F.trim("t")).alias("topic"), F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where("topic <> ''")
    if not occurrences:
        rows = rows.distinct()
    return rows.groupBy("topic", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "topic", "kind").limit(most)


def graph_nodes(essences: DataFrame, id_col: str, entities: Column, keywords: Column) -> DataFrame:
    """(id, kind, weight) of essences, entities and keywords (``kw:`` before the name)."""
    rows = essences.select(
        F.explode(F.concat(
            F.array(F.struct(F.concat(F.lit("essence:"), F.col(id_col).cast("string")).alias("id"), F.lit("essence").alias("kind"))),
            F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda e: F.struct(e.alias("id"), F.lit("entity").alias("kind"))),
            F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.struct(F.concat(F.lit("kw:"), k).alias("id"), F.lit("keyword").alias("kind"))),
        )).alias("n")
    )
    return rows.groupBy("n.id", "n.kind").agg(F.count("*").alias("weight"))


def mention_edges(essences: DataFrame, id_col: str, keywords: Column) -> DataFrame:
    """(source, target, relation): essence mentions keyword, each once."""
    return essences.select(F.concat(F.lit("essence:"), F.col(id_col).cast("string")).alias("source"), F.explode(keywords).alias("k")).select(
        "source", F.concat(F.lit("kw:"), "k").alias("target"), F.lit("mentions").alias("relation")).distinct()


def per_period(df: DataFrame, at: str, unit: str) -> DataFrame:
    """(period, n): rows per day, week (yyyy-Www by ISO) or month; null times are left out."""
    form = {
        "day": F.date_format(at, "yyyy-MM-dd"),
        "week": F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), F.col(at)), F.weekofyear(at)),
        "month": F.date_format(at, "yyyy-MM"),
    }[unit]
    return df.where(F.col(at).isNotNull()).groupBy(form.alias("period")).agg(F.count("*").alias("n"))


def in_period(df: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows with start <= at < end; the bounds are literals, so the filter reaches the scan."""
    return df.where((F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz")))


def diff_lists(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(common, only in a, only in b) of two arrays, lower case and trimmed, sorted."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return tuple(F.array_sort(f(low(a), low(b))) for f in (F.array_intersect, F.array_except, lambda x, y: F.array_except(y, x)))


def merge_lists(a: Column, b: Column) -> Column:
    """Items of both in order, repeats ignoring case and outer blanks left out; the first spelling stays."""
    empty = F.array().cast("array<string>")
    items = F.concat(F.coalesce(a, empty), F.coalesce(b, empty))
    # sorted by key and place, the first of each key stays, and these are put back in order; arrays are bound to variables, so they are sorted once
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(F.trim(x)).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = lambda o: F.filter(o, lambda e, i: (i == 0) | ~F.get(o, i - 1)["k"].eqNullSafe(e["k"]))
    back = lambda f: F.array_sort(F.transform(f, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(back(F.element_at(F.transform(F.array(keyed), firsts), 1)), lambda e: e["x"])


def merge_summary(a: Column, b: Column) -> Column:
    """The second only if it is more than a fifth longer, or the first is missing."""
    return F.when(a.isNull() | (F.length(b) > 1.2 * F.length(a)), F.coalesce(b, a)).otherwise(a)


def line_diff(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """(key, side, line, n): how many more times a line occurs on one side; the multiset difference of lines."""
    lines = lambda df, s: df.select(F.col(key), F.explode(F.split(F.col(text), "\n")).alias("line")).groupBy(key, "line").agg(F.count("*").alias(s))
    both = lines(a, "n_a").join(lines(b, "n_b"), [key, "line"], "full_outer")
    n = F.coalesce("n_b", F.lit(0)) - F.coalesce("n_a", F.lit(0))
    return both.withColumn("d", n).where("d <> 0").select(key, F.when(F.col("d") > 0, "+").otherwise("-").alias("side"), "line", F.abs("d").alias("n"))


def unified_diff(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, diff): a unified line diff of two text columns."""
    import difflib

    def run(batches):
        for pdf in batches:
            pdf["diff"] = ["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), lineterm="")) for x, y in zip(pdf[a], pdf[b])]
            yield pdf[[key, "diff"]]

    return df.select(key, a, b).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, diff string")


def merge_sections(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, title, text): section-wise merge of (key, title, text); a differing second text is added with a mark."""
    both = a.select(key, "title", F.col("text").alias("x")).join(b.select(key, "title", F.col("text").alias("y")), [key, "title"], "full_outer")
    text = F.when(F.col("x").isNull(), F.col("y")).when(F.col("y").isNull() | (F.trim("x") == F.trim("y")), F.col("x")).otherwise(F.concat("x", F.lit("\n[supplement]\n"), "y"))
    return both.select(key, "title", text.alias("text"))


def generate(df: DataFrame, schema: str, generator: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run an injected generator (a model) over batches, with columns ``schema`` and ``error``; only rows that fail by themselves are error rows (``pipeline.in_batches``)."""
    from marginalia.operators.pipeline import in_batches

    return in_batches(df, generator, schema)


def hotspot_nodes(nodes: DataFrame, topics: DataFrame, label: Column) -> DataFrame:
    """Nodes with ``hotspot_count``, the count of the hotspot (topic, n) that equals their label ignoring case, null without one. Of several kinds of a topic the greatest counts."""
    top = topics.groupBy("topic").agg(F.max("n").alias("hotspot_count"))
    return nodes.join(F.broadcast(top), F.lower(label) == top["topic"], "left").drop("topic")  # as many topics as were asked for, 20 by default


def knowledge_graph(essences: DataFrame, id_col: str, title: Column, entities: Column, relationships: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node for each essence (its id and title) and one for each entity; edges for relationships (from, to, type) and for mentions.

    Nodes and edges are listed once; a relationship without a type is ``related_to``; names of missing ends are empty.
    """
    entity = lambda c: F.concat(F.lit("entity:"), F.coalesce(c, F.lit("")))
    named = essences.select(F.col(id_col).cast("string").alias("id"), title.alias("title"), F.coalesce(entities, F.array().cast("array<string>")).alias("e"), relationships.alias("r"))
    parts = named.select("id", F.explode("e").alias("x"))
    nodes = named.groupBy("id").agg(F.max("title").alias("t")).select("id", F.lit("essence").alias("kind"), F.coalesce("t", "id").alias("label"))
    nodes = nodes.unionByName(parts.select(entity(F.col("x")).alias("id"), F.lit("entity").alias("kind"), F.col("x").alias("label")).distinct())
    relations = named.select("id", F.explode("r").alias("x")).select(entity(F.col("x.from")).alias("source"), entity(F.col("x.to")).alias("target"), F.coalesce("x.type", F.lit("related_to")).alias("relation"), F.col("id").alias("essence"))
    mentions = parts.select(F.col("id").alias("source"), entity(F.col("x")).alias("target"), F.lit("mentions").alias("relation"), F.col("id").alias("essence"))
    return nodes, relations.unionByName(mentions).distinct()


def by_topic(essences: DataFrame, id_col: str, topic: str, title: Column, keywords: Column, entities: Column, limit: int = 20) -> DataFrame:
    """(id, match_type): essences on a topic: its title contains it, else a keyword equals it, else an entity, ignoring case; in this order, then by id."""
    t = topic.lower()
    has = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x) == t)
    kind = F.when(F.contains(F.lower(title), F.lit(t)), 1).when(has(keywords), 2).when(has(entities), 3)
    rows = essences.select(F.col(id_col), kind.alias("__k")).where(F.col("__k").isNotNull()).groupBy(id_col).agg(F.min("__k").alias("__k"))
    return rows.orderBy("__k", id_col).limit(limit).select(id_col, F.element_at(F.array(F.lit("title"), F.lit("keyword"), F.lit("entity")), F.col("__k")).alias("match_type"))


def date_range(text: str) -> tuple[str, str]:
    """(start, end) of ``a..b`` (both days included) or one day, for ``in_period``."""
    import datetime as dt

    first, _, last = text.partition("..")
    end = dt.date.fromisoformat((last or first).strip()) + dt.timedelta(days=1)
    return dt.date.fromisoformat(first.strip()).isoformat(), end.isoformat()


def cron_field(spec: str, low: int, high: int) -> list[int]:
    """Values of one cron field: ``*``, ``*/n``, ``a/n``, ``a-b``, ``a-b/n`` and lists."""
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a, b = int(span), high if step else int(span)
        out.update(range(a, b + 1, int(step or 1)))
    return sorted(v for v in out if low <= v <= high)


def cron_matches(at: Column, spec: str) -> Column:
    """Whether a time matches five cron fields; weekday 0 is Monday."""
    minute, hour, day, month, weekday = spec.split()
    bounds = [(minute, 0, 59, F.minute(at)), (hour, 0, 23, F.hour(at)), (day, 1, 31, F.day(at)), (month, 1, 12, F.month(at)), (weekday, 0, 6, F.weekday(at))]
    out = F.lit(True)
    for field, low, high, value in bounds:
        if field != "*":
            out = out & value.isin(cron_field(field, low, high))
    return out
