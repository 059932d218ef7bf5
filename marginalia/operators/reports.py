"""Reports: their files, prompts, statistics, roll-up, and comparison of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import frontmatter
from marginalia.operators.knowledge import diff_lists, merge_lists, merge_summary

# The list fields of a summary.
LISTS = ("key_points", "connections", "contradictions", "open_questions", "entities", "keywords")
#: Kind of report -> format of a period's name.
PERIODS = {"daily": "yyyy-MM-dd", "weekly": "week", "monthly": "yyyy-MM"}


def report_files(notes: DataFrame, kind: str | None = None, limit: int | None = 50, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, title, report_type, generated_at, query, sources) of the notes named ``*_report.md``, newest first, those without a time last.

    What the frontmatter lacks is Untitled, unknown, null, empty and 0; a report whose frontmatter is malformed is left out.
    """
    rows = frontmatter.read_front(notes.where(F.col(path_col).rlike(r"_report\.md$")), path_col, text_col).where(F.col("error").isNull())
    get = lambda n: frontmatter.field(F.col("front"), n)
    out = rows.select(
        path_col, F.coalesce(get("title"), F.lit("Untitled")).alias("title"), F.coalesce(get("report_type"), F.lit("unknown")).alias("report_type"), get("generated_at").alias("generated_at"),
        F.coalesce(get("query"), F.lit("")).alias("query"), F.size(frontmatter.items(F.col("front"), "sources")).alias("sources"),
    )
    out = out if kind is None else out.where(F.col("report_type") == kind)
    out = out.orderBy(F.col("generated_at").desc_nulls_last(), path_col)
    return out if limit is None else out.limit(limit)


def newest(df: DataFrame, at: str, key: str, limit: int = 50) -> DataFrame:
    """The newest rows first, rows without a time last, ties by key."""
    return df.orderBy(F.col(at).desc_nulls_last(), key).limit(limit)


def statistics(df: DataFrame, kind: str, at: str) -> DataFrame:
    """(kind, reports, last): how many of each kind there are and when the newest was made."""
    return df.groupBy(kind).agg(F.count("*").alias("reports"), F.max(at).alias("last"))


def period_name(at: Column, kind: str) -> Column:
    """Day, ISO week or month of a time, as reports are named."""
    if kind == "weekly":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), at), F.weekofyear(at))
    return F.date_format(at, PERIODS[kind])


def roll_up(days: DataFrame, kind: str, day: str = "day", n: str = "n") -> DataFrame:
    """(period, days, n, busiest) of weeks or months from daily counts, so that a longer report needs no more than the shorter ones."""
    return days.groupBy(period_name(F.to_date(day), kind).alias("period")).agg(F.count("*").alias("days"), F.sum(n).alias("n"), F.max(n).alias("busiest"))


def prompts(essences: DataFrame, kind: str, at: str, title: str, summary: str, most: int = 20, chars: int = 300) -> DataFrame:
    """(period, prompt) for the reports of a kind: the task, and the newest ``most`` summaries of each period, each cut to ``chars`` characters.

    Only that many per period reach its row: they are chosen by a window whose limit is applied before its shuffle.
    """
    from pyspark.sql import Window as W

    rows = essences.where(F.col(at).isNotNull()).select(period_name(F.col(at), kind).alias("period"), F.col(at).alias("t"), F.col(title).alias("title"), F.substring(summary, 1, chars).alias("s"))
    w = W.partitionBy("period").orderBy(F.desc("t"), "title", "s")
    top = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most)
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("Untitled")), F.lit(": "), F.coalesce("s", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))["line"]
    task = f"Write a {kind} report on what follows. Name topics, connections and open questions.\n\n"
    return top.groupBy("period").agg(F.concat(F.lit(task + "Period: "), F.first("period"), F.lit("\n"), F.array_join(lines, "\n")).alias("prompt"))


def concat_sources(sources: DataFrame, group: str, order: str, text: str, most_bytes: int = 500 * 1024) -> DataFrame:
    """(group, text, truncated): the sources of each group in their order, up to ``most_bytes``; the one that would exceed it is cut there.

    The limit is that of a model's input. Sources beyond it are dropped before they are put together.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(group).orderBy(order)
    rows = sources.where(F.col(text).isNotNull()).select(group, order, F.col(text).alias("t"), F.octet_length(text).alias("n"))
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = rows.where(F.col("before") < most_bytes)
    # cut in bytes, without half a character at the end
    raw = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode("t", "UTF-8"), F.lit(1), (F.lit(most_bytes) - F.col("before")).cast("int")).cast("string")), "\ufffd+$", "")
    part = F.when(F.col("before") + F.col("n") > most_bytes, raw).otherwise(F.col("t"))
    return kept.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(order, part.alias("p"))))["p"], "\n\n").alias("text"), (F.max(F.col("before") + F.col("n")) > most_bytes).alias("truncated")
    )


def _relations(c: Column) -> Column:
    """Relationships as ``from→type→to``, to be compared like list items."""
    return F.transform(F.coalesce(c, F.array().cast("array<struct<from:string,to:string,type:string>>")), lambda r: F.concat_ws("→", r["from"], r["type"], r["to"]))


def compare_summaries(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with columns ``a`` and ``b`` (structs with summary, the lists of LISTS and relationships) with what sets them apart.

    Added columns: unchanged, complements, conflicts (counts), can_merge, and ``diffs``, an array of (field, kind, only_a, only_b). Items are compared in lower
    case and trimmed; a field is added, removed or changed. Only two different summaries are a conflict.
    """
    text = lambda s: F.coalesce(F.col(s)["summary"], F.lit(""))
    x, y = text(a), text(b)
    unchanged, complements = (x == y).cast("int"), ((x == "") != (y == "")).cast("int")
    conflicts = ((x != y) & (x != "") & (y != "")).cast("int")
    one = lambda field, p, q: F.struct(F.lit(field).alias("field"), F.when(F.size(p) == 0, "added").when(F.size(q) == 0, "removed").otherwise("changed").alias("kind"), p.alias("only_a"), q.alias("only_b"))
    entries = [F.when(x != y, one("summary", F.filter(F.array(x), lambda v: v != ""), F.filter(F.array(y), lambda v: v != "")))]
    for field in (*LISTS, "relationships"):
        p, q = F.col(a)[field], F.col(b)[field]
        if field == "relationships":
            p, q = _relations(p), _relations(q)
        common, left, right = diff_lists(p, q)
        unchanged, complements = unchanged + F.size(common), complements + F.size(left) + F.size(right)
        entries.append(F.when((F.size(left) > 0) | (F.size(right) > 0), one(field, left, right)))
    out = pairs.withColumn("unchanged", unchanged).withColumn("complements", complements).withColumn("conflicts", conflicts)
    return out.withColumn("can_merge", (F.col("conflicts") == 0) & (F.col("complements") > 0)).withColumn("diffs", F.array_compact(F.array(*entries)))


def merge_summaries(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with ``merged``: the first summary unless the second is more than a fifth longer, and the items of both in every list and relationship once."""
    fields = [merge_summary(F.col(a)["summary"], F.col(b)["summary"]).alias("summary")]
    fields += [merge_lists(F.col(a)[f], F.col(b)[f]).alias(f) for f in LISTS]
    fields.append(merge_lists(_relations(F.col(a)["relationships"]), _relations(F.col(b)["relationships"])).alias("relationships"))
    return pairs.withColumn("merged", F.struct(*fields))


def diff_text(unchanged: Column, complements: Column, conflicts: Column, can_merge: Column, diffs: Column | None = None, shown: int = 3) -> Column:
    """A comparison for reading; with ``diffs`` each field with up to ``shown`` of its items on either side and how many more there are."""
    head = F.format_string("Diff Summary: %d unchanged, %d complementary, %d conflicting\n  Can merge: %s\n  Conflicts: %d\n  Complementary: %d\n  Unchanged: %d", unchanged, complements, conflicts, can_merge.cast("string"), conflicts, complements, unchanged)
    if diffs is None:
        return head
    mark = lambda d: F.when(d["kind"] == "added", "+").when(d["kind"] == "removed", "-").otherwise("≠")
    side = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n      {name}: "), F.array_join(F.slice(items, 1, shown), ", "), F.when(F.size(items) > shown, F.format_string(" (+%d more)", F.size(items) - shown)).otherwise("")))
    lines = F.transform(diffs, lambda d: F.concat(F.lit("  ["), mark(d), F.lit("] "), d["field"], F.coalesce(side("A", d["only_a"]), F.lit("")), F.coalesce(side("B", d["only_b"]), F.lit(""))))
    return F.when(F.size(diffs) > 0, F.concat(head, F.lit("\n\nDetails:\n"), F.array_join(lines, "\n"))).otherwise(head)
