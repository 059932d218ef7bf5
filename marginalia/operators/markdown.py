"""Markdown notes: sections, hierarchy, frontmatter, links, tags, embeds, headings and rewriting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import heading_slug, preview, word_count

# What is a link, a tag and an embed.
TAG = r"#([a-zA-Z][a-zA-Z0-9_/-]+)"
EMBED = r"!\[\[([^\]]+)\]\]"
ANY_LINK = r"(!?\[\[[^\]\|#]+(?:#[^\]\|]+)?(?:\|[^\]]+)?\]\])"
LINK = r"(!?)\[\[([^\]\|#]+)(?:#([^\]\|]+))?(?:\|([^\]]+))?\]\]"


def _lines(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_no, level, header, line_start, line_end, content): a section runs from its header to the next.

    Headers are lines of one to six ``#`` and a blank. Text before the first header is dropped. Line numbers start at 1;
    the content is the lines below the header. Notes without headers and null texts give no row. Row by row: the line
    array of one note is cut at its headers, nothing is shuffled.
    """
    numbered = F.transform(_lines(F.col(text_col)), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    heads = F.filter(numbered, lambda x: x["line"].rlike(r"^#{1,6}\s+\S"))
    base = df.select(F.col(id_col), _lines(F.col(text_col)).alias("__lines"), heads.alias("__heads"))
    each = base.select(id_col, "__lines", "__heads", F.posexplode("__heads").alias("__i", "__h"))
    end = F.coalesce(F.try_element_at("__heads", F.col("__i") + 2)["no"] - 1, F.size("__lines"))
    marks = F.regexp_extract(F.col("__h")["line"], r"^(#{1,6})\s", 1)
    return each.select(
        id_col,
        (F.col("__i") + 1).alias("section_no"),
        F.length(marks).alias("level"),
        F.trim(F.regexp_extract(F.col("__h")["line"], r"^#{1,6}\s+(.+)$", 1)).alias("header"),
        F.col("__h")["no"].alias("line_start"),
        end.alias("line_end"),
        F.array_join(F.slice("__lines", F.col("__h")["no"] + 1, end - F.col("__h")["no"]), "\n").alias("content"),
    )


def with_section_fields(df: DataFrame) -> DataFrame:
    """Add preview and word_count to sections."""
    return df.withColumn("content_preview", preview(F.col("content"))).withColumn("word_count", word_count(F.col("content")))


def parents(df: DataFrame, id_col: str, text_col: str, compat: bool = False) -> DataFrame:
    """(id, section_no, header, parent_header): the nearest earlier header of a smaller level.

    ``compat`` cuts the stack of open headers to ``level - 1`` entries by position instead, so that a skipped level
    makes a sibling the parent. One fold over the note's headers.
    """
    heads = F.filter(_lines(F.col(text_col)), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    parsed = F.transform(heads, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)).alias("l"), F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)).alias("t")))
    kind = "struct<open:array<struct<l:int,t:string>>,out:array<struct<t:string,p:string>>>"
    zero = F.struct(F.array().cast("array<struct<l:int,t:string>>").alias("open"), F.array().cast("array<struct<t:string,p:string>>").alias("out")).cast(kind)

    def step(s: Column, h: Column) -> Column:
        left = F.slice(s["open"], 1, h["l"] - 1) if compat else F.filter(s["open"], lambda o: o["l"] < h["l"])
        parent = F.try_element_at(left, F.lit(-1))["t"]
        return F.struct(F.concat(left, F.array(h)).alias("open"), F.concat(s["out"], F.array(F.struct(h["t"].alias("t"), parent.alias("p")))).alias("out"))

    rows = df.select(F.col(id_col), F.posexplode(F.aggregate(parsed, zero, step, lambda s: s["out"])).alias("i", "h"))
    return rows.select(id_col, (F.col("i") + 1).alias("section_no"), F.col("h.t").alias("header"), F.col("h.p").alias("parent_header"))


def frontmatter(c: Column) -> Column:
    """The block between leading ``---`` lines; empty if there is none."""
    return F.regexp_extract(c, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)


def body(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^---\n.*?\n---(?:\n+|$)", "")


def front_fields(c: Column) -> Column:
    """Flat ``key: value`` lines as a map; of repeated keys the last counts, other lines are ignored."""
    lines = F.filter(F.split(frontmatter(c), "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_][\w-]*)", 1).alias("k"), F.trim(F.regexp_replace(x, r"^[A-Za-z_][\w-]*\s*:\s*", "")).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def front_list(fields: Column, key: str) -> Column:
    """A bracketed or comma list among the fields as an array."""
    raw = F.regexp_replace(F.try_element_at(fields, F.lit(key)), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def link_structs(c: Column) -> Column:
    """Array of (target, heading, alias, is_embed, start, end) of every ``[[target#heading|alias]]``, in order; ``start`` counts characters from 0.

    The text between links is found by splitting at them, so repeated links have their own places.
    """
    found = F.regexp_extract_all(c, F.lit(ANY_LINK), F.lit(1))
    between = F.split(c, ANY_LINK.replace("(!?", "!?", 1)[:-1])
    none = lambda x: F.when(x != "", F.trim(x))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast("struct<at:int,out:array<int>>")
    # lengths only: the texts are not copied from step to step
    sizes = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("b"), F.transform(found, lambda x: F.length(x)).alias("f"))
    starts = F.aggregate(sizes, zero, lambda s, x: F.struct((s["at"] + x["b"] + F.coalesce(x["f"], F.lit(0))).alias("at"), F.concat(s["out"], F.array(s["at"] + x["b"])).alias("out")), lambda s: s["out"])

    def one(x: Column) -> Column:
        link, start = x["f"], x["s"]
        part = lambda i: F.regexp_extract(link, LINK, i)
        return F.struct(F.trim(part(2)).alias("target"), none(part(3)).alias("heading"), none(part(4)).alias("alias"), link.startswith("!").alias("is_embed"), start.alias("start"), (start + F.length(link)).alias("end"))

    return F.transform(F.arrays_zip(found.alias("f"), F.slice(starts, 1, F.size(found)).alias("s")), one)


def link_positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, link_no, target, start_at, end_at) of every link, in characters from 0."""
    rows = df.where(F.contains(F.col(text_col), F.lit("[["))).select(F.col(id_col), F.posexplode(link_structs(F.col(text_col))).alias("i", "l"))
    return rows.select(id_col, (F.col("i") + 1).alias("link_no"), "l.target", F.col("l.start").alias("start_at"), F.col("l.end").alias("end_at"))


def wikilinks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, link_no, target, heading, alias, is_embed) of every ``[[target#heading|alias]]``, in order."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(ANY_LINK), F.lit(1))
    rows = df.where(F.contains(F.col(text_col), F.lit("[["))).select(F.col(id_col), F.posexplode(found).alias("i", "l"))
    part = lambda i: F.regexp_extract("l", LINK, i)
    none = lambda c: F.when(c != "", F.trim(c))
    return rows.select(
        id_col, (F.col("i") + 1).alias("link_no"), F.trim(part(2)).alias("target"), none(part(3)).alias("heading"), none(part(4)).alias("alias"), F.col("l").startswith("!").alias("is_embed"),
    )


def tags(c: Column) -> Column:
    """Tags without ``#``, lower case, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(c, F.lit(TAG), F.lit(1)), lambda t: F.lower(t))


def embeds(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(EMBED), F.lit(1))


def link_context(df: DataFrame, id_col: str, text_col: str, reach: int = 100) -> DataFrame:
    """(id, link_no, context): ``reach`` characters on both sides of a link, white space collapsed.

    The text between links is found by splitting at them, so offsets need no search for repeated links.
    """
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(r"(\[\[[^\]]+\]\])"), F.lit(1))
    between = F.split(text, r"\[\[[^\]]+\]\]")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast("struct<at:int,out:array<int>>")
    starts = F.aggregate(
        F.arrays_zip(between.alias("b"), found.alias("f")), zero,
        lambda s, x: F.struct((s["at"] + F.length(x["b"]) + F.coalesce(F.length(x["f"]), F.lit(0))).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(x["b"]))).alias("out")),
        lambda s: s["out"],
    )
    rows = df.select(F.col(id_col), text.alias("__t"), F.posexplode(F.arrays_zip(found.alias("f"), F.slice(starts, 1, F.size(found)).alias("s"))).alias("i", "x"))
    begin = F.greatest(F.col("x.s") - reach, F.lit(0))
    end = F.least(F.col("x.s") + F.length("x.f") + reach, F.length("__t"))
    return rows.select(id_col, (F.col("i") + 1).alias("link_no"), F.trim(F.regexp_replace(F.substring(F.col("__t"), begin + 1, end - begin), r"\s+", " ")).alias("context"))


def headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, heading_no, level, text, slug) of every line that starts with ``#``; no blank is needed, any level counts."""
    found = F.filter(_lines(F.col(text_col)), lambda x: x.rlike(r"^#+\s*[^#\s]"))
    rows = df.select(F.col(id_col), F.posexplode(found).alias("i", "x"))
    text = F.trim(F.regexp_replace("x", "^#+", ""))
    return rows.select(id_col, (F.col("i") + 1).alias("heading_no"), F.length(F.regexp_extract("x", "^(#+)", 1)).alias("level"), text.alias("text"), heading_slug(text).alias("slug"))


def heading_structs(c: Column) -> Column:
    """Array of (level, text, slug) of the lines that ``headings`` finds."""
    found = F.filter(_lines(c), lambda x: x.rlike(r"^#+\s*[^#\s]"))

    def one(x: Column) -> Column:
        text = F.trim(F.regexp_replace(x, "^#+", ""))
        return F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), text.alias("text"), heading_slug(text).alias("slug"))

    return F.transform(found, one)


def _link_to(target: str) -> str:
    return rf"\[\[{re.escape(target)}(#[^\]\|]+)?(\|[^\]]+)?\]\]"


def count_links(c: Column, target: str) -> Column:
    """How many links to ``target`` a text has, with or without heading and alias."""
    return F.regexp_count(c, F.lit(_link_to(target)))


def add_link(c: Column, target: str, context: str = "") -> Column:
    """Append ``[[target]]`` (after ``context``) as a paragraph of its own, unless the text has a link to it already."""
    link = f"{context} [[{target}]]" if context else f"[[{target}]]"
    return F.when(c.rlike(_link_to(target)), c).otherwise(F.concat(F.regexp_replace(c, r"\n+$", ""), F.lit("\n\n" + link)))


def remove_links(c: Column, target: str) -> Column:
    """Cut out links to ``target``; runs of three line breaks or more that this leaves become two. Embeds are left as they are."""
    cut = F.regexp_replace(c, r"(?<!!)" + _link_to(target), "")
    return F.when(c == cut, c).otherwise(F.regexp_replace(cut, r"\n{3,}", "\n\n"))


def append_text(c: Column, text: str, end: bool = True) -> Column:
    """Add a paragraph at the end, or at the start below the frontmatter."""
    if end:
        return F.concat(F.regexp_replace(c, r"\n+$", ""), F.lit("\n\n" + text + "\n"))
    front = F.regexp_extract(c, r"(?s)^(---\n.*?\n---(?:\n+|$))", 1)
    return F.concat(front, F.lit(text + "\n\n"), F.substring(c, F.length(front) + 1, F.length(c)))


def move_note(notes: DataFrame, old: str, new: str, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """The notes with the one at ``old`` moved to ``new`` and all links to its name pointing to the new name; ``links_changed`` counts them.

    Nothing is moved if ``new`` is taken: then every row is as it was. Names are file names without ending; equal names need no relinking.
    """
    stem = lambda p: re.sub(r"\.md$", "", p.rsplit("/", 1)[-1])
    taken = notes.agg(F.coalesce(F.bool_or(F.col(path_col) == new), F.lit(False)).alias("__taken"), F.coalesce(F.bool_or(F.col(path_col) == old), F.lit(False)).alias("__there"))
    go = F.col("__there") & ~F.col("__taken")
    rows = notes.join(F.broadcast(taken))  # one row
    text, n = F.col(text_col), count_links(F.col(text_col), stem(old))
    other = F.lit(stem(old) != stem(new))
    return rows.select(
        *[F.when(go & (F.col(path_col) == old), F.lit(new)).otherwise(F.col(path_col)).alias(path_col) if c == path_col
          else F.when(go & other, relink(text, stem(old), stem(new))).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in notes.columns],
        F.when(go & other, n).otherwise(F.lit(0)).alias("links_changed"),
    )


def title_sections(c: Column) -> Column:
    """Map of the texts below ``## `` headings by their titles, what comes before the first under ``_header``; of equal titles the last counts.

    Null gives null, a text without such headings its whole under ``_header``.
    """
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(c, r"\r\n?", "\n")), r"\n##[ \t]+")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(strip(F.regexp_extract(p, r"^([^\n]*)", 1)).alias("key"), strip(F.regexp_replace(p, r"^[^\n]*", "")).alias("value")))
    every = F.concat(F.array(F.struct(F.lit("_header").alias("key"), strip(F.element_at(parts, 1)).alias("value"))), rest)
    last = F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def relink(c: Column, old: str, new: str) -> Column:
    """Point links from ``old`` to ``new``; heading and alias stay."""
    return F.regexp_replace(c, rf"\[\[{re.escape(old)}((?:#[^\]\|]+)?(?:\|[^\]]+)?)\]\]", "[[" + new.replace("\\", "\\\\").replace("$", "\\$") + "$1]]")


def insert_after_heading(c: Column, heading: str, text: str) -> Column:
    """Insert a line below the first heading with this text; without one, at the end."""
    lines = _lines(c)
    at = F.array_position(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^#+\s*", "")) == F.lit(heading)), True).cast("int")
    spliced = F.concat(F.slice(lines, 1, at), F.array(F.lit(text)), F.slice(lines, at + 1, F.size(lines)))
    return F.array_join(F.when(at > 0, spliced).otherwise(F.concat(lines, F.array(F.lit(text)))), "\n")


def page_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page_no, header, line_start, line_end): extracted text cut at ``## Page n`` lines.

    The header is the first non-empty of a page's first five lines with at most 100 characters, else ``Page n``; line
    numbers are synthetic, a hundred per page.
    """
    pages = F.filter(F.split(F.col(text_col), r"## Page \d+"), lambda p: F.regexp_replace(p, r"\s+", "") != "")
    rows = df.select(F.col(id_col), F.posexplode(pages).alias("i", "p"))
    first = F.filter(F.slice(F.split(F.regexp_replace("p", r"^\s+", ""), "\n"), 1, 5), lambda x: (F.trim(x) != "") & (F.length(F.trim(x)) <= 100))
    return rows.select(
        id_col, (F.col("i") + 1).alias("page_no"), F.coalesce(F.trim(F.try_element_at(first, F.lit(1))), F.concat(F.lit("Page "), F.col("i") + 1)).alias("header"),
        (F.col("i") * 100 + 1).alias("line_start"), ((F.col("i") + 1) * 100).alias("line_end"),
    )


def paragraph_sections(df: DataFrame, id_col: str, text_col: str, name: str = "OCR Section") -> DataFrame:
    """(id, paragraph_no, header, words): text cut at blank lines."""
    parts = F.filter(F.split(F.col(text_col), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\s+", "") != "")
    rows = df.select(F.col(id_col), F.posexplode(parts).alias("i", "p"))
    return rows.select(id_col, (F.col("i") + 1).alias("paragraph_no"), F.concat(F.lit(name + " "), F.col("i") + 1).alias("header"), word_count(F.col("p")).alias("words"))
