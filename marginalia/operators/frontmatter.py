"""Frontmatter as YAML, and one parse of a whole note."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import yaml
from marginalia.operators import markdown

BLOCK = re.compile(r"---\n?(.*?)\n---(?:\n|$)", re.S)


def split_note(text: str) -> tuple[str | None, str]:
    """(frontmatter, body): the block between leading ``---`` lines, or None, and what follows without leading line breaks."""
    m = BLOCK.match(text)
    return (m.group(1), text[m.end() :].lstrip("\n")) if m else (None, text)


def read_front(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, front, body, error): frontmatter as a JSON object and the text below it.

    Nested mappings, block and flow lists and dates (as ISO text) are kept. A note without frontmatter has an empty object; malformed YAML,
    or YAML that is no mapping, gives an empty object and its ``error``; a null text gives nulls. Row by row, in Arrow batches.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fronts, bodies, errors = [], [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if text is None:
                    fronts.append(None), bodies.append(None), errors.append(None)
                    continue
                front, body = split_note(text.replace("\r\n", "\n"))
                found, error = {}, None
                if front is not None:
                    try:
                        found = yaml.load(front)
                        if found is None:
                            found = {}
                        if not isinstance(found, dict):
                            found, error = {}, "frontmatter is no mapping"
                    except yaml.BadYaml as e:
                        found, error = {}, str(e)
                fronts.append(json.dumps(found, ensure_ascii=False)), bodies.append(body), errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fronts, pa.string()), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], [id_col, "front", "body", "error"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, front string, body string, error string")


def field(front: Column, path: str) -> Column:
    """A scalar of the object by its path (``a.b``), as text; null if it is missing."""
    return F.get_json_object(front, "$." + path)


def items(front: Column, path: str) -> Column:
    """A list of the object as an array of text: a list's items, a comma list's parts, one item for another scalar, none if it is missing."""
    raw = F.get_json_object(front, "$." + path)
    listed = F.from_json(raw, "array<string>")
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(raw.startswith("["), listed).otherwise(parts), F.array().cast("array<string>"))


def parse_notes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, front, title, body, links, tags, embeds, headings, error) of each note in one pass.

    ``links`` are (target, heading, alias, is_embed, start, end) in the body, ``headings`` (level, text, slug). The title is the frontmatter's, else
    the first heading's. Tags are those of the text and of the frontmatter's list, each once, in order.
    """
    rows = read_front(df, id_col, text_col)
    body = F.col("body")
    heads = markdown.heading_structs(body)
    both = F.array_distinct(F.concat(F.transform(items(F.col("front"), "tags"), lambda t: F.lower(t)), markdown.tags(body)))
    return rows.select(
        id_col, "front", F.coalesce(field(F.col("front"), "title"), F.try_element_at(heads, F.lit(1))["text"]).alias("title"), "body", markdown.link_structs(body).alias("links"),
        both.alias("tags"), markdown.embeds(body).alias("embeds"), heads.alias("headings"), "error",
    )
