"""How distinctive a term is for a record: log-entropy weights."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import values
from marginalia.operators.skew import by_repetition, skew_join
from marginalia.session import stored

LETTERS = re.compile(r"[^\W\d_]+")
#: Terms whose statistics are broadcast at most; beyond, records and statistics are joined by a split shuffle.
BROADCAST_TERMS = 1_000_000


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters, in lower case."""
    found = LETTERS.findall(text.lower())
    if text.isascii():
        return found
    # the class above also has numerals that are no digits
    return [w for f in found for w in ([f] if f.isalpha() else re.findall(r"\S+", "".join(c if c.isalpha() else " " for c in f)))]


def keyword_list(raw: str | None) -> list[str]:
    """The keywords of a JSON array or a comma list, in lower case and trimmed."""
    if not raw or not raw.strip():
        return []
    if raw.lstrip().startswith("["):
        try:
            return [str(k).strip().lower() for k in json.loads(raw) if k is not None]
        except ValueError:
            pass
    return [k.strip().lower() for k in raw.split(",") if k.strip()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("term", pa.string()), ("in_text", pa.int32()), ("in_keywords", pa.int32()), ("keyword", pa.bool_())]))
    for b in batches:
        ids, lists = [], []
        for key, text, raw in zip(values(b.column(0)), values(b.column(1)), values(b.column(2))):
            keys = keyword_list(raw)
            here, there, whole = Counter(terms_of(text or "")), Counter(t for k in keys for t in terms_of(k)), set(keys)
            ids.append(key)
            lists.append([{"term": t, "in_text": here[t], "in_keywords": there[t], "keyword": t in whole} for t in (here | there)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lists, kind)], ["id", "terms"])


def term_counts(df: DataFrame, id_col: str = "id", text_col: str = "content_full", keywords_col: str = "keywords") -> DataFrame:
    """(id, term, in_text, in_keywords, keyword): one row per record and term.

    Null texts and keywords have no terms; rows without id are left out; repeated rows of an id count once, differing
    ones are added up. Counts are made row by row; only rows whose id is repeated are shuffled before.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(keywords_col).alias("keywords")).where(F.col("id").isNotNull())
    once, rest = by_repetition(rows, "id")
    schema = "id string, terms array<struct<term:string,in_text:int,in_keywords:int,keyword:boolean>>"
    counts = lambda x: x.mapInArrow(_counted, schema).select("id", F.inline("terms"))
    added = counts(rest.distinct()).groupBy("id", "term").agg(*[F.sum(c).cast("int").alias(c) for c in ("in_text", "in_keywords")], F.max("keyword").alias("keyword"))
    return counts(once).unionByName(added)


def statistics(counts: DataFrame, tf: Column | None = None) -> DataFrame:
    """(term, records, text_records, total, logs): aggregated with a map-side combine, one row per term. ``tf`` is the frequency that counts, by default all occurrences."""
    tf = (F.col("in_text") + F.col("in_keywords") if tf is None else tf).cast("double")
    return counts.groupBy("term").agg(
        F.count_if(tf > 0).alias("records"), F.count_if(F.col("in_text") > 0).alias("text_records"), F.sum(tf).alias("total"), F.sum(F.when(tf > 0, tf * F.ln(tf))).alias("logs")
    )


def distinctness(records: int) -> Column:
    """One minus the entropy of a term's spread over records divided by ln(records), at least 0; 1 with one record or none."""
    if records <= 1:
        return F.lit(1.0)
    return F.greatest(F.lit(1.0) - (F.ln("total") - F.col("logs") / F.col("total")) / F.lit(log(records)), F.lit(0.0))


def with_statistics(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Counts joined to their term's statistics; a term that many records share is no hot key."""
    return counts.join(F.broadcast(stats), "term") if stats.count() <= BROADCAST_TERMS else skew_join(counts, stats, ["term"], "inner")


def log_entropy(counts: DataFrame, stats: DataFrame, records: int, tf: Column | None = None) -> DataFrame:
    """Add ``weight``: ln(1 + tf) times the term's distinctness."""
    tf = F.col("in_text") + F.col("in_keywords") if tf is None else tf
    return with_statistics(counts, stats).withColumn("weight", F.ln(1.0 + tf) * distinctness(records))


def distinctive_terms(df: DataFrame, **columns: str) -> DataFrame:
    """(id, term, tf, records, weight) of every term of every record."""
    counts = stored(term_counts(df, **columns), "terms")
    records = counts.select("id").distinct().count()
    out = log_entropy(counts, stored(statistics(counts), "stats"), records)
    return out.select("id", "term", (F.col("in_text") + F.col("in_keywords")).alias("tf"), "records", "weight")


def rare_keywords(df: DataFrame, least: int = 3, records: tuple[int, int] = (2, 5), **columns: str) -> DataFrame:
    """(id, term, weight): terms with ``least`` occurrences in the text that are keywords and occur in the texts of few records, by their log-entropy weight.

    The weight is that of the texts' terms. The entropy of a term in k texts is at most ln(k), so every case weighs at least ln(1 + least)
    times 1 - ln(k) / ln(texts) with the greatest k: terms and their rows below are dropped by weight, and what is left is checked exactly on the counts.
    """
    counts = stored(term_counts(df, **columns), "terms")
    in_text = F.col("in_text")
    n = counts.where(in_text > 0).select("id").distinct().count()
    bound = max(0.0, 1 - log(records[1]) / log(n)) - 1e-9 if n > 1 else 0.0
    stats = statistics(counts, in_text).where(F.col("total") > 0)
    telling = stored(stats.where(distinctness(n) >= bound), "stats")
    rows = log_entropy(counts.where((in_text > 0) & F.col("keyword")), telling, n, in_text)
    cases = rows.where(F.col("weight") >= F.lit(log(1 + least)) * bound - 1e-9)
    return cases.where((in_text >= least) & F.col("text_records").between(*records)).select("id", "term", "weight")
