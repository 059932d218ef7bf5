"""Keywords of texts, their dictionary and the bridge between both."""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marginalia.functions.text import keyword_tokens, umlauts, words
from marginalia.functions.wordlists import FIELD, GERMAN, SECTION
from marginalia.operators.skew import by_repetition


def token_rows(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, word, n, first) per record and distinct word; counted before the shuffle, as a record's words lie together."""
    rows = df.select(F.col(id_col), F.posexplode(tokens).alias("pos", "word"))
    return rows.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def _most_frequent(df: DataFrame, id_col: str, text_col: str, pattern: str, tokens: Column, keep: Column, stopwords: list[str], least: int, n: int) -> DataFrame:
    """(id, rank, word, n) of the ``n`` most frequent words of each record, ties by first occurrence.

    Counted inside the row, in Arrow batches, so no word is shuffled; only records whose id is repeated are taken together by a shuffle.
    """
    once, rest = by_repetition(df.select(id_col, text_col), id_col)
    stop = frozenset(stopwords)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        words = re.compile(pattern)
        for b in batches:
            ids, out = [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if text:
                    count = Counter(w for w in words.findall(text.lower()) if len(w) >= least and w not in stop)
                    # most_common keeps the order of first occurrence among equals
                    top = count.most_common() if len(count) <= n else heapq.nsmallest(n, ((-c, at, w) for at, (w, c) in enumerate(count.items())))
                    top = top if len(count) <= n else [(w, -c) for c, _, w in top]
                    ids += [i] * len(top)
                    out += [(r, w, c) for r, (w, c) in enumerate(top, 1)]
            ranks, names, counts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(ranks, pa.int32()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], [id_col, "rank", "word", "n"])

    near = once.mapInArrow(run, f"`{id_col}` {kind}, rank int, word string, n bigint")
    counted = token_rows(rest, id_col, tokens).where(keep & ~F.col("word").isin(stopwords))
    w = W.partitionBy(id_col).orderBy(F.desc("n"), "first")
    return near.unionByName(counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(id_col, "rank", "word", "n"))


def top_keywords(df: DataFrame, id_col: str, text_col: str, n: int = 10, least: int = 4, stopwords: list[str] | None = None) -> DataFrame:
    """(id, rank, word, n): the most frequent keywords of each record, ties by first occurrence.

    Null and empty texts give no row; repeated ids are taken together.
    """
    return _most_frequent(df, id_col, text_col, rf"(?<!\w)[a-zäöüß]{{{least},}}(?!\w)", keyword_tokens(F.col(text_col), least), F.lit(True), SECTION if stopwords is None else stopwords, least, n)


def handler_keywords(df: DataFrame, id_col: str, text_col: str, stopwords: list[str] | None = None, n: int = 20) -> DataFrame:
    """``top_keywords`` over all words of two characters or more; by default without the German and the field's stopwords."""
    return _most_frequent(df, id_col, text_col, r"\w+", words(F.col(text_col)), F.length("word") >= 2, GERMAN + FIELD if stopwords is None else stopwords, 2, n)


def dictionary(bridge: DataFrame) -> DataFrame:
    """(normalized, keyword, usage_count): one row per normalised keyword; its spelling is the smallest."""
    return bridge.groupBy(umlauts(F.col("word")).alias("normalized")).agg(F.min("word").alias("keyword"), F.count("*").alias("usage_count"))


def section_keywords(df: DataFrame, id_col: str, keywords: Column) -> DataFrame:
    """(id, normalized): each pair once."""
    return df.select(F.col(id_col), F.explode(keywords).alias("k")).select(id_col, umlauts(F.trim("k")).alias("normalized")).where(F.col("normalized") != "").distinct()


class Stopwords:
    """An editable list of stopwords; ``Stopwords()`` starts with those of the keyword handler."""

    def __init__(self, words: list[str] | None = None):
        self.words = dict.fromkeys(w.lower() for w in (GERMAN + FIELD if words is None else words))

    def add(self, *words: str) -> None:
        self.words.update(dict.fromkeys(w.strip().lower() for w in words if w.strip()))

    def remove(self, *words: str) -> None:
        for w in words:
            self.words.pop(w.strip().lower(), None)

    def list(self) -> list[str]:
        return sorted(self.words)

    def count(self) -> int:
        return len(self.words)


class Synonyms:
    """An editable map from terms, of one word or several, to their synonyms. ``load`` reads it from JSON files ({term: [synonym, ...]}), whose path is a parameter."""

    def __init__(self, table: dict[str, list[str]] | None = None):
        self.table: dict[str, list[str]] = {}
        for term, others in (table or {}).items():
            self.add(term, *others)

    @classmethod
    def load(cls, *paths: str) -> Synonyms:
        out = cls()
        for path in paths:
            with open(path, encoding="utf-8") as f:
                for term, others in json.load(f).items():
                    if isinstance(others, list):
                        out.add(term, *map(str, others))
        return out

    def add(self, term: str, *others: str) -> None:
        key = " ".join(term.lower().split())
        self.table[key] = list(dict.fromkeys([*self.table.get(key, []), *others]))

    def get(self, term: str) -> list[str]:
        return self.table.get(" ".join(term.lower().split()), [])

    def has(self, term: str) -> bool:
        return " ".join(term.lower().split()) in self.table

    def expand(self, df: DataFrame, query_col: str) -> DataFrame:
        """Add ``expanded``: each word of the query followed by its synonyms, then those of the terms of several words that the query contains, first occurrences only."""
        single = {k: v for k, v in self.table.items() if " " not in k}
        several = {k: v for k, v in self.table.items() if " " in k}
        none = F.array().cast("array<string>")
        table = F.create_map(*[x for k, v in single.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if single else None
        terms = F.filter(F.split(F.lower(F.col(query_col)), r"\s+"), lambda t: t != "")
        each = F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none)))) if single else terms
        padded = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
        more = [F.when(F.contains(padded, F.lit(f" {k} ")), F.array(*map(F.lit, v))).otherwise(none) for k, v in several.items()]
        return df.withColumn("expanded", F.array_join(F.array_distinct(F.concat(each, *more)), " "))


def expand(df: DataFrame, query_col: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """Add ``expanded`` by a plain map (see ``Synonyms.expand``)."""
    return Synonyms(synonyms).expand(df, query_col)
