"""Sentence and word chunkers as folds over arrays, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import sentences

_STATE = "struct<done:array<string>,cur:string>"


def _fold(parts: Column, most: int, overlap: int, carry, split: bool) -> Column:
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")).cast(_STATE)

    def step(s: Column, p: Column) -> Column:
        flush = (s["cur"] != "") & (F.length(s["cur"]) + F.length(p) > most)
        done = F.when(flush, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"])
        cur = F.when(flush, carry(s["cur"], overlap)).otherwise(s["cur"])
        alone = (cur == "") & (F.length(p) > most)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
        return F.struct(
            F.when(alone, F.concat(done, pieces if split else F.array(p))).otherwise(done).alias("done"),
            F.when(alone, "").when(cur == "", p).otherwise(F.concat(cur, F.lit(" "), p)).alias("cur"),
        )

    end = lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"])))
    return F.aggregate(parts, zero, step, end)


def _last_sentence(cur: Column, overlap: int) -> Column:
    """What follows the last full stop and blank in the tail of ``overlap`` characters, else the last ``! ``, else ``? ``."""
    tail = F.right(cur, F.lit(overlap))
    after = lambda mark: F.when(F.contains(tail, F.lit(mark)), F.element_at(F.split(tail, mark.replace("?", "[?]").replace(".", "[.]")), -1))
    return F.coalesce(after(". "), after("! "), after("? "), F.lit("")) if overlap > 0 else F.lit("")


def _last_words(cur: Column, overlap: int) -> Column:
    return F.when(F.lit(overlap) > 0, F.regexp_extract(F.right(cur, F.lit(overlap)), r"(?:^|\s)(\S.*)$", 1)).otherwise("")


def sentence_chunks(df: DataFrame, id_col: str, text_col: str, most: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, total_chunks, text): sentences packed greedily into at most ``most`` characters.

    A chunk starts with the last sentence of the one before, if it begins within its last ``overlap`` characters, and
    may exceed ``most`` by that; a sentence longer than ``most`` that starts a chunk is split into chunks of ``most`` characters. A text of white space
    is one chunk; null and empty texts give no row.
    """
    text = F.col(text_col)
    found = _fold(sentences(text), most, overlap, _last_sentence, True)
    return _rows(df, id_col, F.when((F.size(sentences(text)) == 0) & (text != ""), F.array(F.substring(text, 1, most))).otherwise(found))


def word_chunks(df: DataFrame, id_col: str, text_col: str, most: int = 500, overlap: int = 50) -> DataFrame:
    """The same with words as units; no word is lost or split, so one longer than ``most`` makes a longer chunk."""
    parts = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    return _rows(df, id_col, _fold(parts, most, overlap, _last_words, False))


def chunk_document(df: DataFrame, id_col: str, text_col: str, most: int = 500, overlap: int = 50, sentences_whole: bool = True, splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """``sentence_chunks`` or, without ``sentences_whole``, ``word_chunks``. ``splitter`` gives the sentences of a text otherwise (a model's pandas UDF, say)."""
    if not sentences_whole:
        return word_chunks(df, id_col, text_col, most, overlap)
    if splitter is None:
        return sentence_chunks(df, id_col, text_col, most, overlap)
    return _rows(df, id_col, _fold(splitter(F.col(text_col)), most, overlap, _last_sentence, True))


def chunk_offsets(df: DataFrame, id_col: str, text_col: str, most: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, start_at, end_at): where the chunks of ``sentence_chunks`` lie in the text's sentences joined by blanks, counted from 0.

    A chunk is followed by its carried sentence or by the next one after a blank, or by the next part of a split sentence without one; which it is
    shows at its place in the joined text.
    """
    joined = F.array_join(sentences(F.col(text_col)), " ")
    chunks = _fold(sentences(F.col(text_col)), most, overlap, _last_sentence, True)

    def step(s: Column, c: Column) -> Column:
        # carried text ends where the last chunk ended; else the chunk begins there, after a blank if there is one
        prev, n = s["end"], F.length(c)
        carried = F.coalesce(F.length(_last_sentence(s["last"], overlap)), F.lit(0))
        plain = prev + F.when((prev > 0) & (F.substring(s["joined"], prev + 1, F.lit(1)) == " ") & (F.substring(s["joined"], prev + 2, n) == c), 1).otherwise(0)
        back = prev - carried
        start = F.when((carried > 0) & (F.substring(s["joined"], back + 1, n) == c), back).otherwise(plain)
        return F.struct(s["joined"].alias("joined"), (start + n).cast("int").alias("end"), c.alias("last"), F.concat(s["out"], F.array(F.struct(start.cast("int").alias("start"), (start + n).cast("int").alias("end")))).alias("out"))

    zero = F.struct(joined.alias("joined"), F.lit(0).alias("end"), F.lit("").alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    kind = "struct<joined:string,end:int,last:string,out:array<struct<start:int,end:int>>>"
    rows = df.select(F.col(id_col), F.posexplode(F.aggregate(chunks, zero.cast(kind), step, lambda s: s["out"])).alias("chunk_index", "o"))
    return rows.select(id_col, "chunk_index", F.col("o.start").alias("start_at"), F.col("o.end").alias("end_at"))


def _rows(df: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    out = df.select(F.col(id_col), chunks.alias("c")).select(id_col, F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "text"))
    return out.select(id_col, "chunk_index", "total_chunks", "text")
