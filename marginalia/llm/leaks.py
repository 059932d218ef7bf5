"""Evaluation passages inside training documents: n-gram windows against a broadcast set of the items' n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import values
from marginalia.operators.skew import skew_join
from marginalia.session import stored

#: A word is a maximal run of letters and digits, in lower case.
WORD = re.compile(r"[^\W_]+")
#: Characters of items whose n-grams go to every task at most; those of more items are joined.
PASS_CHARS = 2_000_000
#: Logarithm of the number of bits that say which hashes some n-gram has (16 MB).
BITS = 27
#: Remembered words per worker.
REMEMBER = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Documents with spans, and spans in them, that are broadcast at most.
BROADCAST_DOCS = 500_000
#: Texts are put together up to so many words before they are compared.
TOGETHER = 200_000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Grams:
    """All n-grams of the items' texts: word numbers, hashes, and the items of each."""

    def __init__(self, items: list[tuple[int, str, str]], n: int):
        self.n, self.vocabulary = n, {}
        grams: dict[tuple[int, ...], set[int]] = {}
        self.parts: list[tuple[int, str, int]] = []
        for item, part, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            at = len(self.parts)
            self.parts.append((item, part, len(ids)))
            for i in range(len(ids) - n + 1):
                grams.setdefault(tuple(ids[i : i + n]), set()).add(at)
        self.ids = np.array(list(grams), dtype=np.int64).reshape(-1, n)
        hashes = self.hash(self.ids.ravel(), np.arange(len(self.ids)) * n)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], self.ids[order]
        owners = [sorted(v) for v in grams.values()]
        self.owners = [owners[i] for i in order]
        # most windows fall through this table of hash prefixes
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hash(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        h = np.zeros(len(starts), dtype=np.uint64)
        unsigned = ids.astype(np.uint64) + np.uint64(1)
        for k in range(self.n):
            h = (h ^ unsigned[starts + k]) * MULTIPLIER
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(position, gram) of the windows that are grams; -1 is no word of any item and ends a run."""
        if len(ids) < self.n or not len(self.hashes):
            return []
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        starts = np.nonzero(known[self.n :] - known[: -self.n] == self.n)[0]
        if not len(starts):
            return []
        h = self.hash(ids, starts)
        near = self.bits[(h >> np.uint64(44)).astype(np.int64)]
        starts, h = starts[near], h[near]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        out = []
        for i in np.nonzero(hi > lo)[0]:
            window = ids[starts[i] : starts[i] + self.n]
            out += [(int(starts[i]), g) for g in range(lo[i], hi[i]) if np.array_equal(self.ids[g], window)]
        return out


SPANS = "id bigint, item_id bigint, part string, item_words int, matched_words int, longest_words int, spans array<struct<start:int,end:int>>"


def leaks(
    docs: DataFrame, items: DataFrame, n: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    parts: tuple[str, ...] = ("question", "passage"),
) -> DataFrame:
    """Every document and item text with at least ``n`` consecutive words in common.

    Result, one row per document (id and text), item and part: id, item_id, part, item_words (words of the item's text),
    matched_words (document words covered by common windows), longest_words (longest covered run), spans
    (character ranges of the covered runs). Windows are compared by hash first and then word by word, so no pair
    is reported in error. Null or short texts match nothing; repeated rows count once; an empty table
    on either side gives an empty result. The documents are read once. Up to PASS_CHARS characters of items, their n-grams go to every task and
    no window is shuffled. Beyond, the n-grams are a table: every task gets a table of bits, of bounded size, of their hashes, and the windows
    that pass it are joined with them.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    texts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in parts])).alias("x")
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("item_id"), texts).select("item_id", "x.part", "x.text").where(F.length("text") > 0).distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > PASS_CHARS:
        return _joined(rows, asked, n).distinct()
    grams = Grams([(r[0], r[1], r[2]) for r in asked.orderBy("item_id", "part", "text").collect()], n)  # at most PASS_CHARS characters
    if not len(grams.hashes):
        return docs.sparkSession.createDataFrame([], SPANS)
    return rows.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(grams)), SPANS).distinct()


def window_hashes(found: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """Hashes of the windows of ``n`` words; ``known`` remembers the words' own."""
    if len(found) < n:
        return np.zeros(0, np.uint64)
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    each = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    h = np.zeros(len(found) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ each[k : k + len(h)]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def _item_grams(n: int):
    """Rows (h, gram, item_id, part, item_words) of rows (item_id, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for item, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), values(b.column(2))):
                found = words(text)
                h = window_hashes(found, n, known)
                if len(known) > REMEMBER:
                    known.clear()
                grams = [" ".join(found[i : i + n]) for i in range(len(h))]
                m = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(grams, pa.string()), pa.array([item] * m, pa.int64()), pa.array([part] * m, pa.string()), pa.array([len(found)] * m, pa.int32())], ["h", "gram", "item_id", "part", "item_words"])

    return run


def _windows(n: int, shared):
    """Rows (h, gram, id, copy, at, start, end) of the documents' windows whose bit is set; ``copy`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = shared.value
        known: dict[str, int] = {}
        kind = pa.schema([("h", pa.int64()), ("gram", pa.string()), ("id", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), values(b.column(1))):
                found = words(text)
                h = window_hashes(found, n, known)
                if len(known) > REMEMBER:
                    known.clear()
                spot = h >> np.uint64(64 - BITS)
                at = np.nonzero((bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1))[0]
                if not len(at):
                    continue
                where = _places(text)
                copy = np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64)
                m = len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[at].view(np.int64)), pa.array([" ".join(found[i : i + n]) for i in at.tolist()], pa.string()), pa.array([key] * m, pa.int64()), pa.array([int(copy)] * m, pa.int64()), pa.array(at.astype(np.int32)),
                    pa.array([where[i][0] for i in at.tolist()], pa.int32()), pa.array([where[i + n - 1][1] for i in at.tolist()], pa.int32()),
                ], schema=kind)

    return run


def _joined(rows: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """``leaks`` by a join of windows with n-grams; a gram that many documents share is split over tasks."""
    grams = stored(asked.mapInArrow(_item_grams(n), "h bigint, gram string, item_id bigint, part string, item_words int").distinct(), "grams")
    spots = grams.select(F.shiftrightunsigned("h", 64 - BITS).alias("s")).select(F.shiftrightunsigned("s", 6).alias("i"), F.expr("shiftleft(1L, cast(s & 63 AS int))").alias("v"))
    table = spots.groupBy("i").agg(F.bit_or("v").alias("v")).toArrow()  # at most 2 ** (BITS - 6) rows
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[table.column("i").to_numpy()] = table.column("v").to_numpy().view(np.uint64)
    found = rows.mapInArrow(_windows(n, rows.sparkSession.sparkContext.broadcast(bits)), "h bigint, gram string, id bigint, copy bigint, at int, start int, end int")
    hits = skew_join(stored(found, "windows"), grams, ["h", "gram"], "inner")
    # the windows that one document and one text of an item share
    each = hits.groupBy("id", "copy", "item_id", "part", "item_words").agg(F.array_sort(F.collect_set(F.struct("at", "start", "end"))).alias("w")).drop("copy")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matched, longest, spans = [], [], []
            for w in values(b.column(4)):
                joined: list[list[int]] = []
                for x in w:
                    if joined and x["at"] <= joined[-1][1]:
                        joined[-1][1], joined[-1][3] = x["at"] + n, x["end"]
                    else:
                        joined.append([x["at"], x["at"] + n, x["start"], x["end"]])
                matched.append(sum(r[1] - r[0] for r in joined))
                longest.append(max(r[1] - r[0] for r in joined))
                spans.append([{"start": r[2], "end": r[3]} for r in joined])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(matched, pa.int32()), pa.array(longest, pa.int32()), pa.array(spans, kind)], ["id", "item_id", "part", "item_words", "matched_words", "longest_words", "spans"])

    return each.select("id", "item_id", "part", "item_words", "w").mapInArrow(runs, SPANS)


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Grams = shared.value
        number = grams.vocabulary.get
        schema = pa.schema([
            ("id", pa.int64()), ("item_id", pa.int64()), ("part", pa.string()), ("item_words", pa.int32()), ("matched_words", pa.int32()),
            ("longest_words", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ])
        gap = [-1]
        for b in batches:
            found: list[dict] = []
            ids: list[int] = []
            begins: list[int] = []
            texts: list[tuple[int, str]] = []

            def settle() -> None:
                for doc, hits in _by_document(grams.hits(np.array(ids, dtype=np.int64)), np.array(begins)).items():
                    found.extend(_describe(grams, texts[doc][0], texts[doc][1], hits))
                ids.clear(), begins.clear(), texts.clear()

            for key, text in zip(b.column(0).to_pylist(), values(b.column(1))):
                begins.append(len(ids))
                texts.append((key, text))
                ids.extend([number(w, -1) for w in WORD.findall(text.lower())])
                ids.extend(gap)
                if len(ids) >= TOGETHER:
                    settle()
            settle()
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


def _by_document(hits: list[tuple[int, int]], begins: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for at, gram in hits:
        doc = int(np.searchsorted(begins, at, "right")) - 1
        out.setdefault(doc, []).append((at - int(begins[doc]), gram))
    return out


def _places(text: str) -> list[tuple[int, int]]:
    """Where the words of the lower-cased text lie in the text itself, though a letter may have another length in lower case."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    origin = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    return [(int(origin[s]), int(origin[e - 1]) + 1) for s, e in spans]


def _describe(grams: Grams, key: int, text: str, hits: list[tuple[int, int]]) -> Iterator[dict]:
    where = _places(text)
    starts: dict[int, list[int]] = {}
    for at, gram in hits:
        for owner in grams.owners[gram]:
            starts.setdefault(owner, []).append(at)
    for owner, ats in sorted(starts.items()):
        runs: list[list[int]] = []
        for at in sorted(set(ats)):
            if runs and at <= runs[-1][1]:
                runs[-1][1] = at + grams.n
            else:
                runs.append([at, at + grams.n])
        item, part, length = grams.parts[owner]
        yield {
            "id": key, "item_id": item, "part": part, "item_words": length, "matched_words": sum(e - s for s, e in runs),
            "longest_words": max(e - s for s, e in runs),
            "spans": [{"start": where[s][0], "end": where[e - 1][1]} for s, e in runs],
        }


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_share: float = 0.8) -> DataFrame:
    """Documents with leaked spans cut out: id, text, removed_chars, dropped.

    A document whose spans cover at least ``drop_share`` of its characters is dropped: its text is null. Documents
    without leaks keep their text. ``found`` is the result of ``leaks``; overlapping spans are merged. The spans are broadcast while the
    documents that have any are no more than BROADCAST_DOCS, so texts stay where they are; beyond, only these documents' ids and spans and the documents themselves are joined by a shuffle.
    """
    spans = stored(found.select("id", F.explode("spans").alias("s")).groupBy("id").agg(F.collect_set("s").alias("spans")), "spans")
    few = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    side = F.broadcast(spans) if max(few) <= BROADCAST_DOCS else spans
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(side, "id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone, drops = [], [], []
            for text, marks in zip(values(b.column(1)), values(b.column(2))):
                parts = merged_spans([(m["start"], m["end"]) for m in marks]) if marks and text else []
                n = sum(e - s for s, e in parts)
                dropped = bool(n) and n >= drop_share * len(text)
                if parts and not dropped:
                    ends = [0, *(e for _, e in parts)]
                    text = "".join(text[e:s] for e, s in zip(ends, [*(s for s, _ in parts), len(text)]))
                texts.append(None if dropped else text)
                gone.append(n)
                drops.append(dropped)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int32()), pa.array(drops, pa.bool_())], ["id", "text", "removed_chars", "dropped"])

    plain = rows.where(F.col("spans").isNull()).select("id", "text", F.lit(0).alias("removed_chars"), F.lit(False).alias("dropped"))
    leaked = rows.where(F.col("spans").isNotNull()).mapInArrow(cut, "id bigint, text string, removed_chars int, dropped boolean")
    return plain.unionByName(leaked).withColumnRenamed("id", id_col)
