"""Cutting long texts into pieces: content-defined landmarks snapped to natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import values
from marginalia.llm.tokens import BREAK, BREAKS, CLAUSE_END, COUNT, HASH, LENGTH, LONGEST, LOOK, SENTENCE_END, SPACED, TOKENIZER, WHITE, Tokens, tokens

#: Pre-tokens that decide a landmark's hash, and places within a landmark's reach that may be one.
WINDOW, CHANCES = 12, 8.0
#: A pre-token of more characters is first cut into parts of this length, as it may exceed a piece by itself.
LONG = 96
MIX = np.uint64(0xD6E8FEB86659FD93)
# strength of a boundary: before a heading, paragraph, line, sentence, clause, word, none
HEADING, PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, NONE = 6, 5, 4, 3, 2, 1, 0


def strengths(seen: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each pre-token, from their looks."""
    n = len(seen)
    white = (seen & WHITE) > 0
    breaks = ((seen & BREAK) > 0) + 2 * ((seen & BREAKS) > 0)
    before = np.zeros(n, np.int64)
    before[1:] = breaks[:-1]
    before[2:] += breaks[:-2] * white[1:-1]
    end = np.zeros(n, np.int64)
    end[1:] = seen[:-1]
    end[2:] = np.where(white[1:-1], seen[:-2], end[2:])
    opens = (seen & SPACED) > 0
    opens[1:] |= white[:-1]
    out = opens * (BLANK + ((end & CLAUSE_END) > 0) + 2 * ((end & SENTENCE_END) > 0))
    out[before == 1] = LINE
    out[before > 1] = PARAGRAPH
    out[(before >= 1) & ((seen & HASH) > 0)] = HEADING
    out[white] = NONE  # white space stays with what precedes it
    out[0] = HEADING
    return out


def landmarks(bits: np.ndarray, ends: np.ndarray, reach: float) -> np.ndarray:
    """Places whose hash of the last WINDOW pre-tokens is the least within ``reach`` tokens on both sides.

    Only places with a small hash, CHANCES of them within ``reach`` tokens on average, are looked at. Whether a place is a landmark
    depends on the text within ``reach`` and a window of it, and on nothing else.
    """
    n = len(bits)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((bits & 0xFFFFFFFF).astype(np.uint64), dtype=np.uint64)))
    at = np.arange(1, n)
    rolled = ((sums[at] - sums[np.maximum(at - WINDOW, 0)]) * MIX) >> np.uint64(40)
    at = at[rolled < (np.minimum(1.0, CHANCES * (ends[at] - ends[at - 1]) / reach) * (1 << 24)).astype(np.uint64)]
    hashes, place = rolled[at - 1], ends[at]
    least = np.ones(len(at), bool)
    for off in range(1, len(at)):
        near = place[off:] - place[:-off] <= reach
        if not near.any():
            break
        least[off:] &= ~(near & (hashes[:-off] <= hashes[off:]))  # of equal ones the first counts
        least[:-off] &= ~(near & (hashes[off:] < hashes[:-off]))
    return at[least]


def cuts(bits: np.ndarray, ends: np.ndarray, least: int, most: int) -> list[int]:
    """Starts of the pieces, as numbers of pre-tokens.

    Landmarks (``landmarks``, within a third of ``most``) are snapped to the nearest boundary of the greatest strength within
    a third of that, or a half where there is none but between words. They depend on the text around them only, so an edit moves none
    that is farther off. What lies between two of them and is longer than ``most`` tokens is cut further by itself (``_steps``).
    """
    strong = strengths(bits >> LOOK)
    reach = max(1.0, most / 3)
    snapped = set()
    for at in landmarks(bits, ends, reach).tolist():
        for part in (3, 2):
            a, z = np.searchsorted(ends, [ends[at] - reach / part, ends[at] + reach / part])
            a, z = max(int(a), 1), min(max(int(z), at + 1), len(bits))
            near = strong[a:z]
            if near.max() > BLANK:
                break
        best = a + np.nonzero(near == near.max())[0]
        snapped.add(int(best[np.argmin(np.abs(ends[best] - ends[at]))]))
    edge = reach / 3
    fixed = [0, *sorted(c for c in snapped if ends[c] >= edge and ends[-1] - ends[c] >= edge), len(bits)]
    return [c for a, z in zip(fixed, fixed[1:]) for c in _steps(ends, strong, a, z, least, most)]


def _steps(ends: np.ndarray, strong: np.ndarray, start: int, stop: int, least: int, most: int) -> list[int]:
    """Starts of pieces of at most ``most`` tokens in the stretch from ``start`` to ``stop``: each ends at the last strongest boundary that leaves
    it ``least`` tokens or more; text without any boundary is cut between pre-tokens."""
    out = [start]
    while ends[stop] - ends[start] > most and start + 1 < stop:
        lo = int(np.searchsorted(ends, ends[start] + least, "left"))
        hi = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
        if ends[stop] - ends[start] <= most + least:  # leave no crumb
            hi = min(hi, int(np.searchsorted(ends, ends[stop] - least / 2, "right")) - 1)
        lo = max(min(lo, hi), start + 1)
        hi = min(max(hi, lo), stop - 1)
        lo = min(lo, hi)
        near = strong[lo : hi + 1]
        start = lo + int(np.nonzero(near == near.max())[0][-1])
        out.append(start)
    return out


def _refined(t: Tokens, parts: list[str], most: int) -> list[str]:
    """Pre-tokens with the very long ones cut into parts of at most ``most`` tokens (one character at least)."""
    out: list[str] = []
    left = [p[i : i + LONG] for p in reversed(parts) for i in reversed(range(0, len(p), LONG))]
    while left:
        p = left.pop()
        if t.counts[p] <= most or len(p) == 1:
            out.append(p)
        else:
            left += [p[len(p) // 2 :], p[: len(p) // 2]]
    return out


def pieces(text: str, limit: int, overlap: int, t: Tokens, share: float = 0.4) -> list[tuple[int, int, int, int]]:
    """(start, core_start, end, n_tokens) of the pieces, in characters; a text within the limit is one piece."""
    parts = t.split(text)
    bits = np.fromiter(map(t.__getitem__, parts), np.int64, len(parts))
    if int((bits >> COUNT).sum()) <= limit:
        return [(0, 0, len(text), int((bits >> COUNT).sum()))]
    room = limit - overlap
    if uneven := bool(((((bits >> LENGTH) & LONGEST) > LONG) | ((bits >> COUNT) > room // 4)).any()):
        parts = _refined(t, parts, max(1, room // 4))
        bits = np.fromiter(map(t.__getitem__, parts), np.int64, len(parts))
    zero = np.zeros(1, np.int64)
    ends = np.concatenate((zero, np.cumsum(bits >> COUNT)))
    chars = np.concatenate((zero, np.cumsum((bits >> LENGTH) & LONGEST)))
    least = max(1, int(room * share))
    starts = cuts(bits, ends, least, room)
    strong = strengths(bits >> LOOK)
    todo = [(s, e, room) for s, e in zip(starts, [*starts[1:], len(parts)])][::-1]
    out = []
    while todo:
        s, e, most = todo.pop()
        b = int(np.searchsorted(ends, ends[s] - overlap, "left")) if s else 0
        # at the end of a piece its trailing white space is one pre-token
        tail = e
        while tail > b and parts[tail - 1].isspace():
            tail -= 1
        n = int(ends[tail] - ends[b]) + (t.counts["".join(parts[tail:e])] if tail < e else 0)
        if uneven:
            n = t.count(text[chars[b] : chars[e]])
        if n <= limit or e - s <= 1 or most <= 1:
            out.append((int(chars[b]), int(chars[s]), int(chars[e]), n))
            continue
        # parts of a cut pre-token may merge differently: this piece alone is cut again, with less room
        most = min(most, int(ends[e] - ends[s])) * 9 // 10
        again = _steps(ends, strong, s, e, min(least, max(1, most // 2)), max(1, most))
        todo += [(x, y, most) for x, y in zip(again, [*again[1:], e])][::-1]
    return out


PIECES = "id bigint, piece int, char_start int, core_start int, char_end int, n_tokens int, text string"


def split_long(
    df: DataFrame, limit: int = 512, overlap: int = 64, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
    keep_short: bool = False,
) -> DataFrame:
    """Cut every text of more than ``limit`` tokens into pieces of at most ``limit``.

    Result: id, piece (from 0), char_start, core_start, char_end, n_tokens (of the piece itself), text. Characters
    core_start..char_end of the pieces follow each other without gap and give the text back; before its core a
    piece repeats at most ``overlap`` tokens of the one before, as many whole words as fit. Texts within the limit are
    left out, or with ``keep_short`` are one piece. Null and empty texts give no row. Copies are cut each, all alike.
    A text without any boundary is cut between characters. Everything happens row by row, without a shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(tokenizer)
        schema = pa.schema([("id", pa.int64()), *[(c, pa.int32()) for c in ("piece", "char_start", "core_start", "char_end", "n_tokens")], ("text", pa.string())])
        for b in batches:
            cols: list[list] = [[] for _ in schema]

            def settle() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                for c in cols:
                    c.clear()
                return out

            for key, text in zip(b.column(0).to_pylist(), values(b.column(1))):
                found = pieces(text, limit, overlap, t)
                if len(found) == 1 and not keep_short:
                    continue
                for i, (s, core, e, n) in enumerate(found):
                    for c, v in zip(cols, (key, i, s, core, e, n, text[s:e])):
                        c.append(v)
                if len(cols[0]) > 2000:
                    yield settle()
            yield settle()

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # a token has one byte at least, so shorter texts are within the limit
    rows = rows.where(F.length("text") > 0) if keep_short else rows.where(F.octet_length("text") > limit)
    return rows.mapInArrow(run, PIECES).withColumnRenamed("id", id_col)
