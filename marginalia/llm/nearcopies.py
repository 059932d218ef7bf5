"""Near-duplicate texts: SetSketch registers, banded, estimated jointly, then verified.

A text is the multiset of its words; its elements are (word, occurrence number). Register i holds the largest
floor(1 - log_b h_i(x)) over the elements x, with h_i(x) exponentially distributed: truncated minima on a scale of
powers of b (Ertl, SetSketch: Filling the Gap between MinHash and HyperLogLog). Equal registers become likelier
with the Jaccard similarity, and how many are greater, less and equal gives its likelihood.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import values
from marginalia.operators.skew import skew_join
from marginalia.session import stored

WORD = re.compile(r"[^\W_]+")
#: Bands and registers in each; two texts are candidates if a band's registers are all equal.
BANDS, ROWS = 64, 7
REGISTERS = BANDS * ROWS
#: Base of the registers' scale, and of the coarser scale (four steps in one) used for the estimate.
BASE = 1.1
COARSE = 4
#: Registers of the estimate, every seventh of all.
ESTIMATE = 64
#: Pairs whose estimated similarity is this far below the least possible one are dropped (three standard deviations).
SLACK = 0.18
#: Texts of a band's bucket that are paired at once; a larger bucket is a crowd.
CROWD = 64
#: Texts, and bytes of their words, of one side of a cell.
CELL, CELL_BYTES = 1024, 32 << 20
#: Texts beyond which buckets that hold a hundredth of all are looked for, in a sample of so many, and not sorted in one task.
HOT_TEXTS = 2_000_000
#: Remembered elements per worker.
REMEMBER = 150_000
#: Texts that are broadcast as candidates' keys and ids at most; beyond, the texts are shuffled to the candidates.
BROADCAST_KEYS = 1_000_000
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Elements(dict):
    """Element -> its row in the tables of hashes and register values."""

    def __init__(self, registers: np.ndarray):
        self.which = (registers.astype(np.uint64) + np.uint64(1)) * _GOLD
        self.hashes = np.zeros(1024, np.uint64)
        self.values = np.zeros((1024, len(registers)), np.uint8)

    def __missing__(self, element) -> int:
        row = len(self)
        if row == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        word, nth = element if isinstance(element, tuple) else (element, 0)
        h = mixed(np.array([xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))], np.uint64) + np.array([nth], np.uint64) * _GOLD)[0]
        self.hashes[row] = h
        u = (mixed(h + self.which) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        self.values[row] = np.clip(np.floor(1 - np.log(-np.log(u)) / math.log(BASE)) + 40, 0, 255)
        self[element] = row
        return row

    def numbers(self, words: list[str]) -> np.ndarray:
        """The rows of a text's elements."""
        counts = Counter(words)
        out = [self[w] for w in counts]
        if len(counts) < len(words):
            out += [self[w, k] for w, n in counts.items() if n > 1 for k in range(1, n)]
        return np.array(out, np.int64)


_kept: dict[int, Elements] = {}


def _elements(registers: int) -> Elements:
    """This worker's table of elements with so many registers."""
    if registers not in _kept:
        _kept[registers] = Elements(np.arange(registers))
    return _kept[registers]


def _length_code(n: int) -> int:
    """Logarithm of the number of words in steps of 3 %, in 8 bits."""
    return min(255, round(math.log(max(1, n)) / math.log(1.03)))


#: Length codes further apart than this cannot belong to texts whose lengths differ by a fifth at most.
LENGTH_STEPS = math.ceil(math.log(1 / 0.8) / math.log(1.03)) + 1


def _keys(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each multiset; the low byte of the first is its length code."""
    scattered = mixed(hashes)
    total = mixed(np.add.reduceat(scattered, starts))
    other = mixed(np.add.reduceat(mixed(scattered ^ _GOLD), starts))
    codes = np.array([_length_code(int(n)) for n in sizes], np.uint64)
    return ((total & ~np.uint64(0xFF)) | codes).view(np.int64), other.view(np.int64)


class Group:
    """Texts that are worked on together: their elements' rows, fingerprints and sizes."""

    def __init__(self, e: Elements, names: list, rows: list[np.ndarray]):
        self.names, self.rows = names, rows
        self.sizes = np.array([len(r) for r in rows])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = e.hashes[np.concatenate(rows)]
        self.keys, self.others = _keys(self.hashes, self.starts, self.sizes)

    def sketches(self, e: Elements, which: np.ndarray) -> np.ndarray:
        return np.stack([e.values[self.rows[i]].max(axis=0) for i in which])


def _groups(e: Elements, names: Iterator, texts: Iterator, least: int, size: int = 256) -> Iterator[Group]:
    held: list = []
    rows: list[np.ndarray] = []
    for name, text in zip(names, texts):
        words = WORD.findall(text.lower())
        if len(words) < least:
            continue
        if len(e) > REMEMBER:  # rows of the old numbering must be used up first
            if held:
                yield Group(e, held, rows)
                held, rows = [], []
            e.clear()
        held.append(name)
        rows.append(e.numbers(words))
        if len(held) == size:
            yield Group(e, held, rows)
            held, rows = [], []
    if held:
        yield Group(e, held, rows)


def _signed(least: int):
    """Rows (id, key, other, n, sig, bands) of each text. ``sig`` has two coarse registers in a byte, as distance from the value expected for n;
    ``bands`` has 40 bits of band and band value for each band. Both are null for copies that the task has met before."""
    power = mixed((np.arange(ROWS, dtype=np.uint64) + np.uint64(1)) * _GOLD) | np.uint64(1)
    numbers = np.arange(BANDS, dtype=np.uint64) * _M1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _elements(REGISTERS)
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for g in _groups(e, values(b.column(0)), values(b.column(1)), least):
                fresh = []
                for i, k in enumerate(zip(g.keys.tolist(), g.others.tolist())):
                    if k not in seen:
                        seen.add(k)
                        fresh.append(i)
                if len(seen) > 500_000:
                    seen.clear()
                sigs, bands = [None] * len(g.names), [None] * len(g.names)
                if fresh:
                    sketch = g.sketches(e, fresh)
                    offsets = np.array([_offset(int(n)) for n in g.sizes[fresh]])
                    coarse = np.clip(sketch[:, :: REGISTERS // ESTIMATE].astype(np.int64) // COARSE - offsets[:, None], 0, 15).astype(np.uint8)
                    packed = coarse[:, 0::2] << 4 | coarse[:, 1::2]
                    band = mixed((sketch.reshape(len(fresh), BANDS, ROWS).astype(np.uint64) * power).sum(axis=2) + numbers) >> np.uint64(24)
                    short = band.astype("<u8").view(np.uint8).reshape(len(fresh), BANDS, 8)[:, :, :5]
                    for i, x, y in zip(fresh, packed, short):
                        sigs[i], bands[i] = x.tobytes(), y.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.names, pa.string()), pa.array(g.keys), pa.array(g.others), pa.array(g.sizes.astype(np.int32)), pa.array(sigs, pa.binary()), pa.array(bands, pa.binary())],
                    ["id", "key", "other", "n", "sig", "bands"],
                )

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, key) of each (key, bands)."""
    for b in batches:
        if b.num_rows:
            short = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, BANDS, 5)
            whole = np.zeros((b.num_rows, BANDS, 8), np.uint8)
            whole[:, :, :5] = short
            yield pa.RecordBatch.from_arrays([pa.array(whole.reshape(-1, 8).copy().view("<i8").ravel()), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS))], ["bucket", "key"])


def _pairs(crowd: int):
    """Rows (a, b, bucket) of rows (bucket, key) sorted by both: the pairs of a bucket of up to ``crowd`` texts, without bucket.

    Of a larger bucket each text is given with the bucket and its least text, the leader. Such a bucket is passed
    on as it comes, so no more than ``crowd`` + a batch of its rows are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_b, rest_k = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_bucket, leader, last = None, 0, 0

        def work(bucket: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            starts = np.nonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[0]
            sizes = np.diff(np.append(starts, len(bucket)))
            a, z = [], []
            for s in np.unique(sizes[(sizes > 1) & (sizes <= crowd)]):
                at = starts[sizes == s]
                i, j = np.triu_indices(s, 1)
                a.append((at[:, None] + i).ravel())
                z.append((at[:, None] + j).ravel())
            if a:
                i, j = np.concatenate(a), np.concatenate(z)
                near = np.abs((key[i] & 255) - (key[j] & 255)) <= LENGTH_STEPS
                if near.any():
                    yield _candidates(key[i][near], key[j][near], None)
            for at, s in zip(starts[sizes > crowd], sizes[sizes > crowd]):
                yield _candidates(key[at : at + s], np.full(s, key[at]), bucket[at : at + s])

        for b in batches:
            bucket = np.concatenate((rest_b, b.column(0).to_numpy(zero_copy_only=False)))
            key = np.concatenate((rest_k, b.column(1).to_numpy(zero_copy_only=False)))
            if len(key) > 1:  # copies from several tasks
                keep = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])))
                bucket, key = bucket[keep], key[keep]
            rest_b, rest_k = bucket[:0], key[:0]
            if open_bucket is not None and len(bucket):
                n = int(np.searchsorted(bucket, open_bucket, "right"))
                more = key[:n][key[:n] > last]
                if len(more):
                    last = int(more[-1])
                    yield _candidates(more, np.full(len(more), leader), np.full(len(more), open_bucket))
                bucket, key = bucket[n:], key[n:]
                if len(bucket):
                    open_bucket = None
            if not len(bucket):
                continue
            tail = int(np.searchsorted(bucket, bucket[-1], "left"))
            yield from work(bucket[:tail], key[:tail])
            if len(bucket) - tail > crowd:
                open_bucket, leader, last = int(bucket[-1]), int(key[tail]), int(key[-1])
                yield from work(bucket[tail:], key[tail:])
            else:
                rest_b, rest_k = bucket[tail:], key[tail:]
        yield from work(rest_b, rest_k)

    return run


def _candidates(a, b, bucket) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bucket, pa.int64()) if bucket is not None else pa.nulls(len(a), pa.int64())],
        ["a", "b", "bucket"],
    )


def _offset(n: int) -> int:
    """Coarse value that stands for 0 in a signature of a text of n words."""
    return round((40 + math.log(n) / math.log(BASE)) / COARSE) - 5


def likely_similarity(plus: np.ndarray, minus: np.ndarray, equal: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, given how many registers are greater, less and equal.

    ``u`` is the first set's share of both sizes. A register of the first is greater with probability
    -log_b(1 - (u - v J)(b - 1)/b), of the second likewise; the rest is equal.
    """
    base = BASE**COARSE
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / math.log(base)
    a, b = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-9
    score = plus[:, None] * np.log(a + tiny) + minus[:, None] * np.log(b + tiny) + equal[:, None] * np.log(np.maximum(1 - a - b, tiny))
    return grid[np.arange(len(u)), score.argmax(axis=1)]


def _unpacked(sigs: list[bytes], n: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(n), -1)
    shift = np.array([_offset(int(x)) for x in n])
    return np.stack((raw >> 4, raw & 15), axis=2).reshape(len(n), -1).astype(np.int16) + shift[:, None].astype(np.int16)


def likely(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, floor: float, share: float) -> np.ndarray:
    """Whether the pairs of signatures x[i] and y[j], of texts of n[i] and m[j] words, have lengths that allow the share and an estimated similarity of at least ``floor``."""
    out = np.minimum(n[i], m[j]) >= share * np.maximum(n[i], m[j]) - 1e-9
    at = np.nonzero(out)[0]
    for lo in range(0, len(at), 50_000):
        z = at[lo : lo + 50_000]
        p, q = x[i[z]], y[j[z]]
        plus, minus = (p > q).sum(1), (p < q).sum(1)
        # alike cases are estimated once
        cases, which = np.unique(np.stack((plus, minus, n[i[z]], m[j[z]])), axis=1, return_inverse=True)
        similar = likely_similarity(cases[0], cases[1], p.shape[1] - cases[0] - cases[1], cases[2] / (cases[2] + cases[3]))
        out[z] = (similar >= floor)[which.ravel()]
    return out


def _estimated(floor: float, share: float):
    """Keep pairs (a, b, n_a, n_b, sig_a, sig_b) that are ``likely``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                i = np.arange(b.num_rows)
                ok = likely(_unpacked(b.column(4).to_pylist(), n), _unpacked(b.column(5).to_pylist(), m), i, i, n, m, floor, share)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _across(floor: float, share: float):
    """Pairs of a cell's texts (key, label, n, sig, side) that are likely and have different labels."""

    def run(cell: pa.Table) -> pa.Table:
        key, label, n, side = (cell.column(c).to_numpy() for c in ("key", "label", "n", "side"))
        n = n.astype(np.int64)
        sig = _unpacked(cell.column("sig").to_pylist(), n)
        left, right = np.nonzero(side <= 0)[0], np.nonzero(side >= 0)[0]
        found = []
        for lo in range(0, len(left), 64):
            i, j = (x.ravel() for x in np.meshgrid(left[lo : lo + 64], right, indexing="ij"))
            ok = (label[i] != label[j]) & ((side[i] != side[j]) | (key[i] < key[j]))
            i, j = i[ok], j[ok]
            ok = likely(sig, sig, i, j, n, n, floor, share)
            found.append(np.stack((key[i][ok], key[j][ok])))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _word_lists(least: int):
    """Rows (key, other, words): the sorted 64-bit hashes of a text's elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _elements(0)
        for b in batches:
            for g in _groups(e, iter(range(b.num_rows)), values(b.column(0)), least):
                lists = [np.sort(g.hashes[s : s + n]).tobytes() for s, n in zip(g.starts, g.sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(g.keys), pa.array(g.others), pa.array(lists, pa.binary())], ["key", "other", "words"])

    return run


def shared_words(x: bytes, y: bytes) -> tuple[int, int]:
    """(words in common, words of the longer) of two lists."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.sort(np.concatenate((a, b)))
    return int((both[1:] == both[:-1]).sum()), max(len(a), len(b))


LINKS = "a bigint, other_a bigint, b bigint, other_b bigint, common int, longer int"


def _verified(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared_words(x, y) for x, y in zip(values(b.column(4)), values(b.column(5)))]
            common, longer = (np.array([g[i] for g in got], np.int32) for i in (0, 1))
            ok = pa.array(common >= share * longer - 1e-9)
            cols = [*b.columns[:4], pa.array(common), pa.array(longer)]
            yield pa.RecordBatch.from_arrays(cols, ["a", "other_a", "b", "other_b", "common", "longer"]).filter(ok)

    return run


def _crowd(floor: float, share: float, whole: bool):
    """Verified links among a cell's texts (key, other, n, sig, words, side): all of them (``whole``, as LINKS), or as SUMMARY how many each text has and which texts they connect."""

    def run(cell: pa.Table) -> pa.Table:
        key, other, n, side = (cell.column(c).to_numpy() for c in ("key", "other", "n", "side"))
        once = np.unique(np.stack((key, other)), axis=1, return_index=True)[1]
        key, other, n, side = key[once], other[once], n[once].astype(np.int64), side[once]
        words, sig = cell.column("words").to_pylist(), cell.column("sig").to_pylist()
        sig = _unpacked([sig[i] for i in once], n)
        lists = [np.frombuffer(words[i], np.uint64) for i in once]
        _, where, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        shared = times[where] > 1  # the rest is in one text only
        where, row = np.unique(where[shared], return_inverse=True)[1], row[shared]
        order = np.argsort(where, kind="stable")
        where, row = where[order], row[order]
        common = np.zeros((len(lists), len(lists)), np.float32)
        for lo in range(0, int(where[-1]) + 1 if len(where) else 0, 2048):
            z = slice(np.searchsorted(where, lo), np.searchsorted(where, lo + 2048))
            m = np.zeros((len(lists), 2048), np.float32)
            m[row[z], where[z] - lo] = 1
            common += m @ m.T
        near = common >= share * np.maximum(n[:, None], n[None, :]) - 1e-3
        # sides -1 and 1 are two blocks, whose texts meet across; 0 is one block with itself
        near &= (side[:, None] == 0) | (side[:, None] != side[None, :])
        i, j = np.nonzero(np.triu(near, 1))
        ok = likely(sig, sig, i, j, n, n, floor, share)
        i, j = i[ok], j[ok]
        if whole:
            longer = np.maximum(n[i], n[j]).astype(np.int32)
            return pa.table({"a": key[i], "other_a": other[i], "b": key[j], "other_b": other[j], "common": common[i, j].astype(np.int32), "longer": longer})
        links = np.bincount(i, minlength=len(key)) + np.bincount(j, minlength=len(key))
        root = np.arange(len(key))
        while len(i):  # least number among a text's links, until nothing changes
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        at = np.nonzero(links)[0]
        return pa.table({"a": key[at], "other_a": other[at], "b": key[root[at]], "other_b": other[root[at]], "links": links[at].astype(np.int64)})

    return run


SUMMARY = "a bigint, other_a bigint, b bigint, other_b bigint, links bigint"


class NearCopies:
    """The near-copies among texts: ``members`` (id, key, other) and ``links`` between different word multisets.

    Two texts are linked if they share at least ``share`` of the words of the longer, counting repetitions; texts with
    fewer than ``least`` words are left out. All texts of one word multiset (key, other) are a class of copies and
    compared once; copies are merged within a task before anything is shuffled. Candidates agree on one band of
    registers at least: pairs at the least similarity (Jaccard 2/3 for a share of 0.8) are found by bands with probability
    0.988, at 0.7 with 0.998, at 0.75 with 0.9999; the estimate drops a few of those at the least similarity (SLACK), so
    that bands and estimate together find 0.987 there (20,000 simulated pairs of 60 to 300 words). Every link is verified on the word lists, so none is wrong. Null, empty and short texts are
    in no group; repeated rows of an id count once; an id with several texts is a member of each text's class.

    A band's bucket of more than CROWD texts is a crowd. Its texts are labelled with the least text of all crowds they are in (their leader),
    so a large group of near-copies, which fills a crowd in every band, has one label nearly throughout. Texts of one label meet
    once, in a grid of cells of bounded size, whatever the number of bands they agree in; pairs of a crowd with different labels are estimated in a grid and then go the way of
    other candidates. So each pair of texts is compared once, and always by estimate and word lists.
    """

    def __init__(self, df: DataFrame, id_col: str = "id", text_col: str = "content_full", least: int = 40, share: float = 0.8):
        texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
        self.least, self.share, self.floor, self.texts = least, share, share / (2 - share) - SLACK, texts
        signed = stored(texts.mapInArrow(_signed(least), "id string, key bigint, other bigint, n int, sig binary, bands binary"), "signed")
        self.members = signed.select("id", "key", "other").distinct()
        self.sizes = signed.where("sig IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
        found = stored(self._candidates(signed), "candidates")
        crowds = found.where("bucket IS NOT NULL")
        pairs = found.where("bucket IS NULL").groupBy("a", "b").agg(F.lit(1).alias("x")).select("a", "b")
        self.labels = None
        if not crowds.isEmpty():
            labels = crowds.groupBy("a").agg(F.min("b").alias("label"))
            self.labels = stored(labels.withColumnRenamed("a", "key").join(self.sizes, "key"), "labels")
            side = lambda s: self.labels.select(F.col("key").alias(s), F.col("label").alias(f"label_{s}"))
            pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("label_a IS NULL OR label_b IS NULL OR label_a <> label_b").select("a", "b")
        close = (
            pairs.join(self.sizes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
            .join(self.sizes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
            .select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
            .mapInArrow(_estimated(self.floor, share), "a bigint, b bigint")
        )
        if self.labels is not None:
            close = close.union(self._crossing(crowds)).distinct()
        close = stored(close, "close")
        wanted = close.select(F.col("a").alias("key")).union(close.select("b"))
        if self.labels is not None:
            wanted = wanted.union(self.labels.select("key"))
        self.lists = self._lists(stored(wanted.distinct(), "wanted"))
        side = lambda s: self.lists.select(F.col("key").alias(s), F.col("other").alias(f"other_{s}"), F.col("words").alias(f"words_{s}"))
        #: links between texts of different labels, or without
        self.single = close.join(side("a"), "a").join(side("b"), "b").select("a", "other_a", "b", "other_b", "words_a", "words_b").mapInArrow(_verified(share), LINKS)

    @property
    def links(self) -> DataFrame:
        """(a, other_a, b, other_b, common, longer): every verified link, once."""
        return self.single if self.labels is None else self.single.unionByName(self._crowded(True))

    def _candidates(self, signed: DataFrame) -> DataFrame:
        """(a, b, bucket) as ``_pairs`` gives them; buckets that hold much of all texts are split over tasks."""
        keyed = signed.where("bands IS NOT NULL").select("key", "bands")
        rows = keyed.mapInArrow(_band_rows, "bucket bigint, key bigint")
        parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = keyed.count()
        hot = []
        if n > HOT_TEXTS:
            every = -(-n // HOT_TEXTS)
            some = keyed.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).mapInArrow(_band_rows, "bucket bigint, key bigint")
            # a bucket with a hundredth of the sample: at most 100 in a band
            hot = [r[0] for r in some.groupBy("bucket").count().where(F.col("count") > max(CROWD, n / every / 100)).select("bucket").collect()]
        sort = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket", "key").mapInArrow(_pairs(CROWD), "a bigint, b bigint, bucket bigint")
        if not hot:
            return sort(rows)
        table = F.broadcast(signed.sparkSession.createDataFrame([(b,) for b in hot], "bucket bigint"))
        heavy = rows.join(table, "bucket")
        leaders = F.broadcast(heavy.groupBy("bucket").agg(F.min("key").alias("b")))  # as many rows as hot buckets
        return sort(rows.join(table, "bucket", "left_anti")).union(heavy.join(leaders, "bucket").select(F.col("key").alias("a"), "b", "bucket").distinct())

    def _crossing(self, crowds: DataFrame) -> DataFrame:
        """(a, b): likely pairs of a crowd whose labels differ."""
        rows = stored(crowds.select(F.col("a").alias("key"), "bucket").join(self.labels, "key"), "crowds")
        mixed_ = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("s")).where("x < y").select("bucket", F.ceil(F.col("s") / CELL).cast("int").alias("blocks"))
        cells = _grid(skew_join(rows, mixed_, ["bucket"], "inner"), "key")
        return cells.groupBy("bucket", "i", "j").applyInArrow(_across(self.floor, self.share), "a bigint, b bigint")

    def _crowded(self, whole: bool) -> DataFrame:
        """The links among texts of one label, or their summary."""
        rows = self.labels.join(self.lists, "key")
        size = F.greatest(F.count("*") / CELL, F.sum(F.col("n").cast("bigint")) * 8 / CELL_BYTES)
        blocks = self.labels.groupBy("label").agg(F.ceil(size).cast("int").alias("blocks"), F.count("*").alias("s")).where("s > 1").drop("s")
        cells = _grid(skew_join(rows, blocks, ["label"], "inner"), "key")
        return cells.groupBy("label", "i", "j").applyInArrow(_crowd(self.floor, self.share, whole), LINKS if whole else SUMMARY)

    def _lists(self, wanted: DataFrame) -> DataFrame:
        """(key, other, words) of the wanted texts; only one row of each is read for its words."""
        first = self.members.join(wanted, "key").groupBy("key", "other").agg(F.min("id").alias("id"))
        ids = stored(first.select("id").distinct(), "ids")
        few = ids.count() <= BROADCAST_KEYS
        texts = self.texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        lists = texts.select("text").mapInArrow(_word_lists(self.least), "key bigint, other bigint, words binary")
        return stored(lists.join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key", "other").agg(F.first("words").alias("words")), "words")

    def pairs(self) -> DataFrame:
        """(id_a, id_b) of all near-copies, id_a < id_b, copies of one class included: as many rows as there are such pairs, see ``classes``."""
        x = self.members.select(F.col("id").alias("id_a"), F.col("key").alias("a"), F.col("other").alias("other_a"))
        y = self.members.select(F.col("id").alias("id_b"), F.col("key").alias("b"), F.col("other").alias("other_b"))
        links = stored(self.links.select("a", "other_a", "b", "other_b"), "links")
        links = skew_join(y, skew_join(x, links, ["a", "other_a"], "inner"), ["b", "other_b"], "inner")
        links = links.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        crowd = self.members.groupBy("key", "other").agg(F.count("*").alias("n")).where("n > 1").select("key", "other", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
        m = _grid(skew_join(self.members, crowd, ["key", "other"], "inner"), "id")
        cell = ["key", "other", "i", "j"]
        left = m.where("side <= 0").select(*cell, F.col("id").alias("x"), F.col("side").alias("side_x"))
        right = m.where("side >= 0").select(*cell, F.col("id").alias("y"), F.col("side").alias("side_y"))
        inside = left.join(right, cell).where("x <> y AND (side_x <> side_y OR x < y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return links.union(inside).distinct()

    def classes(self) -> DataFrame:
        """One row per id: copy_of (the smallest id with the same words), group_id (of all texts linked to it), copies, links.

        The links of crowds are counted and joined up where they are found and never listed, so this does not grow with the pairs.
        """
        from marginalia.llm.graphs import components

        reps = stored(self.members.groupBy("key", "other").agg(F.min("id").alias("copy_of"), F.count("*").alias("copies")), "classes")
        # an id with several texts stands for several classes; no class is linked to itself
        name = lambda s: reps.select(F.col("key").alias(s), F.col("other").alias(f"other_{s}"), F.col("copy_of").alias(f"rep_{s}"))
        single = stored(self.single.select("a", "other_a", "b", "other_b"), "links")
        edges = single
        ends = single.select("a", "other_a", F.lit(1).cast("bigint").alias("links")).union(single.select("b", "other_b", F.lit(1).cast("bigint")))
        if self.labels is not None:
            summary = stored(self._crowded(False), "summary")
            edges = edges.union(summary.select("a", "other_a", "b", "other_b"))
            ends = ends.union(summary.select("a", "other_a", "links"))
        named = edges.join(name("a"), ["a", "other_a"]).join(name("b"), ["b", "other_b"]).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).where("a <> b").distinct()
        groups = components(named)
        degree = ends.groupBy(F.col("a").alias("key"), F.col("other_a").alias("other")).agg(F.sum("links").alias("links"))
        full = reps.join(groups.select(F.col("node").alias("copy_of"), F.col("component").alias("group_id")), "copy_of", "left").join(degree, ["key", "other"], "left")
        return skew_join(self.members, stored(full, "full"), ["key", "other"], "inner").select(
            "id", "copy_of", F.coalesce("group_id", "copy_of").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")
        )


def _grid(rows: DataFrame, unique: str) -> DataFrame:
    """Rows with ``blocks`` sent to the cells (i, j), i <= j, of their block: every two rows of a group meet in one cell.

    ``side`` is 0 in a block's cell with itself, else -1 for the block i and 1 for the block j.
    """
    own = F.pmod(F.xxhash64(unique), F.col("blocks")).cast("int")
    out = rows.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("to"), 0).when(F.col("own") < F.col("to"), -1).otherwise(1)
    return out.select(*[c for c in rows.columns if c != "blocks"], F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), side.alias("side"))
