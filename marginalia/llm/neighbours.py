"""The most similar vectors of every vector: probed lists, scanned by blocks of rotated dimensions."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marginalia.llm.nearcopies import mixed as scattered
from marginalia.operators.skew import skew_join
from marginalia.session import stored

#: Vectors that the list centres are fitted on at most, and rounds of fitting; every vector is assigned to a list.
SAMPLE, FIT_ROUNDS = 40_000, 8
#: Vectors of a list on average; centres at most, and parts that each of them is divided into at most (both go to every task).
PER_LIST, MOST_LISTS, MOST_PARTS = 1500, 4096, 1024
#: Vectors and queries of a list that meet in one cell.
BLOCK = 8192
#: Bytes of vectors for a task.
PART_BYTES = 32 << 20
#: Dimensions looked at in one step, and the tests' strictness (Gao and Long, ADSampling): a candidate is given up if its
#: partial distance is improbable, at so many deviations, for a vector that is near enough.
STEP, STRICT = 32, 3.0
#: A list is probed if a neighbour just similar enough could lie in it, at so many deviations of what sets the two apart.
PROBE = 3.5
#: The same for searches without a least similarity, where the k-th best so far takes its place; recall is measured, see the README.
PROBE_FREE = 0.7
#: Keys of outdated vectors and copies that are broadcast at most; beyond, they are removed by a shuffle.
BROADCAST_KEYS = 4_000_000


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres of ``lists`` groups of unit vectors (spherical k-means)."""
    rng = np.random.default_rng(5)
    if not len(sample):
        return np.zeros((0, sample.shape[1]), np.float32)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(near, kind="stable")
        which, first = np.unique(near[order], return_index=True)
        c[which] = np.add.reduceat(sample[order], first, axis=0)
        empty = np.setdiff1d(np.arange(len(c)), which)
        c[empty] = sample[rng.choice(len(sample), len(empty))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def spread(sample: np.ndarray, c: np.ndarray, near: np.ndarray | None) -> np.ndarray:
    """Deviation, along the difference of every two centres, of the unit vector that sets a neighbour apart: the greatest of three.

    It is spread evenly over all dimensions, like what sets vectors apart from their centre, or like the vectors themselves.
    """
    apart = sample if near is None else sample - c[near] * np.einsum("ij,ij->i", sample, c[near])[:, None]
    apart = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)
    out = np.zeros((len(c), len(c)), np.float32)
    for x in (None, apart, sample) if near is not None else (None, apart):
        moved = c / math.sqrt(c.shape[1]) if x is None else c @ np.linalg.cholesky(x.T.astype(np.float64) @ x / len(x) + 1e-9 * np.eye(c.shape[1]))
        moved = moved.astype(np.float32)
        norm = (moved**2).sum(axis=1)
        np.maximum(out, norm[:, None] + norm - 2 * (moved @ moved.T), out=out)
    return np.sqrt(out)


def nearer(best: np.ndarray, row: np.ndarray, mark: np.ndarray) -> None:
    """Put marks into the sorted rows of ``best``, which keep their least ones."""
    if not len(row):
        return
    k = best.shape[1]
    order = np.lexsort((mark, row))
    g = row[order]
    first = np.concatenate(([True], g[1:] != g[:-1]))
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    keep = place < k
    touched = g[first]
    new = np.full((len(touched), k), np.inf)
    new[np.cumsum(first)[keep] - 1, place[keep]] = mark[order][keep]
    best[touched] = np.sort(np.concatenate((best[touched], new), axis=1), axis=1)[:, :k]


#: A mark orders candidates by distance (rounded to six places of the similarity), then by their number in the block.
_MARK = float(1 << 26)


def scan(base: np.ndarray, queries: np.ndarray, base_ids: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray | float, both: bool) -> tuple[np.ndarray, ...]:
    """(id, neighbour, similarity) of each query's ``k`` best in ``base`` of at least ``floor`` (one for all or one for each query), and with ``both`` of each base vector's best among the queries.

    Vectors are kept as column blocks of STEP dimensions. A pair is abandoned after a block if its partial distance fails the test for the
    present bound: the query's k-th best so far, or the base vector's if that is wider and ``both`` is set, and never beyond ``floor``. Only the k best
    of every row are held, so memory does not depend on how many pairs are near. Of equal similarities (six places) the
    smaller id comes first. Where most pairs of a block survive its first columns, the rest is one product of matrices.
    """
    order, q_order = np.argsort(base_ids, kind="stable"), np.argsort(query_ids, kind="stable")
    base, base_ids, queries, query_ids = base[order], base_ids[order], queries[q_order], query_ids[q_order]
    dim = base.shape[1]
    steps = list(range(0, dim, STEP))
    b_cols = [np.ascontiguousarray(base[:, s : s + STEP]) for s in steps]
    q_cols = [np.ascontiguousarray(queries[:, s : s + STEP]) for s in steps]
    b_norm, q_norm = ([(c * c).sum(axis=1) for c in cols] for cols in (b_cols, q_cols))
    widest = np.broadcast_to(np.asarray(2.0 - 2.0 * np.asarray(floor, np.float64)), (len(q_order),) if np.ndim(floor) == 0 else np.shape(floor))
    widest = widest[q_order] if np.ndim(floor) else widest
    best = np.full((len(queries), k), np.inf)
    back = np.full((len(base) if both else 0, k), np.inf)
    reach = lambda marks, most: np.minimum(most, (np.floor(marks / _MARK) + 0.5) * 2e-6)
    grow = lambda seen: seen / dim * (1 + STRICT / math.sqrt(seen)) ** 2 if seen < dim else 1.0
    for at in range(0, len(queries), 512):
        q = slice(at, min(at + 512, len(queries)))
        for lo in range(0, len(base), 2048):
            b = slice(lo, min(lo + 2048, len(base)))
            bound = reach(best[q, -1], widest[q])[:, None]
            if both:
                bound = np.maximum(bound, reach(back[b, -1], float(widest[0]))[None, :])
            part = q_norm[0][q, None] + b_norm[0][None, b] - 2 * (q_cols[0][q] @ b_cols[0][b].T)
            alive = part <= grow(min(STEP, dim)) * bound + 1e-6
            n = int(np.count_nonzero(alive))
            if not n:
                continue
            if n > alive.size // 8:
                for s, x, y, u, v in zip(steps[1:], q_cols[1:], b_cols[1:], q_norm[1:], b_norm[1:]):
                    part += u[q, None] + v[None, b] - 2 * (x[q] @ y[b].T)
                i, j = np.nonzero((part <= bound + 1e-6) & (query_ids[q, None] != base_ids[None, b]))
                dist = part[i, j]
            else:
                i, j = np.nonzero(alive)
                dist = part[i, j]
                limit = np.broadcast_to(bound, alive.shape)[i, j]
                for m, s in enumerate(steps[1:], 1):
                    dist = dist + q_norm[m][at + i] + b_norm[m][lo + j] - 2 * np.einsum("ij,ij->i", q_cols[m][at + i], b_cols[m][lo + j])
                    ok = dist <= grow(min(s + STEP, dim)) * limit + 1e-6
                    i, j, dist, limit = i[ok], j[ok], dist[ok], limit[ok]
                    if not len(i):
                        break
                ok = query_ids[at + i] != base_ids[lo + j]
                i, j, dist = i[ok], j[ok], dist[ok]
            if not len(i):
                continue
            level = np.rint(np.maximum(dist, 0) * 5e5) * _MARK
            nearer(best[q], i, level + (lo + j))
            if both:
                nearer(back[b], j, level + (at + i))
    out = []
    for marks, mine, other, x, y in ((best, query_ids, base_ids, queries, base), (back, base_ids, query_ids, base, queries)):
        row, place = np.nonzero(np.isfinite(marks))
        near = (marks[row, place] % _MARK).astype(np.int64)
        similar = np.concatenate([np.einsum("ij,ij->i", x[row[z : z + 65536]].astype(np.float64), y[near[z : z + 65536]].astype(np.float64)) for z in range(0, len(row), 65536)] or [np.zeros(0)])
        out.append((mine[row], other[near], similar))
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with ``dim`` finite numbers that are not all zero, and which they are."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    right = np.nonzero(np.nan_to_num(sizes.astype(np.float64), nan=-1) == dim)[0]
    if not len(right):
        return np.zeros((0, dim)), right
    x = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[ok], right[ok]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@dataclass(frozen=True)
class Scale:
    """Which lists a vector probes: the ``first`` nearest ones, or those in which a neighbour at its floor could lie (``skip`` leaves the nearest out).

    ``floor`` is the usual one, for sizes only.
    """

    floor: float
    both: bool = False
    first: int = 0
    skip: bool = False
    deviations: float = PROBE

    def reach(self, floor: np.ndarray) -> np.ndarray:
        """Leads that a list may lack, in deviations along the difference of two centres.

        Let x and y have similarity s, homes h and j and leads a and b (of h over j for x, of j over h for y). What sets y
        apart from x then deviates by s a + b along the difference of the centres, and the other way round by s b + a. So
        at so many deviations the smaller lead is at most tan(angle / 2) of them: with ``both`` that side finds the pair.
        Otherwise only x asks, and b may be 0.
        """
        near = 1 + floor if self.both else floor
        out = np.full(len(floor), np.inf)
        ok = near > 0
        out[ok] = self.deviations * np.sqrt(np.maximum(0.0, 1 - floor[ok] ** 2)) / near[ok]
        return out


class Lists:
    """Lists of unit vectors: ``lists`` centres, each divided by the same ``parts`` of what vectors differ from their centre.

    Both sets of centres are fitted on the sample and bounded (MOST_LISTS, MOST_PARTS), as they go to every task; their products are
    as many lists as the number of vectors asks for, up to MOST_LISTS x MOST_PARTS x PER_LIST vectors at PER_LIST in each.
    """

    def __init__(self, sample: np.ndarray, lists: int, parts: int):
        self.centres = centres(sample, lists)
        near = _closest(sample, self.centres)
        self.spread = spread(sample, self.centres, near) if len(sample) else np.zeros((0, 0), np.float32)
        rest = sample - self.centres[near] if len(sample) else sample
        if parts > 1 and len(sample):
            self.parts = _means(rest, parts)
            self.norms = np.sqrt(np.maximum((self.centres**2).sum(1)[:, None] + (self.parts**2).sum(1)[None, :] + 2 * self.centres @ self.parts.T, 1e-12)).astype(np.float32)
            self.part_spread = spread(rest, self.parts, None)
        else:
            self.parts = np.zeros((1, sample.shape[1]), np.float32)
        self.count = max(1, len(self.centres)) * len(self.parts)

    def assign(self, v: np.ndarray, scale: Scale, floor: np.ndarray, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home list of each vector, row, list): the lists that rows which ask probe besides their home."""
        n = len(v)
        sims = v @ self.centres.T
        home = sims.argmax(axis=1)
        lead = sims[np.arange(n), home][:, None] - sims
        reach = scale.reach(floor)
        near = np.zeros(lead.shape, bool)
        if scale.first:
            k = min(scale.first, lead.shape[1])
            near = lead <= np.partition(lead, k - 1, axis=1)[:, k - 1][:, None]
        single = len(self.parts) == 1
        if scale.first and not scale.skip:
            probe = near
        else:
            with np.errstate(invalid="ignore"):
                probe = lead <= np.nan_to_num(reach[:, None] * self.spread[home], nan=np.inf)
            if single:  # the nearest lists were searched whole
                probe &= ~near
        probe[np.arange(n), home] = not single
        if asks is not None:
            probe &= asks[:, None]
        if single:
            i, j = np.nonzero(probe)
            return home, i, j
        own, rows, to = np.zeros(n, np.int64), [], []
        along = v @ self.parts.T
        m = len(self.parts)
        for lo in range(0, n, max(1, 2_000_000 // (m * 16))):
            z = slice(lo, lo + max(1, 2_000_000 // (m * 16)))
            i, j = np.nonzero(probe[z] | (np.arange(probe.shape[1])[None, :] == home[z, None]))
            i += lo
            score = (sims[i, j][:, None] + along[i]) / self.norms[j]
            best = score.argmax(axis=1)
            own[i[j == home[i]]] = best[j == home[i]]
            if scale.first and not scale.skip:
                inside = score >= np.partition(score, max(0, m - scale.first), axis=1)[:, max(0, m - scale.first)][:, None]
            else:  # only x asks here: what visits a list is no base vector of it
                wide = dataclasses.replace(scale, both=False).reach(floor[i])[:, None] * self.part_spread[best]
                with np.errstate(invalid="ignore"):
                    inside = score[np.arange(len(i)), best][:, None] - score <= np.nan_to_num(wide, nan=np.inf)
            inside &= probe[i, j][:, None]
            a, part = np.nonzero(inside)
            cell = j[a] * m + part
            other = cell != (home * m + own)[i[a]]
            rows.append(i[a][other])
            to.append(cell[other])
        return home * m + own, np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(to) if to else np.zeros(0, np.int64)


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, parts: int) -> np.ndarray:
    """Means of ``parts`` groups of vectors (k-means)."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(parts, len(x)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        half = (c**2).sum(axis=1) / 2
        near = np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        which, first, n = np.unique(near[order], return_index=True, return_counts=True)
        c[which] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return c


class VectorIndex:
    """The newest usable vector of every key, in lists.

    ``vectors``: (vec_id bigint, key string, at, embedding array<float>). Of the rows of a key with ``dim`` finite numbers
    that are not all zero, the one with the greatest ``at`` counts, then the greatest vec_id; a null ``at`` is oldest.
    Keys with equal vectors are a class and searched once. Null, short and zero vectors are left out, repeated rows
    count once, lengths of vectors do not matter, an empty table gives empty results.
    """

    def __init__(self, vectors: DataFrame, dim: int = 128):
        self.dim = dim
        self.rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("key").cast("string"), F.col("at").cast("timestamp_ntz"), F.col("embedding").cast("array<float>")).where("vec_id IS NOT NULL AND key IS NOT NULL AND embedding IS NOT NULL")

        def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, rows = _matrix(b.column(3), dim)
                hashes = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in _unit(x)], np.uint64).view(np.int64) if len(x) else np.zeros(0, np.int64)
                where = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), b.column(2).take(where), pa.array(hashes)], ["vec_id", "key", "at", "same"])

        good = stored(self.rows.mapInArrow(usable, "vec_id bigint, key string, at timestamp_ntz, same bigint"), "usable")
        # equal vectors may be a third of all: their class is joined in parts
        newest = good.groupBy("key").agg(F.max(F.struct("at", "vec_id", "same")).alias("r")).select("key", "r.vec_id", "r.same")
        first = newest.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        #: key, its own vec_id, the vec_id that represents its class, and the size of the class
        self.members = stored(skew_join(newest, first, ["same"], "inner").select("key", "vec_id", "rep", "n"), "members")
        reps = self.members.select(F.col("rep").alias("vec_id")).distinct()
        self.size = reps.count()
        out = stored(good.select("vec_id").distinct().join(reps, "vec_id", "left_anti"), "outdated")
        drop = F.broadcast(out) if out.count() <= BROADCAST_KEYS else out
        # vec_ids of unusable rows are not in ``out``; they are dropped again where vectors are read
        self.vectors = self.rows.select("vec_id", "embedding").join(drop, "vec_id", "left_anti")
        self.turn = rotation(dim)
        self._fit()

    def _fit(self) -> None:
        """Centres and the expected rows of each list, from a sample by hash of at most SAMPLE vectors."""
        every = max(1, -(-self.size // SAMPLE))
        sample = self.vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("embedding").limit(SAMPLE).toArrow().column(0)
        x = np.concatenate([_matrix(c, self.dim)[0] for c in sample.chunks]) if sample.num_chunks else np.zeros((0, self.dim))
        unit = (_unit(x) @ self.turn if len(x) else np.zeros((0, self.dim))).astype(np.float32)
        lists = max(1, round(self.size / PER_LIST))
        self.map = Lists(unit, min(MOST_LISTS, lists), min(MOST_PARTS, -(-lists // MOST_LISTS)))
        self.sample, self.lists = unit, self.map.count

    def routed(self, rows: DataFrame, scale: Scale, share: float) -> DataFrame:
        """(cell, vec_id, home, asks, floor, vector) of ``rows`` (vec_id, embedding, asks, floor): each vector to its list, and those that ask to the lists they probe.

        A list of more than BLOCK vectors, or with more than BLOCK queries, is a grid of cells: a vector goes to the row of its
        block, a query to the column of its own, so every pair meets in one cell and no cell grows with the data. ``share`` is the part of the vectors that asks.
        """
        lists, turn, dim = self.map, self.turn, self.dim
        home, at, where = lists.assign(self.sample, scale, np.full(len(self.sample), scale.floor)) if len(self.sample) else (np.zeros(0, np.int64),) * 3
        each = self.size / max(1, len(self.sample))
        blocks = lambda n: np.maximum(1, np.ceil(n * each / BLOCK)).astype(np.int64)
        high = blocks(np.bincount(home, minlength=lists.count))
        wide = blocks((np.bincount(where, minlength=lists.count) + (0 if scale.skip else np.bincount(home, minlength=lists.count))) * share)
        first = np.cumsum(high * wide) - high * wide
        copies = len(where) / max(1, len(self.sample)) * share + float((high * wide).sum()) / max(1, len(high))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, good = _matrix(b.column(1), dim)
                for lo in range(0, len(x), 2000):
                    v = _unit(x[lo : lo + 2000]) @ turn
                    take = pa.array(good[lo : lo + 2000])
                    ids, asks, floor = (b.column(c).take(take).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
                    asks = asks.astype(bool)
                    h, i, j = lists.assign(v, scale, floor, asks)
                    spot = scattered(ids.astype(np.uint64))
                    up, across = (spot >> np.uint64(1)).astype(np.int64) % high[h], lambda l, r: (spot[r] >> np.uint64(7)).astype(np.int64) % wide[l]
                    # as a base vector: to every column of its row of the home list
                    r1 = np.repeat(np.arange(len(v)), wide[h])
                    c1 = np.arange(len(r1)) - np.repeat(np.cumsum(wide[h]) - wide[h], wide[h])
                    asks1 = asks[r1] & (c1 == across(h[r1], r1)) & (not scale.skip)
                    cell1 = first[h[r1]] + up[r1] * wide[h[r1]] + c1
                    # as a query: to every row of the lists it probes, and of its home but where it stands already
                    l2, q2 = (j, i) if scale.skip else (np.concatenate((j, h[asks])), np.concatenate((i, np.nonzero(asks)[0])))
                    r2, l3 = np.repeat(q2, high[l2]), np.repeat(l2, high[l2])
                    u2 = np.arange(len(r2)) - np.repeat(np.cumsum(high[l2]) - high[l2], high[l2])
                    other = (l3 != h[r2]) | (u2 != up[r2]) | scale.skip
                    r2, l3, u2 = r2[other], l3[other], u2[other]
                    cell2 = first[l3] + u2 * wide[l3] + across(l3, r2)
                    row = np.concatenate((r1, r2))
                    raw, width = v.astype(np.float32).tobytes(), 4 * dim
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate((cell1, cell2))), pa.array(ids[row]), pa.array(np.arange(len(row)) < len(r1)), pa.array(np.concatenate((asks1, np.ones(len(r2), bool)))), pa.array(floor[row]),
                         pa.array([raw[r * width : (r + 1) * width] for r in row.tolist()], pa.binary())],
                        ["cell", "vec_id", "home", "asks", "floor", "vector"],
                    )

        spark = rows.sparkSession
        parts = max(2 * spark.sparkContext.defaultParallelism, math.ceil(self.size * (1 + copies) * (4 * dim + 40) / PART_BYTES))
        return rows.mapInArrow(run, "cell bigint, vec_id bigint, home boolean, asks boolean, floor double, vector binary").repartition(parts, "cell")

    def _found(self, rows: DataFrame, scale: Scale, share: float, k: int, both: bool) -> DataFrame:
        """(a, b, similarity): the best of each vector in each cell."""
        dim = self.dim

        def search(cell: pa.Table) -> pa.Table:
            home, asks, ids, floor = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("home", "asks", "vec_id", "floor"))
            once = np.unique(np.stack((ids, home.astype(np.int64))), axis=1, return_index=True)[1]  # repeated rows
            v = np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.float32) for c in cell.column("vector").chunks] or [np.zeros(0, np.float32)]).reshape(-1, dim)[once]
            home, asks, ids, floor = home[once].astype(bool), asks[once].astype(bool), ids[once], floor[once]
            own, guests = home & asks, ~home
            one = floor[0] if both else None
            found = [scan(v[home], v[side], ids[home], ids[side], k, one if both else floor[side], both and side is guests) for side in (own, guests) if side.any() and home.any()]
            a, b, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": np.round(s, 6)})

        found = self.routed(rows, scale, share).groupBy("cell").applyInArrow(search, "a bigint, b bigint, similarity double")
        return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    def nearest(self, k: int = 5, floor: float | None = 0.8, asked: DataFrame | None = None, first: int = 4) -> DataFrame:
        """(key, neighbour, similarity, place): each key's k most similar others with a similarity of at least ``floor``.

        ``asked`` (each key's own vec_id) limits the keys that are looked up, never those found. A list is probed if a
        neighbour at ``floor`` could lie in it, at PROBE deviations. Without ``floor`` a query first searches its ``first`` nearest lists; its k-th best
        there is its floor for a second search, in the other lists in which something better could lie, at PROBE_FREE deviations. Of equal
        similarities (to six places) the smaller key comes first, but among more than k level ones in a list the smaller vec_ids are
        taken. Classes of equal vectors are expanded by their first k + 1 keys, which is all a list of k can hold.
        """
        mine = self.members
        rows = self.vectors.withColumn("floor", F.lit(-1.0 if floor is None else float(floor)))
        share = 1.0
        if asked is not None:
            mine = mine.join(asked.select("vec_id").distinct(), "vec_id", "left_semi")
            reps = stored(mine.select(F.col("rep").alias("vec_id")).distinct(), "asked")
            share = reps.count() / max(1, self.size)
            rows = rows.join(reps.withColumn("asks", F.lit(True)), "vec_id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        else:
            rows = rows.withColumn("asks", F.lit(True))
        rows = rows.select("vec_id", "embedding", "asks", "floor")
        if floor is not None:
            found = self._found(rows, Scale(floor, both=asked is None), share, k, asked is None)
        else:
            near = stored(self._found(rows, Scale(-1.0, first=first), share, k, False), "first")
            # a query with fewer than k so far has no floor
            kth = near.groupBy("a").agg(F.when(F.count("*") >= k, F.get(F.sort_array(F.collect_list("similarity"), False), F.lit(k - 1))).alias("kth"))  # first x k rows at most
            again = rows.join(kth.withColumnRenamed("a", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("kth", "floor")).select("vec_id", "embedding", "asks", "floor")
            typical = kth.agg(F.avg("kth")).first()[0] or -1.0
            found = near.union(self._found(again, Scale(typical, first=first, skip=True, deviations=PROBE_FREE), share, k, False)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
        found = found.withColumn("r", F.rank().over(W.partitionBy("a").orderBy(F.desc("similarity")))).where(F.col("r") <= k).drop("r")
        # the window's limit is applied before its shuffle, so a class with a third of all keys sends k + 1 of them from a task
        firsts = stored(self.members.withColumn("i", F.row_number().over(W.partitionBy("rep").orderBy("key"))).where(F.col("i") <= k + 1).select("rep", "key"), "firsts")
        other = firsts.select(F.col("rep").alias("b"), F.col("key").alias("neighbour"))
        found = stored(found.join(other, "b").select("a", "neighbour", "similarity"), "found")
        apart = skew_join(mine.select(F.col("rep").alias("a"), "key"), found, ["a"], "inner").select("key", "neighbour", "similarity")
        twins = firsts.select("rep", F.col("key").alias("neighbour"))
        alike = skew_join(mine.where("n > 1").select("rep", "key"), twins, ["rep"], "inner").where("key <> neighbour").select("key", "neighbour", F.lit(1.0).alias("similarity"))
        place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))
        return apart.union(alike).withColumn("place", place).where(F.col("place") <= k)


def similar_pairs(index: VectorIndex, k: int = 5, floor: float = 0.8) -> DataFrame:
    """(a, b), a < b: pairs of keys of which one is among the k most similar of the other, with at least ``floor``."""
    near = index.nearest(k, floor)
    return near.where(F.col("similarity") >= floor).select(F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b")).distinct()
