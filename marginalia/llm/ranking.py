"""One ranking from several differently scaled scores: a random walk over ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marginalia.session import release, stored

#: Items of a list that one task ranks in memory; longer lists are ranked by distributed prefix sums.
LONG_LIST = 20_000
#: Rounds stop when no item of a list has changed by more than this share of its even part; with this damping ROUNDS always suffice.
DAMPING, ROUNDS, LEAST_CHANGE = 0.9, 320, 1e-12
#: Long lists whose names and sizes are broadcast at most.
BROADCAST_LISTS = 1_000_000


def rank_walk(lists: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Stationary distribution of every list's walk; ``lists`` is non-decreasing, ``scores`` has a column per score.

    From an item the walk picks a score and jumps to one of the items with a better value of it, all alike, or stays if
    there is none; with 1 - DAMPING it jumps anywhere in the list. Greater is better, NaN is worse than any
    value, equal values are level. A step needs one sum over the sorted order per score, for all lists at once.
    """
    n, m = scores.shape
    if not n:
        return np.zeros(0)
    first = np.nonzero(np.concatenate(([True], lists[1:] != lists[:-1])))[0]
    size = np.diff(np.append(first, n))
    start_of = np.repeat(first, size)
    plans = []
    for k in range(m):
        x = np.where(np.isnan(scores[:, k]), -np.inf, scores[:, k])
        order = np.lexsort((-x, lists))
        x = x[order]
        fresh = np.concatenate(([True], (x[1:] != x[:-1]) | (lists[1:] != lists[:-1])))
        run = np.nonzero(fresh)[0]
        run_end = np.repeat(np.append(run[1:], n), np.diff(np.append(run, n)))
        better = np.repeat(run, np.diff(np.append(run, n))) - start_of  # items with a better value
        plans.append((order, better, run_end, np.where(better > 0, 1.0 / np.maximum(better, 1), 0.0)))
    list_end = np.repeat(first + size, size)
    even = 1.0 / np.repeat(size, size)
    p = even.copy()
    for _ in range(ROUNDS):
        new = np.zeros(n)
        for order, better, run_end, inverse in plans:
            q = p[order]
            sums = np.concatenate(([0.0], np.cumsum(q * inverse)))
            new[order] += sums[list_end] - sums[run_end] + np.where(better == 0, q, 0.0)
        new = DAMPING * new / m + (1 - DAMPING) * even
        change = (np.abs(new - p) / even).max()
        p = new
        if change < LEAST_CHANGE:
            break
    return p


def unbeaten(scores: np.ndarray, order: np.ndarray) -> int:
    """The item that beats each other one in more scores than it loses, or -1; tried from the front of ``order``."""
    x = np.where(np.isnan(scores), -np.inf, scores)
    left = list(order)
    while left:
        at = left[0]
        margin = (x[at] > x).sum(axis=1) - (x[at] < x).sum(axis=1)
        margin[at] = 1
        rest = np.nonzero(margin <= 0)[0]
        if not len(rest):
            return int(at)
        beats = set(np.nonzero(margin < 0)[0].tolist())  # only an item that beats this one can still be it
        left = [i for i in left if i in beats]
    return -1


def _rank_lists(n_scores: int, winners: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table) -> pa.RecordBatch:
            lists = rows.column(0).to_numpy()
            names = np.array(rows.column(1).to_pylist(), object)
            scores = np.stack([rows.column(2 + k).to_numpy().astype(np.float64) for k in range(n_scores)], axis=1)
            p = rank_walk(lists, scores)
            which = np.unique(lists, return_inverse=True)[1]
            order = np.lexsort((names, -np.round(p * np.bincount(which)[which], 8), lists)) if len(p) else np.zeros(0, np.int64)
            lists, names, scores, p = lists[order], names[order], scores[order], p[order]
            first = np.nonzero(np.concatenate(([True], lists[1:] != lists[:-1])))[0] if len(lists) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(lists)))
            place = np.arange(len(lists)) - np.repeat(first, size) + 1
            top = np.zeros(len(lists), bool)
            if winners:
                for a, s in zip(first, size):
                    if (w := unbeaten(scores[a : a + s], np.arange(s))) >= 0:
                        top[a + w] = True
            return pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int64()), pa.array(names.tolist(), pa.string()), pa.array(p), pa.array(place, pa.int64()), pa.array(top)],
                ["list", "item", "stationary", "place", "unbeaten"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows = pa.Table.from_batches(held)
            lists = rows.column(0).to_numpy()
            cut = int(np.searchsorted(lists, lists[-1], "left"))
            if cut:
                yield work(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return run


RANKED = "list bigint, item string, stationary double, place bigint, unbeaten boolean"


def ranking(items: DataFrame, list_col: str, item_col: str, scores: list[Column], winners: bool = False) -> DataFrame:
    """Rank the items of every list: list, item, stationary, place (from 1), unbeaten.

    ``items`` has one row per list and item (``combine`` makes it); each of ``scores`` is better when greater and null
    when missing. Ties in stationarity go to the smaller item. ``unbeaten`` marks, with ``winners``, the item that is
    better in more scores than worse against every other one of its list, found by an exact check that follows
    the ranking's order; there may be none. A list with one item has that item on place 1, unbeaten. Rows without
    list or item are left out; an empty table gives an empty result. Lists of up to LONG_LIST items are ranked in
    memory, many at once; longer ones by prefix sums over range partitions, so no list is gathered in a task.
    """
    named = [s.cast("double").alias(f"s{k}") for k, s in enumerate(scores)]
    rows = items.select(F.col(list_col).cast("bigint").alias("list"), F.col(item_col).cast("string").alias("item"), *named).where("list IS NOT NULL AND item IS NOT NULL")
    rows = stored(rows.select("list", "item", *[F.when(~F.isnan(f"s{k}"), F.col(f"s{k}")).alias(f"s{k}") for k in range(len(scores))]), "items")
    long_lists = rows.groupBy("list").count().where(F.col("count") > LONG_LIST).select("list")
    short, far = rows, None
    long_lists = stored(long_lists, "long")
    n_long = long_lists.count()
    if n_long:
        side = _sized(n_long)
        short = rows.join(side(long_lists), "list", "left_anti")
        far = long_ranking(stored(rows.join(side(long_lists), "list", "left_semi"), "far"), len(scores), winners, n_long)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = short.repartition(parts, "list").sortWithinPartitions("list", "item").mapInArrow(_rank_lists(len(scores), winners), RANKED)
    return near if far is None else near.unionByName(far)


def _sized(lists: int):
    """How a table with one row for each of so many lists is joined: broadcast while they are few enough."""
    return F.broadcast if lists <= BROADCAST_LISTS else (lambda df: df)


def long_ranking(rows: DataFrame, n_scores: int, winners: bool, n_lists: int) -> DataFrame:
    """``ranking`` for ``n_lists`` lists that no task should hold: every sum over a list goes over range partitions of its sorted order.

    The rounds are those of ``rank_walk`` and stop by the same rule; a round's table is deleted when the next one is written.
    """
    f = F
    side = _sized(n_lists)
    score = f.explode(f.array(*[f.struct(f.lit(k).alias("s"), f.coalesce(f.col(f"s{k}"), f.lit(float("-inf"))).alias("x")) for k in range(n_scores)]))
    long = rows.select("list", "item", score.alias("v")).select("list", "item", "v.s", "v.x")
    values_ = long.groupBy("list", "s", "x").agg(f.count("*").alias("n"))
    worth = running(values_, ["list", "s"], f.col("x").desc(), "n", "better")
    slots = stored(long.join(worth.select("list", "s", "x", "part", "better"), ["list", "s", "x"]), "slots")
    size = stored(rows.groupBy("list").agg(f.count("*").alias("size")), "sizes")
    walk = p = stored(rows.select("list", "item").join(side(size), "list").select("list", "item", (1 / f.col("size")).alias("p")), "walk")
    for _ in range(ROUNDS):
        flow = slots.join(p, ["list", "item"]).withColumn("q", f.when(f.col("better") > 0, f.col("p") / f.col("better")).otherwise(0.0))
        per_value = flow.groupBy("list", "s", "part", "x").agg(f.sum("q").alias("q"))
        inside = f.coalesce(f.sum("q").over(W.partitionBy("list", "s", "part").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), f.lit(0.0))
        per_part = per_value.groupBy("list", "s", "part").agg(f.sum("q").alias("all"))
        beyond = f.coalesce(f.sum("all").over(W.partitionBy("list", "s").orderBy(f.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)), f.lit(0.0))
        worse = per_value.withColumn("inside", inside).join(per_part.withColumn("beyond", beyond).drop("all"), ["list", "s", "part"])
        worse = worse.select("list", "s", "x", (f.col("inside") + f.col("beyond")).alias("worse"))
        step = flow.join(worse, ["list", "s", "x"]).groupBy("list", "item").agg(
            f.sum(f.col("worse") + f.when(f.col("better") == 0, f.col("p")).otherwise(0.0)).alias("sum"), f.first("p").alias("old")
        )
        new = step.join(side(size), "list").select("list", "item", "old", "size", (DAMPING / n_scores * f.col("sum") + (1 - DAMPING) / f.col("size")).alias("p"))
        new = stored(new, "walk")
        change = new.agg(f.max(f.abs(f.col("p") - f.col("old")) * f.col("size"))).first()[0]
        release(walk)
        walk, p = new, new.select("list", "item", "p")
        if change is None or change < LEAST_CHANGE:
            break
    key = f.struct(f.round(-f.col("p") * f.col("size"), 8).alias("p"), f.col("item").alias("i"))
    placed = running(p.join(side(size), "list").withColumn("key", key).withColumn("one", f.lit(1)), ["list"], f.col("key").asc(), "one", "before")
    out = placed.select("list", "item", f.col("p").alias("stationary"), (f.col("before") + 1).alias("place"))
    if not winners:
        return out.withColumn("unbeaten", f.lit(False))
    # the only item that can be unbeaten: one that survives when each round's best drops all it is not beaten by
    left = stored(rows.join(out.select("list", "item", "place"), ["list", "item"]), "left")
    every, found = left, None
    while not left.isEmpty():
        best = left.groupBy("list").agg(f.min_by(f.struct("item", *[f"s{k}" for k in range(n_scores)]), "place").alias("b"))
        low = lambda c: f.coalesce(c, f.lit(float("-inf")))
        margin = sum((_versus(low(f.col("b")[f"s{k}"]), low(f.col(f"s{k}"))) for k in range(n_scores)), f.lit(0))
        against = every.join(side(best), "list").where(f.col("b")["item"] != f.col("item")).withColumn("margin", margin)
        beaten = against.where("margin <= 0").select("list").distinct()
        won = best.join(beaten, "list", "left_anti").select("list", f.col("b")["item"].alias("item"))
        won = stored(won, "won")
        found = won if found is None else found.union(won)
        left = stored(left.join(against.where("margin < 0").select("list", "item"), ["list", "item"], "left_semi").join(side(won.select("list")), "list", "left_anti"), "left")
    flags = found.withColumn("unbeaten", f.lit(True)) if found is not None else None
    return out.join(flags, ["list", "item"], "left").withColumn("unbeaten", f.coalesce("unbeaten", f.lit(False))) if flags is not None else out.withColumn("unbeaten", f.lit(False))


def _versus(a: Column, b: Column) -> Column:
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)


def running(df: DataFrame, group: list[str], order: Column, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group before each row in ``order``, without a task per group.

    Rows are range-partitioned by group and order; within a partition a window adds up, and the sums of earlier
    partitions (one row per partition and group) are added. Column ``part`` keeps the partition.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*group, "part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy(*group, "part").agg(F.sum(value).alias("all"))
    before = F.coalesce(F.sum("all").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        ranged.withColumn("inside", inside)
        .join(sums.withColumn("earlier", before).drop("all"), [*group, "part"])
        .withColumn(out, F.col("inside") + F.col("earlier"))
        .drop("inside", "earlier")
    )


def combine(results: DataFrame, sources: dict[str, bool], list_col: str = "search_id", item_col: str = "section_id") -> tuple[DataFrame, list[Column]]:
    """One row per list and item from rows per source, and the score columns.

    ``sources`` says for each source whether smaller scores are better. Repeated rows count once; of differing
    scores for the same list, item and source the best counts.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    signed = [(s, F.when(F.lower(F.trim("source")) == s, -score if smaller else score)) for s, smaller in sources.items()]
    wide = results.groupBy(list_col, item_col).agg(
        *[F.max(x).alias(f"score_{s}") for s, x in signed], F.max("importance_score").alias("importance"), F.max("rerank_score").alias("rerank")
    )
    return wide, [F.col(f"score_{s}") for s, _ in signed] + [F.col("importance"), F.col("rerank")]
