"""Joins and rankings that do not depend on how rows are spread over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marginalia.session import stored

#: A key is hot when it holds more than this share of the left rows, so at most 1 / share keys are hot.
HOT_SHARE = 0.001
#: Below this many left rows no key is worth splitting.
HOT_ROWS = 200_000
#: Keys that are broadcast at most; beyond, rows are sent to them by a shuffle.
BROADCAST_KEYS = 1_000_000


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int = 32) -> DataFrame:
    """Equi-join whose hot left keys are split over ``salts`` tasks.

    The hot keys are those with more than ``HOT_SHARE`` of all left rows, so their number is at most
    1 / ``HOT_SHARE`` whatever the data: only that list is collected and broadcast. Right rows of a hot key are copied to
    each salt, all others are sent once. Null keys match nothing and are never hot. Left rows are counted with a
    map-side combine before anything else moves. ``how`` may be inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot split a {how} join")
    total = left.count()
    if total < HOT_ROWS:
        return left.join(right, on, how)
    floor = max(HOT_ROWS // salts, int(total * HOT_SHARE))
    hot = left.dropna(subset=on).groupBy(*on).count().where(F.col("count") > floor).select(*on).collect()  # at most 1 / HOT_SHARE rows
    if not hot:
        return left.join(right, on, how)
    hot = left.sparkSession.createDataFrame(hot, left.select(*on).schema).withColumn("__hot", F.lit(True))
    # a hash of the row, not a random number: a task that is run again must send each row to the same place
    plain = [F.col(c) for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    salted = left.withColumn("__row", F.xxhash64(*plain)).join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod("__row", F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    copies = right.join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("__hot", "__row").join(copies.drop("__hot"), [*on, "__salt"], how).drop("__salt")


def by_repetition(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once, the rest): null keys belong to the rest.

    Only keys are shuffled to find out, so rows with long texts stay where they are unless their key is repeated. The repeated
    keys are broadcast if they are no more than BROADCAST_KEYS.
    """
    keys = df.groupBy(key).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) & F.col(key).isNotNull()).select(key)
    keys = stored(keys, "repeated")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    there = df.where(F.col(key).isNotNull())
    return there.join(side, key, "left_anti"), there.join(side, key, "left_semi").unionByName(df.where(F.col(key).isNull()))


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """``df.distinct()`` where ``key`` is the same in repeated rows and seldom in others: only rows with a repeated key are shuffled."""
    once, rest = by_repetition(df, key)
    return once.unionByName(rest.distinct())


def rank_within(df: DataFrame, group: list[str], unique: Column, out: str, slices: int = 64) -> DataFrame:
    """Number the rows of each group from 0 in an arbitrary but repeatable order, without one task per group.

    A group is cut into ``slices`` by the hash of ``unique``; rows are numbered within a slice and shifted by the
    sizes of the slices before it. The table of sizes has at most groups x slices rows.
    """
    cut = df.withColumn("__slice", F.pmod(F.xxhash64(unique), F.lit(slices)).cast("int"))
    # null-safe grouping: a null group is one group
    sizes = cut.groupBy(*group, "__slice").count()
    before = sizes.withColumn(
        "__shift",
        F.coalesce(F.sum("count").over(W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("count")
    local = cut.withColumn("__n", F.row_number().over(W.partitionBy(*group, "__slice").orderBy(unique)) - 1)
    keys = [*group, "__slice"]
    on = [local[k].eqNullSafe(before[k]) for k in keys]
    joined = local.join(before, on, "left")
    return joined.select(*[local[c] for c in df.columns], (local["__n"] + before["__shift"]).cast("bigint").alias(out))
