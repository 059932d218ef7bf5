"""Filling containers of a fixed number of tokens with documents: shortest-pack-first over the length histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.tokens import TOKENIZER, token_counts
from marginalia.operators.skew import rank_within
from marginalia.session import stored

#: Items of one length that are numbered in one task, about.
SLICE = 250_000


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns (how often, {length: copies}) for a histogram of lengths in 1..capacity.

    Lengths are placed from the longest to the shortest. An item goes into the pack with the most room, and a new
    pack is opened when that has too little. Packs of equal content are counted, never listed, so work and
    memory depend on the capacity, not on the number of items.
    """
    room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            widest = max(room, default=0)
            if widest < length:
                each = capacity // length
                for times, copies in ((left // each, each), (1, left % each)):
                    if times and copies:
                        room.setdefault(capacity - copies * length, []).append((times, {length: copies}))
                left = 0
                continue
            times, pack = room[widest].pop()
            if not room[widest]:
                del room[widest]
            taken = min(times, left)
            left -= taken
            if times > taken:
                room.setdefault(widest, []).append((times - taken, pack))
            room.setdefault(widest - length, []).append((taken, pack | {length: pack.get(length, 0) + 1}))
    return [p for space in sorted(room) for p in room[space]]


SLOTS = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "first", "end", "base", "copies")])


def slots(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """For each pattern and length in it: ranks [first, end) of that length go to containers from ``base``, ``copies`` each."""
    out, base, used = [], 0, {}
    for times, pack in found:
        for length, copies in pack.items():
            first = used.get(length, 0)
            used[length] = end = first + times * copies
            out.append((length, first, end, base, copies))
        base += times
    return out


def pack(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Assign every document to a container: id, piece, token_start, n_tokens, container_id.

    A document longer than ``capacity`` is split at multiples of it; the rest after the last full piece is packed
    like a document. Null and empty texts have 0 tokens and a null container. Repeated rows are items of their own;
    which of several equal lengths comes first is arbitrary. An empty table gives an empty result. Only the histogram
    reaches the driver: at most ``capacity`` lengths. The slot table made from it has a row per pattern and length,
    which depends on the capacity alone, and is broadcast.
    """
    spark = df.sparkSession
    sizes = stored(token_counts(df, id_col, text_col, tokenizer), "sizes")
    full = F.lit(capacity)
    items = (
        sizes.where("n_tokens > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / full))))
        .withColumn("token_start", F.col("piece") * full)
        .withColumn("length", F.least(full.cast("bigint"), F.col("n_tokens") - F.col("token_start")))
        .drop("n_tokens")
    )
    histogram = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = F.broadcast(spark.createDataFrame(slots(patterns(histogram, capacity)), SLOTS))
    # so many slices that the most frequent length is numbered in parts of at most SLICE items
    slices = max(16, -(-max(histogram.values(), default=0) // SLICE))
    ranked = rank_within(items, ["length"], F.struct("id", "piece"), "rank", slices)
    on = (ranked["length"] == table["length"]) & (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["end"])
    placed = ranked.join(table, on).select(
        F.col("id").alias(id_col), "piece", "token_start", ranked["length"].alias("n_tokens"),
        (F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("copies"))).cast("bigint").alias("container_id"),
    )
    none = sizes.where("n_tokens = 0").select(
        F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("token_start"), "n_tokens", F.lit(None).cast("bigint").alias("container_id")
    )
    return placed.unionByName(none)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, unused tokens and the share of used space."""
    per = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"))
    return total.withColumn("unused", F.col("containers") * capacity - F.col("tokens")).withColumn(
        "fill", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity))
    )
