"""Sharding by sampled splitters: near-equal bytes, equal texts together."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import located, saved

ROW_BYTES = 16
SHARDED = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _splitters(rows: DataFrame, ranges: int, sample: int, total: int) -> list[int]:
    """Keys that cut the bytes into near-equal ranges, by a size-weighted sample.

    A row is drawn once for every ``total / sample`` bytes it has, the rest by
    chance. The sample is bounded and sets only where ranges end; what they
    hold is counted over all rows.
    """
    chance = F.pmod(F.xxhash64("key", "seed", F.lit(17)), F.lit(1 << 20)) / (1 << 20)
    draws = F.floor(F.col("size") * (sample / total) + chance).cast("int")
    drawn = rows.select("key", draws.alias("n")).where("n > 0").select("key", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = ", ".join(str(i / ranges) for i in range(1, ranges))
    found = drawn.agg(F.expr(f"percentile_approx(key, array({at}), {20 * ranges})").alias("at")).first()["at"] if ranges > 1 else []
    return sorted(set(found or []))


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are below the key: first by every ``step``-th, then by those between."""
    if not splitters:
        return F.lit(0)
    step = math.isqrt(len(splitters)) + 1
    coarse = F.array(*map(F.lit, splitters[step - 1 :: step]))
    fine = F.array(*(F.array(*map(F.lit, splitters[i : i + step])) for i in range(0, len(splitters), step)), F.array().cast("array<bigint>"))
    first = F.size(F.filter(coarse, lambda x: x < key))
    return first * step + F.size(F.filter(F.get(fine, first), lambda x: x < key))


def shard(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 16, sample: int = 40_000) -> DataFrame:
    """Deal all documents into ``shards`` shards of near-equal bytes.

    Reads ``doc_id`` and ``text``; other columns are left out. A row's size is
    the bytes of its text (null: none) plus 16; its key is a hash of its text.
    Splitters from a size-weighted sample cut the keys into ranges. A range
    with over twice its share of the bytes is subdivided, between keys, and a
    key with more bytes than a shard by a hash of its rows' places. The resulting units, largest
    first, go to the shard with the fewest bytes. So equal texts share a shard
    unless their group has more than a shard's bytes. Null texts count as
    empty; repeated rows are placed each; an empty table gives no rows.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless in
    its shard) and grown_shard (null: more shards are dealt anew under this law).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = saved(
        located(docs.select("doc_id", "text")).select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64("at.file", "at.row").alias("seed"),  # tells rows apart that share a doc_id
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], SHARDED)
    ranges = shards * max(ranges_per_shard, -(-n // (shards * 500_000)))  # a unit has about half a million rows at most
    share, half = total / ranges, total / (2 * shards)
    rows = rows.withColumn("range", _range_of(F.col("key"), _splitters(rows, ranges, max(sample, 60 * ranges), total)))
    by_range = rows.groupBy("range").agg(F.sum("size").alias("bytes"))
    overfull = by_range.where(F.col("bytes") > 2 * share).select("range")  # at most half the ranges
    # Bytes of a key and of those before it in its range; a hot key is one row here.
    keys = rows.join(F.broadcast(overfull), "range").groupBy("range", "key").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    hot, alone = F.col("bytes") > 2 * half, F.col("bytes") > half
    keys = keys.select(
        "range",
        "key",
        # A large group that fits into a shard is a unit of its own.
        F.when(hot, F.lit(-1)).when(alone, -2 - F.pmod("key", F.lit(1 << 40))).otherwise(F.floor(F.coalesce(before, F.lit(0)) / share)).cast("long").alias("cut"),
        F.when(hot, F.ceil(F.col("bytes") / share)).otherwise(1).cast("int").alias("pieces"),
    )
    whole = rows.join(F.broadcast(overfull), "range", "left_anti").select("*", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("piece"))
    # A hot key has over a shard's bytes, so there are fewer than shards: they are broadcast, and no text's rows meet in one task before they are divided.
    keys = saved(keys, "shard-keys")
    hot_ones = F.broadcast(keys.where("pieces > 1"))
    inside = rows.join(F.broadcast(overfull), "range")
    piece = (F.pmod(F.xxhash64("seed", F.lit(5)), F.col("pieces")) + 1).cast("long")
    divided = inside.join(hot_ones, ["range", "key"]).withColumn("piece", piece).drop("pieces")
    others = inside.join(hot_ones, ["range", "key"], "left_anti").join(keys.where("pieces = 1"), ["range", "key"])
    divided = divided.unionByName(others.withColumn("piece", F.lit(0).cast("long")).drop("pieces"))
    unit = ["range", "cut", "piece"]
    placed = saved(whole.unionByName(divided), "shard-units")
    units = placed.groupBy(*unit).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # a few for each range

    fullness = [(0, s) for s in range(shards)]
    filled, dealt = [0] * shards, []
    for u in sorted(units, key=lambda u: (-u["bytes"], u["range"], u["cut"], u["piece"])):
        held, s = heapq.heappop(fullness)
        dealt.append((u["range"], u["cut"], u["piece"], s, filled[s]))
        filled[s] += u["n"]
        heapq.heappush(fullness, (held + u["bytes"], s))
    dealt = spark.createDataFrame(dealt, "range int, cut long, piece long, shard int, before long")
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy("key", "doc_id", "text_crc32", "seed"))
    return placed.withColumn("rank", rank).join(F.broadcast(dealt), unit).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
