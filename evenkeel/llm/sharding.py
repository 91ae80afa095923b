"""Sharding by jump consistent hashing, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import gapless_rank, materialize

#: Multiplier of the published 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
_LOW22, _LOW20 = (1 << 22) - 1, (1 << 20) - 1
_C0, _C1, _C2 = MULTIPLIER & _LOW22, (MULTIPLIER >> 22) & _LOW22, MULTIPLIER >> 44
#: Bytes that storage takes for a row besides its text.
ROW_BYTES = 16


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of a 64-bit key among ``shards``, and among ``shards + 1``.

    The generator's state is held in limbs of 22, 22 and 20 bits, because the product must wrap at
    64 bits and long arithmetic raises on overflow. Each step moves to a higher shard, so shards + 1
    steps always reach the end; finished rows skip the remaining ones.
    """
    key = key.cast("long")
    start = F.struct(
        key.bitwiseAND(_LOW22).alias("k0"),
        F.shiftright(key, 22).bitwiseAND(_LOW22).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
        F.lit(0).cast("long").alias("next"),
        F.lit(0).cast("long").alias("now"),
        F.lit(0).cast("long").alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        low = s["k0"] * _C0 + 1
        mid = s["k0"] * _C1 + s["k1"] * _C0 + F.shiftright(low, 22)
        high = (s["k0"] * _C2 + s["k1"] * _C1 + s["k2"] * _C0 + F.shiftright(mid, 22)).bitwiseAND(_LOW20)
        top31 = F.shiftleft(high, 11) + F.shiftright(mid.bitwiseAND(_LOW22), 11)
        jump = F.floor((s["next"] + 1) * (F.lit(float(1 << 31)) / (top31 + 1).cast("double"))).cast("long")
        moved = F.struct(
            low.bitwiseAND(_LOW22).alias("k0"),
            mid.bitwiseAND(_LOW22).alias("k1"),
            high.alias("k2"),
            jump.alias("next"),
            F.when(s["next"] < shards, s["next"]).otherwise(s["now"]).alias("now"),
            s["next"].alias("grown"),
        )
        return F.when(s["next"] > shards, s).otherwise(moved)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return end["now"].cast("int"), end["grown"].cast("int")


def shard_rows(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """One row per row of df: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: key and shard count alone decide, and one more shard takes rows only into
    itself. A null key hashes as -1; a null text has no bytes (size 16, checksum 0). Rows with equal
    keys share a shard and get slots of their own; slots follow (key, checksum, size), so equal rows
    are interchangeable. Other columns of df are left out, whatever their names. An empty df gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    now, grown = jump_hash(F.coalesce(F.col(key).cast("long"), F.lit(-1)), shards)
    keyed = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.struct(now.alias("now"), grown.alias("grown")).alias("to"),
    ).select("key", "size", "text_crc32", F.col("to.now").alias("shard"), F.col("to.grown").alias("grown_shard"))
    ranked = gapless_rank(materialize(keyed), ["shard"], ["key", "text_crc32", "size"], "slot", shards)
    return ranked.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
