"""Rendezvous (highest random weight) sharding of stable record keys.

Each shard draws a number from the key and its own name; the key goes to the
shard with the best draw. Another shard only wins keys for itself, a removed
one only gives up its own, and a changed weight moves keys to or from that
shard alone. Everything is a column expression on hashes.

Nulls, empty and odd input: a null key is a key of its own, so all null keys
share a shard; equal keys always share a shard; a null text has no bytes;
repeated rows get a slot each. No shard, a weight that is not positive or a
repeated shard name is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from airtrace.llm.common import require
from airtrace.session import materialise


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the key and the shard, 52 bits wide."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(shard)), 12)
    return (bits.cast("double") + 0.5) / float(2**52)


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key: the least ``-ln(draw) / weight`` wins, ties to the smaller name."""
    if not weights:
        raise ValueError("no shards")
    if any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError(f"weights must be positive: {weights}")
    bids = [F.struct((-F.log(draw(key, s)) / float(w)).alias("bid"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(df: DataFrame, key: Column, weights: dict[int, float], name: str = "shard") -> DataFrame:
    """Add the shard of each row; row by row, without a shuffle."""
    return df.withColumn(name, shard_of(key, weights))


def numbered(rows: DataFrame, chunks: int = 4096) -> DataFrame:
    """Give the rows of each ``shard`` gapless numbers from 0 as ``slot``.

    Equal rows are counted first and numbered as one block, so that a repeated
    row is no hot key. Blocks are numbered within hash chunks of a shard, and a
    table of at most ``chunks`` totals a shard gives each chunk its start.
    """
    require(rows, "shard")
    keys = rows.columns
    blocks = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    blocks = blocks.withColumn("_h", F.xxhash64(*keys)).withColumn("_chunk", F.pmod("_h", F.lit(chunks)).cast("int"))
    blocks = materialise(blocks, "shard-slots")
    order = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard", "_chunk").agg(F.sum("_n").alias("_sum"))
    starts = totals.select("shard", "_chunk", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_chunk").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(starts), ["shard", "_chunk"])  # shards x chunks rows at most
    first = F.col("_start") + F.col("_before")
    return placed.select(*keys, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Size, checksum, shard and slot of every document, and its shard among one more."""
    require(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    even = {s: 1.0 for s in range(shards)}
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = assign_shards(rows, F.col("doc_id"), even)
    rows = assign_shards(rows, F.col("doc_id"), even | {shards: 1.0}, "grown_shard")
    out = numbered(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
