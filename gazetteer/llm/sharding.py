"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair gets a pseudorandom score, -ln(u) / weight with u from
XXH64, and the key goes to the shard with the smallest.  A shard's scores do
not depend on the other shards, so one more shard only takes rows into itself
and a removed one only hands out its own.  Placement is a column expression
without a shuffle; slots come from counts of (shard, hash chunk) and a rank
inside each chunk.

Defined cases: a null key is one key like any other; equal keys go to the same
shard and get different slots; a null text has no bytes; an empty table gives
an empty table; a shard of weight zero gets nothing.  Input columns are read by
name and nothing else is carried, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer.llm.common import running_start
from gazetteer.session import cut_lineage

SHARDS = 8


def score(key: Column, shard: int, weight: float) -> Column:
    """Exponential race time of a shard for a key; the first wins."""
    drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def shard_of(key: Column, weights: list[float]) -> Column:
    """Shard number of a key over shards with the given weights."""
    races = [F.struct(score(key, i, w).alias("t"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not races:
        raise ValueError("a shard with a weight above zero is needed")
    return races[0]["shard"] if len(races) == 1 else F.least(*races)["shard"]


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None,
           grown: float = 1.0) -> DataFrame:
    """Place rows: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``grown_shard`` is the placement with one more shard of weight ``grown``.
    """
    weights = [1.0] * SHARDS if weights is None else weights
    body = F.coalesce(F.col(text), F.lit(""))
    placed = df.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), [*weights, grown]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"), F.lit(1).cast("long").alias("_one"))
    placed = cut_lineage(placed)  # row numbers stay as they are when a task runs again
    placed = running_start(placed, ["shard"], ["doc_id", "_row"], "_one", "slot", placed.count())
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
