"""Sharding by weighted rendezvous hashing of record keys.

Every shard scores a key by weight / -ln(u), u being a hash of key and shard number in (0, 1); the highest score wins, so a
shard's share is in proportion to its weight, and one more shard only takes keys into itself. The law is ``key``: the key
and the shards decide, nothing else.

Cases: a null key is a key of its own; equal keys go to one shard; null text has no bytes; an empty table yields no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import gapless, materialize


def shard_of(key: Column, weights: list[float]) -> Column:
    """The number of the shard that key goes to, among shards 0 to len(weights) - 1."""
    scores = []
    for k, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit("rendezvous"), key, F.lit(k)), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(k).alias("shard")))
    return F.array_max(F.array(*scores))["shard"]


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds shard, size, text_crc32, law and slot to (key, text): slots are gapless in each shard, in order of the table's
    parts, and of key within a part.

    grown: the weights with shards added, for grown_shard.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(key),
            (F.octet_length(content) + 1).cast("long").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            shard_of(F.col(key), weights).alias("shard"),
            (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
            F.spark_partition_id().alias("_part"),
        ),
        "shards",
    )
    order = [F.col(key).asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    return gapless(rows, "shard", "_part", order, "slot").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
