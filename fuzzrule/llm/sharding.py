"""Sharding by jump consistent hashing (native: SQL functions only).

A stable key is hashed to 64 bits; a short chain of multiplications gives
its shard without a ring table.  Appending a shard moves rows only into the
new shard, about 1 / (shards + 1) of them.

Defined cases: a null key is hashed as the empty string; rows with equal keys
share a shard and get slots of their own; a null text has no bytes (its CRC
is 0); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import read_table

# fixed values of the published algorithm
FACTOR = 2862933555777941757
TWO64 = 18446744073709551616
SHORT = 64


def key64(key: Column) -> Column:
    """An unsigned 64-bit hash of the key as decimal(20,0)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def _chain(state: str, steps: int, n: int) -> str:
    nxt = f"cast((s.k * {FACTOR} + 1) % {TWO64}BD as decimal(20,0))"
    jump = "cast(floor((s.j + 1) * (2147483648D / cast((k2 div 8589934592BD) + 1 as double))) as bigint)"
    step = f"transform(array({nxt}), k2 -> named_struct('k', k2, 'b', s.j, 'j', {jump}))[0]"
    return f"aggregate(sequence(1, {steps}), {state}, (s, i) -> if(s.j >= {n}, s, {step}))"


def jump_shard(docs: DataFrame, key: str, shards: int, shard: str = "shard",
               grown: str = "grown_shard") -> DataFrame:
    """``docs`` with its shard of ``shards`` and its shard of one more.

    One chain gives both: it stops at the first jump target not below
    ``shards``; if that is ``shards`` itself, the row moves there.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = "named_struct('k', __k, 'b', -1L, 'j', 0L)"
    quick = _chain(start, min(SHORT, shards), shards)
    # at most `shards` jumps are possible; the tail runs on where SHORT ended
    rest = "__s" if shards <= SHORT else f"if(__s.j >= {shards}, __s, {_chain('__s', shards, shards)})"
    return (docs.withColumn("__k", key64(F.col(key)))
            .withColumn("__s", F.expr(quick)).withColumn("__s", F.expr(rest))
            .withColumn(shard, F.expr("cast(__s.b as int)"))
            .withColumn(grown, F.expr(f"cast(if(__s.j = {shards}, {shards}, __s.b) as int)"))
            .drop("__s"))


def shard_table(docs: DataFrame, key: str, text: str, shards: int, rows_per_bucket: int = 2000) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 in each shard, in order of (hash bucket, key).  Buckets
    keep every window at about ``rows_per_bucket`` rows whatever the shard's
    size; the bucket counts, a small table, give each bucket its first slot.
    """
    buckets = max(1, docs.count() // (shards * rows_per_bucket))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(16).cast("long")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    thin = docs.select(F.col(key).alias("__id"), size.alias("size"), crc.alias("text_crc32"))
    at = lambda d: jump_shard(d, "__id", shards).withColumn(
        "__bucket", (F.col("__k") % F.lit(buckets)).cast("long"))
    counts = at(docs.select(F.col(key).alias("__id"))).groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "__bucket", F.expr(
        "sum(n) over (partition by shard order by __bucket rows unbounded preceding) - n").alias("__first"))
    slots = at(thin).withColumn("__in", F.expr(
        "row_number() over (partition by shard, __bucket order by __id, size, text_crc32)"))
    return slots.join(first, ["shard", "__bucket"]).select(
        F.col("__id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__first") + F.col("__in") - 1).alias("slot"), "grown_shard")


SHARDS = 40


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 39 (law ``key``)."""
    return shard_table(read_table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)
