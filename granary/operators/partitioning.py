"""Rows to shards: by hash, range, list and consistent hashing."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_shard(key: Column, shards: int) -> Column:
    """md5 of the key's text modulo the number of shards, a power of two up to 65536: the last hex digits decide."""
    if shards & (shards - 1) or not 0 < shards <= 1 << 16:
        raise ValueError("the number of shards must be a power of two up to 65536")
    return (F.conv(F.right(F.md5(key.cast("string")), F.lit(4)), 16, 10).cast("int") % shards).cast("int")


def any_hash_shard(key: Column, shards: int) -> Column:
    """md5 of the key's text modulo any number of shards up to 2^31, eight hex digits after the other."""
    digest, out = F.md5(key.cast("string")), F.lit(0).cast("long")
    for at in range(1, 33, 7):
        n = min(7, 33 - at)
        part = F.conv(F.substring(digest, at, n), 16, 10).cast("long")
        out = (out * F.lit(16**n % shards) + part) % shards
    return out.cast("int")


def range_shard(key: Column, bounds: list[int]) -> Column:
    """The first shard whose bound is above the key; keys past the last bound go to the last shard."""
    out = F.lit(len(bounds)).cast("int")
    for i, bound in reversed(list(enumerate(bounds))):
        out = F.when(key < bound, i).otherwise(out)
    return out


def list_shard(key: Column, lists: dict[str, list[str]], other: str) -> Column:
    """The shard whose list has the key."""
    out = F.lit(other)
    for shard, members in lists.items():
        out = F.when(key.isin(members), shard).otherwise(out)
    return out


def ring(shards: int, points: int = 150) -> list[tuple[str, int]]:
    """Positions of a consistent-hash ring with their shards, in order."""
    return sorted((hashlib.md5(f"shard-{shard}-vn-{i}".encode()).hexdigest(), shard) for shard in range(shards) for i in range(points))


def ring_shard(spark: SparkSession, df: DataFrame, key: str, shards: int, name: str = "shard", points: int = 150) -> DataFrame:
    """`df` with the shard of the first ring position at or after the key's md5, the first of all past the end.

    Positions are grouped by their first two hex digits, each group closed by the position that follows it, so a key
    looks at a handful of positions only. The broadcast side has 256 rows and shards x points positions.
    """
    held = ring(shards, points)
    groups = []
    for n in range(256):
        digits = f"{n:02x}"
        own = [(p, s) for p, s in held if p.startswith(digits)]
        after = next((s for p, s in held if p[:2] > digits), held[0][1])
        groups.append((digits, [*own, ("~", after)]))
    table = spark.createDataFrame(groups, "_digits string, _ring array<struct<at: string, shard: int>>")
    hashed = df.withColumn("_md5", F.md5(F.col(key).cast("string"))).withColumn("_digits", F.left("_md5", F.lit(2)))
    found = hashed.join(F.broadcast(table), "_digits").withColumn(name, F.expr("filter(_ring, r -> r.at >= _md5)[0].shard"))
    return found.drop("_md5", "_digits", "_ring")
