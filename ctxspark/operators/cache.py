"""A bounded cache as a small keyed table, with fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxspark.functions.text import clamp01

MAX_BYTES = 100 * 1024 * 1024


def confidence(stable: Column, imports: Column, tests: Column) -> Column:
    return F.round(0.4 * stable + 0.3 * clamp01(imports) + 0.3 * clamp01(tests), 3)


def fingerprint(content: Column) -> Column:
    """Hash, bytes and full confidence of a content."""
    return F.struct(F.sha2(content, 256).alias("hash"), F.octet_length(content).cast("long").alias("size"), F.lit(1.0).alias("confidence"))


def put(cache: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """cache with new(key, content): equal content only touches last_access, other content is the next version."""
    f = fingerprint(F.col("content"))
    n = new.select("key", F.col("content").alias("c"), f.alias("f"))
    j = cache.join(n, "key", "full_outer")
    same = F.col("f.hash").isNull() | (F.col("hash") == F.col("f.hash"))
    touched = F.col("f").isNotNull()
    same = F.coalesce(same, F.lit(False))
    return j.select(
        "key", F.when(same, F.col("content")).otherwise(F.col("c")).alias("content"), F.when(same, F.col("hash")).otherwise(F.col("f.hash")).alias("hash"),
        F.when(same, F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1).cast("long").alias("version"), F.when(same, F.col("confidence")).otherwise(F.col("f.confidence")).alias("confidence"),
        F.when(same, F.col("size")).otherwise(F.col("f.size")).alias("size"), F.when(same, F.col("updated_at")).otherwise(F.lit(now)).cast("long").alias("updated_at"), F.when(touched, F.lit(now)).otherwise(F.col("last_access")).cast("long").alias("last_access"),
    )


def get(cache: DataFrame, key: str) -> DataFrame:
    return cache.where(F.col("key") == key)


def touch(cache: DataFrame, key: str, now: int) -> DataFrame:
    """cache after key was read: its last_access is now."""
    return cache.withColumn("last_access", F.when(F.col("key") == key, F.lit(now).cast("long")).otherwise(F.col("last_access")))


def delete(cache: DataFrame, key: str) -> DataFrame:
    return cache.where(F.col("key") != key)


def invalidate(cache: DataFrame, *prefixes: str) -> DataFrame:
    for p in prefixes:
        cache = cache.where(~F.col("key").startswith(p))
    return cache


def evicted(cache: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Rows that go: the least recently used, until the rest fits. The bound is the cache's own size, so one window does."""
    order = W.orderBy("last_access", "key")
    whole = W.partitionBy()
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = F.sum("size").over(whole) - most
    return cache.select("*", before.alias("_before"), over.alias("_over")).where(F.col("_before") < F.col("_over")).drop("_before", "_over")


def evict(cache: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    return cache.join(evicted(cache, most).select("key"), "key", "left_anti")


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("last_access").alias("oldest"))
