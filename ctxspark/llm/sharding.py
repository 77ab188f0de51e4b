"""Sharding by longest-processing-time scheduling.

Documents with equal text form a group, which stays together. Groups go by falling size, each to the shard with the
least bytes so far. Groups of equal size are interchangeable, so the driver schedules a size class at once: the heap's
c smallest of {load_i + j * size} say how many of the class's c groups each shard gets. That is the same schedule as
one group at a time. The driver sees distinct group sizes only, never groups, and holds CLASSES of them at a time: sizes
come in falling order and the plan goes in parts to a table in the shared folder.

Null and empty texts are one group (0 bytes). Ties: by text hash, then doc_id; repeated rows stay in their group, each
with a slot of its own. Empty tables give empty results; extra columns are ignored."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, ranked, shared_dir

SHARDS = 16
#: Size classes that the driver holds at once.
CLASSES = 50_000


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count equal groups each shard gets, each going to the least-loaded shard; loads is brought up to date.

    The first groups fill the low shards up to a common level, which arithmetic does; the heap deals the rest."""
    n, got = len(loads), [0] * len(loads)
    if count > 4 * n:
        level = (sum(loads) + size * (count - 2 * n)) // n  # no shard gets past it before the others come near
        for i, load_i in enumerate(loads):
            got[i] = max(0, (level - load_i) // size)
        while sum(got) > count:  # shards above the level took no part: lower it
            level -= max(size, (sum(got) - count) * size // n)
            got = [max(0, (level - x) // size) for x in loads]
        for i in range(n):
            loads[i] += got[i] * size
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        x, i = heap[0]
        heapq.heapreplace(heap, (x + size, i))
        got[i] += 1
        loads[i] = x + size
    return got


def schedule(classes: Iterable[tuple[int, int]], shards: int, most: int = CLASSES) -> Iterator[list[tuple]]:
    """For classes (size, count), sizes falling: (size, its first place in the order of groups, the running counts by shard),
    in lists of most."""
    loads, first, out = [0] * shards, 0, []
    for size, count in classes:
        got = deal(loads, size, count)
        out.append((size, first, list(accumulate(got))))
        first += count
        if len(out) == most:
            yield out
            out = []
    yield out


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """id_col, size, text_crc32, shard and slot for every row of docs."""
    spark, t = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.select(F.col(id_col), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("_key")))
    groups = rows.groupBy("_key").agg(F.sum("size").alias("_gsize"))
    groups = ranked(groups, [F.col("_gsize").desc(), F.col("_key")])
    classes = materialize(groups.groupBy("_gsize").agg(F.count(F.lit(1)).alias("n")))
    parts = (tuple(r) for r in classes.orderBy(F.desc("_gsize")).toLocalIterator())
    where, form = f"{shared_dir(spark)}/{uuid.uuid4().hex}", "_gsize long, _first long, _upto array<long>"
    for part in schedule(parts, shards):
        spark.createDataFrame(part, form).coalesce(1).write.mode("append").parquet(where)
    plan = spark.read.schema(form).parquet(where)
    at = F.size(F.filter("_upto", lambda x: x <= F.col("_rank") - F.col("_first")))
    homes = groups.join(plan.hint("merge"), "_gsize")  # the plan grows with the input: never broadcast
    homes = homes.select("_key", at.alias("shard"))
    placed = rows.join(homes, "_key").select(id_col, "size", "text_crc32", "shard")
    placed = ranked(placed, [F.col("shard"), F.col(id_col), F.col("text_crc32"), F.col("size")])
    ends = placed.groupBy("shard").agg(F.min("_rank").alias("_start"))
    return placed.join(F.broadcast(ends), "shard").select(id_col, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_rank") - F.col("_start")).alias("slot"))  # one row a shard


def op4_lpt_shards(spark, sf_dir: str) -> DataFrame:
    placed = shard(load(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
