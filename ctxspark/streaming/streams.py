"""Structured Streaming: debounced file events, the tool log, commits into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.operators import search
from ctxspark.sources import gitlog
from ctxspark.store import Store

#: Fixed value: files that a store itself writes, and directories that no watcher follows.
QUIET = r"(?:^|/)(?:node_modules|\.git|\.ctxspark)(?:/|$)|\.db(?:-wal|-shm|-journal)?$"
TOOL_LOG = "ts timestamp, sessionId string, tool string"


def debounced(events: DataFrame, gap: str = "250 milliseconds", late: str | None = "1 minute", path: str = "path", ts: str = "ts") -> DataFrame:
    """(path, first_ts, last_ts, n): bursts of events(path, ts) on a path that end with gap of quiet. On a stream, late
    bounds the state."""
    e = events.where(~F.col(path).rlike(QUIET))
    if late and e.isStreaming:
        e = e.withWatermark(ts, late)
    g = e.groupBy(F.session_window(ts, gap).alias("w"), F.col(path)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return g.select(path, "first_ts", "last_ts", "n")


def tool_log(spark: SparkSession, folder: str) -> DataFrame:
    """The append-only log of tool uses as a stream of JSON lines."""
    return spark.readStream.schema(TOOL_LOG).json(folder)


def per_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", by: str = "tool", ts: str = "ts") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, window).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def merge_entities(store: Store, found: DataFrame) -> None:
    """Add found entities (as of gitlog) to the table: contents are appended, created_at stays, last_seen is
    now. The search index changes with them, for these entities only; all tables move in one step."""
    have = store.read("entities")
    old = have.select(F.lit(-1).cast("long").alias("seq"), "id", "type", "name", "content", "commit_sha")
    touched = old.join(found.select("id").distinct(), "id", "left_semi").unionByName(found.select(*old.columns))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    new = gitlog.accumulated(touched).join(have.select("id", F.col("created_at").alias("_at"), F.col("tags").alias("_tags")), "id", "left")
    new = new.withColumns({"created_at": F.coalesce("_at", now), "last_seen": now, "tags": F.coalesce("_tags", F.array().cast("array<string>"))}).drop("_at", "_tags").persist()
    ids = new.select("id")
    merged = have.join(ids, "id", "left_anti").unionByName(new)
    tables = zip(("postings", "posting_lengths"), search.entity_postings(new if store.has("postings") else merged), strict=True)
    store.write(entities=merged, **{name: store.read(name).join(ids, "id", "left_anti").unionByName(rows) for name, rows in tables})
    new.unpersist()


def sync_commits(store: Store, root: str) -> int:
    """Read the commits since the cursor and merge them; the same tables as reading all at once, but for relations, which
    relate the commits of one synchronisation only. The number of new commits."""
    spark = store.spark
    log = gitlog.git_log(spark, root, store.metadata("last_indexed_sha"))
    log = log.join(store.read("commits").select("sha"), "sha", "left_anti").persist()
    n = log.count()
    if n:
        base = store.read("commits").agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("b")).first()["b"]
        log = log.withColumn("seq", F.col("seq") + base)
        files, found = store.read("files"), gitlog.entities(log)
        store.merge("commits", gitlog.commit_rows(log))
        store.insert_ignore("commit_files", gitlog.commit_files(log, files))
        merge_entities(store, found)
        store.insert_ignore("backlinks", gitlog.relation_rows(found))
        store.insert_ignore("entity_symbols", gitlog.entity_symbols(found, store.read("symbols"), files))
        store.set_metadata("last_indexed_sha", log.agg(F.max_by("sha", "seq")).first()[0])
    log.unpersist()
    return n


def entity_stream(commits: DataFrame, store: Store, checkpoint: str):
    """Start a stream of commit rows (as of gitlog) that keeps the entities' table up to date, batch by batch."""

    def merge(batch: DataFrame, _: int) -> None:
        merge_entities(store, gitlog.entities(batch))

    return commits.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
