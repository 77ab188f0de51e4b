"""The composite read queries: overview, lists, activity, entity pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.operators import graph

NEW = "NEW"


def overview(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table: one aggregate for each, joined as single rows."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.crossJoin(n)
    return out


def type_histogram(entities: DataFrame, by: str = "type") -> DataFrame:
    """Counts by type with their share."""
    c = entities.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return c.select(by, "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share")).orderBy(F.desc("n"), by)


def newest(entities: DataFrame, limit: int = 200) -> DataFrame:
    return entities.orderBy(F.desc("created_at"), "id").limit(limit).withColumn("snippet", F.substring("content", 1, 160))


def by_type(entities: DataFrame, kind: str, limit: int) -> DataFrame:
    return newest(entities.where(F.col("type") == kind), limit)


def entities_with_links(entities: DataFrame, backlinks: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    nodes = newest(entities, limit)
    return nodes, graph.induced(nodes, backlinks)


def activity(commits: DataFrame, entities: DataFrame, weeks: int = 12, c_at: str = "author_ts", e_at: str = "created_ts") -> DataFrame:
    """(week, commits, entities): the last weeks of each side, merged, missing ones 0; up to twice as many weeks."""

    def latest(df: DataFrame, at: str, name: str) -> DataFrame:
        return df.groupBy(X.week(F.col(at)).alias("week")).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc("week")).limit(weeks)

    j = latest(commits, c_at, "commits").join(latest(entities, e_at, "entities"), "week", "full_outer")
    return j.select("week", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("entities", F.lit(0)).alias("entities")).orderBy("week")


def growth(weeks: DataFrame, value: str) -> DataFrame:
    """Change to the week before in percent, rounded half up; NEW after a 0. A week is a row, so the window is small."""
    before = F.lag(value).over(W.orderBy("week"))
    rate = F.floor((F.col(value) - before) / before * 100 + 0.5).cast("long").cast("string")
    return weeks.select("week", value, F.when(before.isNull(), None).when(before == 0, NEW).otherwise(rate).alias("growth"))


def timeline(commits: DataFrame, entities: DataFrame, limit: int = 50, most: int = 8) -> DataFrame:
    """The latest commits(sha, ts) with their number of entities(commit_sha, id) and the first of them."""
    c = commits.orderBy(F.desc("ts"), "sha").limit(limit)
    own = entities.join(F.broadcast(c.select(F.col("sha").alias("commit_sha"))), "commit_sha").groupBy("commit_sha").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("id")), 1, most).alias("ids"))
    return c.join(own, c.sha == own.commit_sha, "left").select(*c.columns, F.coalesce("n", F.lit(0)).alias("n_entities"), F.coalesce("ids", F.array().cast("array<string>")).alias("entities"))


def relations(backlinks: DataFrame, entities: DataFrame, limit: int = 100) -> DataFrame:
    """Links with both names, by from_id."""
    a = entities.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"))
    b = entities.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    return backlinks.join(a, "from_id").join(b, "to_id").select("from_id", "from_name", "to_id", "to_name", "relationship").orderBy("from_id", "to_id", "relationship").limit(limit)


def dataflow(projected: DataFrame, limit: int = 200) -> dict[str, DataFrame]:
    """The first tables, queries and services, their edges, and the files of those queries."""
    tables = projected.select("table_name").distinct().orderBy("table_name").limit(limit)
    queries = projected.select("query_id", "path").distinct().orderBy("query_id").limit(limit)
    services = projected.where("service IS NOT NULL").select("service").distinct().orderBy("service").limit(limit)
    kept = projected.join(F.broadcast(tables), "table_name", "left_semi").join(F.broadcast(queries.select("query_id")), "query_id", "left_semi")
    return {"tables": tables, "queries": queries, "services": services, "edges": kept.select("table_name", "query_id", "path").distinct(), "files": queries.select("path").distinct()}


def entity_page(entities: DataFrame, commits: DataFrame, backlinks: DataFrame, id_: str) -> DataFrame:
    """An entity with its commit and outgoing links; no row if unknown."""
    e = entities.where((F.col("id") == id_) | (F.col("name") == id_)).orderBy(F.when(F.col("id") == id_, 0).otherwise(1), "id").limit(1)
    links = graph.related(backlinks, e).groupBy(F.col("from_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("to_id").alias("id"), "relationship"))).alias("related"))
    c = commits.select(F.col("sha").alias("commit_sha"), F.struct("sha", "message", "author", "author_date").alias("commit"))
    return e.join(links, "id", "left").join(c, "commit_sha", "left")


def symbols(files: DataFrame, symbols_: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    s = symbols_.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "name", "kind", "start_line")
    return files.orderBy("path").limit(limit), s.orderBy("path", "name", "start_line").limit(limit)


def ratios(n_entities: int, n_backlinks: int) -> dict[str, float]:
    return {"fill": min(1.0, n_entities / 1000), "density": min(1.0, n_backlinks / n_entities / 8) if n_entities else 0.0}
