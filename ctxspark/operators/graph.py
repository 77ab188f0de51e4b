"""Graphs as edge tables: bounded traversal, symbol edges, entity relations, data flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxspark.functions import text as X


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(node, depth): nodes reached from seeds(node) over edges(src, dst) in 1 to depth steps, each with its least depth,
    seeds left out. Depths are few, so the frontier joins are unrolled; an anti-join guards against cycles."""
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()
    seen = seeds.select(F.col(node).alias("node")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(e, frontier.node == e._s).select(F.col("_d").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").withColumnRenamed("node", node)


def dependencies(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    return bfs(edges, seeds, depth)


def dependents(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    return bfs(edges, seeds, depth, "dst", "src")


def related(backlinks: DataFrame, ids: DataFrame) -> DataFrame:
    """Outgoing links of ids(id), not de-duplicated."""
    return backlinks.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi")


def related_recursive(backlinks: DataFrame, ids: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth, relationship): each entity once; the label is the smallest among links from the depth before."""
    seen = ids.select(F.col("id").alias("id")).distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relationship"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("from_id")).join(backlinks, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("relationship").alias("relationship"))
        frontier = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "relationship")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def proximity(depth: Column) -> Column:
    return 1 / (1 + F.coalesce(depth, F.lit(3)))


def representative_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol edges from file imports(file_id, resolved_file_id): the first exported symbol of the importing file to each
    exported symbol of the imported one. A file that imports twice gives its edges twice."""
    exported = symbols.where("exported").select("id", "file_id")
    first = exported.groupBy("file_id").agg(F.min("id").alias("from_symbol_id"))
    target = exported.select(F.col("file_id").alias("resolved_file_id"), F.col("id").alias("to_symbol_id"))
    return imports.join(first, "file_id").join(target, "resolved_file_id").where("from_symbol_id <> to_symbol_id").select("from_symbol_id", "to_symbol_id", F.lit("imports").alias("kind"))


def nearest_following(marks: DataFrame, events: DataFrame, key: str, at: str, then: str, carry: list[str]) -> DataFrame:
    """As-of join forwards: for each mark(key, at) the event of the same key with the least then >= at. The two are laid in
    one falling order and the last event seen is carried on, so no pair is made and a key's rows are read once."""
    m = marks.select(*marks.columns, F.col(at).alias("_t"), F.lit(0).alias("_kind"))
    e = events.select(F.col(key), F.col(then).alias("_t"), F.lit(1).alias("_kind"), F.struct(F.col(then).alias("then"), *carry).alias("_next"))
    both = m.unionByName(e, allowMissingColumns=True)
    ahead = W.partitionBy(key).orderBy(F.desc("_t"), F.desc("_kind"), F.col("_next").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_next", F.last("_next", ignorenulls=True).over(ahead)).where("_kind = 0")
    return found.select(*marks.columns, F.col("_next.then").alias(then), *[F.col(f"_next.{c}").alias(c) for c in carry])


def shared_relations(entity_keys: DataFrame, entities: DataFrame) -> DataFrame:
    """Ordered pairs of entities(id, type) that share a key of entity_keys(id, key), once each, labelled from the from side."""
    own = entity_keys.select("id", "key").distinct()
    pairs = own.select(F.col("id").alias("from_id"), "key").join(own.select(F.col("id").alias("to_id"), "key"), "key").where("from_id <> to_id").select("from_id", "to_id").distinct()
    label = F.when(F.col("type") == "bug_fix", "fixes").when(F.col("type") == "breaking_change", "breaks").when(F.col("type") == "pattern", "implements").otherwise("relates_to")
    return pairs.join(entities.select(F.col("id").alias("from_id"), "type"), "from_id").select("from_id", "to_id", label.alias("relationship"), F.lit("shared files").alias("context"))


def both_ways(relations: DataFrame) -> DataFrame:
    """Relations and their inverses, the first of equal (from, to, relationship)."""
    back = relations.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.concat(F.lit("inverse:"), "relationship").alias("relationship"), "context")
    return relations.select("from_id", "to_id", "relationship", "context").unionByName(back).groupBy("from_id", "to_id", "relationship").agg(F.min("context").alias("context"))


def projection(files: DataFrame, queries: DataFrame, query_tables: DataFrame) -> DataFrame:
    """(table_name, query_id, path, service) for files(id, path), queries(id, file_id), query_tables(query_id, table_name)."""
    q = queries.select(F.col("id").alias("query_id"), "file_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return query_tables.select("query_id", "table_name").join(q, "query_id").select("table_name", "query_id", "path", X.service_name(F.col("path")).alias("service"))


def tagged(graph: DataFrame, tags: dict[str, str] | None) -> DataFrame:
    """Rows whose table has all the given tags."""
    for dimension, value in (tags or {}).items():
        graph = graph.where(X.tag(F.col("table_name"), dimension) == value)
    return graph


def impact(graph: DataFrame, table: str, tags: dict[str, str] | None = None) -> DataFrame:
    """One row: files and services that a table reaches."""
    hit = tagged(graph.where(F.col("table_name") == table), tags)
    return hit.agg(F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.collect_set("service")).alias("services"), F.count_distinct("path").alias("n_files"), F.count_distinct("service").alias("n_services"))


def parallel_storage(graph: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """(table_name, systems) of tables that are kept in two or more systems."""
    return tagged(graph, tags).groupBy("table_name").agg(F.array_sort(F.collect_set(X.storage_system(F.col("path")))).alias("systems")).where(F.size("systems") > 1)


def counts(graph: DataFrame) -> DataFrame:
    """One row: the tables, queries and files of the data flow."""
    return graph.agg(F.count_distinct("table_name").alias("tables"), F.count_distinct("query_id").alias("queries"), F.count_distinct("path").alias("files"))


def validate(files: DataFrame, queries: DataFrame, query_tables: DataFrame) -> dict[str, DataFrame]:
    """Queries without a table, and files with SQL but no service."""
    orphan = queries.join(query_tables.select(F.col("query_id").alias("id")), "id", "left_anti")
    graph = projection(files, queries, query_tables)
    unmapped = files.join(queries.select(F.col("file_id").alias("id")), "id", "left_semi").where(X.service_name(F.col("path")).isNull())
    counts = graph.agg(F.count_distinct("table_name").alias("tables"), F.count_distinct("query_id").alias("queries"), F.count_distinct("service").alias("services"))
    return {"orphan_queries": orphan, "unmapped_files": unmapped, "counts": counts}


def induced(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Edges with both ends among nodes."""
    n = nodes.select(F.col(key))
    return edges.join(n, edges.from_id == n[key], "left_semi").join(n.select(F.col(key).alias("_to")), F.col("to_id") == F.col("_to"), "left_semi")
