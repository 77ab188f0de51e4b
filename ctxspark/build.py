"""Index a source tree into a store: files, symbols, imports, edges, SQL, requirement links, history."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.operators import extract, graph, resolve
from ctxspark.sources import files as source
from ctxspark.store import Store
from ctxspark.streaming.streams import sync_commits


def index_tree(store: Store, tree: DataFrame, now: int, force: bool = False) -> int:
    """Build from a snapshot of the tree; only changed files are parsed; the specifiers of the others are kept, and all are resolved
    anew, as files come and go. The number of
    changed files."""
    tree = tree.persist()
    old = store.read("files")
    todo = source.sources(tree)
    todo = (todo if force or store.needs_reparse() else source.changed(todo, old)).persist()
    n = todo.count()
    ids = tree.select(F.xxhash64("path").alias("file_id"))
    fresh = todo.select(F.xxhash64("path").alias("file_id"))
    files = source.file_rows(todo, now).unionByName(old.join(fresh.select(F.col("file_id").alias("id")), "id", "left_anti").join(ids.select(F.col("file_id").alias("id")), "id", "left_semi"))
    store.write(files=files)
    files = store.read("files")
    found = extract.extract(todo).persist()

    def children(table: str, new: DataFrame) -> DataFrame:
        kept = store.read(table).join(fresh, "file_id", "left_anti").join(ids, "file_id", "left_semi")
        return kept.unionByName(new, allowMissingColumns=True)

    queries = extract.sql_queries(todo)
    store.write(symbols=children("symbols", extract.symbols(found)), sql_queries=children("sql_queries", queries.drop("tables")))
    symbols = store.read("symbols")
    specifiers = ["id", "file_id", "source", "static"]
    kept = store.read("imports").join(fresh, "file_id", "left_anti").join(ids, "file_id", "left_semi")
    all_imports = kept.select(*specifiers).unionByName(extract.imports(found).select(*specifiers))
    crates = tree_dirs(tree)
    module = next((r["module"] for r in resolve.go_module(tree).collect()), None)
    resolved = resolve.resolve(all_imports, files, resolve.packages(tree), module, crates)
    store.write(imports=resolved, query_tables=extract.query_tables(extract.sql_queries(tree)), requirement_code_links=extract.requirement_links(tree, symbols))
    store.write(edges=graph.representative_edges(store.read("imports").where("resolved_file_id IS NOT NULL"), symbols))
    for x in (found, todo, tree):
        x.unpersist()
    return n


def tree_dirs(tree: DataFrame) -> DataFrame:
    """Directories of crates."""
    return tree.where(F.col("path").rlike(r"(?:^|/)Cargo\.toml$")).select(F.regexp_replace("path", r"/?Cargo\.toml$", "").alias("dir"))


def index(spark: SparkSession, root: str, store_root: str, now: int, force: bool = False) -> dict:
    """Index a local repository and its history."""
    store = Store(spark, store_root)
    n = index_tree(store, source.source_tree(spark, root), now, force)
    commits = sync_commits(store, root) if os.path.isdir(os.path.join(root, ".git")) else 0
    return {"files_changed": n, "commits": commits, **{t: store.read(t).count() for t in ("files", "symbols", "imports", "edges")}}
