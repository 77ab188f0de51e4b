"""Vectors: exact nearest neighbours, the semantic corpus, staleness and incremental embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.functions import text as X


def l2(a: Column, q: list[float]) -> Column:
    """Euclidean distance to a query vector, in double precision."""
    lit = F.array(*[F.lit(float(x)) for x in q])
    return F.sqrt(F.aggregate(F.zip_with(a, lit, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def l2_to_cosine(d: Column) -> Column:
    return 1 - d * d / 2


def knn(vectors: DataFrame, q: list[float], k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest rows: a scan, then a top-k that keeps k rows a task."""
    return vectors.select(id_col, l2(F.col(vec), q).alias("distance")).orderBy("distance", id_col).limit(k)


def knn_by(vectors: DataFrame, q: list[float], k: int, by: str, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest rows of each group; Spark prunes to k rows a group and task before the shuffle."""
    d = vectors.select(by, id_col, l2(F.col(vec), q).alias("distance"))
    return d.withColumn("rn", F.row_number().over(W.partitionBy(by).orderBy("distance", id_col))).where(F.col("rn") <= k)


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedEmbedder:
    """A deterministic embedder without a model file: tokens hashed to signed dimensions, scaled to length 1."""

    def __init__(self, dim: int = 384, model: str = "hashed-tokens"):
        self.dim, self.model = dim, model

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embed_column(embedder: Embedder):
    """A vectorised UDF around an embedder."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embedder.embed(s.fillna("").tolist())))

    return run


def entity_docs(entities: DataFrame) -> DataFrame:
    return entities.select(F.lit("entity").alias("kind"), F.col("id").alias("doc_id"), F.format_string("%s: %s\n%s", "type", "name", F.coalesce("content", F.lit(""))).alias("text"), F.col("name").alias("label"), F.lit(None).cast("string").alias("source_path"))


def symbol_docs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    s = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return s.select(F.lit("symbol").alias("kind"), F.concat(F.lit("sym:"), F.col("id").cast("string")).alias("doc_id"), F.format_string("%s (%s)\n%s\n%s", "name", "kind", "path", F.coalesce("docstring", F.lit(""))).alias("text"), F.col("name").alias("label"), F.col("path").alias("source_path"))


def module_cards(files: DataFrame, symbols: DataFrame, imports: DataFrame, queries: DataFrame, query_tables: DataFrame) -> DataFrame:
    """A card for each file that isn't markdown: exports, imports out, importers, tables; empty lines left out."""
    f = files.where(~F.lower("path").endswith(".md")).select("id", "path")

    def line(name: str, rows: DataFrame, distinct: bool) -> DataFrame:
        gather = F.collect_set("v") if distinct else F.collect_list("v")
        return rows.groupBy("id").agg(F.concat(F.lit(f"{name}: "), F.array_join(F.array_sort(gather), ", ")).alias(name))

    path = files.select(F.col("id").alias("_f"), F.col("path").alias("v"))
    exports = line("exports", symbols.where("exported").select(F.col("file_id").alias("id"), F.col("name").alias("v")), False)
    out = line("imports-out", imports.select(F.col("file_id").alias("id"), F.col("source").alias("v")), True)
    back = line("imported-by", imports.where("resolved_file_id IS NOT NULL").join(path, F.col("file_id") == F.col("_f")).select(F.col("resolved_file_id").alias("id"), "v"), True)
    tables = line("tables", queries.select(F.col("id").alias("query_id"), "file_id").join(query_tables, "query_id").select(F.col("file_id").alias("id"), F.col("table_name").alias("v")), True)
    for x in (exports, out, back, tables):
        f = f.join(x, "id", "left")
    return f.select(F.lit("module").alias("kind"), F.concat(F.lit("mod:"), "path").alias("doc_id"), F.concat_ws("\n", "path", "exports", "`imports-out`", "`imported-by`", "tables").alias("text"), F.col("path").alias("label"), F.col("path").alias("source_path"))


def markdown_chunks(pages: DataFrame, most: int = 700) -> DataFrame:
    """Pieces of pages(path, content) that begin at headings of level 1 to 3; pieces without text are skipped but counted."""
    marked = F.regexp_replace("content", r"(?m)^(?=#{1,3}\s)", "\u0000")
    pieces = F.filter(F.split(marked, "\u0000"), lambda x: F.length(x) > 0)
    p = pages.select("path", F.posexplode(pieces).alias("i", "body")).where(X.trim(F.col("body")) != "")
    return p.select(F.lit("doc").alias("kind"), F.concat(F.lit("doc:"), "path", F.lit("#"), F.col("i").cast("string")).alias("doc_id"), X.clamp_text(F.concat("path", F.lit(" — "), X.trim(F.col("body"))), most, "…").alias("text"), X.first_line(F.col("body")).alias("label"), F.col("path").alias("source_path"))


def staleness(corpus: DataFrame, meta: DataFrame) -> DataFrame:
    """Documents of corpus(kind, doc_id, text) without a row in meta(kind, doc_id, hash), or with another hash."""
    m = meta.select("kind", "doc_id", F.col("hash").alias("_old"))
    return corpus.join(m, ["kind", "doc_id"], "left").where(F.col("_old").isNull() | (F.col("_old") != F.sha2("text", 256))).drop("_old")


def orphans(corpus: DataFrame, meta: DataFrame) -> DataFrame:
    return meta.join(corpus.select("kind", "doc_id"), ["kind", "doc_id"], "left_anti")


def embed(corpus: DataFrame, stored: DataFrame | None, embedder: Embedder, now: int) -> DataFrame:
    """The new vector table: unchanged rows as they are, stale ones embedded, orphans gone; all anew for another model."""
    if stored is not None:
        stored = stored.where((F.col("model") == embedder.model) & (F.col("dim") == embedder.dim))
    todo = corpus if stored is None else staleness(corpus, stored)
    fresh = todo.select("kind", "doc_id", F.sha2("text", 256).alias("hash"), F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"), "source_path", F.lit(now).cast("long").alias("embedded_at"), "label", F.substring("text", 1, 160).alias("snippet"), embed_column(embedder)(F.col("text")).alias("embedding"))
    if stored is None:
        return fresh
    kept = stored.join(corpus.select("kind", "doc_id", F.sha2("text", 256).alias("hash")), ["kind", "doc_id", "hash"], "left_semi")
    return kept.select(*fresh.columns).unionByName(fresh)


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """One row with the number of documents of each kind."""
    return corpus.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("entity", "symbol", "module", "doc")])


def embed_status(corpus: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: corpus size, rows embedded (orphans included), their ratio, stale documents and the last time."""
    m = stored.select("kind", "doc_id", F.col("hash").alias("_old"))
    j = corpus.join(m, ["kind", "doc_id"], "left")
    now = j.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_old").isNull() | (F.col("_old") != F.sha2("text", 256))).alias("stale"))
    had = stored.agg(F.count(F.lit(1)).alias("embedded"), F.max("embedded_at").alias("last_embed_at"))
    ratio = F.when(F.col("total") == 0, 0.0).otherwise(F.col("embedded") / F.col("total"))
    return now.crossJoin(had).select("total", "embedded", ratio.alias("coverage"), "stale", "last_embed_at")  # single rows
