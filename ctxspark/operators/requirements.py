"""Requirements: tracker exports, atomic statements, coverage and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions import text as X


def normalise(raw: DataFrame, kind: str) -> DataFrame:
    """requirements(id, title, description, source, status, warning) from a tracker's rows: jira (key, self, fields), github
    (number, title, body, html_url, state, labels, pull_request; only issues labelled requirement) or native."""
    if kind == "jira":
        status = F.col("fields.status.name")
        return raw.where("key IS NOT NULL").select(F.col("key").alias("id"), F.coalesce("fields.summary", F.lit("")).alias("title"), X.html_to_text(F.col("fields.description")).alias("description"), F.coalesce("self", F.lit("jira")).alias("source"), X.external_status(status).alias("status"), F.when(~X.known_status(status), F.concat(F.lit("unmapped status: "), F.coalesce(status, F.lit("")))).alias("warning"))
    if kind == "github":
        kept = raw.where(F.exists("labels", lambda x: F.lower(x["name"]) == "requirement"))
        if "pull_request" in raw.columns:
            kept = kept.where("pull_request IS NULL")
        status = F.when(F.lower("state") == "closed", "implemented").otherwise("draft")
        return kept.select(F.concat(F.lit("GH-"), F.col("number").cast("string")).alias("id"), "title", X.html_to_text(F.col("body")).alias("description"), F.coalesce("html_url", F.lit("github")).alias("source"), status.alias("status"), F.lit(None).cast("string").alias("warning"))
    if kind == "native":
        return raw.where("id IS NOT NULL AND status IN ('draft', 'approved', 'implemented')").select("id", "title", "description", "source", "status", F.lit(None).cast("string").alias("warning"))
    raise ValueError(f"unknown format {kind!r}")


def atomic(requirements: DataFrame) -> DataFrame:
    """(req_id, statement, type, order) of each requirement's lines."""
    s = requirements.select(F.col("id").alias("req_id"), F.explode(X.atomic_statements(F.col("description"))).alias("s"))
    return s.select("req_id", F.col("s.text").alias("statement"), "s.type", F.col("s.pos").cast("int").alias("order"))


def orphan_requirements(requirements: DataFrame, links: DataFrame) -> DataFrame:
    return requirements.join(links.select(F.col("req_id").alias("id")), "id", "left_anti")


def untracked_symbols(symbols: DataFrame, links: DataFrame) -> DataFrame:
    return symbols.join(links.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def citing_commits(commits: DataFrame, req_id: str) -> DataFrame:
    """Commits whose message names the requirement as a word: a cheap test first, then the exact one."""
    import re

    return commits.where(F.lower("message").contains(req_id.lower()) & F.col("message").rlike(rf"(?i)(?<![A-Za-z0-9]){re.escape(req_id)}(?![0-9])"))


def context(req_id: str, requirements: DataFrame, atomics: DataFrame, commits: DataFrame, links: DataFrame, symbols: DataFrame, files: DataFrame) -> dict | None:
    """A requirement with its statements, the commits that cite it and its symbols."""
    row = requirements.where(F.lower("id") == req_id.lower()).first()
    if row is None:
        return None
    linked = links.where(F.col("req_id") == row["id"]).join(symbols.select(F.col("id").alias("symbol_id"), "name", "file_id"), "symbol_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return row.asDict() | {
        "statements": [r.asDict() for r in atomics.where(F.col("req_id") == row["id"]).orderBy("order").collect()],
        "commits": [r.asDict() for r in citing_commits(commits, row["id"]).orderBy("sha").collect()],
        "symbols": [r.asDict() for r in linked.select("name", "path").orderBy("path", "name").collect()],
    }
