"""Git history as a table, and what is derived from commits."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ctxspark.functions import text as X

DIFF = 4000
#: Fixed value: characters of a diff in a prompt.
PROMPT_DIFF = 800
_FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%aI%x1f%cI%x1f%s"


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=True).stdout


def commits(root: str, since: str | None = None) -> list[tuple]:
    """(seq, sha, parent_sha, author, author_date, committer_date, message, files), oldest first, merges by git's own subject
    left out; an unknown since means all."""
    span = []
    if since and subprocess.run(["git", "-C", root, "cat-file", "-e", f"{since}^{{commit}}"], capture_output=True).returncode == 0:
        span = [f"{since}..HEAD"]
    out = []
    for n, part in enumerate(_git(root, "log", "--reverse", "--name-only", f"--format={_FORMAT}", *span).split("\x1e")[1:]):
        head, _, names = part.partition("\n")
        sha, parents, author, authored, committed, subject = head.split("\x1f")
        if not subject.startswith("Merge "):
            out.append((n, sha, parents.split(" ")[0] or None, author, authored, committed, subject, [x for x in names.split("\n") if x]))
    return out


class GitLog(DataSource):
    """spark.read.format("gitlog").load(repository): a row for each commit. One process reads the log; a history is small
    beside what is derived from it."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "seq long, sha string, parent_sha string, author string, author_date string, committer_date string, message string, files array<string>"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.since = options["path"], options.get("since")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from commits(self.root, self.since)


def git_log(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    spark.dataSource.register(GitLog)
    r = spark.read.format("gitlog")
    return (r.option("since", since) if since else r).load(root)


def diff(root: str, sha: str) -> str:
    """A commit's diff, cut; the first commit's statistics."""
    first = not _git(root, "rev-list", "--parents", "-n", "1", sha).split()[1:]
    return (_git(root, "show", "--stat", sha) if first else _git(root, "diff", f"{sha}^", sha))[:DIFF]


def batches(log: DataFrame, size: int = 10) -> DataFrame:
    """log with a batch number; seq counts from 0 in the log's order."""
    return log.withColumn("batch", F.floor(F.col("seq") / size))


def with_diffs(log: DataFrame, root: str) -> DataFrame:
    """log with each commit's diff, read where the rows are; the repository must be mounted there."""

    @F.pandas_udf(T.StringType())
    def read(sha: pd.Series) -> pd.Series:
        return sha.map(lambda s: diff(root, s))

    return log.withColumn("diff", read("sha"))


def sanitized(text: Column) -> Column:
    """A diff without secrets, known ones by pattern and others by entropy."""
    from ctxspark.functions.udfs import redact_entropy

    return redact_entropy(X.redact_patterns(text))


def batch_prompts(log: DataFrame, size: int = 10) -> DataFrame:
    """(batch, commit_sha, prompt) for log(seq, sha, author, message, diff): what a model is asked about size commits in their
    order, diffs redacted and cut; commit_sha is the first commit."""
    cut = F.substring(sanitized(F.coalesce("diff", F.lit(""))), 1, PROMPT_DIFF)
    block = F.concat_ws("\n", F.concat(F.lit("Commit "), F.substring("sha", 1, 7), F.lit(" by "), F.coalesce("author", F.lit("unknown"))), F.concat(F.lit("Message: "), F.coalesce("message", F.lit(""))), F.concat(F.lit("Diff: "), cut))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"])  # size rows
    task = (
        "Read these commits and tell what they show about the code. Answer with JSON alone: an object with a list entities, each "
        f"with type (one of {', '.join(k for k, _ in X.TYPE_WORDS)}), name (lower case, words joined by -) and content (what and why).\n\n"
    )
    b = batches(log.withColumn("block", block), size).groupBy("batch").agg(F.min_by("sha", "seq").alias("commit_sha"), F.array_join(ordered, "\n\n").alias("blocks"))
    return b.select("batch", "commit_sha", F.concat(F.lit(task), "blocks").alias("prompt"))


def answered_entities(answers: DataFrame) -> DataFrame:
    """(batch, id, type, name, content, commit_sha) from answers(batch, commit_sha, answer): entities of a known type with a
    name. An answer that isn't the JSON asked for has none; fences around it are taken off."""
    asked = F.from_json(X.strip_fences(F.col("answer")), "entities array<struct<type:string,name:string,content:string>>")
    e = answers.select("batch", "commit_sha", F.explode(asked["entities"]).alias("e"))
    name = X.trim(F.lower("e.name"))
    e = e.where(F.col("e.type").isin(*[k for k, _ in X.TYPE_WORDS])).select("batch", F.col("e.type").alias("type"), name.alias("name"), F.coalesce("e.content", F.lit("")).alias("content"), "commit_sha").where("name <> ''")
    return e.select("batch", X.entity_id(F.col("type"), F.col("name")).alias("id"), "type", "name", "content", "commit_sha")


def model_entities(log: DataFrame, model: Callable[[str], str], size: int = 10) -> DataFrame:
    """Entities that a model finds in log(seq, sha, author, message, diff). The model is called on the executors."""

    @F.pandas_udf(T.StringType())
    def ask(prompt: pd.Series) -> pd.Series:
        return prompt.map(model)

    return answered_entities(batch_prompts(log, size).select("batch", "commit_sha", ask("prompt").alias("answer")))


def commit_rows(log: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return log.select("sha", "message", "author", "author_date", "committer_date", zero.alias("insertions"), zero.alias("deletions"), "parent_sha", X.commit_type(F.col("message")).alias("commit_type"), "seq")


def commit_files(log: DataFrame, files: DataFrame) -> DataFrame:
    return log.select(F.col("sha").alias("commit_sha"), F.explode("files").alias("path")).join(files.select(F.col("id").alias("file_id"), "path"), "path").select("commit_sha", "file_id").distinct()


def entities(log: DataFrame) -> DataFrame:
    """(seq, id, type, name, content, commit_sha, files): one entity a commit."""
    kind = X.classify_type(F.concat(F.col("message"), F.lit(" "), F.array_join("files", " ")))
    e = log.select("seq", "sha", "files", "message", kind.alias("type"), X.derive_name(F.col("message")).alias("name"))
    return e.select("seq", X.entity_id(F.col("type"), F.col("name")).alias("id"), "type", "name", X.entity_content(F.col("message"), F.col("files")).alias("content"), F.col("sha").alias("commit_sha"), "files")


def appended(parts: Column) -> Column:
    """Contents in order, each on a line of its own unless the text so far contains it."""
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), lambda acc, x: F.when(F.contains(acc, x), acc).otherwise(F.concat(acc, F.lit("\n"), x)))


def accumulated(found: DataFrame, key: str = "id", seq: str = "seq", content: str = "content", first: tuple[str, ...] = ("type", "name", "commit_sha")) -> DataFrame:
    """One row a key: the first row's columns, contents appended in order."""
    ordered = F.sort_array(F.collect_list(F.struct(seq, content)))
    return found.groupBy(key).agg(*[F.min_by(c, seq).alias(c) for c in first], appended(F.transform(ordered, lambda x: x[content])).alias(content))


def relation_rows(found: DataFrame) -> DataFrame:
    """Relations of the entities of some commits and their inverses. An entity's files are those of its last commit."""
    from ctxspark.operators import graph

    last = found.groupBy("id").agg(F.max_by("files", "seq").alias("files"), F.min_by("type", "seq").alias("type"))
    keys = last.select("id", F.explode("files").alias("key"))
    return graph.both_ways(graph.shared_relations(keys, last.select("id", "type")))


def entity_symbols(found: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(entity_id, symbol_id): symbols of the commit's files that are named like the entity."""
    s = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", F.lower("name").alias("name"), F.col("id").alias("symbol_id"))
    e = found.select(F.col("id").alias("entity_id"), F.lower("name").alias("name"), F.explode("files").alias("path"))
    return e.join(s, ["path", "name"]).select("entity_id", "symbol_id").distinct()


