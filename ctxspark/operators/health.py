"""Health: signals, dimensions, score and issues."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions.text import clamp01

DAY_MS, ISSUE_LIMIT, ISSUE_GROUPS = 24 * 60 * 60 * 1000, 50, 10
PAIRS = (("tests_pass", "tests_total"), ("lint_errors", "lint_total"))


def normalise_signals(pairs: dict[str, float]) -> dict[str, float]:
    """Ratios: a count with its total is divided by it; alone it is a ratio already. A total is kept as 1."""
    out: dict[str, float] = {}
    for part, total in PAIRS:
        if part not in pairs:
            if total in pairs:
                raise ValueError(f"{total} without {part}")
            continue
        if total in pairs and pairs[total] <= 0:
            raise ValueError(f"{total} must be greater than 0")
        out[part] = pairs[part] / pairs[total] if total in pairs else pairs[part]
        if not 0 <= out[part] <= 1:
            raise ValueError(f"{part} must be in [0, 1]")
        out[total] = 1.0
    return out | {k: v for k, v in pairs.items() if k not in out}


def check_signal(key: str, value: float) -> None:
    if not key or not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"signal {key!r} must be a finite ratio in [0, 1], not {value}")


def dimensions(files: DataFrame, imports: DataFrame, signals: DataFrame, now: int) -> DataFrame:
    """One row: freshness, consistency, coverage, confidence, score. files(parsed_at), imports(resolved, external),
    signals(key, value); what has no data is neutral."""
    f = files.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parsed_at") > now - DAY_MS).alias("recent"))
    i = imports.agg(F.count_if(~F.col("external")).alias("inside"), F.count_if(~F.col("resolved")).alias("broken"))
    s = signals.agg(F.max(F.when(F.col("key") == "tests_pass", F.col("value"))).alias("tests"), F.max(F.when(F.col("key") == "lint_errors", F.col("value"))).alias("lint"))
    one = f.crossJoin(i).crossJoin(s)  # three single rows
    half = F.lit(0.5)
    good = F.when(F.col("inside") == 0, half).otherwise(clamp01(1 - F.col("broken") / F.col("inside")))
    tests = F.coalesce(clamp01(F.col("tests")), half)
    out = one.select(
        F.when((F.col("n") == 0) | (F.col("recent") == 0), half).otherwise(clamp01(F.col("recent") / F.col("n"))).alias("freshness"),
        good.alias("consistency"),
        clamp01(tests * F.coalesce(clamp01(1 - F.col("lint")), half)).alias("coverage"),
        clamp01(0.5 * good + 0.5 * tests).alias("confidence"),
    )
    score = 0.3 * F.col("freshness") + 0.3 * F.col("consistency") + 0.2 * F.col("coverage") + 0.2 * F.col("confidence")
    return out.withColumn("score", F.floor(score * 100 + 0.5).cast("long"))


def issues(files: DataFrame, imports: DataFrame, dims: DataFrame) -> DataFrame:
    """(seq, type, message, location): broken imports by id, then weak dimensions."""
    broken = imports.where(~F.col("resolved")).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    broken = broken.select(F.col("id").alias("seq"), F.lit("broken_import").alias("type"), F.concat(F.lit("unresolved import: "), "source").alias("message"), F.col("path").alias("location"))
    last = (1 << 62)
    weak = dims.select(F.explode(F.array(*[F.struct(F.lit(last + n).alias("seq"), F.lit(f"low_{d}").alias("type"), F.lit(f"{d} below 50%").alias("message"), F.lit(None).cast("string").alias("location"), (F.col(d) < 0.5).alias("_on")) for n, d in enumerate(("coverage", "confidence"))])).alias("x")).select("x.*").where("_on").drop("_on")
    return broken.unionByName(weak)


def issue_summary(found: DataFrame, groups: int = ISSUE_GROUPS) -> DataFrame:
    """The most frequent (type, message); ties by first appearance."""
    g = found.groupBy("type", "message").agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"))
    return g.orderBy(F.desc("count"), "first_seq").limit(groups)


def issue_page(found: DataFrame, limit: int = ISSUE_LIMIT, offset: int = 0) -> DataFrame:
    """Rows by seq; equal ones by message, type and location, all descending, so that pages neither share nor lose a row."""
    return found.orderBy("seq", F.desc("message"), F.desc("type"), F.desc("location")).offset(max(0, offset)).limit(max(0, limit))


def report(files: DataFrame, imports: DataFrame, signals: DataFrame, now: int, limit: int = ISSUE_LIMIT, offset: int = 0) -> dict:
    """The whole report as plain values; issues are a page."""
    dims = dimensions(files, imports, signals, now)
    found = issues(files, imports, dims)
    page = [r.asDict() for r in issue_page(found, limit, offset).drop("seq").collect()]
    total = found.count()
    row = dims.first().asDict()
    return {"score": row.pop("score"), "dimensions": row, "issues": page, "issues_total": total, "issues_truncated": max(0, total - offset - len(page)), "issue_summary": [r.asDict() for r in issue_summary(found).drop("first_seq").collect()]}
