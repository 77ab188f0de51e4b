"""Test, lint and coverage reports, requirement exports and the project registry."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 64 * 1024 * 1024
VITEST = "numTotalTests long, numPassedTests long, numFailedTests long, numPendingTests long, testResults array<struct<startTime:double,endTime:double>>"
ESLINT = "array<struct<errorCount:long,warningCount:long>>"
COVERAGE = "map<string,struct<s:map<string,long>,b:map<string,array<long>>,f:map<string,long>>>"


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(value) the text of each file."""
    return spark.read.text(path, wholetext=True)


def vitest_column(doc: Column) -> Column:
    """(total, passed, failed, skipped, duration_ms) of a report."""
    r = F.from_json(doc, VITEST)
    took = F.aggregate(F.coalesce(r["testResults"], F.array().cast("array<struct<startTime:double,endTime:double>>")), F.lit(0.0), lambda a, x: a + F.coalesce(x["endTime"] - x["startTime"], F.lit(0.0)))
    return F.struct(r["numTotalTests"].alias("total"), r["numPassedTests"].alias("passed"), r["numFailedTests"].alias("failed"), r["numPendingTests"].alias("skipped"), took.alias("duration_ms"))


def eslint_column(doc: Column) -> Column:
    """(errors, warnings, files, files_with_errors) of a report."""
    r = F.from_json(doc, ESLINT)

    def total(name: str) -> Column:
        return F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x[name])

    return F.struct(total("errorCount").alias("errors"), total("warningCount").alias("warnings"), F.size(r).cast("long").alias("files"), F.size(F.filter(r, lambda x: x["errorCount"] > 0)).cast("long").alias("files_with_errors"))


def junit_column(doc: Column) -> Column:
    """(total, passed, failed, skipped) of a report: the sums over its testsuite tags."""
    suites = F.regexp_extract_all(doc, F.lit(r"<testsuite\s[^>]*>"), F.lit(0))

    def total(name: str) -> Column:
        return F.aggregate(suites, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(F.nullif(F.regexp_extract(s, rf'\s{name}="(\d+)"', 1), F.lit("")).cast("long"), F.lit(0).cast("long")))

    n, bad, skipped = total("tests"), total("failures") + total("errors"), total("skipped")
    return F.struct(n.alias("total"), F.greatest(n - bad - skipped, F.lit(0).cast("long")).alias("passed"), bad.alias("failed"), skipped.alias("skipped"))


def coverage_column(doc: Column) -> Column:
    """(lines_pct, branches_pct, functions_pct) of a report as ratios; nothing to cover is 1."""
    files = F.map_values(F.from_json(doc, COVERAGE))

    def ratio(counts: Column) -> Column:
        return F.when(F.size(counts) > 0, F.size(F.filter(counts, lambda x: x > 0)) / F.size(counts)).otherwise(1.0)

    def hits(name: str) -> Column:
        return F.transform(files, lambda f: F.map_values(f[name]))

    lines, branches, functions = hits("s"), hits("b"), hits("f")
    return F.struct(ratio(F.flatten(lines)).alias("lines_pct"), ratio(F.flatten(F.flatten(branches))).alias("branches_pct"), ratio(F.flatten(functions)).alias("functions_pct"))


PARSERS = {"vitest": vitest_column, "eslint": eslint_column, "junit": junit_column, "coverage": coverage_column}


def parsed(docs: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Each report of docs(value) as a row."""
    return docs.select(PARSERS[kind](F.col(value)).alias("_r")).select("_r.*")


def check_report(path: str) -> None:
    if not os.path.exists(path):
        raise ValueError(f"report not found: {path}")
    if os.path.isfile(path) and os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"report larger than 64 MB: {path}")


def report_signals(spark: SparkSession, kind: str, path: str) -> dict[str, float]:
    """The signals of a report; kind: vitest, eslint, junit (a file or a directory of .xml files) or coverage."""
    check_report(path)
    docs = whole(spark, os.path.join(path, "*.xml") if os.path.isdir(path) else path)
    if kind in ("vitest", "junit"):
        r = parsed(docs, kind).agg(F.sum("total").alias("total"), F.sum("passed").alias("passed")).first()
        if not r["total"]:
            raise ValueError("the report has no tests")
        return {"tests_pass": float(r["passed"]), "tests_total": float(r["total"])}
    if kind == "eslint":
        r = parsed(docs, kind).first()
        return {"lint_errors": float(r["files_with_errors"]), "lint_total": float(max(1, r["files"]))}
    if kind == "coverage":
        return {f"coverage_{k[:-4]}": v for k, v in parsed(docs, kind).first().asDict().items()}
    raise ValueError(f"unknown report {kind!r}")


def signal_pairs(args: list[str]) -> dict[str, float]:
    out = {}
    for a in args:
        m = re.fullmatch(r"([^=]+)=(.+)", a)
        if not m:
            raise ValueError(f"expected key=value: {a!r}")
        out[m[1]] = float(m[2])
    return out


JIRA = "key string, self string, fields struct<summary:string,description:string,status:struct<name:string>>"


def requirements_export(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A tracker's export as requirement rows; jira files may wrap their issues."""
    from ctxspark.operators.requirements import normalise

    if kind == "jira":
        both = F.coalesce(F.from_json("value", f"issues array<struct<{re.sub(r'(\w+) (string|struct)', r'\1:\2', JIRA)}>>")["issues"], F.from_json("value", f"array<struct<{re.sub(r'(\w+) (string|struct)', r'\1:\2', JIRA)}>>"))
        return normalise(whole(spark, path).select(F.explode(both).alias("x")).select("x.*"), kind)
    raw = spark.read.json(path, multiLine=True)
    return normalise(raw, kind)


def load_registry(path: str) -> list[dict]:
    try:
        with open(path) as f:
            return list(json.load(f).get("projects", []))
    except (OSError, ValueError):
        return []


def register_project(path: str, name: str, root: str, store: str, now: int) -> dict:
    """Upsert by root."""
    entry = {"name": name, "path": root, "store": store, "last_indexed": now}
    rest = [p for p in load_registry(path) if p.get("path") != root]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump({"projects": [*rest, entry]}, f, indent=1)
    return entry


def discover_projects(root: str, depth: int = 2, marker: str = ".ctxspark") -> list[dict]:
    """Directories with a store, down to a depth."""
    out = []
    for at, dirs, _ in os.walk(root):
        level = 0 if at == root else os.path.relpath(at, root).count(os.sep) + 1
        if marker in dirs:
            out.append({"name": os.path.basename(at), "path": at, "store": os.path.join(at, marker)})
        dirs[:] = [d for d in sorted(dirs) if level < depth and not d.startswith(".")]
    return out


def projects(path: str, root: str | None = None) -> list[dict]:
    """Registered projects, then discovered ones at other places."""
    known = load_registry(path)
    have = {p.get("path") for p in known}
    return known + [p for p in (discover_projects(root) if root else []) if p["path"] not in have]
