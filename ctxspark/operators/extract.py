"""Symbols and imports of source files.

No grammar library is assumed: Python is parsed by its own ast module, the other languages by tables of declaration and
import patterns over text whose comments and strings are blanked. A language without a table yields its file row only."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.sources.files import language_column

ID = r"[A-Za-z_$][\w$]*"
#: By language: (kind, pattern whose group "name" is the symbol's name).
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "typescript": [("class", rf"\b(?:abstract\s+)?class\s+(?P<name>{ID})"), ("method", rf"\b(?:async\s+)?function\s*\*?\s*(?P<name>{ID})"), ("interface", rf"\binterface\s+(?P<name>{ID})"), ("type", rf"\btype\s+(?P<name>{ID})\s*(?:<[^=]*>)?\s*="), ("enum", rf"\benum\s+(?P<name>{ID})"), ("const", rf"^(?:export\s+)?(?:const|let)\s+(?P<name>{ID})")],
    "java": [("class", rf"\b(?:class|record)\s+(?P<name>{ID})"), ("interface", rf"\binterface\s+(?P<name>{ID})"), ("enum", rf"\benum\s+(?P<name>{ID})"), ("method", rf"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)[\w$.<>\[\],? ]+\s+(?P<name>{ID})\s*\([^;{{]*\)\s*(?:throws\s+[\w., ]+)?\s*[{{;]")],
    "go": [("method", rf"^func\s+(?:\([^)]*\)\s*)?(?P<name>{ID})"), ("class", rf"^type\s+(?P<name>{ID})")],
    "rust": [("class", rf"\bstruct\s+(?P<name>{ID})"), ("enum", rf"\benum\s+(?P<name>{ID})"), ("method", rf"\bfn\s+(?P<name>{ID})"), ("method", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>{ID})")],
    "c": [("method", rf"^(?!\s|#|typedef|return|else)[\w*\s]+?\b(?P<name>{ID})\s*\([^;{{]*\)\s*\{{")],
    "cpp": [("class", rf"^\s*(?:class|struct)\s+(?P<name>{ID})\s*[:{{]"), ("method", rf"^(?!\s*#|\s*return|\s*else)[\w:*&<>\s]+?\b(?P<name>{ID})\s*\([^;{{]*\)\s*(?:const)?\s*\{{")],
    "php": [("class", rf"\bclass\s+(?P<name>{ID})"), ("interface", rf"\binterface\s+(?P<name>{ID})"), ("enum", rf"\benum\s+(?P<name>{ID})"), ("method", rf"\bfunction\s+&?(?P<name>{ID})")],
    "ruby": [("class", rf"^\s*(?:class|module)\s+(?P<name>{ID})"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)")],
    "c_sharp": [("class", rf"\b(?:class|record|struct)\s+(?P<name>{ID})"), ("interface", rf"\binterface\s+(?P<name>{ID})"), ("enum", rf"\benum\s+(?P<name>{ID})"), ("method", rf"^\s+(?:(?:public|protected|private|internal|static|virtual|override|async)\s+)+[\w<>\[\],? ]+\s+(?P<name>{ID})\s*\([^;{{]*\)\s*[{{=]")],
    "swift": [("class", rf"\b(?:class|struct)\s+(?P<name>{ID})"), ("interface", rf"\bprotocol\s+(?P<name>{ID})"), ("enum", rf"\benum\s+(?P<name>{ID})"), ("method", rf"\bfunc\s+(?P<name>{ID})")],
    "kotlin": [("class", rf"\b(?:class|object)\s+(?P<name>{ID})"), ("interface", rf"\binterface\s+(?P<name>{ID})"), ("method", rf"\bfun\s+(?:<[^>]+>\s*)?(?:{ID}\.)?(?P<name>{ID})\s*\(")],
    "scala": [("class", rf"\b(?:class|object)\s+(?P<name>{ID})"), ("interface", rf"\btrait\s+(?P<name>{ID})"), ("method", rf"\bdef\s+(?P<name>{ID})")],
    "bash": [("method", r"^\s*(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\)\s*\{"), ("method", r"^\s*function\s+(?P<name>[A-Za-z_][\w-]*)\s*\{")],
    "dart": [("class", rf"\bclass\s+(?P<name>{ID})"), ("enum", rf"\benum\s+(?P<name>{ID})"), ("method", rf"^(?!\s*(?:return|if|for|while|else)\b)[\w<>?]+\s+(?P<name>{ID})\s*\([^;{{]*\)\s*(?:async)?\s*\{{")],
    "lua": [("method", rf"\bfunction\s+(?:{ID}[.:])*(?P<name>{ID})")],
    "elixir": [("class", r"\bdefmodule\s+(?P<name>[\w.]+)"), ("method", r"^\s*defp?\s+(?P<name>[a-z_]\w*[?!]?)")],
    "objc": [("class", rf"@(?:interface|implementation)\s+(?P<name>{ID})")],
}
DECLARATIONS["javascript"] = [d for d in DECLARATIONS["typescript"] if d[0] in ("class", "method", "const")]
#: By language: patterns whose group "source" is the specifier.
IMPORTS: dict[str, list[str]] = {
    "typescript": [r"^\s*import\s+(?:[^'\";]*?\sfrom\s+)?['\"](?P<source>[^'\"]+)['\"]"],
    "java": [r"^\s*import\s+(?P<static>static\s+)?(?P<source>[\w.$]+(?:\.\*)?)\s*;"],
    "kotlin": [r"^\s*import\s+(?P<source>[\w.]+(?:\.\*)?)"],
    "scala": [r"^\s*import\s+(?P<source>[\w.]+(?:\._)?)"],
    "c_sharp": [r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<source>\w+(?:\.\w+)+)\s*;"],
    "swift": [r"^\s*(?:@testable\s+)?import\s+(?P<source>[\w.]+)"],
    "php": [r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<source>[^'\"]+)['\"]"],
    "elixir": [r"^\s*(?:alias|import)\s+(?P<source>[A-Z][\w.]*)"],
    "go": [r"^\s*import\s+(?:[\w.]+\s+)?\"(?P<source>[^\"]+)\"", r"^\s+(?:[\w.]+\s+)?\"(?P<source>[\w./~-]+)\"\s*$"],
    "lua": [r"\brequire\s*\(?\s*['\"](?P<source>[^'\"]+)['\"]"],
    "bash": [r"^\s*(?:source|\.)\s+['\"]?(?P<source>[^\s'\";]+)"],
    "dart": [r"^\s*(?:import|export)\s+['\"](?!package:)(?P<source>[^'\"]+)['\"]"],
    "c": [r"^\s*#\s*(?:include|import)\s+\"(?P<source>[^\"]+)\""],
    "ruby": [r"\b(?P<how>require_relative|require)\s*\(?\s*['\"](?P<source>[^'\"]+)['\"]"],
    "rust": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<source>[\w:]+)", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<mod>{ID})\s*;"],
}
IMPORTS["javascript"], IMPORTS["cpp"], IMPORTS["objc"] = IMPORTS["typescript"], IMPORTS["c"], IMPORTS["c"]
HASH_COMMENTS = frozenset("python ruby bash elixir perl r yaml".split())
COMMENT = re.compile(r"^\s*(?://|/\*|\*|#|--|\"\"\"|''')")
BRANCH = re.compile(r"(?<![A-Za-z0-9_])(?:if|for|while|switch)(?![A-Za-z0-9_])|&&|\|\||\?")


def blank(text: str, language: str) -> str:
    """text with comments blanked, places and lines kept."""
    wipe = lambda m: re.sub(r"[^\n]", " ", m[0])
    if language in HASH_COMMENTS:
        return re.sub(r"(?m)(?<![\w$\"'{&])#[^\n]*", wipe, text)
    if language == "lua":
        return re.sub(r"--[^\n]*", wipe, text)
    return re.sub(r"(?s)/\*.*?\*/|(?<!:)//[^\n]*", wipe, text)


def docstring(lines: list[str], at: int) -> str:
    """The comment lines right above a line, without their marks, at most 400 characters."""
    own = []
    while at and COMMENT.match(lines[at - 1]):
        at -= 1
        own.append(lines[at])
    own = [re.sub(r"^\s*(?:///?|/\*+|\*+(?!/)|#|--)\s?|\s*\*+/\s*$", "", x).rstrip() for x in reversed(own)]
    return "\n".join(x for x in own if x.strip("*/ "))[:400]


def span_end(text: str, start: int) -> int:
    """The end of the braces that follow a declaration, or of its line."""
    depth, i = 0, start
    line = text.find("\n", start)
    first = text.find("{", start)
    if first < 0 or (0 <= line < first and text[start:first].strip().endswith(";")):
        return line if line >= 0 else len(text)
    for i in range(first, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            return i
    return i


def exported(language: str, line: str, name: str) -> bool:
    if language in ("typescript", "javascript"):
        return re.match(r"\s*export\b", line) is not None
    if language == "go":
        return name[:1].isupper()
    if language == "dart":
        return not name.startswith("_")
    if language == "rust":
        return re.search(r"\bpub\b", line) is not None
    if language in ("c_sharp", "elixir"):
        return False
    return re.search(r"\b(?:private|static)\b" if language in ("c", "cpp") else r"\bprivate\b", line) is None


def symbols_of(text: str, language: str) -> list[tuple]:
    """(name, kind, start_line, end_line, exported, complexity, docstring), lines from 0."""
    lines, out = text.split("\n"), []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        for node in ast.walk(tree):
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
                kind = "class" if isinstance(node, ast.ClassDef) else "method"
                out.append((node.name, kind, node.lineno - 1, (node.end_lineno or node.lineno) - 1, True, 1 + len(BRANCH.findall(body)), docstring(lines, node.lineno - 1)))
        return sorted(out, key=lambda s: (s[2], s[0]))
    bare, seen = blank(text, language), set()
    for kind, pattern in DECLARATIONS.get(language, []):
        for m in re.finditer(pattern, bare, re.M):
            at = m.start("name")
            if at in seen:
                continue
            seen.add(at)
            row, end = bare.count("\n", 0, at), span_end(bare, m.end("name"))
            out.append((m["name"], kind, row, bare.count("\n", 0, max(at, end)), exported(language, lines[row], m["name"]), 1 + len(BRANCH.findall(bare[m.start() : end + 1])), docstring(lines, row)))
    return sorted(out, key=lambda s: (s[2], s[0]))


def imports_of(text: str, language: str) -> list[tuple[str, bool]]:
    """(specifier, static) in order."""
    if language == "python":
        try:
            nodes = list(ast.walk(ast.parse(text)))
        except (SyntaxError, ValueError, RecursionError):
            return []
        found = [(n.lineno, a.name) for n in nodes if isinstance(n, ast.Import) for a in n.names]
        found += [(n.lineno, "." * n.level + (n.module or "")) for n in nodes if isinstance(n, ast.ImportFrom)]
        return [(s, False) for _, s in sorted(found, key=lambda x: x[0])]
    bare, out = blank(text, language), []
    if language == "go":
        block = [m.span() for m in re.finditer(r"(?s)^import\s*\(.*?\)", bare, re.M)]
    for pattern in IMPORTS.get(language, []):
        for m in re.finditer(pattern, bare, re.M):
            g = m.groupdict()
            if language == "go" and pattern.startswith(r"^\s+") and not any(a < m.start() < b for a, b in block):
                continue
            if g.get("mod"):
                out.append((m.start(), f"self::{g['mod']}", False))
                continue
            s = g["source"]
            if language == "scala" and s.endswith("._"):
                s = s[:-2] + ".*"
            if language == "scala":
                s = s.rstrip(".")
            if language == "rust":
                s = s.rstrip(":")
            if language == "ruby" and g["how"] == "require_relative" and not s.startswith("."):
                s = f"./{s}"
            out.append((m.start(), s, bool(g.get("static"))))
    return [(s, static) for _, s, static in sorted(out) if s]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, lang, text in zip(b["file_id"], b["language"], b["content"], strict=True):
            if isinstance(lang, str) and isinstance(text, str):
                rows += [(i, "symbol", n, *s, None, None) for n, s in enumerate(symbols_of(text, lang))]
                rows += [(i, "import", n, None, None, None, None, None, None, None, s, static) for n, (s, static) in enumerate(imports_of(text, lang))]
        yield pd.DataFrame(rows, columns=["file_id", "what", "n", "name", "kind", "start_line", "end_line", "exported", "complexity", "docstring", "source", "static"])


SCHEMA = "file_id long, what string, n int, name string, kind string, start_line int, end_line int, exported boolean, complexity long, docstring string, source string, static boolean"


def extract(tree: DataFrame) -> DataFrame:
    """Symbols and imports of tree(path, content) in one pass; ids come from the path and the place."""
    rows = tree.select(F.xxhash64("path").alias("file_id"), language_column(F.col("path")).alias("language"), "content")
    return rows.mapInPandas(_extract, SCHEMA)


def symbols(found: DataFrame) -> DataFrame:
    s = found.where("what = 'symbol'")
    return s.select(F.xxhash64("file_id", "name", "kind", "start_line").alias("id"), "file_id", "name", "kind", "start_line", "end_line", "exported", "complexity", "docstring")


def imports(found: DataFrame) -> DataFrame:
    return found.where("what = 'import'").select(F.xxhash64("file_id", "n", "source").alias("id"), "file_id", "n", "source", "static")


def sql_queries(tree: DataFrame) -> DataFrame:
    """(id, query_text, file_id, tables): one row for each file of code or SQL that refers to tables."""
    lang = language_column(F.col("path"))
    code = F.lower("path").endswith(".sql") | (lang.isNotNull() & ~lang.isin("html", "css", "json", "yaml", "markdown"))
    q = tree.where(code).select(F.xxhash64(F.lit("q"), "path").alias("id"), F.col("content").alias("query_text"), F.xxhash64("path").alias("file_id"), X.sql_tables(F.col("content")).alias("tables"))
    return q.where(F.size("tables") > 0)


def query_tables(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").alias("query_id"), F.explode("tables").alias("table_name")).distinct()


def requirement_links(tree: DataFrame, syms: DataFrame) -> DataFrame:
    """(symbol_id, req_id): each @req annotation with the nearest symbol at or after its line."""
    from ctxspark.operators import graph

    marks = tree.select(F.xxhash64("path").alias("file_id"), F.explode(X.requirement_marks(F.col("content"))).alias("m")).select("file_id", "m.line", "m.req_id")
    near = graph.nearest_following(marks, syms.select("file_id", F.col("start_line").alias("start_line"), F.col("id").alias("symbol_id")), "file_id", "line", "start_line", ["symbol_id"])
    return near.where("symbol_id IS NOT NULL").select("symbol_id", "req_id").distinct()
