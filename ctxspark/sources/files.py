"""Source trees as tables."""

from __future__ import annotations

import json
import os
import posixpath
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Languages by file extension.
LANGUAGES = {
    "typescript": ".ts .tsx .mts .cts", "javascript": ".js .jsx .mjs .cjs", "python": ".py", "java": ".java", "cpp": ".cpp .hpp .cc .cxx", "go": ".go", "rust": ".rs", "c": ".c .h", "php": ".php", "ruby": ".rb", "c_sharp": ".cs", "swift": ".swift",
    "kotlin": ".kt .kts", "scala": ".scala .sc", "bash": ".sh .bash", "dart": ".dart", "lua": ".lua", "elixir": ".ex .exs", "objc": ".m .mm", "html": ".html .htm", "css": ".css", "json": ".json", "yaml": ".yaml .yml", "markdown": ".md .markdown",
    "vue": ".vue", "svelte": ".svelte", "perl": ".pl .pm", "r": ".r", "haskell": ".hs", "clojure": ".clj .cljs", "erlang": ".erl", "zig": ".zig",
}
EXTENSIONS = {e: lang for lang, exts in LANGUAGES.items() for e in exts.split()}
#: Directories that hold no source.
IGNORED = "node_modules .git dist build coverage .omc .planning .claude .next out target __pycache__ .venv venv .cache .nx .turbo .output .gradle .idea tmp".split()
CONFIG = ".ctxspark.toml"
#: Files without a language that resolution reads.
MANIFESTS = ("go.mod", "Cargo.toml")


def load_config(repo: str) -> dict:
    """The repository's settings; a broken file counts as none."""
    try:
        with open(os.path.join(repo, CONFIG), "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def ignored_dirs(repo: str) -> set[str]:
    extra = load_config(repo).get("index", {}).get("ignore", [])
    return {*IGNORED, *(x for x in extra if isinstance(x, str))}


def settings(repo: str) -> dict:
    """repair_below, semantic, model, model_path and session_budget_ms; values of another kind count as not given. A model's
    path must lie in the repository, unless the environment gives it."""
    c = load_config(repo)
    health, semantic, hooks = (x if isinstance(x := c.get(s), dict) else {} for s in ("health", "semantic", "hooks"))

    def whole(x: object, default: int) -> int:
        return x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else default

    model, env, own = semantic.get("model"), os.environ.get("CTXSPARK_MODEL_PATH", "").strip(), semantic.get("model_path")
    path = os.path.abspath(env) if env else None
    if not env and isinstance(own, str) and own.strip():
        root = os.path.abspath(repo)
        at = os.path.normpath(os.path.join(root, own.strip()))
        path = at if os.path.commonpath([root, at]) == root else None
    return {
        "repair_below": whole(health.get("repair_below"), 70),
        "semantic": semantic.get("enabled") is True,
        "model": model if model in ("minilm", "bge") else "minilm",
        "model_path": path,
        "session_budget_ms": whole(hooks.get("session_budget_ms"), 10_000),
    }


def language(path: str) -> str | None:
    return EXTENSIONS.get(os.path.splitext(path)[1].lower())


def walk(root: str, ignore: set[str], dot_names: bool = True) -> Iterator[tuple[str, int, int]]:
    """(relative path, mtime in ms, bytes) of files; links are not followed, unreadable directories are empty. ignore holds
    base names and relative paths."""
    stack = [""]
    while stack:
        at = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            rel = f"{at}/{e.name}" if at else e.name
            if e.is_symlink() or e.name in ignore or rel in ignore or (not dot_names and e.name.startswith(".")):
                continue
            if e.is_dir(follow_symlinks=False):
                stack.append(rel)
            elif e.is_file(follow_symlinks=False):
                s = e.stat(follow_symlinks=False)
                yield rel, int(s.st_mtime * 1000), s.st_size


class _Batch(InputPartition):
    def __init__(self, rows: list[tuple[str, int, int]]):
        super().__init__(0)
        self.rows = rows


class SourceTree(DataSource):
    """spark.read.format("sourcetree").load(root): path, mtime, size, content of supported files. The driver lists the
    tree, executors read the contents, some files a partition; the root must be mounted on all of them."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "path string, mtime long, size long, content string"

    def reader(self, schema) -> DataSourceReader:
        return SourceTreeReader(self.options)


class SourceTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.step = options["path"], int(options.get("filesPerPartition", "256"))
        self.markdown = options.get("markdown", "false") == "true"
        self.only = json.loads(options["only"]) if "only" in options else None

    def partitions(self):
        if self.only is not None:
            base = os.path.realpath(self.root)
            own = [p for p in self.only if os.path.realpath(os.path.join(base, p)) == os.path.join(base, p) and os.path.isfile(os.path.join(base, p))]
            return [_Batch([(p, 0, 0) for p in own])]
        found = walk(self.root, ignored_dirs(self.root), not self.markdown)
        keep = (lambda p: p.lower().endswith(".md")) if self.markdown else (lambda p: language(p) or p.lower().endswith(".sql") or posixpath.basename(p) in MANIFESTS)
        rows = sorted(x for x in found if keep(x[0]))
        return [_Batch(rows[i : i + self.step]) for i in range(0, len(rows), self.step)]

    def read(self, partition):
        for path, mtime, size in partition.rows if partition else []:  # without partitions Spark gives None
            with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                yield path, mtime, size, f.read()


def source_tree(spark: SparkSession, root: str, markdown: bool = False) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("sourcetree").option("markdown", str(markdown).lower()).load(root)


def some_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, content) of the few given paths below root; missing ones, links and paths that lead out have no row."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("sourcetree").option("only", json.dumps(paths)).load(root).select("path", "content")


def files_on_store(spark: SparkSession, glob: str, ignore: list[str] | None = None) -> DataFrame:
    """The same from any Hadoop file system, by Spark's binary reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    base = re.sub(r"[*?\[{].*$", "", glob).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(re.sub(r'^[a-z]+:/*', '/', base))}/", "")
    rows = raw.select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))
    parts = F.array(*[F.lit(x) for x in (ignore or IGNORED)])
    return rows.where(~F.arrays_overlap(F.split("path", "/"), parts)).where(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*EXTENSIONS, ".sql"))


def language_column(path: Column) -> Column:
    """The language of a path's extension as a column."""
    table = F.create_map(*[x for e, lang in EXTENSIONS.items() for x in (F.lit(e), F.lit(lang))])
    return table[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def sources(tree: DataFrame) -> DataFrame:
    """The tree without manifests."""
    return tree.where(~F.substring_index("path", "/", -1).isin(*MANIFESTS))


def file_rows(tree: DataFrame, parsed_at: int) -> DataFrame:
    """files rows from a source tree; ids come from the path, so they are the same in every run."""
    return tree.select(F.xxhash64("path").alias("id"), "path", F.sha2("content", 256).alias("hash"), "mtime", "size", language_column(F.col("path")).alias("language"), F.lit(parsed_at).cast("long").alias("parsed_at"))


def changed(tree: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of tree that files doesn't have with the same hash."""
    return tree.join(files.select("path", "hash"), (tree.path == files.path) & (F.sha2("content", 256) == files.hash), "left_anti")
