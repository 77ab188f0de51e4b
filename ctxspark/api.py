"""The read surface: each HTTP path or tool name is one function over a store; results are plain values.

serve() answers GET /api/... and POST /context on a local address; serve_tools() speaks line-delimited JSON-RPC."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.operators import cache, dashboard, graph, health, requirements, search, vector
from ctxspark.sources import files as source
from ctxspark.sources import reports
from ctxspark.store import Store
from ctxspark.streaming.streams import sync_commits

MODES = ("lexical", "semantic", "hybrid")


def rows(df: DataFrame) -> list[dict]:
    """A result small by its own limit, as plain values."""
    return [r.asDict(recursive=True) for r in df.collect()]


def limit_param(value: str | None, default: int) -> int:
    """A positive whole number; anything else is the default."""
    try:
        n = int(float(value)) if value is not None else default
    except ValueError:
        return default
    return n if n > 0 else default


class Api:
    """root is the repository that the store indexes: with it, reads of knowledge take in new commits first, summaries have
    text, markdown is part of the corpus and its settings count."""

    def __init__(self, store: Store, now: int, registry: str | None = None, embedder: vector.Embedder | None = None, root: str | None = None):
        self.store, self.now, self.registry, self.embedder, self.root = store, now, registry, embedder, root

    def fresh(self) -> None:
        """Take in new commits; a failure leaves the store as it is."""
        if self.root and os.path.isdir(os.path.join(self.root, ".git")):
            try:
                sync_commits(self.store, self.root)
            except Exception as e:
                print(f"sync skipped: {e}", file=sys.stderr)

    def t(self, name: str) -> DataFrame:
        return self.store.read(name)

    def projects(self) -> dict:
        return {"projects": reports.projects(self.registry) if self.registry else []}

    def overview(self) -> dict:
        names = ("files", "symbols", "edges", "query_tables", "commits", "entities", "backlinks")
        counts = rows(dashboard.overview(**{n: self.t(n) for n in names}))[0]
        return counts | {"types": rows(dashboard.type_histogram(self.t("entities")))}

    def health(self, limit: int = health.ISSUE_LIMIT, offset: int = 0) -> dict:
        return health.report(self.t("files"), self.t("imports"), self.t("health_signals"), self.now, limit, offset)

    def entities(self, limit: int = 200) -> dict:
        nodes, links = dashboard.entities_with_links(self.t("entities"), self.t("backlinks"), limit)
        return {"entities": rows(nodes), "links": rows(links)}

    def projected(self) -> DataFrame:
        return graph.projection(self.t("files"), self.t("sql_queries"), self.t("query_tables"))

    def dataflow(self, limit: int = 200) -> dict:
        return {k: rows(v) for k, v in dashboard.dataflow(self.projected(), limit).items()}

    def commits(self, limit: int = 50) -> dict:
        c = self.t("commits").withColumn("ts", F.to_timestamp("author_date"))
        return {"commits": rows(dashboard.timeline(c, self.t("entities").select("commit_sha", "id"), limit))}

    def relations(self, limit: int = 100) -> list[dict]:
        return rows(dashboard.relations(self.t("backlinks"), self.t("entities"), limit))

    def activity(self, weeks: int = 12) -> dict:
        c = self.t("commits").select(F.to_timestamp("author_date").alias("author_ts"), "sha")
        e = self.t("entities").join(c, F.col("commit_sha") == F.col("sha")).withColumnRenamed("author_ts", "created_ts")
        return {"activity": rows(dashboard.activity(c, e, weeks))}

    def entity(self, id_: str) -> dict | None:
        found = rows(dashboard.entity_page(self.t("entities"), self.t("commits"), self.t("backlinks"), id_))
        return found[0] if found else None

    def symbols(self, limit: int = 500) -> dict:
        files, syms = dashboard.symbols(self.t("files"), self.t("symbols"), limit)
        return {"files": rows(files), "symbols": rows(syms)}

    def corpus(self) -> DataFrame:
        """The documents to embed: entities, symbols, module cards and, with a root, its markdown."""
        t = self.t
        docs = vector.entity_docs(t("entities")).unionByName(vector.symbol_docs(t("symbols"), t("files")))
        docs = docs.unionByName(vector.module_cards(t("files"), t("symbols"), t("imports"), t("sql_queries"), t("query_tables")))
        return docs.unionByName(vector.markdown_chunks(source.source_tree(self.store.spark, self.root, True))) if self.root else docs

    def embed(self, only_stale: bool = False) -> int:
        """Bring the vector table up to date; the number of documents that were new or had changed."""
        corpus, stored = self.corpus(), self.t("embeddings")
        embedder = self.embedder or vector.HashedEmbedder()
        usable = stored.where((F.col("model") == embedder.model) & (F.col("dim") == embedder.dim))
        stale = vector.staleness(corpus, usable).count()
        if stale or not only_stale:
            self.store.write(embeddings=vector.embed(corpus, stored, embedder, self.now))
        return stale

    def auto_embed(self) -> dict:
        """Embed what is stale where the settings allow it, else say how."""
        if not (self.root and source.settings(self.root)["semantic"]):
            return {"hint": f"set enabled = true under [semantic] in {source.CONFIG}"}
        return {"embedded": self.embed(only_stale=True)}

    def embed_status(self) -> dict:
        corpus = self.corpus()
        own = source.settings(self.root) if self.root else {"semantic": False}
        embedder = self.embedder or vector.HashedEmbedder()
        status = rows(vector.embed_status(corpus, self.t("embeddings")))[0]
        available = own["semantic"] and status["embedded"] > 0
        hint = {} if available else {"hint": "run embed" if own["semantic"] else f"run embed, then set enabled = true under [semantic] in {source.CONFIG}"}
        return status | hint | {"available": available, "model": embedder.model, "dim": embedder.dim, "corpus_counts": rows(vector.corpus_counts(corpus))[0]}

    def entity_index(self) -> tuple[DataFrame, DataFrame] | None:
        """The kept index, where the store has one."""
        return (self.t("postings"), self.t("posting_lengths")) if self.store.has("postings") else None

    def search(self, query: str, limit: int = 20, mode: str | None = None) -> list[dict]:
        """Entities by BM25; semantic and hybrid add vectors where there are some, else fall back to the lexical list."""
        lexical = search.search_entities(self.t("entities"), self.t("backlinks"), query, limit, self.entity_index())
        if mode in (None, "lexical"):
            return rows(lexical)
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        ranked = search.numbered(lexical.select("id", "rank", "name"), limit, F.asc("rank"), F.asc("id")).select(F.lit("entity").alias("kind"), "id", "rn", F.col("name").alias("label"))
        vec = None
        stored = self.t("embeddings")
        if self.embedder is not None and not stored.isEmpty():
            q = [float(x) for x in self.embedder.embed([query])[0]]
            vec = search.numbered(search.vector_hits(stored, q, limit), limit, *search.hit_order()).select("kind", "id", "rn", "label")
        if mode == "semantic":
            return rows((vec if vec is not None else ranked).orderBy("rn"))
        files = search.numbered(self.retrieve_frame(query, limit), limit, F.desc("score"), F.asc("path")).select(F.lit("file").alias("kind"), F.col("path").alias("id"), "rn", F.col("path").alias("label"))
        return rows(search.hybrid(self.store.spark, ranked, vec, files))

    def retrieve_frame(self, query: str, k: int = 10) -> DataFrame:
        edges = self.t("edges").select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"))
        return search.retrieve(self.t("files").select("id", "path"), self.t("symbols").select("id", "file_id", "name"), edges, query, k)

    def retrieve(self, query: str, k: int = 10) -> list[dict]:
        """The best files with score, symbols and a summary (empty without a root)."""
        spark = self.store.spark
        hits = search.with_symbols(self.retrieve_frame(query, k), self.t("files"), self.t("symbols"))
        hits = spark.createDataFrame(hits.collect(), hits.schema)  # k rows
        texts = source.some_files(spark, self.root, [r["path"] for r in hits.select("path").collect()]) if self.root else None
        return rows(search.with_summary(hits, texts).orderBy(F.desc("score"), "path"))

    def backlinks(self, id_: str, hops: int = 1) -> dict:
        if not 1 <= hops <= 5:
            raise ValueError("hops must be 1 to 5")
        known = self.t("entities").where((F.col("id") == id_) | (F.col("name") == id_)).select("id").limit(1)
        if known.isEmpty():
            raise KeyError(id_)
        return {"backlinks": rows(graph.related_recursive(self.t("backlinks"), known, hops).orderBy("depth", "id"))}

    def get_entity(self, id_: str) -> dict | None:
        """An entity with symbols, or a requirement with its context."""
        found = self.entity(id_)
        if found is None:
            return requirements.context(id_, self.t("requirements"), self.t("atomic_requirements"), self.t("commits"), self.t("requirement_code_links"), self.t("symbols"), self.t("files"))
        symbols = self.t("symbols").select(F.col("id").alias("symbol_id"), "file_id", "name", "kind")
        linked = self.t("entity_symbols").where(F.col("entity_id") == found["id"]).join(symbols, "symbol_id").join(self.t("files").select(F.col("id").alias("file_id"), "path"), "file_id")
        return found | {"symbols": rows(linked.select(F.col("symbol_id").alias("id"), "name", "kind", "path").orderBy("path", "name", "id")), "data_flow": rows(graph.counts(self.projected()))[0]}

    def by_type(self, kind: str, limit: int = 20) -> list[dict]:
        return rows(dashboard.by_type(self.t("entities"), kind, limit))

    def context(self, task: str, top: int = 10) -> dict:
        """What a coding task needs: files, their neighbours, entities, health."""
        files = self.retrieve(task, top)
        paths = [f["path"] for f in files]
        own = self.t("files").where(F.col("path").isin(paths)).select(F.col("id").alias("file_id"))
        seeds = self.t("symbols").join(F.broadcast(own), "file_id").select(F.col("id").alias("node"))  # top files at most
        edges = self.t("edges").select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"))
        near = graph.dependencies(edges, seeds, 1).unionByName(graph.dependents(edges, seeds, 1)).select(F.col("node").alias("id")).distinct()
        names = self.t("symbols").join(near, "id").join(self.t("files").select(F.col("id").alias("file_id"), "path"), "file_id").select("name", "path").distinct().orderBy("path", "name").limit(50)
        return {"files": files, "neighbourhood": rows(names), "entities": [{k: e[k] for k in ("type", "name")} for e in self.search(task, 5)], "health": self.health(10)}

    def cache_stats(self) -> dict:
        return rows(cache.stats(self.t("cache")))[0]

    def impact(self, table: str, **tags: str) -> dict:
        return rows(graph.impact(self.projected(), table, tags))[0]

    def parallel_storage(self, **tags: str) -> list[dict]:
        return rows(graph.parallel_storage(self.projected(), tags))

    def coverage(self) -> dict:
        return {"orphan_requirements": rows(requirements.orphan_requirements(self.t("requirements"), self.t("requirement_code_links")).select("id", "title")), "untracked_symbols": requirements.untracked_symbols(self.t("symbols"), self.t("requirement_code_links")).count()}

    def handle(self, url: str) -> tuple[int, object]:
        """Status and body of GET url."""
        parts = urlparse(url)
        q = {k: v[0] for k, v in parse_qs(parts.query).items()}
        name = parts.path.removeprefix("/api/").replace("-", "_")
        n = lambda d: limit_param(q.get("limit"), d)
        calls: dict[str, Callable[[], object]] = {
            "projects": self.projects, "overview": self.overview, "health": lambda: self.health(n(health.ISSUE_LIMIT), max(0, limit_param(q.get("offset"), 0))), "entities": lambda: self.entities(n(200)), "dataflow": lambda: self.dataflow(n(200)), "commits": lambda: self.commits(n(50)),
            "relations": lambda: self.relations(n(100)), "activity": lambda: self.activity(limit_param(q.get("weeks"), 12)), "symbols": lambda: self.symbols(n(500)), "embed_status": self.embed_status,
            "search": lambda: self.search(q.get("q", ""), n(20), q.get("mode")), "entity": lambda: self.entity(q.get("id", "")),
        }
        if not parts.path.startswith("/api/") or name not in calls:
            return 404, {"error": "not found"}
        try:
            body = calls[name]()
        except ValueError as e:
            return 400, {"error": str(e)}
        return (404, {"error": "not found"}) if body is None else (200, body)

    def tool(self, name: str, args: dict) -> object:
        tools = {
            "search_knowledge": lambda: [{k: h[k] for k in ("id", "type", "name", "related")} for h in self.search(args["query"], int(args.get("limit", 10)))],
            "semantic_search": lambda: self.search(args["query"], int(args.get("limit", 10)), args.get("mode", "hybrid")), "get_entity": lambda: self.get_entity(args["entity_id"]), "get_backlinks": lambda: self.backlinks(args["entity_id"], int(args.get("hops", 1))),
            "get_decisions": lambda: self.by_type("decision", int(args.get("limit", 20))), "get_bugs": lambda: self.by_type("bug_fix", int(args.get("limit", 20))), "get_patterns": lambda: self.by_type("pattern", int(args.get("limit", 20))),
        }
        self.fresh()
        return tools[name]()


TOOLS = ("search_knowledge", "semantic_search", "get_entity", "get_backlinks", "get_decisions", "get_bugs", "get_patterns")


def local_request(method: str, host: str | None, origin: str | None) -> bool:
    """Whether a request comes from this machine's own pages."""
    names = ("localhost", "127.0.0.1", "[::1]")
    ok = host is not None and host.rsplit(":", 1)[0] in names
    return ok and method in ("GET", "POST") and (not origin or urlparse(origin).hostname in ("localhost", "127.0.0.1", "::1"))


def serve(api: Api, port: int = 0) -> ThreadingHTTPServer:
    """A server on 127.0.0.1 that has been bound and not started."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def allowed(self) -> bool:
            ok = local_request(self.command, self.headers.get("Host"), self.headers.get("Origin"))
            if not ok:
                self.answer(403, {"error": "local requests only"})
            return ok

        def do_GET(self) -> None:
            if self.allowed():
                self.answer(*api.handle(self.path))

        def do_POST(self) -> None:
            if not self.allowed():
                return
            if self.path != "/context":
                return self.answer(404, {"error": "not found"})
            try:
                task = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["task"]
            except (ValueError, KeyError, TypeError):
                return self.answer(400, {"error": "a task is needed"})
            self.answer(200, api.context(task))

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve_tools(api: Api, lines=sys.stdin, out=sys.stdout) -> None:
    """JSON-RPC requests, one a line: initialize, tools/list, tools/call."""
    for line in lines:
        try:
            m = json.loads(line)
            method, params = m.get("method"), m.get("params") or {}
            if method == "initialize":
                result: object = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "ctxspark", "version": "1"}}
            elif method == "tools/list":
                result = {"tools": [{"name": n, "inputSchema": {"type": "object"}} for n in TOOLS]}
            elif method == "tools/call" and params.get("name") in TOOLS:
                result = {"content": [{"type": "text", "text": json.dumps(api.tool(params["name"], params.get("arguments") or {}), default=str)}]}
            else:
                out.write(json.dumps({"jsonrpc": "2.0", "id": m.get("id"), "error": {"code": -32601, "message": "no such method"}}) + "\n")
                continue
            out.write(json.dumps({"jsonrpc": "2.0", "id": m.get("id"), "result": result}) + "\n")
        except (ValueError, KeyError) as e:
            out.write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32602, "message": str(e)}}) + "\n")
