"""The command line. Exit codes: 0 done, 1 below a threshold or an error, 2 wrong use or no index."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import functions as F

from ctxspark import build, hooks
from ctxspark.api import Api, rows, serve, serve_tools
from ctxspark.operators import graph, health, repair, requirements
from ctxspark.session import get_session
from ctxspark.sources import files as source
from ctxspark.sources import reports
from ctxspark.store import Store
from ctxspark.streaming.streams import sync_commits
from ctxspark.streaming.watch import DEBOUNCE, watch

STORE = ".ctxspark"
HOOKS = ("session-start", "user-prompt-submit", "post-tool-use", "session-end")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ctxspark")
    p.add_argument("--repo", default=".")
    p.add_argument("--store")
    p.add_argument("--json", action="store_true")
    s = p.add_subparsers(dest="verb", required=True)
    s.add_parser("index").add_argument("--force", action="store_true")
    s.add_parser("build-graph").add_argument("--force", action="store_true")
    s.add_parser("health").add_argument("--threshold", type=int, default=0)
    x = s.add_parser("signal")
    x.add_argument("pairs", nargs="*")
    x.add_argument("--reset", action="store_true")
    for kind in ("vitest", "eslint", "junit", "coverage"):
        x.add_argument(f"--{kind}")
    s.add_parser("repair").add_argument("--threshold", type=int)
    x = s.add_parser("retrieve")
    x.add_argument("query")
    x.add_argument("--top", type=int, default=10)
    x = s.add_parser("search")
    x.add_argument("query")
    x.add_argument("--mode", default="lexical")
    x.add_argument("--limit", type=int, default=10)
    x = s.add_parser("requirements-import")
    x.add_argument("format")
    x.add_argument("file")
    s.add_parser("sync-requirements").add_argument("file")
    s.add_parser("check-req-coverage")
    for verb in ("analyze-impact", "check-parallel-storage"):
        x = s.add_parser(verb)
        if verb == "analyze-impact":
            x.add_argument("table")
        for dim in ("domain", "region", "system"):
            x.add_argument(f"--{dim}")
    s.add_parser("list-tables")
    s.add_parser("find-table-usage").add_argument("table")
    for verb in ("summarize-graph", "git-index", "git-sync", "embed", "mcp"):
        s.add_parser(verb)
    s.add_parser("serve").add_argument("--port", type=int, default=0)
    s.add_parser("watch").add_argument("--debounce", type=int, default=DEBOUNCE)
    x = s.add_parser("hook")
    x.add_argument("name", choices=HOOKS)
    for name, default in (("task", ""), ("tool", ""), ("session", "unknown"), ("summary", "")):
        x.add_argument(f"--{name}", default=default)
    return p


def signals(store: Store, a: argparse.Namespace, now: int) -> dict[str, float]:
    given = [(k, getattr(a, k)) for k in ("vitest", "eslint", "junit", "coverage") if getattr(a, k)]
    if len(given) > 1 or (not given and not a.pairs and not a.reset):
        raise ValueError("give one report, pairs or --reset")
    pairs = reports.report_signals(store.spark, *given[0]) if given else reports.signal_pairs(a.pairs)
    pairs = health.normalise_signals(pairs)
    for k, v in pairs.items():
        health.check_signal(k, v)
    if a.reset:
        store.write(health_signals=store.read("health_signals").limit(0))
    if pairs:
        store.merge("health_signals", store.spark.createDataFrame([(k, float(v), given[0][0] if given else "cli", now) for k, v in pairs.items()], "key string, value double, source string, updated_at long"))
    return pairs


def import_requirements(store: Store, kind: str, path: str) -> dict:
    reports.check_report(path)
    new = reports.requirements_export(store.spark, kind, path).persist()
    store.merge("requirements", new)
    store.replace_children("atomic_requirements", "req_id", new.select(F.col("id").alias("req_id")), requirements.atomic(new))
    out = {"imported": new.count(), "warnings": [r["warning"] for r in new.where("warning IS NOT NULL").select("warning").collect()]}
    new.unpersist()
    return out


def start_session(store: Store, api: Api, root: str, now: int) -> dict:
    """New commits, changed files, stale embeddings where the settings allow them, and repair below the set score."""
    own = source.settings(root)

    def mend() -> object:
        return [x["stage"] for x in repair.repair(store, root, now, own["repair_below"])] if repair.score(store, now) < own["repair_below"] else "healthy"

    steps = {
        "sync": lambda: sync_commits(store, root) if os.path.isdir(os.path.join(root, ".git")) else "no history",
        "index": lambda: build.index_tree(store, source.source_tree(store.spark, root), now),
        "embed": lambda: api.auto_embed() if own["semantic"] else "off",
        "repair": mend,
    }
    return hooks.session_start(store, root, now, steps, own["session_budget_ms"])


def run_hook(a: argparse.Namespace, store: Store, api: Api, root: str, at: str, now: int) -> object:
    if a.name == "session-start":
        return start_session(store, api, root, now)
    if a.name == "user-prompt-submit":
        return hooks.user_prompt(api, a.task)
    if a.name == "post-tool-use":
        return hooks.post_tool_use(os.path.join(at, "log"), a.tool, a.session, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now / 1000)))
    return {"summary": hooks.session_end(os.path.join(at, "sessions"), a.session, a.summary)}


def summarize(api: Api) -> dict:
    """What the data flow holds, and what is left out of it."""
    found = graph.validate(api.t("files"), api.t("sql_queries"), api.t("query_tables"))
    return rows(found["counts"])[0] | {"orphan_queries": found["orphan_queries"].count(), "unmapped_files": found["unmapped_files"].count()}


def run(a: argparse.Namespace, now: int) -> tuple[int, object]:
    root = os.path.abspath(a.repo)
    at = a.store or os.path.join(root, STORE)
    store = Store(get_session(master=os.environ.get("CTXSPARK_MASTER", "local[*]")), at)
    api, verb = Api(store, now, root=root), a.verb
    if verb in ("index", "build-graph"):
        return 0, build.index(store.spark, root, at, now, a.force) | api.auto_embed()
    if verb == "hook" and a.name != "user-prompt-submit":
        return 0, run_hook(a, store, api, root, at, now)
    if not os.path.exists(os.path.join(at, "pointers")):
        return 2, {"error": "no index; run index first"}
    tags = {k: v for k in ("domain", "region", "system") if (v := getattr(a, k, None))}
    if verb == "health":
        r = api.health()
        return int(r["score"] < a.threshold), r
    if verb == "repair":
        least = source.settings(root)["repair_below"] if a.threshold is None else a.threshold
        stages = repair.repair(store, root, now, least, lambda: build.index(store.spark, root, at, now, True))
        return int(stages[-1]["score"] < least), stages
    if verb == "embed":
        stale = api.embed()
        return 0, {"stale": stale, "embedded": store.read("embeddings").count()}
    if verb == "serve":
        server = serve(api, a.port)
        print(f"http://127.0.0.1:{server.server_port}", file=sys.stderr)
        server.serve_forever()
    if verb == "watch":
        if a.debounce < 0:
            raise ValueError("--debounce must not be negative")
        try:
            watch(store, root, a.debounce, lambda x: print(x, flush=True))
        except KeyboardInterrupt:
            return 0, None
    if verb == "mcp":
        serve_tools(api)
        return 0, None
    if verb in ("retrieve", "search"):
        api.fresh()
    calls = {
        "signal": lambda: signals(store, a, now), "retrieve": lambda: api.retrieve(a.query, a.top), "search": lambda: api.search(a.query, a.limit, a.mode),
        "requirements-import": lambda: import_requirements(store, a.format, a.file), "sync-requirements": lambda: import_requirements(store, "native", a.file), "check-req-coverage": api.coverage,
        "analyze-impact": lambda: api.impact(a.table, **tags), "check-parallel-storage": lambda: api.parallel_storage(**tags), "list-tables": lambda: [r["table_name"] for r in api.t("query_tables").select("table_name").distinct().orderBy("table_name").collect()],
        "find-table-usage": lambda: [r["path"] for r in api.projected().where(F.col("table_name") == a.table).select("path").distinct().orderBy("path").collect()], "summarize-graph": lambda: summarize(api), "hook": lambda: run_hook(a, store, api, root, at, now),
        "git-index": lambda: {"commits": sync_commits(store, root)}, "git-sync": lambda: {"commits": sync_commits(store, root)} | api.auto_embed(),
    }
    return 0, calls[verb]()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        code, out = run(a, int(time.time() * 1000))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if out is not None:
        print(json.dumps(out, default=str, indent=None if a.json else 1))
    return code


if __name__ == "__main__":
    sys.exit(main())
