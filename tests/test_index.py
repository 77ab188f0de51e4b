"""A small repository that the test writes: index, history, reads, streams."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from ctxspark import build, cli, hooks
from ctxspark.api import Api, local_request
from ctxspark.operators import extract, repair, search
from ctxspark.sources import files as source
from ctxspark.sources import gitlog, reports
from ctxspark.store import Store
from ctxspark.streaming import streams

FILES = {
    "src/a.ts": 'import { bar } from "./b.js";\nimport fs from "node:fs";\n// says hello\nexport function foo(x: number) {\n  if (x && bar) { return 1; }\n}\n',
    "src/b.ts": 'import { baz } from "./c";\nimport x from "./missing";\nexport const bar = 1;\n',
    "src/c.ts": "// @req REQ-7\nexport class baz {}\n",
    "src/UserService.ts": 'const q = "SELECT * FROM users"; // FROM nowhere\nexport const run = 1;\n',
    "src/mongo/Users.ts": 'db.collection("users");\n',
    "py/pkg/__init__.py": "", "py/pkg/mod.py": "from . import other\nimport os\nfrom .gone import x\n\n\ndef f():\n    return 1\n", "py/pkg/other.py": "class Thing:\n    pass\n",
    "j/com/acme/A.java": "package com.acme;\nimport com.acme.B;\nimport com.acme.Gone;\nimport java.util.List;\npublic class A {\n  public int m(int x) { return x; }\n}\n", "j/com/acme/B.java": "package com.acme;\npublic class B {}\n",
    "go.mod": "module ex.com/m\n", "lib/z.go": 'package lib\nimport "ex.com/m/lib2"\nfunc Do() {}\n', "lib2/y.go": "package lib2\nfunc Up() {}\n",
    "rs/Cargo.toml": "[package]\n", "rs/src/main.rs": "mod util;\nuse crate::util::go;\nuse crate::nope::x;\nfn main() {}\n", "rs/src/util.rs": "pub fn go() {}\n",
    "node_modules/x.ts": "export const hidden = 1;\n",
}


def git(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    for p, t in FILES.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(t)
    os.symlink("/etc", f"{root}/link")
    git(root, "init", "-q")
    git(root, "add", "src/a.ts", "src/b.ts")
    git(root, "commit", "-qm", "feat: initial foo")
    git(root, "add", "src")
    git(root, "commit", "-qm", "fix: REQ-7 off by one")
    return root


@pytest.fixture(scope="module")
def store(spark, repo, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    assert build.index_tree(s, source.source_tree(spark, repo), 1000) == 14
    streams.sync_commits(s, repo)
    return s


def test_symbols_and_imports(store):
    names = {r["name"]: r for r in store.read("symbols").collect()}
    assert {"foo", "bar", "baz", "f", "Thing", "A", "B", "m", "Do", "Up", "main", "go"} <= set(names) and "hidden" not in names
    assert names["foo"]["exported"] and names["foo"]["complexity"] == 3 and names["foo"]["docstring"] == "says hello" and names["foo"]["start_line"] == 3
    paths = {r["id"]: r["path"] for r in store.read("files").collect()}
    got = {(paths[r["file_id"]], r["source"]): (paths.get(r["resolved_file_id"]), r["resolved"], r["external"]) for r in store.read("imports").collect()}
    assert got["src/a.ts", "./b.js"] == ("src/b.ts", True, False)
    assert got["src/a.ts", "node:fs"] == (None, True, True)
    assert got["src/b.ts", "./missing"] == (None, False, False)
    assert got["py/pkg/mod.py", "."][0] == "py/pkg/__init__.py" and got["py/pkg/mod.py", "os"] == (None, True, True)
    assert got["py/pkg/mod.py", ".gone"] == (None, False, False)
    assert got["j/com/acme/A.java", "com.acme.B"][0] == "j/com/acme/B.java" and got["j/com/acme/A.java", "com.acme.Gone"] == (None, False, False) and got["j/com/acme/A.java", "java.util.List"][2]
    assert got["lib/z.go", "ex.com/m/lib2"][0] == "lib2/y.go"
    assert got["rs/src/main.rs", "self::util"][0] == "rs/src/util.rs" and got["rs/src/main.rs", "crate::util::go"][0] == "rs/src/util.rs" and got["rs/src/main.rs", "crate::nope::x"] == (None, False, False)


def test_graph_and_links(store):
    names = {r["id"]: r["name"] for r in store.read("symbols").collect()}
    edges = {(names[r["from_symbol_id"]], names[r["to_symbol_id"]]) for r in store.read("edges").collect()}
    assert ("foo", "bar") in edges and ("bar", "baz") in edges
    assert [(names[r["symbol_id"]], r["req_id"]) for r in store.read("requirement_code_links").collect()] == [("baz", "REQ-7")]


def test_nothing_changed(spark, repo, store):
    assert build.index_tree(store, source.source_tree(spark, repo), 2000) == 0


def test_history(store, repo):
    types = {r["name"]: r["type"] for r in store.read("entities").collect()}
    assert types == {"initial-foo": "pattern", "req-7-off-by-one": "bug_fix"}
    assert streams.sync_commits(store, repo) == 0
    assert store.read("commits").count() == 2 and store.metadata("last_indexed_sha")
    assert len(gitlog.diff(repo, store.metadata("last_indexed_sha"))) <= gitlog.DIFF


def test_api(store):
    api = Api(store, 1500)
    assert api.retrieve("foo")[0]["path"] == "src/a.ts"
    assert api.handle("/api/overview")[1]["files"] == 14
    assert api.handle("/api/health")[1]["issue_summary"]
    assert api.impact("users")["n_files"] == 2 and api.parallel_storage() == [{"table_name": "users", "systems": ["mongodb", "sql"]}]
    assert [h["name"] for h in api.search("off-by", 5)] == ["req-7-off-by-one"]
    assert {h["kind"] for h in api.search("foo", 5, "hybrid")} == {"entity", "file"}
    assert api.handle("/api/entity?id=nope")[0] == 404 and api.handle("/x")[0] == 404
    assert api.tool("get_bugs", {})[0]["type"] == "bug_fix"
    for path in ("entities", "dataflow", "commits", "relations", "activity", "symbols", "embed-status", "projects"):
        assert api.handle(f"/api/{path}")[0] == 200, path
    assert hooks.user_prompt(api, "foo")["topFiles"][0] == "src/a.ts"
    assert local_request("GET", "127.0.0.1:80", None) and not local_request("GET", "evil.com", None)


def test_claims_and_repair(store, tmp_path):
    root = str(tmp_path)
    git(root, "init", "-q")
    for text in ("// there are 4 worker threads\n", "// CLAIM: there are 4 worker threads\n"):
        (tmp_path / "o.ts").write_text(text)
        git(root, "add", ".")
        git(root, "commit", "-qm", "x")
    assert repair.contradicted_claims(root, ["o.ts"]) == [("o.ts", "there are 4 worker threads")]
    assert [s["stage"] for s in repair.repair(store, root, 1500, 0)] == ["rebuild"]
    assert repair.ask(store, lambda p: "answer", "q", 5) == ("answer", False) and repair.ask(store, lambda p: "other", "q", 6) == ("answer", True)


def test_registry_and_config(tmp_path):
    reg = str(tmp_path / "r.json")
    reports.register_project(reg, "a", "/a", "/a/.ctxspark", 1)
    reports.register_project(reg, "b", "/a", "/a/.ctxspark", 2)
    assert [p["name"] for p in reports.projects(reg)] == ["b"]
    (tmp_path / ".ctxspark.toml").write_text('[index]\nignore = ["gen"]\n')
    assert "gen" in source.ignored_dirs(str(tmp_path)) and source.language("x.R") == "r"


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["--repo", str(tmp_path), "health"]) == 2
    (tmp_path / "a.py").write_text("def f():\n    pass\n")
    assert cli.main(["--repo", str(tmp_path), "index"]) == 0
    (tmp_path / "req.json").write_text(json.dumps([{"id": "R1", "title": "t", "description": "It must", "source": "s", "status": "draft"}]))
    assert cli.main(["--repo", str(tmp_path), "sync-requirements", str(tmp_path / "req.json")]) == 0
    assert cli.main(["--repo", str(tmp_path), "signal", "tests_pass=1"]) == 0
    capsys.readouterr()
    assert cli.main(["--repo", str(tmp_path), "--json", "health", "--threshold", "101"]) == 1
    assert json.loads(capsys.readouterr().out)["dimensions"]["coverage"] == 0.5


def test_streams(spark, tmp_path):
    log = str(tmp_path / "log")
    hooks.post_tool_use(log, "Read", "s", "2024-01-01T00:00:00Z")
    hooks.post_tool_use(log, "Read", "s", "2024-01-01T00:10:00Z")
    q = streams.per_window(streams.tool_log(spark, log)).writeStream.format("memory").queryName("uses").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["n"] for r in spark.table("uses").collect()] == [2]
    e = spark.createDataFrame([("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 00:00:00.1"), ("a", "2024-01-01 00:00:01"), (".git/x", "2024-01-01 00:00:01")], "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in streams.debounced(e).collect()) == [1, 2]


def test_accumulation_in_batches_equals_all_at_once(spark, tmp_path):
    rows = [(0, "i", "t", "n", "one", "s0"), (1, "i", "t", "n", "two", "s1"), (2, "i", "t", "n", "one", "s2"), (3, "j", "t", "m", "x", "s3")]
    df = spark.createDataFrame(rows, "seq long, id string, type string, name string, content string, commit_sha string")
    whole = {r["id"]: r["content"] for r in gitlog.accumulated(df).collect()}
    assert whole == {"i": "one\ntwo", "j": "x"}
    first = gitlog.accumulated(df.where("seq < 2")).withColumn("seq", F.lit(-1).cast("long")).select(*df.columns)
    assert {r["id"]: r["content"] for r in gitlog.accumulated(first.unionByName(df.where("seq >= 2"))).collect()} == whole


def test_extractors():
    assert extract.imports_of("import static a.b.C.m;\nimport a.b.*;\n", "java") == [("a.b.C.m", True), ("a.b.*", False)]
    assert extract.imports_of('#include "x.h"\n#include <y.h>\n', "c") == [("x.h", False)]
    assert extract.imports_of("require_relative 'h'\nrequire 'json'\n", "ruby") == [("./h", False), ("json", False)]
    assert [s[0] for s in extract.symbols_of("pub struct P;\nfn q() {}\n// fn no() {}\n", "rust")] == ["P", "q"]
    assert extract.symbols_of("def broken(", "python") == []


def test_retrieve_has_symbols_and_a_summary(store, repo):
    hit = Api(store, 1500, root=repo).retrieve("foo")[0]
    assert set(hit) == {"path", "score", "symbols", "summary"} and hit["path"] == "src/a.ts"
    assert [s["name"] for s in hit["symbols"]] == ["foo"] and hit["summary"] == "export function foo(x: number) {"
    assert Api(store, 1500).retrieve("foo")[0]["summary"] == "" and Api(store, 1500).retrieve("zzz") == []


def test_some_files_stay_below_the_root(spark, repo):
    got = source.some_files(spark, repo, ["src/b.ts", "link/passwd", "../x", "none.ts"]).collect()
    assert [r["path"] for r in got] == ["src/b.ts"]
    assert source.some_files(spark, repo, []).count() == 0


def test_entities_show_symbols_and_data_flow(store, repo):
    foo = store.read("symbols").where("name = 'foo'").select(F.col("id").alias("symbol_id"))
    entity = store.read("entities").where("name = 'initial-foo'").select(F.col("id").alias("entity_id"))
    store.merge("entity_symbols", entity.crossJoin(foo))
    found = Api(store, 1500, root=repo).tool("get_entity", {"entity_id": "initial-foo"})
    assert [(s["name"], s["path"]) for s in found["symbols"]] == [("foo", "src/a.ts")] and found["data_flow"]["tables"] == store.read("query_tables").select("table_name").distinct().count()


def test_embedding_follows_the_settings(spark, repo, store, tmp_path):
    api = Api(store, 1500, root=str(tmp_path))
    assert "hint" in api.auto_embed() and not api.embed_status()["available"]
    (tmp_path / ".ctxspark.toml").write_text('[semantic]\nenabled = true\nmodel = "other"\nmodel_path = "../out"\n[health]\nrepair_below = 55\n[hooks]\nsession_budget_ms = "x"\n')
    (tmp_path / "n.md").write_text("# One\ntext\n## Two\nmore\n")
    assert source.settings(str(tmp_path)) == {"repair_below": 55, "semantic": True, "model": "minilm", "model_path": None, "session_budget_ms": 10_000}
    total = api.embed_status()["total"]
    assert api.auto_embed() == {"embedded": total} and api.auto_embed() == {"embedded": 0}
    status = api.embed_status()
    assert status["available"] and status["coverage"] == 1 and status["stale"] == 0 and status["corpus_counts"]["doc"] == 2


def test_vector_hits_come_from_each_table(spark):
    rows = [("entity", "e1", "E", [1.0, 0.0]), ("entity", "e2", "E", [0.9, 0.1]), ("module", "m", "", [1.0, 0.0]), ("doc", "d", "D", [0.0, 1.0]), ("symbol", "s", "S", [1.0, 0.0])]
    stored = spark.createDataFrame([(*r, "x", None) for r in rows], "kind string, doc_id string, label string, embedding array<float>, snippet string, source_path string")
    got = [(r["kind"], r["label"]) for r in search.vector_hits(stored, [1.0, 0.0], 3).collect()]
    assert got == [("entity", "E"), ("symbol", "S"), ("module", "m")]
    assert search.vector_hits(stored.limit(0), [1.0, 0.0], 3).count() == 0


def test_hooks_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("def f():\n    pass\n")
    repo = ["--repo", str(tmp_path), "--json"]
    assert cli.main([*repo, "hook", "session-start"]) == 0
    steps = json.loads(capsys.readouterr().out)["steps"]
    assert steps["index"] == 1 and steps["embed"] == "off" and list(steps) == ["sync", "index", "embed", "repair"]
    assert cli.main([*repo, "hook", "post-tool-use", "--tool", "Read"]) == 0 and cli.main([*repo, "hook", "session-end", "--summary", "done"]) == 0
    capsys.readouterr()
    assert cli.main([*repo, "summarize-graph"]) == 0
    assert json.loads(capsys.readouterr().out)["orphan_queries"] == 0
