import math

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import cache, dashboard, graph, health, requirements, search, vector


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, ["auth", "login"]), (2, ["unrelated"])], "id long, t array<string>")
    assert [(r["id"], round(r["score"], 9)) for r in search.tfidf(docs, "id", F.col("t"), ["auth"]).collect()] == [(1, round(math.log(2), 9))]


def test_bfs_guards_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    s = spark.createDataFrame([(1,)], "node long")
    assert sorted(map(tuple, graph.dependencies(e, s, 5).collect())) == [(2, 1), (3, 2), (4, 3)]
    assert sorted(map(tuple, graph.dependents(e, s, 1).collect())) == [(3, 1)]
    assert graph.dependencies(e, s, 0).count() == 0


def test_relations(spark):
    keys = spark.createDataFrame([("b", "a"), ("b", "shared"), ("p", "shared"), ("d", "other")], "id string, key string")
    ents = spark.createDataFrame([("b", "bug_fix"), ("p", "pattern"), ("d", "decision")], "id string, type string")
    got = sorted(tuple(r)[:3] for r in graph.shared_relations(keys, ents).collect())
    assert got == [("b", "p", "fixes"), ("p", "b", "implements")]
    assert graph.both_ways(graph.shared_relations(keys, ents)).count() == 4


def test_rrf(spark):
    a = spark.createDataFrame([("doc", "x", 1, "one"), ("doc", "y", 2, "one")], "kind string, id string, rn int, label string")
    b = spark.createDataFrame([("doc", "x", 1, "two")], "kind string, id string, rn int, label string")
    first = search.fused_order(search.rrf([a, b])).first()
    assert (first["id"], first["label"]) == ("x", "one") and math.isclose(first["score"], 2 / 61)


def test_health(spark):
    none = {"files": "id long, path string, parsed_at long", "imports": "id long, file_id long, source string, resolved boolean, external boolean", "signals": "key string, value double"}
    empty = [spark.createDataFrame([], x) for x in none.values()]
    assert health.dimensions(*empty, 0).first().asDict() == {"freshness": 0.5, "consistency": 0.5, "coverage": 0.25, "confidence": 0.5, "score": 45}
    files = spark.createDataFrame([(1, "a.ts", 10)], none["files"])
    imports = spark.createDataFrame([(1, 1, "./b", True, False)], none["imports"])
    assert health.dimensions(files, imports, empty[2], 10).first()["score"] == 80
    assert health.normalise_signals({"tests_pass": 3, "tests_total": 4, "x": 0.1}) == {"tests_pass": 0.75, "tests_total": 1.0, "x": 0.1}
    with pytest.raises(ValueError):
        health.normalise_signals({"tests_total": 4})


def test_cache(spark):
    c = spark.createDataFrame([("a", "x", "h", 1, 1.0, 60, 0, 1), ("b", "y", "h2", 1, 1.0, 60, 0, 2)], "key string, content string, hash string, version long, confidence double, size long, updated_at long, last_access long")
    assert [r["key"] for r in cache.evict(c, 100).collect()] == ["b"]
    new = spark.createDataFrame([("a", "z")], "key string, content string")
    put = {r["key"]: r for r in cache.put(c, new, 9).collect()}
    assert (put["a"]["version"], put["a"]["content"], put["b"]["version"]) == (2, "z", 1)
    again = {r["key"]: r for r in cache.put(cache.put(c, new, 9), new, 10).collect()}
    assert (again["a"]["version"], again["a"]["last_access"]) == (2, 10)


def test_nearest_following(spark):
    m = spark.createDataFrame([("f", 1, "R1"), ("f", 9, "R2")], "file string, line int, req string")
    s = spark.createDataFrame([("f", 0, 10), ("f", 1, 11), ("f", 5, 12)], "file string, start_line int, sym int")
    got = {r["req"]: r["sym"] for r in graph.nearest_following(m, s, "file", "line", "start_line", ["sym"]).collect()}
    assert got == {"R1": 11, "R2": None}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in vector.knn(v, [0.9, 0.1], 1).collect()] == [1]
    corpus = spark.createDataFrame([("doc", "a", "alpha", "A", "p"), ("doc", "b", "beta", "B", "p")], "kind string, doc_id string, text string, label string, source_path string")
    e = vector.HashedEmbedder(16)
    first = vector.embed(corpus, None, e, 1).persist()
    assert first.count() == 2 and vector.staleness(corpus, first).count() == 0
    changed = corpus.withColumn("text", F.when(F.col("doc_id") == "a", "new").otherwise(F.col("text"))).where("doc_id = 'a'")
    second = vector.embed(changed, first, e, 2)
    assert [(r["doc_id"], r["embedded_at"]) for r in second.collect()] == [("a", 2)]


def test_requirements(spark):
    raw = spark.createDataFrame([(1, "T", "<p>must do</p>", "u", "closed", [("requirement",)]), (2, "N", None, "u", "open", [])], "number long, title string, body string, html_url string, state string, labels array<struct<name string>>")
    r = requirements.normalise(raw, "github").collect()
    assert [(x["id"], x["status"], x["description"]) for x in r] == [("GH-1", "implemented", "must do")]
    commits = spark.createDataFrame([("s1", "fix REQ-1 now"), ("s2", "REQ-12"), ("s3", "xREQ-1")], "sha string, message string")
    assert [x["sha"] for x in requirements.citing_commits(commits, "REQ-1").collect()] == ["s1"]


def test_growth(spark):
    w = spark.createDataFrame([("2024-01", 0), ("2024-02", 4), ("2024-03", 5)], "week string, n long")
    assert [r["growth"] for r in dashboard.growth(w, "n").orderBy("week").collect()] == [None, "NEW", "25"]


def test_markdown_chunks(spark):
    p = spark.createDataFrame([("r.md", "intro\n# One\ntext\n## Two\n\n#### not\n")], "path string, content string")
    assert [r["doc_id"] for r in vector.markdown_chunks(p).orderBy("doc_id").collect()] == ["doc:r.md#0", "doc:r.md#1", "doc:r.md#2"]
