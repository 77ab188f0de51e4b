"""Cases that the review of round 1 named, outside the training-data operators."""

import json
import random
import re

from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.operators import graph, health, resolve, search
from ctxspark.store import Store


def test_store_survives_a_crash(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *keys: spark.createDataFrame([(k, 1.0, "x", 1) for k in keys], "key string, value double, source string, updated_at long")
    have = lambda: sorted(r["key"] for r in Store(spark, store.root).read("health_signals").collect())
    store.write(health_signals=rows("a"))
    store.write(health_signals=rows("a", "b"))
    (tmp_path / "s/pointers/next.tmp").write_text("{")  # died before the rename
    assert have() == ["a", "b"]
    (tmp_path / "s/pointers/99.json").write_text('{"version": 7, "tab')  # cut off
    assert have() == ["a", "b"]
    for n in range(8):
        store.set_metadata("n", str(n))
    assert have() == ["a", "b"] and store.metadata("n") == "7" and len(store._pointers()) <= 6
    assert json.loads((tmp_path / f"s/pointers/{store._pointers()[-1]}.json").read_text())["tables"] == {"health_signals": 2}


def test_candidates():
    c = lambda path, source, crate=None, language="rust": resolve.candidates(path, language, source, crate)
    assert c("src/a/b.rs", "crate::x::Y", "") == ["src/x/Y.rs", "src/x/Y/mod.rs", "src/x.rs", "src/x/mod.rs"]
    assert c("src/a/b.rs", "self::x", "") == ["src/a/b/x.rs", "src/a/b/x/mod.rs"]
    assert c("src/a/mod.rs", "super::x", "") == ["src/x.rs", "src/x/mod.rs"]
    assert c("k/src/a/b.rs", "super::super::x", "k") == ["k/src/x.rs", "k/src/x/mod.rs"]
    assert c("k/src/lib.rs", "x", "k") == ["k/src/x.rs", "k/src/x/mod.rs"]
    assert c("a.rs", "super::super::x", "") == c("a.rs", "::std::x", "") == c("a.rs", "self", "") == []
    ts = c("src/a.ts", "./b.js", language="typescript")
    assert ts[0] == "src/b.js" and ts[-2:] == ["src/b.ts", "src/b.tsx"] and "src/b.js/index.ts" in ts
    assert c("a.ts", ".", language="typescript")[1:3] == [".ts", ".tsx"] and "index.ts" in c("a.ts", ".", language="typescript")
    assert c("x/a.mts", "../b.mjs", language="typescript")[-1] == "b.mts"


def test_types_as_by_patterns(spark):
    """The words' short cut against the patterns themselves."""
    r = random.Random(3)
    words = [w for _, x in X.TYPE_WORDS for w in x.split("|")] + ["prefix", "renamer", "FIX", "Why", "éfix", "fix_", "later", "refactor", "x"]
    texts = ["".join(r.choice(words) + r.choice([" ", "  ", "-", "_", ".", "é", "\n"]) for _ in range(r.randint(0, 4))) for _ in range(600)] + [None]

    def by_pattern(t):
        return next((n for n, x in X.TYPE_WORDS if re.search(rf"{X.LEFT}(?:{x}){X.RIGHT}", t or "", re.I | re.A)), "concept")

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.classify_type(F.col("t")).alias("k")).collect()
    assert {x["i"]: x["k"] for x in got} == {i: by_pattern(t) for i, t in enumerate(texts)}


def test_following_is_linear_and_right(spark):
    r = random.Random(2)
    marks = [(k, t, i) for i, (k, t) in enumerate((r.choice("ab"), r.randint(0, 40)) for _ in range(60))]
    events = [(r.choice("ab"), r.randint(0, 40), i) for i in range(30)]
    got = graph.nearest_following(spark.createDataFrame(marks, "k string, t long, i long"), spark.createDataFrame(events, "k string, u long, e long"), "k", "t", "u", ["e"])
    want = {i: min(((u, e) for x, u, e in events if x == k and u >= t), default=(None, None)) for k, t, i in marks}
    assert {x["i"]: (x["u"], x["e"]) for x in got.collect()} == want
    plan = got._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(i, f"alpha beta {'alpha ' * (i % 3)}") for i in range(40)], "id long, text string")
    scored = search.tfidf(docs, "id", X.tokenize(F.col("text")), ["alpha", "beta", "none"])
    assert scored.count() == 40
    scored.collect()
    assert "ReusedExchange" in scored._jdf.queryExecution().executedPlan().toString()


def test_pages_of_issues_do_not_depend_on_the_plan(spark):
    """Equal seq at page ends: any order of rows gives the same pages, which together hold each row once."""
    rows = [(n // 4, "broken_import", f"unresolved import: part-{n * 7 % 12}", "x") for n in range(12)]
    pages = lambda own: [[tuple(r) for r in health.issue_page(spark.createDataFrame(own, "seq long, type string, message string, location string").coalesce(1), 3, at).collect()] for at in range(0, 12, 3)]
    got = pages(rows)
    assert got == pages(rows[::-1]) and sorted(sum(got, [])) == sorted(rows)
