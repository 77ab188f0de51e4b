"""The inverted index beside the search that reads whole texts, its upkeep, and entities that a model finds."""

import pytest
from pyspark.sql import functions as F

from ctxspark.functions import text as X
from ctxspark.operators import search
from ctxspark.sources import gitlog
from ctxspark.store import Store
from ctxspark.streaming.streams import merge_entities

TEXTS = ["a a a b", "a b a b c", "c-d e", "", None, "b a", "a", "c d d c d"]


@pytest.mark.parametrize("query", ["a", "a-a", "b a", "c-d", "a-b-a", "d-c-d a", "none", "c none"])
def test_the_index_ranks_like_the_texts(spark, query):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), "[^a-z]+"), lambda t: t != "")
    wanted = search.phrases(query)
    whole = search.bm25(docs, "id", tokens, wanted).collect()
    index = search.bm25_postings(*search.postings(docs, "id", tokens), wanted).collect()
    assert {r["id"]: round(r["rank"], 9) for r in index} == {r["id"]: round(r["rank"], 9) for r in whole}


def test_an_empty_index(spark):
    docs = spark.createDataFrame([], "id string, text string")
    index = search.postings(docs, "id", X.all_tokens(F.col("text")))
    assert search.bm25_postings(*index, [["a"]]).collect() == []


def test_upkeep(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = "seq long, id string, type string, name string, content string, commit_sha string"

    def matches() -> None:
        entities = store.read("entities")
        whole, lengths = search.entity_postings(entities)
        assert sorted(map(str, store.read("postings").select("term", "id", "positions").collect())) == sorted(map(str, whole.select("term", "id", "positions").collect()))
        assert sorted(map(str, store.read("posting_lengths").collect())) == sorted(map(str, lengths.collect()))
        for q in ("tokens", "session-token", "missing"):
            kept = search.search_entities(entities, store.read("backlinks"), q, 10, (store.read("postings"), store.read("posting_lengths")))
            assert str(kept.collect()) == str(search.search_entities(entities, store.read("backlinks"), q).collect())

    merge_entities(store, spark.createDataFrame([(0, "x", "decision", "session", "token of the session token", "s0"), (0, "y", "bug_fix", "other", "words", "s0")], row))
    matches()
    merge_entities(store, spark.createDataFrame([(1, "y", "bug_fix", "other", "more tokens", "s1"), (1, "z", "pattern", "new", None, "s1")], row))
    matches()
    assert {r["id"] for r in store.read("posting_lengths").collect()} == {"x", "y", "z"}


def test_a_store_without_an_index_gets_a_whole_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(entities=spark.createDataFrame([("old", "concept", "old", "old words")], "id string, type string, name string, content string"))
    assert not store.has("postings")
    merge_entities(store, spark.createDataFrame([(0, "x", "decision", "n", "new words", "s0")], "seq long, id string, type string, name string, content string, commit_sha string"))
    assert {r["id"] for r in store.read("posting_lengths").collect()} == {"old", "x"}


def test_a_model_reads_batches(spark):
    log = spark.createDataFrame([(n, f"{n:07d}ff", "A", f"m{n}", None if n == 3 else "token = 'abcdefgh1234'") for n in range(12)], "seq long, sha string, author string, message string, diff string")
    prompts = {r["batch"]: r for r in gitlog.batch_prompts(log).collect()}
    assert sorted(prompts) == [0, 1] and prompts[1]["commit_sha"] == "0000010ff"
    assert "abcdefgh1234" not in prompts[0]["prompt"] and prompts[0]["prompt"].count("Message: ") == 10

    def model(prompt: str) -> str:
        return "no idea" if "m11" in prompt else '```json\n{"entities": [{"type": "concept", "name": "Batch"}]}\n```'

    got = gitlog.model_entities(log, model).collect()
    assert [(r["type"], r["name"], r["content"], r["commit_sha"]) for r in got] == [("concept", "batch", "", "0000000ff")]


def test_unchanged_files_keep_their_specifiers(spark, tmp_path, monkeypatch):
    from ctxspark import build
    from ctxspark.operators import extract

    def tree(*rows: tuple[str, str]):
        return spark.createDataFrame([(p, 0, len(c), c) for p, c in rows], "path string, mtime long, size long, content string")

    user = ("a/U.java", "package a;\nimport static b.T.m;\nimport b.Gone;\n")
    target = ("b/T.java", "package b;\npublic class T {}\n")
    store = Store(spark, str(tmp_path / "s"))
    build.index_tree(store, tree(user, target, ("b/Gone.java", "package b;\npublic class Gone {}\n")), 1)

    parsed, whole = [], extract.extract
    monkeypatch.setattr(extract, "extract", lambda t: parsed.extend(r["path"] for r in t.select("path").collect()) or whole(t))
    build.index_tree(store, tree(user, target, ("c/New.java", "package c;\npublic class New {}\n")), 2)
    assert parsed == ["c/New.java"]
    paths = {r["id"]: r["path"] for r in store.read("files").collect()}
    got = {r["source"]: (paths.get(r["resolved_file_id"]), r["resolved"], r["static"]) for r in store.read("imports").collect()}
    assert got == {"b.T.m": ("b/T.java", True, True), "b.Gone": (None, False, False)}
