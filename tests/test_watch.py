"""The watcher tells settled changes once and drops their summaries."""

from ctxspark.operators import cache
from ctxspark.store import Store
from ctxspark.streaming import watch


def test_changes_are_told_once_they_settle(tmp_path):
    (tmp_path / "a.ts").write_text("1")
    w = watch.Watcher(str(tmp_path))
    assert w.look(0) == []
    (tmp_path / "a.ts").write_text("22")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x").write_text("1")
    (tmp_path / "s.db-wal").write_text("1")
    assert w.look(100) == [] and w.look(300) == []
    (tmp_path / "a.ts").write_text("333")
    assert w.look(340) == [] and w.look(500) == []  # a change within the quiet starts it anew
    assert w.look(590) == ["a.ts"] and w.look(900) == []
    (tmp_path / "a.ts").unlink()
    assert w.look(1000) == [] and w.look(1250) == ["a.ts"]


def test_summaries_of_changed_files_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [(watch.summary_key("/r", "a.ts"), "x"), (watch.summary_key("/r", "b.ts"), "y"), ("repair:1", "z")]
    store.write(cache=cache.put(store.read("cache"), spark.createDataFrame(rows, "key string, content string"), 1))
    watch.invalidate(store, "/r", ["a.ts", "none.ts"])
    assert sorted(r["content"] for r in store.read("cache").collect()) == ["y", "z"]


def test_watch_ends(spark, tmp_path):
    told, left = [], iter([True, True, False])
    watch.watch(Store(spark, str(tmp_path / "store")), str(tmp_path), 100, told.append, lambda: next(left))
    assert told == ["watching"]
    assert watch.summary_key("/r", "a") != watch.summary_key("/q", "a")
