"""Repair in stages: rebuild, drop stale summaries, check claims against history, ask a model if one is given."""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Callable

from pyspark.sql import functions as F

from ctxspark.operators import cache, health
from ctxspark.store import Store

CLAIM = r"//\s*CLAIM:\s*(.+)"


def cache_key(prompt: str) -> str:
    return "repair:" + hashlib.sha256(prompt.encode()).hexdigest()


def score(store: Store, now: int) -> int:
    return health.dimensions(store.read("files"), store.read("imports"), store.read("health_signals"), now).first()["score"]


def invalidate(store: Store) -> int:
    """Drop cached repairs and summaries; how many."""
    old = store.read("cache")
    kept = cache.invalidate(old, "repair:", "summary:")
    n = old.count() - kept.count()
    store.write(cache=kept)
    return n


def contradicted_claims(root: str, files: list[str], most: int = 10) -> list[tuple[str, str]]:
    """(file, claim) of claim comments whose words stand in a line that history removed."""
    out = []
    for f in [x for x in files if x.endswith((".ts", ".js"))][:most]:
        with open(f"{root}/{f}", errors="replace") as h:
            claims = re.findall(CLAIM, h.read())
        if not claims:
            continue
        log = subprocess.run(["git", "-C", root, "log", "-p", "--format=", "--", f], capture_output=True, text=True, errors="replace").stdout
        gone = [x[1:].strip().lower() for x in log.split("\n") if x.startswith("-") and not x.startswith("---")]
        out += [(f, c.strip()) for c in claims if any(c.strip().lower() in x for x in gone)]
    return out


def ask(store: Store, model: Callable[[str], str], prompt: str, now: int) -> tuple[str, bool]:
    """A model's answer and whether it came from the cache."""
    old = store.read("cache")
    hit = cache.get(old, cache_key(prompt)).first()
    if hit:
        store.write(cache=cache.touch(old, cache_key(prompt), now))
        return hit["content"], True
    answer = model(prompt)
    new = store.spark.createDataFrame([(cache_key(prompt), answer)], "key string, content string")
    store.write(cache=cache.evict(cache.put(old, new, now)))
    return answer, False


def repair(store: Store, root: str, now: int, threshold: int = 70, rebuild: Callable[[], object] | None = None, model: Callable[[str], str] | None = None) -> list[dict]:
    """The stages that ran, up to the first that brings the score to the threshold."""

    def claims() -> object:
        files = [r["path"] for r in store.read("files").select("path").orderBy("path").where(F.col("path").rlike(r"\.(?:ts|js)$")).collect()]
        return contradicted_claims(root, files)

    stages: list[tuple[str, Callable[[], object]]] = [("rebuild", rebuild or (lambda: None)), ("cache", lambda: invalidate(store)), ("history", claims)]
    if model:
        stages.append(("model", lambda: ask(store, model, f"repair a store of score {score(store, now)}", now)))
    out = []
    for name, run in stages:
        action = run()
        s = score(store, now)
        out.append({"stage": name, "action": action, "score": s})
        if s >= threshold:
            break
    return out
