"""Watching a source tree: files that changed and then settled lose their cached summaries."""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from ctxspark.sources import files as source
from ctxspark.store import Store
from ctxspark.streaming.streams import QUIET

#: Quiet after the last change to a path, time that a file must keep its size, and time between looks (ms).
DEBOUNCE, SETTLED, LOOK = 250, 100, 50


class Watcher:
    """Compares snapshots of a tree. A path that comes, changes or goes is told once, after quiet for debounce and at least
    SETTLED; what is there at the start is not told."""

    def __init__(self, root: str, debounce: int = DEBOUNCE):
        self.root, self.quiet = root, max(debounce, SETTLED)
        self.seen, self.pending = self.snapshot(), {}

    def snapshot(self) -> dict[str, tuple[int, int]]:
        ignore = {"node_modules", ".git", ".ctxspark"}
        return {p: (mtime, size) for p, mtime, size in source.walk(self.root, ignore) if not re.search(QUIET, p)}

    def look(self, now: float) -> list[str]:
        """Paths that have settled by now (ms)."""
        new = self.snapshot()
        self.pending |= {p: now for p in {*new, *self.seen} if new.get(p) != self.seen.get(p)}
        self.seen = new
        done = sorted(p for p, at in self.pending.items() if now - at >= self.quiet)
        for p in done:
            del self.pending[p]
        return done


def summary_key(root: str, path: str) -> str:
    return "summary:" + hashlib.sha256(os.path.join(os.path.abspath(root), path).encode()).hexdigest()


def invalidate(store: Store, root: str, paths: list[str]) -> None:
    """Drop the summaries of some paths, all in one write, if there are any."""
    cache = store.read("cache")
    hit = F.col("key").isin([summary_key(root, p) for p in paths])
    if not cache.where(hit).isEmpty():
        store.write(cache=cache.where(~hit))


def watch(store: Store, root: str, debounce: int = DEBOUNCE, tell: Callable[[str], object] = print, go_on: Callable[[], bool] = lambda: True) -> None:
    """Look until go_on says no."""
    watcher = Watcher(root, debounce)
    tell("watching")
    while go_on():
        time.sleep(LOOK / 1000)
        paths = watcher.look(time.monotonic() * 1000)
        if paths:
            invalidate(store, root, paths)
            for p in paths:
                tell(f"invalidated: {p}")
