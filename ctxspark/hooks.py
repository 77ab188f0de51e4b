"""Session hooks: a budgeted chain at the start, context for a prompt, a log of tool uses, a summary at the end."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from ctxspark.api import Api
from ctxspark.operators import repair
from ctxspark.store import Store

BUDGET_MS = 10_000


def session_start(store: Store, root: str, now: int, steps: dict[str, Callable[[], object]], budget_ms: int = BUDGET_MS, clock: Callable[[], float] = time.monotonic) -> dict:
    """Run the steps (sync, index, embed, ...) in order while the budget lasts; a step's failure is noted and skipped."""
    began, done = clock(), {}
    for name, step in steps.items():
        if (clock() - began) * 1000 >= budget_ms:
            done[name] = "skipped"
            continue
        try:
            done[name] = step()
        except Exception as e:  # a hook must not stop a session
            done[name] = f"failed: {e}"
    return {"steps": done, "score": repair.score(store, now), "root": root}


def user_prompt(api: Api, task: str) -> dict:
    c = api.context(task)
    return {"topFiles": [f["path"] for f in c["files"]], "entities": [f"{e['type']}:{e['name']}" for e in c["entities"]], "health": c["health"]["score"]}


def post_tool_use(folder: str, tool: str, session: str, ts: str) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "tool-log.jsonl"), "a") as f:
        f.write(json.dumps({"ts": ts, "sessionId": session, "tool": tool}) + "\n")


def session_end(folder: str, session: str, summary: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"session-{session}.md")
    with open(path, "w") as f:
        f.write(f"# Session {session}\n\n{summary}\n")
    return path
