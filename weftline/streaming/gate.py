"""File events as a stream: debounced batches and a hold gate around repository operations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_MS, SETTLE_MS, MAX_HOLD_MS = 150, 300, 60_000
ORPHAN_LOCK_MS = 30_000


def classify(path_col: str = "path") -> Column:
    """Repository activity (lock and log files), a reference change, or the working tree."""
    p = F.col(path_col)
    return F.when(p.rlike(r"(?:^|/)\.git/(?:HEAD|refs/|packed-refs)"), "ref").when(p.rlike(r"(?:^|/)\.git/"), "activity").otherwise("tree")


def lock_is_live(age_ms: Column, git_running: Column) -> Column:
    """Whether a lock file means a running operation: a young one does, an old one unless no git process is known to run."""
    return F.when(age_ms.isNull(), False).when(age_ms < ORPHAN_LOCK_MS, True).otherwise(~(git_running.eqNullSafe(False)))


def debounced(events: DataFrame, quiet_ms: int = QUIET_MS, lateness: str = "10 seconds") -> DataFrame:
    """Bursts per root as session windows over event time.  events: root, path, ts."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("root", F.session_window("ts", f"{quiet_ms} milliseconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("path")).alias("paths"))
        .select("root", F.col("w.start").alias("first"), F.col("w.end").alias("closed"), "n", "paths")
    )


class Gate:
    """Holds working-tree changes while a repository is at work.

    Without a hold, tree events pass at once.  Activity, a reference change or a busy repository starts a
    hold; in it every event counts as activity.  The hold ends once the repository is not busy and
    ``settle`` has passed since the last event, or after ``most`` in any case.
    """

    def __init__(self, settle: int = SETTLE_MS, most: int = MAX_HOLD_MS, state: tuple = (False, -1, -1, False, ())):
        self.settle, self.most = settle, most
        self.busy, self.started, self.last, self.ref, self.paths = *state[:4], list(state[4])

    @property
    def state(self) -> tuple:
        return self.busy, self.started, self.last, self.ref, list(self.paths)

    def due(self) -> int | None:
        """When the hold ends if nothing more happens."""
        if self.started < 0:
            return None
        latest = self.started + self.most
        return latest if self.busy else min(latest, self.last + self.settle)

    def expire(self, now: int) -> list[tuple]:
        """The flush that is due by ``now``: (action, at, paths, ref, timed_out, held)."""
        due = self.due()
        if due is None or due > now:
            return []
        settled = not self.busy and due >= self.last + self.settle
        out = [("flush", due, self.paths, self.ref, not settled, due - self.started)]
        self.started, self.last, self.ref, self.paths = -1, -1, False, []
        if self.busy:  # still at work: the next hold starts with the next event
            self.busy = False
        return out

    def step(self, now: int, kind: str, path: str | None) -> list[tuple]:
        """kind: tree, activity, ref, busy (a live lock, a rebase) or free."""
        out = self.expire(now)
        if kind == "free":
            if self.busy:
                self.busy, self.last = False, now
            return out
        if self.started < 0 and kind == "tree":
            return [*out, ("pass", now, [path] if path else [], False, False, 0)]
        if self.started < 0:
            self.started = now
        self.last, self.busy, self.ref = now, self.busy or kind == "busy", self.ref or kind == "ref"
        if kind == "tree" and path:
            self.paths.append(path)
        return out


GATED = "root string, action string, at long, paths array<string>, ref boolean, timed_out boolean, held_ms long"
_STATE = "busy boolean, started long, last long, ref boolean, paths array<string>"


def hold_gate(events: DataFrame, settle_ms: int = SETTLE_MS, max_hold_ms: int = MAX_HOLD_MS) -> DataFrame:
    """What a root's gate lets through: tree events as they come, or one flush at the end of a hold.

    events: root, kind (tree, activity, ref, busy, free), path, ts.  ``ref`` of a flush asks for a full reload.
    A hold lasts ``max_hold_ms`` at most, which bounds its state.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(settle_ms, max_hold_ms, state.get if state.exists else (False, -1, -1, False, ()))
        if state.hasTimedOut:
            out = gate.expire(max(gate.due() or 0, state.getCurrentWatermarkMs()))
        else:
            rows = sorted((round(t.timestamp() * 1000), k, p) for b in batches for t, k, p in zip(b["ts"], b["kind"], b["path"].where(b["path"].notna(), ""), strict=True))
            out = [x for at, kind, path in rows for x in gate.step(at, kind, path or None)]
        due = gate.due()
        if due is None and not gate.busy:
            state.remove()
        else:
            state.update(gate.state)
            if due is not None:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["root", "action", "at", "paths", "ref", "timed_out", "held_ms"])

    return (
        events.withWatermark("ts", "1 second").groupBy("root")
        .applyInPandasWithState(step, GATED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def refresh(events: DataFrame, apply, checkpoint: str):
    """Starts the stream that hands each micro-batch's changed paths to ``apply(batch, id)``."""
    return events.dropDuplicates(["root", "path", "ts"]).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
