"""Captures that settle, and jobs that wait: streams with state and event-time timers. Times in state are milliseconds since 1970 in UTC, so no
session's zone changes them. They need the RocksDB state store (see needs_rocksdb)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: When captures are final, two checks settle, a check comes again, and all settle [CX10].
LATE, APART, CADENCE, BACKSTOP = 24 * 3_600_000, 3_600_000, 3 * 3_600_000, 48 * 3_600_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(spark: SparkSession) -> None:
    """Names the state store that these streams need, where the session names none of its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def replay(captured: int, ended: int | None, sha: str | None, checks: list[tuple[int, str | None]], now: int) -> dict[str, Any]:
    """What is known of a capture at `now` from its checks (time, digest), in any order: counts, whether and when it settled, why, and the next check.

    Checks count in the order of their times, each compared with the one before, the first with the capture; equal times by digest. What
    comes after the settling isn't a check."""
    told = {"n_checks": 0, "n_revisions": 0, "under_churn": False, "settled_at": None, "reason": "provisional", "next_check": None}
    if ended is not None and captured > ended + LATE:
        return told | {"settled_at": captured, "reason": "late"}
    before, last, last_same, end = sha, None, False, captured + BACKSTOP
    for at, digest in sorted(checks, key=lambda c: (c[0], c[1] is not None, c[1] or "")):
        if at >= end or at > now:
            break
        same = digest == before
        told["n_checks"] += 1
        told["n_revisions"] += not same
        if same and last_same and at - last >= APART:
            return told | {"settled_at": at, "reason": "unchanged"}
        before, last, last_same = digest, at, same
    if now >= end:
        return told | {"settled_at": end, "reason": "backstop", "under_churn": told["n_revisions"] > 0}
    return told | {"next_check": min((captured if last is None else last) + CADENCE, end)}


SETTLED = "subject long, n_checks long, n_revisions long, settle boolean, under_churn boolean, reason string, settled_at long, next_check long, final boolean"
_TOLD = "n_checks long, n_revisions long, under_churn boolean, settled_at long, reason string, next_check long"


class _Settling(StatefulProcessor):
    """Value state: the capture and what was told last; list state: its checks; one timer: the next moment at which anything can change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.capture = handle.getValueState("capture", "captured long, ended long, sha string")
        self.checks = handle.getListState("checks", "at long, sha string")
        self.told = handle.getValueState("told", _TOLD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for is_capture, at, ended, sha in zip(batch["is_capture"], batch["at_ms"], batch["ended_ms"], batch["sha256"]):
                sha = None if pd.isna(sha) else sha
                if is_capture:
                    first = self.capture.get() if self.capture.exists() else None
                    if first is None or at < first[0]:  # the first capture counts, whenever it comes
                        self.capture.update((int(at), None if pd.isna(ended) else int(ended), sha))
                else:
                    self.checks.appendValue((int(at), sha))
        yield from self._tell(key, mark, self._newest(mark))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        yield from self._tell(key, mark, self._newest(mark))

    def _newest(self, mark: int) -> int:
        return max([mark, *(c[0] for c in self.checks.get())])

    def _tell(self, key: tuple, mark: int, now: int) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not self.capture.exists():
            self.handle.registerTimer(now + BACKSTOP + LATE)  # checks of a capture that never comes don't stay for ever
            if self.told.exists() or now - min([c[0] for c in self.checks.get()], default=now) > BACKSTOP + LATE:
                self._forget()
            return
        captured, ended, sha = self.capture.get()
        found = replay(captured, ended, sha, [tuple(c) for c in self.checks.get()], now)
        final = found["settled_at"] is not None and found["settled_at"] < mark
        columns = [c.split()[0] for c in _TOLD.split(", ")]
        was = tuple(self.told.get()) if self.told.exists() else None
        if was != tuple(found[c] for c in columns) or final:
            row = {"subject": key[0], "settle": found["settled_at"] is not None, "final": final} | found
            yield pd.DataFrame([row])[[c.split()[0] for c in SETTLED.split(", ")]].astype({"settled_at": "Int64", "next_check": "Int64"})
        if final:
            self._forget()
            return
        self.told.update(tuple(found[c] for c in columns))
        wake = found["settled_at"] if found["settled_at"] is not None else found["next_check"] if found["next_check"] > now else captured + BACKSTOP
        self.handle.registerTimer(max(wake, mark) + 1)

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.capture.clear()
        self.checks.clear()
        self.told.clear()


def settling(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """[SM5, CX10, CX23] SETTLED with times as timestamps: a row whenever what is known of a capture changes, the last one with final true.

    events (a stream): subject, is_capture, at (timestamp), ended (timestamp, of captures: when the meeting ended, null if unknown), sha256.
    Captures and checks may come in any order of batches: until the watermark has passed a settling, a late check revises it; then the final row
    is told and the subject's state is gone. A subject's state is its checks up to the backstop (a few dozen). Checks without a capture are
    dropped after three days."""
    needs_rocksdb(events.sparkSession)
    ready = events.withWatermark("at", late).withColumns({"at_ms": F.unix_millis("at"), "ended_ms": F.unix_millis("ended")})
    found = ready.select("subject", "is_capture", "at", "at_ms", "ended_ms", "sha256").groupBy("subject").transformWithStateInPandas(_Settling(), SETTLED, "Append", "EventTime")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("settled_at", "next_check")})


DELIVERED = "job_id long, kind string, payload string, run_after long, delivered long"


class _Deferral(StatefulProcessor):
    """Value state: the job that waits; one timer at its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "kind string, payload string, run_after long, asked long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.job.get() if self.job.exists() else None
        for batch in rows:
            for kind, payload, run_after, asked in zip(batch["kind"], batch["payload"], batch["run_ms"], batch["at_ms"]):
                if newest is None or asked >= newest[3]:  # of several requests for one job the latest holds
                    newest = (kind, payload, int(asked) if pd.isna(run_after) else int(run_after), int(asked))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        mark = timerValues.getCurrentWatermarkInMs()
        if newest[2] <= max(mark, newest[3]):
            yield self._deliver(key, newest, max(newest[2], newest[3]))
        else:
            self.job.update(newest)
            self.handle.registerTimer(newest[2])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            newest = self.job.get()
            yield self._deliver(key, newest, newest[2])

    def _deliver(self, key: tuple, job: tuple, at: int) -> pd.DataFrame:
        self.job.clear()
        return pd.DataFrame({"job_id": [key[0]], "kind": [job[0]], "payload": [job[1]], "run_after": [job[2]], "delivered": [at]})


def deferred(requests: DataFrame, late: str = "0 seconds") -> DataFrame:
    """[SM2] DELIVERED with times as timestamps: each job once its time has come in event time; one that may run at once is handed on, so jobs that came
    later overtake those that wait.

    requests (a stream): job_id, kind, payload, at (timestamp of the request), run_after (timestamp or null). A new request for a job that
    still waits replaces the old one. A waiting job is one small state; a delivered one leaves none."""
    needs_rocksdb(requests.sparkSession)
    ready = requests.withWatermark("at", late).withColumns({"at_ms": F.unix_millis("at"), "run_ms": F.unix_millis("run_after")})
    found = ready.select("job_id", "kind", "payload", "at", "at_ms", "run_ms").groupBy("job_id").transformWithStateInPandas(_Deferral(), DELIVERED, "Append", "EventTime")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("run_after", "delivered")})
