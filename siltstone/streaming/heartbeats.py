"""Timers on streams: owners whose heartbeat stops, and sessions that end.

Both keep state by key and set timers in event time, so the answers depend on the rows and the watermark alone, not on how
the rows come in batches. They need the RocksDB state store (STATE_STORE).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting that streams with timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: A crawl whose heartbeat is older than this has no live owner.
STALE_MS = 2 * 60 * 1000
HOUR_MS = 60 * 60 * 1000


def _instants(ms: list[int]) -> np.ndarray:
    return np.array(ms, "datetime64[ms]").astype("datetime64[us]")


def _held(state) -> np.ndarray:
    """The numbers of a value state, which keeps them as bytes: read and written in one message, whatever their number."""
    found = state.get()
    return np.frombuffer(found[0] if found else b"", np.int64)


class StaleOwners(StatefulProcessor):
    """A row for each heartbeat that no other follows within the limit.

    Beats are kept until the watermark has passed them by the limit: only then nothing can come between any more. So
    beats may come in any order within the watermark's delay. An owner has a timer for the earliest beat of a batch, and
    then one for the earliest that is left: its state is read and written once a batch, not once a beat.
    """

    def __init__(self, limit_ms: int = STALE_MS):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.beats = handle, handle.getValueState("beats", "ms binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = set(_held(self.beats).tolist())
        new = {ms for part in rows for ms in part["ms"].tolist()} - known
        if new:
            self.beats.update((np.array(sorted(known | new), np.int64).tobytes(),))
            self.handle.registerTimer(min(new) + self.limit)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        beats = _held(self.beats).tolist()
        due = bisect_right(beats, passed - self.limit)
        if not due:
            return
        if due < len(beats):
            self.beats.update((np.array(beats[due:], np.int64).tobytes(),))
            self.handle.registerTimer(beats[due] + self.limit)
        else:
            self.beats.clear()
        silent = [beat for beat, following in zip(beats[:due], [*beats[1:], None], strict=False) if following is None or following > beat + self.limit]
        if silent:
            yield pd.DataFrame({"key": key[0], "last_beat": _instants(silent), "stale_at": _instants([beat + self.limit for beat in silent])})

    def close(self) -> None:
        pass


def stale_owners(beats: DataFrame, key: str, at: str, limit_ms: int = STALE_MS, delay: str = "10 minutes") -> DataFrame:
    """(key, last_beat, stale_at) of a stream beats(key, at): owners that were silent for longer than the limit.

    An owner that beats again and stops again has a row each time; the same beat twice counts once. A beat exactly at the
    limit is in time. Rows without a key or instant are left out, and beats that come later than the delay are ignored.
    """
    plain = beats.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).dropna().withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)
    found = plain.groupBy("key").transformWithStateInPandas(StaleOwners(limit_ms), "key string, last_beat timestamp_ntz, stale_at timestamp_ntz", "Append", "EventTime")
    return found.select(F.col("key").cast(beats.schema[key].dataType).alias(key), "last_beat", "stale_at")


def _sweep(end_ms: int) -> int:
    """The first full hour at or after an end."""
    return -(-end_ms // HOUR_MS) * HOUR_MS


def swept(spans: list[tuple[int, int]], passed: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """((end, sweep) of the sessions that are over, what is left) of spans(at, end) after all sweeps up to an instant.

    Sweeps go in order; those that have begun and last are carried from one to the next, so each sees only its own.
    """
    over, begun, coming = [], [], deque(sorted(spans))
    for hour in sorted({h for _, end in spans if (h := _sweep(end)) <= passed}):
        while coming and coming[0][0] <= hour:
            begun.append(coming.popleft())
        lasting = [s for s in begun if s[1] > hour]
        if begun and not lasting:
            over.append((max(end for _, end in begun), hour))
        begun = lasting
    return over, [*begun, *coming]


class EndedSessions(StatefulProcessor):
    """A row for each session at the first full hour after its end, unless it was renewed by then.

    Starts and renewals are kept until the watermark has passed the sweep of their end, as beats are; timers are those of
    the earliest sweep of a batch, and of what is left.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.spans = handle, handle.getValueState("spans", "at_ends binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = set(map(tuple, _held(self.spans).reshape(-1, 2).tolist()))
        new = {span for part in rows for span in zip(part["at_ms"].tolist(), part["end_ms"].tolist(), strict=True)} - known
        if new:
            self.spans.update((np.array(sorted(known | new), np.int64).tobytes(),))
            self.handle.registerTimer(_sweep(min(end for _, end in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        spans = list(map(tuple, _held(self.spans).reshape(-1, 2).tolist()))
        over, left = swept(spans, passed)
        if not left:
            self.spans.clear()
        elif len(left) < len(spans):
            self.spans.update((np.array(left, np.int64).tobytes(),))
        if later := [h for _, end in left if (h := _sweep(end)) > passed]:
            self.handle.registerTimer(min(later))
        if over:
            yield pd.DataFrame({"key": key[0], "ended_at": _instants([end for end, _ in over]), "swept_at": _instants([hour for _, hour in over])})

    def close(self) -> None:
        pass


def ended_sessions(sessions: DataFrame, key: str, at: str, expires: str, delay: str = "10 minutes") -> DataFrame:
    """(key, ended_at, swept_at) of a stream sessions(key, at, expires): the hourly sweep of sessions that are over.

    Every row of a session, its start or a renewal, says until when it lasts; the latest end counts of those that come by
    the sweep. A session that starts again after a sweep has a row for each. Rows without a key, instant or end are left out.
    """
    plain = sessions.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(expires).cast("timestamp")).alias("end_ms")).dropna().withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    found = plain.groupBy("key").transformWithStateInPandas(EndedSessions(), "key string, ended_at timestamp_ntz, swept_at timestamp_ntz", "Append", "EventTime")
    return found.select(F.col("key").cast(sessions.schema[key].dataType).alias(key), "ended_at", "swept_at")
