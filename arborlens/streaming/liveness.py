"""Locks and changes with state that outlives a micro-batch (R4, R7, R8): transformWithState with timers.

A repository's lock is held by one token. It is kept alive by heartbeats; a timer ends it STALE_SECONDS after the last one, whether or not anything more
arrives for that repository. Pause, resume and stop change its status, release gives it up.

Most keys have few rows in a micro-batch, so locks take rows as they are, not as a table for each key, and paths share tables; the store is asked once and told once for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: After how long without a heartbeat a lock is stale, and the statuses of a lock that is held.
STALE_SECONDS = 30
HELD = ["active", "paused", "stopping"]
STATUSES = {"pause": "paused", "resume": "active", "stop": "stopping", "release": "released"}

LOCK_STATE = "token string, status string, beat long"
LOCK_ROWS = "repository_id long, at_us long, token string, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lock_step(state: tuple | None, token: str, kind: str, at: int, stale_us: int) -> tuple[tuple | None, str | None]:
    """One request (kind: acquire, beat, pause, resume, stop, release) of a token at a time: (new state (token, status, beat), status to tell or None).

    A held lock whose last heartbeat is recent belongs to its token: another's acquire is refused, its other requests are ignored.
    """
    held = state is not None and state[1] in HELD and at - state[2] <= stale_us
    if kind == "acquire":
        if held and state[0] != token:
            return state, "refused"
        return (token, "active", at), None if held and state[1] == "active" else "active"
    if not held or state[0] != token:
        return state, None
    if kind == "beat":
        return (token, state[1], max(at, state[2])), None
    status = STATUSES.get(kind)
    if status is None or status == state[1]:
        return state, None
    return (token, status, state[2]), status


def _told(repository: int, at_us: int, token: str, status: str) -> Row:
    return Row(repository_id=repository, at_us=at_us, token=token, status=status)


class Locks(StatefulProcessor):
    """State: the lock of a repository. Timer: when it is stale, if no heartbeat comes."""

    def __init__(self, stale_seconds: int = STALE_SECONDS):
        self.stale = stale_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", LOCK_STATE)

    def _timer(self, state: tuple | None) -> int | None:
        """The first millisecond after which the heartbeat of a held lock is too old: a held lock has this timer, another has none."""
        return (state[2] + self.stale * 1_000_000) // 1000 + 1 if state is not None and state[1] in HELD else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.lock.get()
        state = before = tuple(state) if state is not None else None
        for r in sorted(rows, key=lambda r: (r.at_us, r.event_id)):
            if state is not None and state[1] in HELD and r.at_us - state[2] > self.stale * 1_000_000:
                yield _told(key[0], state[2] + self.stale * 1_000_000, state[0], "stale")
                state = (state[0], "stale", state[2])
            state, told = lock_step(state, r.token, r.kind, r.at_us, self.stale * 1_000_000)
            if told:
                yield _told(key[0], r.at_us, r.token, told)
        if state is not None and state != before:
            self.lock.update(state)
        old, new = self._timer(before), self._timer(state)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.lock.get()
        if state is not None and state[1] in HELD:
            self.lock.update((state[0], "stale", state[2]))
            yield _told(key[0], state[2] + self.stale * 1_000_000, state[0], "stale")


def lock_stream(requests: DataFrame, stale_seconds: int = STALE_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """requests(event_id, ts with a zone, repository_id, token, kind), a stream -> repository_id, at_us, token, status: what happens to each lock, stale ones by timer as the watermark passes."""
    rows = requests.withWatermark("ts", delay).selectExpr("ts", "event_id", "unix_micros(ts) AS at_us", "repository_id", "token", "kind")
    return rows.groupBy("repository_id").transformWithState(statefulProcessor=Locks(stale_seconds), outputStructType=LOCK_ROWS, outputMode="Append", timeMode="EventTime")


#: Groups that share out the paths: a group's rows of a micro-batch are one table, and its paths' states a map. State is kept by group, so this stays as it is.
SHARES = 1024


class Fingerprints(StatefulProcessor):
    """State of a share of the paths: the last content and working-tree fingerprints of each, and its metadata. Told is a change of a fingerprint; other changes are taken in silently."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "name string", "content string, tree string, metadata string, changes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values(["name", "ts", "event_id"])
        name, content, tree, metadata = (d[c].to_numpy(object) for c in ("name", "content", "tree", "metadata"))
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        count = np.diff(first, append=len(d))
        moved = np.ones(len(d), bool)
        moved[1:] = (content[1:] != content[:-1]) | (tree[1:] != tree[:-1])
        before = np.zeros(len(first), np.int64)
        for k, i in enumerate(first.tolist()):
            state = self.seen.getValue((name[i],))
            moved[i] = state is None or (content[i], tree[i]) != tuple(state[:2])
            before[k] = state[3] if state is not None else 0
        n = np.cumsum(moved)
        n += np.repeat(before - n[first] + moved[first], count)
        for i in (first + count - 1).tolist():
            self.seen.updateValue((name[i],), (content[i], tree[i], metadata[i], int(n[i])))
        yield d.assign(change=n)[moved][["event_id", "repository", "path", "change"]]


def content_changes(events: DataFrame) -> DataFrame:
    """events(event_id, ts, repository_id, path, content, tree, metadata), a stream -> event_id, repository_id, path, change (numbered): events whose content or tree differs from what was last seen on that path."""
    name = F.to_json(F.struct("repository_id", "path"))
    # A number that may be null would be a float in a table, so the repository goes as text.
    rows = events.select(F.pmod(F.xxhash64("repository_id", "path"), F.lit(SHARES)).alias("share"), name.alias("name"), "ts", "event_id", F.col("repository_id").cast("string").alias("repository"), "path", "content", "tree", "metadata")
    told = rows.groupBy("share").transformWithStateInPandas(statefulProcessor=Fingerprints(), outputStructType="event_id long, repository string, path string, change long", outputMode="Append", timeMode="None")
    return told.select("event_id", F.col("repository").cast("long").alias("repository_id"), "path", "change")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what its source holds now into Parquet and read it back; state is kept in the store that timers need. Run again, it goes on from the checkpoint."""
    spark = stream.sparkSession
    # A query takes the setting over when it starts.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
