"""The refresh queue as a stream: a forum comes out when it falls due.

Forums are dealt by hash into a fixed number of buckets. A processor keeps the newest known facts of the
forums of a bucket as one list and one timer at the earliest of their next refresh times. When the timer
expires, the forums that fell due are emitted once, with the reason and priority the batch queue gives
them; new facts replace old ones. So a batch reads and writes the list of a bucket once, not a state per
forum. States and timers live in the checkpoint, so a restarted query goes on where it stopped, and
forums that fell due in the meantime come out at once.

The clock is the wall clock (such a query never runs out of batches: run it continuously or once at a time), or the event time of the rows, which only moves when rows arrive: replays
and tests use it, with rows of no forum as ticks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy import schema as S
from colloquy.operators.refresh import refresh_reason
from colloquy.streaming.refresh import use_rocksdb

CLOCKS = {"wall": "ProcessingTime", "event": "EventTime"}
FACTS = "at_ms bigint, due_ms bigint, reason string, emitted boolean"
BUCKETS = 4096


class DueProcessor(StatefulProcessor):
    """One list of facts and at most one timer per bucket of forums."""

    def __init__(self, clock: str, key_type: str):
        self._event, self._schema = clock == "event", f"forum_id {key_type}, {FACTS}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._facts = handle.getListState("facts", self._schema)

    def _now(self, timer_values) -> int:
        return timer_values.getCurrentWatermarkInMs() if self._event else timer_values.getCurrentProcessingTimeInMs()

    def _emit(self, forum_id, due_ms: int, reason: str) -> Row:
        return Row(forum_id=forum_id, due_at=due_ms / 1000.0, reason=reason, priority=0 if reason == "missing_decision" else 1)

    def _known(self) -> dict:
        return {f[0]: tuple(f[1:]) for f in self._facts.get()} if self._facts.exists() else {}

    @staticmethod
    def _earliest(known: dict) -> int | None:
        return min((due for _, due, _, emitted in known.values() if not emitted), default=None)

    def _keep(self, known: dict) -> None:
        if known:
            self._facts.put([(forum_id, *facts) for forum_id, facts in known.items()])
        else:
            self._facts.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: dict = {}
        for r in rows:  # only the newest one of a forum is kept
            if r.forum_id is not None and (r.forum_id not in newest or r.at_ms > newest[r.forum_id][0]):
                newest[r.forum_id] = (r.at_ms, r.next_refresh_at, r.reason)
        if not newest:
            return
        known, clock = self._known(), self._now(timerValues)
        before, held = self._earliest(known), bool(known)
        for forum_id, (at, next_refresh_at, reason) in newest.items():
            if forum_id in known and known[forum_id][0] > at:
                continue
            if reason is None:
                known.pop(forum_id, None)
                continue
            due = at if next_refresh_at is None else math.ceil(next_refresh_at * 1000)
            now = due <= clock or next_refresh_at is None
            known[forum_id] = (at, due, reason, now)
            if now:
                yield self._emit(forum_id, due, reason)
        if known or held:
            self._keep(known)
        after = self._earliest(known)
        if after != before:
            if before is not None:
                self._handle.deleteTimer(before)
            if after is not None:
                self._handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, expired, clock = self._known(), expiredTimerInfo.getExpiryTimeInMs(), self._now(timerValues)
        if self._earliest(known) != expired:
            return
        for forum_id, (at, due, reason, emitted) in known.items():
            if not emitted and (due <= expired or due < clock):
                known[forum_id] = (at, due, reason, True)
                yield self._emit(forum_id, due, reason)
        self._keep(known)
        after = self._earliest(known)
        if after is not None:
            self._handle.registerTimer(after)

    def close(self) -> None:
        pass


def with_tick(forums: DataFrame, now: float) -> DataFrame:
    """Rows and one of no forum, whose event time moves the clock to ``now`` (epoch seconds)."""
    blank = [F.timestamp_millis(F.lit(math.ceil(now * 1000) + 1)).alias(c) if c == "at"  # timers expire before the clock
             else F.lit(None).cast(forums.schema[c].dataType).alias(c) for c in forums.columns]
    return forums.unionByName(forums.sparkSession.range(1).select(*blank))


def due_forums(forums: DataFrame, cycles=None, clock: str = "wall", key: str = "forum_id", buckets: int = BUCKETS) -> DataFrame:
    """Stream of (forum_id, due_at, reason, priority) from a stream of forum facts.

    Facts have the columns of the batch queue (decision, venue, status, next_refresh_at) and ``at``, the
    timestamp of their arrival; the newest facts of a forum count. Terminal forums and forums without a
    reason never fall due; forums without a next refresh time are due on arrival. ``buckets`` must stay the same for the life of a checkpoint."""
    if clock not in CLOCKS:
        raise ValueError(f"unknown clock: {clock!r}")
    use_rocksdb(forums.sparkSession)
    terminal = F.coalesce(F.col("status").isin(*S.TERMINAL_STATUSES), F.lit(False))
    facts = forums.select(
        F.col(key).alias("forum_id"), "at", F.unix_millis("at").alias("at_ms"), "next_refresh_at",
        F.when(F.col(key).isNotNull() & ~terminal, refresh_reason(cycles=cycles)).alias("reason"))
    if clock == "event":
        facts = facts.withWatermark("at", "0 seconds")
    key_type = forums.schema[key].dataType.simpleString()
    return facts.withColumn("bucket", F.pmod(F.xxhash64("forum_id"), F.lit(buckets))).groupBy("bucket").transformWithState(
        statefulProcessor=DueProcessor(clock, key_type),
        outputStructType=f"forum_id {key_type}, due_at double, reason string, priority int",
        outputMode="Append", timeMode=CLOCKS[clock])
