"""The refresh state machine on a stream of results, keyed by forum.

Two forms with the same states. ``refresh_states`` keeps one small state per forum in
the state store; a task orders the results of a forum within a trigger. ``replay_batches``
keeps states in a table of snapshots and deltas (`streaming.state_table`) and replays each
micro-batch with `operators.refresh.replay`, which also splits a forum that holds a large
part of a batch.

Addition to the batch semantics: a result older than the last one applied is ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from colloquy import schema as S
from colloquy.operators.refresh import replay
from colloquy.streaming.state_table import BUCKETS, FOLD, StateTable

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = {"withdrawn": "withdrawn", "desk_reject": "desk_rejected"}


def use_rocksdb(spark: SparkSession) -> None:
    """The state operator needs the RocksDB store; states do not have to fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def advance(state: tuple, result: Row, *, max_attempts: int = S.REFRESH_MAX_ATTEMPTS,
            base_hours: float = S.REFRESH_BASE_HOURS,
            expiry_days: float = S.REFRESH_EXPIRY_DAYS) -> tuple:
    """State after one result. A state is (status, last_checked_at, attempts, next)."""
    status, last, attempts, _ = state
    if status in S.TERMINAL_STATUSES or (last is not None and result.ts < last):
        return state
    if not result.ok:
        attempts += 1
        if attempts >= max_attempts:
            return "unavailable", result.ts, attempts, None
    else:
        ended = OUTCOMES.get(result.decision)
        if ended is None and not result.active:
            if result.decision in S.RESOLVED_DECISIONS:
                ended = "finalized"
            elif (result.ts - (result.fetched_at or result.ts)) / 86400.0 > expiry_days:  # no time: age 0
                ended = "refresh_expired"
        if ended is not None:
            return ended, result.ts, attempts, None
        attempts = 0 if result.changed else attempts + 1
        status = "active" if result.active else "unresolved"
    wait = base_hours * 2.0 ** min(attempts, S.REFRESH_BACKOFF_CAP) * 3600.0
    return status, result.ts, attempts, result.ts + wait


class RefreshProcessor(StatefulProcessor):
    """One value state per forum. Results of a trigger are applied in time order; the
    trigger size (``maxFilesPerTrigger``) bounds how many a task has to order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState(
            "refresh", "status string, last_checked_at double, attempts int, next double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._state.get() if self._state.exists() else ("unseen", None, 0, None)
        state = tuple(state)
        for result in sorted(rows, key=lambda r: (r.ts, r.seq)):
            state = advance(state, result)
        self._state.update(state)
        status, last, attempts, due = state
        terminal = status if status in S.TERMINAL_STATUSES else None
        yield Row(forum_id=key[0], status=status, terminal_reason=terminal,
                  last_checked_at=last, refresh_attempts=attempts, next_refresh_at=due)

    def close(self) -> None:
        pass


def output_schema(results: DataFrame) -> StructType:
    return StructType([results.schema["forum_id"], *S.REFRESH.fields[:2], *S.REFRESH.fields[2:]])


def refresh_states(results: DataFrame) -> DataFrame:
    """Stream of updated refresh states from a stream of results."""
    use_rocksdb(results.sparkSession)
    return results.groupBy("forum_id").transformWithState(
        statefulProcessor=RefreshProcessor(), outputStructType=output_schema(results),
        outputMode="Update", timeMode="None")


def current_states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Latest state of every forum in a state table."""
    states = StateTable(spark, path).states(before)
    if states is None:
        raise ValueError(f"{path}: no batch was committed")
    return states


def replay_batches(path: str, *, buckets: int = BUCKETS, fold: int = FOLD, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that applies a batch of results to the states under
    ``path``, a `StateTable`. A batch reads the touched buckets as earlier batches left
    them, so a retry gives the same outcome and a batch costs the same at any age."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table = StateTable(batch.sparkSession, path, "forum_id", buckets, fold)
        rows, commit = batch.withColumn("_bucket", table.bucket()), table.latest(batch_id)
        touched = [r._bucket for r in rows.select("_bucket").distinct().collect()]  # at most the number of buckets
        states = table.read(commit, touched)
        if states is not None:
            start = states.select(
                "forum_id", F.col("status").alias("start_status"),
                F.col("refresh_attempts").alias("start_attempts"),
                F.col("last_checked_at").alias("_last"))
            rows = rows.join(start, "forum_id", "left").where(
                ~F.coalesce(F.col("start_status").isin(*S.TERMINAL_STATUSES), F.lit(False))
                & (F.col("_last").isNull() | (F.col("ts") >= F.col("_last")))
            ).withColumns({
                "start_status": F.coalesce("start_status", F.lit("unseen")),
                "start_attempts": F.coalesce("start_attempts", F.lit(0))}).drop("_last")
        table.commit(batch_id, replay(rows.drop("_bucket"), **options))

    return write
