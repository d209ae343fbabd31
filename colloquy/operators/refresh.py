"""Refresh schedule of a growing corpus: candidate queue and state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import labels as L

STATE = ("status", "terminal_reason", "last_checked_at", "refresh_attempts", "next_refresh_at")


# --- queue ------------------------------------------------------------------------------


def refresh_reason(decision="decision", family="venue_family", year="venue_year",
                   cycles=None) -> Column:
    return F.when(L.is_undecided(decision), "missing_decision").when(
        L.is_active_cycle(family, year, cycles), "active_cycle")


def refresh_candidates(forums: DataFrame, now: Column | float, cycles=None,
                       policy: str = "active") -> DataFrame:
    """Forums due for a refresh with reason and priority. Terminal forums and forums
    that are still cooling down are not due."""
    if policy not in ("none", "active"):
        raise ValueError(f"unknown refresh policy: {policy!r}")
    now = now if isinstance(now, Column) else F.lit(float(now))
    due = (
        ~F.coalesce(F.col("status").isin(*S.TERMINAL_STATUSES), F.lit(False))
        & (F.col("next_refresh_at").isNull() | (F.col("next_refresh_at") <= now))
        & F.lit(policy == "active")
    )
    return (
        forums.where(due).withColumn("reason", refresh_reason(cycles=cycles))
        .where(F.col("reason").isNotNull())
        .withColumn("priority", F.when(F.col("reason") == "missing_decision", 0).otherwise(1))
    )


def refresh_queue(forums: DataFrame, now: Column | float, limit: int, cycles=None) -> DataFrame:
    """The first ``limit`` candidates over all venues."""
    return refresh_candidates(forums, now, cycles).orderBy("priority", "forum_id").limit(limit)


def refresh_queue_per_venue(forums: DataFrame, now: Column | float, limit: int,
                            cycles=None) -> DataFrame:
    """The first ``limit`` candidates of every venue."""
    from colloquy.operators.order_stats import top_k

    return top_k(refresh_candidates(forums, now, cycles), ["venue_family", "venue_year"],
                 [F.col("priority"), F.col("forum_id")], limit)


# --- state machine ----------------------------------------------------------------------
#
# A refresh result has: forum_id, ts (epoch seconds), seq (unique tie-break), ok, changed,
# decision, active, fetched_at (first fetch). Transitions:
#   failed           attempts + 1; unavailable at the maximum, else backoff
#   withdrawn, desk_reject, decided outside an active cycle, or too old: terminal
#   otherwise        attempts = 0 if changed else + 1; active or unresolved; backoff
# Terminal states absorb: no candidate is ever selected from them again.


def terminal_status(max_age_days: float = S.REFRESH_EXPIRY_DAYS) -> Column:
    """Terminal status a successful result leads to, NULL when it stays open."""
    d, active = F.col("decision"), F.col("active")
    return (
        F.when(~F.col("ok"), F.lit(None))
        .when(d == "withdrawn", "withdrawn")
        .when(d == "desk_reject", "desk_rejected")
        .when(L.is_resolved(d) & ~active, "finalized")
        .when((L.age_days("fetched_at", F.col("ts")) > max_age_days) & ~active, "refresh_expired")
    )


def replay(results: DataFrame, *, chunk_seconds: int = 30 * 86400,
           max_attempts: int = S.REFRESH_MAX_ATTEMPTS, base_hours: float = S.REFRESH_BASE_HOURS,
           expiry_days: float = S.REFRESH_EXPIRY_DAYS) -> DataFrame:
    """Final refresh state per forum from a log of results, without iterating.

    Between two resets (a successful change) the attempt counter counts rows, so it is
    a running count that can start anywhere: the log is cut into time chunks, chunk
    totals are carried over, and only the rows of one (forum, chunk) are ordered in one
    task. The state is that of the first terminal row, or of the last row. Columns that
    name the start state (``start_*``) are optional and constant per forum."""
    key, order = ["forum_id"], ["ts", "seq"]
    start_attempts = (F.col("start_attempts") if "start_attempts" in results.columns
                      else F.lit(0))
    start_status = (F.col("start_status") if "start_status" in results.columns
                    else F.lit("unseen"))
    rows = results.withColumns({
        "_chunk": F.floor(F.col("ts") / chunk_seconds),
        "_end": terminal_status(expiry_days),
        "_start": start_attempts, "_from": start_status,
    }).withColumn("_reset", F.col("ok") & F.col("changed") & F.col("_end").isNull())

    chunk = [*key, "_chunk"]
    # By chunk, not by forum: an input that arrives partitioned by forum would otherwise
    # keep all chunks of a busy forum in one task.
    rows = rows.repartition(*chunk)
    in_chunk = W.partitionBy(*chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_resets", F.sum(F.col("_reset").cast("int")).over(in_chunk))
    run = W.partitionBy(*chunk, "_resets").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = local.withColumn("_steps", F.sum((~F.col("_reset")).cast("int")).over(run))

    # Steps after the last reset of a chunk, and whether it has a reset at all.
    tails = local.groupBy(*chunk).agg(
        F.max(F.struct(*order, "_resets", "_steps")).alias("_last"))
    carry = W.partitionBy(*key).orderBy("_chunk")
    tails = tails.select(
        *chunk, (F.col("_last._resets") > 0).alias("_cut"), F.col("_last._steps").alias("_tail"))
    era = tails.withColumn("_era", F.sum(F.col("_cut").cast("int")).over(
        carry.rowsBetween(W.unboundedPreceding, 0)))
    in_era = W.partitionBy(*key, "_era").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    era = era.withColumn("_sofar", F.sum("_tail").over(in_era))
    before = era.select(
        *chunk,
        F.coalesce(F.lag("_sofar").over(carry), F.lit(0)).alias("_carry"),
        (F.coalesce(F.lag("_era").over(carry), F.lit(0)) == 0).alias("_first_era"))
    counted = (
        local.join(before, chunk)
        .withColumn("attempts", F.col("_steps") + F.when(
            F.col("_resets") == 0,
            F.col("_carry") + F.when(F.col("_first_era"), F.col("_start")).otherwise(0)
        ).otherwise(0))
        .withColumn("_stop", F.coalesce("_end", F.when(
            ~F.col("ok") & (F.col("attempts") >= max_attempts), F.lit("unavailable"))))
    )
    # A terminal row does not count as an attempt unless the fetch failed.
    at = F.struct(*order)
    fact = F.struct("ts", "ok", "attempts", "active", "_stop", "_from", "_start")
    final = counted.groupBy(*key).agg(
        F.min_by(F.when(F.col("_stop").isNotNull(), fact), F.when(F.col("_stop").isNotNull(), at))
        .alias("_t"),
        F.max_by(fact, at).alias("_l"),
        # last successful open row, for the status that failures leave untouched
        F.max_by(F.when(F.col("ok"), F.col("active")), F.when(F.col("ok"), at)).alias("_open"),
        F.max(F.col("_from")).alias("_from"),
    )
    pick = F.coalesce("_t", "_l")
    ended = F.col("_t").isNotNull()
    attempts = F.when(ended & F.col("_t.ok"), F.col("_t.attempts") - 1).otherwise(pick["attempts"])
    return final.select(
        *key,
        F.when(ended, F.col("_t._stop"))
        .when(F.col("_open").isNull(), F.col("_from"))
        .when(F.col("_open"), "active").otherwise("unresolved").alias("status"),
        F.when(ended, F.col("_t._stop")).alias("terminal_reason"),
        pick["ts"].alias("last_checked_at"),
        attempts.cast("int").alias("refresh_attempts"),
        F.when(~ended, pick["ts"] + L.backoff_hours(attempts, base_hours) * 3600.0)
        .alias("next_refresh_at"),
    )
