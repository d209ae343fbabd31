"""Refresh transitions, queue, and the stream against its batch twin."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from colloquy.operators import refresh as R
from colloquy.operators.ingest import latest_version
from colloquy.streaming import acquisition as AQ
from colloquy.streaming import refresh as SR

NOW, DAY = 1_800_000_000.0, 86400.0
LOG = ("forum_id string, ts double, seq bigint, ok boolean, changed boolean, decision string, "
       "active boolean, fetched_at double")


def result(fid="f", ts=NOW, seq=0, ok=True, changed=False, decision="unknown", active=False, age=30):
    return (fid, ts, seq, ok, changed, decision, active, NOW - age * DAY)


def states(spark, rows, **kw):
    return {r.forum_id: r for r in R.replay(spark.createDataFrame(rows, LOG), **kw).collect()}


@pytest.mark.parametrize("kw,status", [
    ({"decision": "accept", "changed": True}, "finalized"), ({"active": True, "changed": True}, "active"),
    ({"decision": "accept", "active": True}, "active"), ({"decision": "withdrawn"}, "withdrawn"),
    ({"decision": "desk_reject", "active": True}, "desk_rejected"), ({"age": 400}, "refresh_expired"),
    ({"age": 400, "active": True}, "active"), ({}, "unresolved"), ({"ok": False}, "unseen"),
])
def test_single_transition(spark, kw, status):
    r = states(spark, [result(**kw)])["f"]
    assert r.status == status
    terminal = status in ("finalized", "withdrawn", "desk_rejected", "refresh_expired")
    assert (r.terminal_reason == status) == terminal and (r.next_refresh_at is None) == terminal


def test_failures_until_unavailable(spark):
    five = [result(ts=NOW + i, seq=i, ok=False) for i in range(5)]
    r = states(spark, five)["f"]
    assert (r.status, r.refresh_attempts, r.next_refresh_at) == ("unseen", 5, NOW + 4 + 24 * 32 * 3600)
    r = states(spark, [*five, result(ts=NOW + 9, ok=False), result(ts=NOW + 99, changed=True)])["f"]
    assert (r.status, r.refresh_attempts, r.last_checked_at) == ("unavailable", 6, NOW + 9)


def test_change_resets_and_backoff_is_capped(spark):
    rows = [result(ts=NOW + i * DAY, seq=i, active=True) for i in range(9)]
    r = states(spark, rows)["f"]
    assert (r.refresh_attempts, r.next_refresh_at) == (9, NOW + 8 * DAY + 24 * 64 * 3600)
    r = states(spark, [*rows, result(ts=NOW + 20 * DAY, active=True, changed=True)])["f"]
    assert (r.refresh_attempts, r.next_refresh_at) == (0, NOW + 20 * DAY + DAY)


def random_log(seed, forums=25, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        fid = "hot" if rng.random() < 0.34 else f"f{rng.randint(1, forums)}"
        decision = rng.choices(["unknown", "accept", "withdrawn"], [0.985, 0.01, 0.005])[0]
        rows.append(result(fid, NOW + rng.randint(0, 200) * DAY / 2, i, rng.random() > 0.3, rng.random() < 0.3,
                           decision, fid != "f1", 10))
    return rows


def folded(rows):
    """The transition function applied row by row."""
    names = [c.split(" ")[0] for c in LOG.split(", ")]
    out = {}
    for r in sorted((Row(**dict(zip(names, row, strict=True))) for row in rows), key=lambda r: (r.ts, r.seq)):
        out[r.forum_id] = SR.advance(out.get(r.forum_id, ("unseen", None, 0, None)), r)
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 86400), (2, 5 * 86400), (3, 10**9), (4, 3 * 86400)])
def test_replay_equals_folding(spark, seed, chunk):
    rows = random_log(seed)
    got = states(spark, rows, chunk_seconds=chunk)
    want = folded(rows)
    assert set(got) == set(want)
    for fid, (status, last, attempts, due) in want.items():
        r = got[fid]
        assert (r.status, r.last_checked_at, r.refresh_attempts, r.next_refresh_at) == (status, last, attempts, due)


def test_replay_from_a_start_state(spark):
    df = spark.createDataFrame([result(ok=False)], LOG).withColumns({
        "start_attempts": F.lit(5), "start_status": F.lit("active")})
    r = R.replay(df).first()
    assert (r.status, r.refresh_attempts) == ("unavailable", 6)
    df = spark.createDataFrame([result(ok=False)], LOG).withColumns({
        "start_attempts": F.lit(2), "start_status": F.lit("active")})
    r = R.replay(df).first()
    assert (r.status, r.refresh_attempts) == ("active", 3)


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = sorted(random_log(7, forums=8, n=300), key=lambda r: (r[1], r[2]))
    names = [c.split(" ")[0] for c in LOG.split(", ")]
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()

    def land(name, part):
        (src / name).write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in part))

    def run():
        schema = spark.createDataFrame([], LOG).schema
        stream = SR.refresh_states(AQ.read_landed(spark, str(src), schema, max_files=1))
        q = (stream.writeStream.outputMode("update").option("checkpointLocation", str(cp))
             .trigger(availableNow=True).foreachBatch(AQ.append_versions(str(out))).start())
        q.awaitTermination()

    land("a.json", rows[:100])
    run()
    land("b.json", rows[100:])  # a second query run goes on from the checkpoint
    run()
    got = latest_version(spark.read.parquet(str(out)), "last_checked_at", "batch_id")
    got = {r.forum_id: (r.status, r.last_checked_at, r.refresh_attempts, r.next_refresh_at) for r in got.collect()}
    assert got == folded(rows)


def test_replayed_batches_equal_folding(spark, tmp_path):
    rows = sorted(random_log(11, forums=8, n=400), key=lambda r: (r[1], r[2]))
    write = SR.replay_batches(str(tmp_path / "s"), chunk_seconds=3 * 86400)
    # Batches of whole time steps; the second one is retried, the last one comes late.
    cut = next(i for i in range(200, 400) if rows[i][1] != rows[i - 1][1])
    write(spark.createDataFrame(rows[:cut], LOG), 0)
    for _ in range(2):
        write(spark.createDataFrame(rows[cut:], LOG), 1)
    write(spark.createDataFrame(rows[:20], LOG).where(F.col("ts") < rows[cut][1]), 2)
    got = {r.forum_id: (r.status, r.last_checked_at, r.refresh_attempts, r.next_refresh_at)
           for r in SR.current_states(spark, str(tmp_path / "s")).collect()}
    assert got == folded(rows)


def test_acquisition_skips_seen_forums_over_a_restart(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    schema = spark.createDataFrame([], "forum_id string, v int").schema

    def run(name, rows):
        (src / name).write_text("\n".join(json.dumps({"forum_id": f, "v": v}) for f, v in rows))
        q = (AQ.first_seen(AQ.read_landed(spark, str(src), schema)).writeStream
             .option("checkpointLocation", str(cp)).trigger(availableNow=True)
             .foreachBatch(AQ.append_versions(str(out))).start())
        q.awaitTermination()

    run("a.json", [("x", 1), ("y", 1)])
    run("b.json", [("x", 2), ("z", 2)])
    got = {(r.forum_id, r.v) for r in spark.read.parquet(str(out)).collect()}
    assert got == {("x", 1), ("y", 1), ("z", 2)}
    AQ.compact(spark, str(out), str(tmp_path / "c"), "v")
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3


def test_queue(spark):
    rows = [("a", "iclr", 2024, "", "unseen", None), ("b", "iclr", 2026, "accept", "active", NOW - 1),
            ("c", "iclr", 2023, "accept", "finalized", None), ("d", "iclr", 2024, "unknown", "unresolved", NOW + DAY),
            ("e", "iclr", 2024, "accept", "active", None), ("f", "iclr", None, "unknown", None, NOW)]
    df = spark.createDataFrame(rows, "forum_id string, venue_family string, venue_year int, decision string, "
                                     "status string, next_refresh_at double")
    got = [(r.forum_id, r.reason) for r in R.refresh_queue(df, NOW, 10).collect()]
    assert got == [("a", "missing_decision"), ("f", "missing_decision"), ("b", "active_cycle")]
    assert [r.forum_id for r in R.refresh_queue(df, NOW, 1).collect()] == ["a"]
    assert R.refresh_candidates(df, NOW, policy="none").count() == 0
    with pytest.raises(ValueError):
        R.refresh_candidates(df, NOW, policy="x")


def test_next_unseen(spark):
    df = spark.createDataFrame([("v", f"f{i}", 10 - i) for i in range(5)], "venue string, forum_id string, tcdate int")
    assert {r.forum_id for r in AQ.next_unseen(df, 2, ["venue"]).collect()} == {"f4", "f3"}
    one = {r.forum_id for r in AQ.next_unseen(df, 2, ["venue"], seed=1).collect()}
    assert one == {r.forum_id for r in AQ.next_unseen(df.repartition(3), 2, ["venue"], seed=1).collect()}
