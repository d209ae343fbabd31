"""The state table under cuts, failures and retries; the stream of due forums against the batch queue."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import refresh as R
from colloquy.streaming import acquisition as AQ
from colloquy.streaming import refresh as SR
from colloquy.streaming import schedule as SD
from colloquy.streaming.state_table import Commit, StateTable
from tests.test_refresh import LOG, folded, random_log

NOW = 1_800_000_000.0


def rows_of(df):
    return {r.forum_id: (r.status, r.last_checked_at, r.refresh_attempts, r.next_refresh_at) for r in df.collect()}


@pytest.mark.parametrize("seed", [3, 4])
def test_states_equal_folding_after_cuts_failures_and_retries(spark, tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    rows = sorted(random_log(seed, forums=12, n=300), key=lambda r: (r[1], r[2]))
    borders = [i for i in range(1, len(rows)) if rows[i][1] != rows[i - 1][1]]
    cuts = [0, *sorted(rng.sample(borders, 6)), len(rows)]
    write = SR.replay_batches(str(tmp_path / "s"), buckets=3, fold=2, chunk_seconds=5 * 86400)
    real = StateTable._write_commit

    def fail(self, commit):
        raise OSError("lost")

    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(rows[a:b], LOG)
        if n % 3 == 1:  # all files are written, then the driver is lost
            monkeypatch.setattr(StateTable, "_write_commit", fail)
            with pytest.raises(OSError):
                write(batch, n)
            monkeypatch.setattr(StateTable, "_write_commit", real)
            assert StateTable(spark, str(tmp_path / "s")).batches() == list(range(n))
        for _ in range(1 + (n % 3 == 2)):
            write(batch, n)
        if n == 4:
            StateTable(spark, str(tmp_path / "s")).vacuum()
    assert rows_of(SR.current_states(spark, str(tmp_path / "s"))) == folded(rows)


def test_a_batch_reads_touched_buckets_at_a_bounded_depth(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k", buckets=8, fold=3)
    want = {}
    for n in range(11):
        keys = range(40) if n < 2 else range(3)  # later batches touch a few buckets only
        want |= {k: n for k in keys}
        commit = table.commit(n, spark.createDataFrame([(k, n) for k in keys], "k int, v int"))
        assert all(len(d) < 3 for d in commit.deltas.values())
        assert Commit.from_json(commit.to_json()) == commit and table.latest() == commit
    assert {r.k: r.v for r in table.states().collect()} == want
    assert {r.k: r.v for r in table.states(before=1).collect()} == {k: 0 for k in range(40)}
    touched = [r.b for r in spark.range(3).select(table.bucket(F.col("id").cast("int")).alias("b")).distinct().collect()]
    files = table.read(table.latest(), touched).inputFiles()
    assert files and all(any(f"bucket={b}/" in f for b in touched) for f in files) and len(files) <= 3 * len(touched)
    table.vacuum(keep=1)
    assert table.batches() == [10] and {r.k: r.v for r in table.states().collect()} == want
    kept = {p.name for p in (tmp_path / "t" / "delta").iterdir()}
    assert len(kept) <= 4


def test_empty_and_missing_state_tables(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k", 2)
    assert table.states() is None and table.batches() == [] and table.vacuum() == []
    table.commit(0, spark.createDataFrame([], "k int, v int"))
    assert table.states() is None and table.batches() == [0]
    with pytest.raises(ValueError):
        SR.current_states(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        StateTable(spark, "x", fold=1)


def test_missing_and_zero_fetch_times_are_age_zero(spark):
    rows = [("none", NOW, 0, True, False, "unknown", False, None), ("zero", NOW, 0, True, False, "unknown", False, 0.0),
            ("old", NOW, 0, True, False, "unknown", False, NOW - 400 * 86400)]
    got = {r.forum_id: r.status for r in R.replay(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {"none": "unresolved", "zero": "unresolved", "old": "refresh_expired"}
    assert got == {k: v[0] for k, v in folded(rows).items()}


FACTS = "forum_id string, venue_family string, venue_year int, decision string, status string, next_refresh_at double, at timestamp"
CYCLES = [("iclr", 2026)]


def facts(spark, seed, ids, at):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["iclr", "x"]), rng.choice([2025, 2026, None]), rng.choice(["", "unknown", "accept", None]),
             rng.choice(["active", "unseen", None, "finalized", "unresolved"]),
             rng.choice([None, at + rng.randint(-50, 400), at + 100.0, at + 300.0]), at) for i in ids]
    return spark.createDataFrame([r[:-1] for r in rows], FACTS.rsplit(",", 1)[0]).withColumn("at", F.timestamp_seconds(F.lit(at)))


def test_due_forums_equal_the_batch_queue_at_chosen_times(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    first = facts(spark, 1, [f"f{i}" for i in range(120)], NOW)
    second = facts(spark, 2, [f"f{i}" for i in range(60, 150)], NOW + 150)

    def run(landed, now):
        """One run of the same query over one more file; it stops and starts from its checkpoint."""
        SD.with_tick(landed, now).coalesce(1).write.mode("append").parquet(src)
        stream = SD.due_forums(spark.readStream.schema(landed.schema).parquet(src), CYCLES, clock="event")
        q = (stream.writeStream.outputMode("append").option("checkpointLocation", cp).trigger(availableNow=True)
             .foreachBatch(AQ.append_versions(out)).start())
        q.awaitTermination()
        return [(r.forum_id, r.reason, r.priority) for r in spark.read.parquet(out).collect()]

    def queue(known, now):
        return {(r.forum_id, r.reason, r.priority) for r in R.refresh_candidates(known, now, CYCLES).collect()}

    at_100 = run(first, NOW + 100)
    assert len(at_100) == len(set(at_100)) and set(at_100) == queue(first, NOW + 100) and len(at_100) > 20
    at_140 = run(first.limit(0), NOW + 140)
    assert len(at_140) == len(set(at_140)) and set(at_140) == queue(first, NOW + 140)
    at_460 = Counter(run(second, NOW + 460)) - Counter(at_140)
    newest = first.join(second.select("forum_id"), "forum_id", "left_anti").unionByName(second)
    told = {f for f, _, _ in at_140} - {r.forum_id for r in second.collect()}
    assert max(at_460.values()) == 1 and set(at_460) == {q for q in queue(newest, NOW + 460) if q[0] not in told} and len(at_460) > 20


def test_due_forums_share_the_state_of_a_bucket(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    known, told = facts(spark, 7, [f"f{i}" for i in range(200)], NOW), []
    for landed, now in ((known, NOW + 50), (known.limit(0), NOW + 120), (known.limit(0), NOW + 400)):
        SD.with_tick(landed, now).coalesce(1).write.mode("append").parquet(src)
        stream = SD.due_forums(spark.readStream.schema(known.schema).parquet(src), CYCLES, clock="event", buckets=2)
        q = (stream.writeStream.outputMode("append").option("checkpointLocation", cp).trigger(availableNow=True)
             .foreachBatch(AQ.append_versions(out)).start())
        q.awaitTermination()
        told = [r.forum_id for r in spark.read.parquet(out).collect()]
        assert len(told) == len(set(told)) and set(told) == {r.forum_id for r in R.refresh_candidates(known, now, CYCLES).collect()}
    assert len(told) > 20


def test_due_forums_on_the_wall_clock(spark, tmp_path):
    known = facts(spark, 5, [f"f{i}" for i in range(40)], 1000.0)
    known.write.parquet(str(tmp_path / "in"))
    stream = SD.due_forums(spark.readStream.schema(known.schema).parquet(str(tmp_path / "in")), CYCLES)
    q = (stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True)
         .foreachBatch(AQ.append_versions(str(tmp_path / "out"))).start())
    assert q.awaitTermination(60)  # on the wall clock a query has a next batch for ever
    got = {r.forum_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.forum_id for r in R.refresh_candidates(known, 1e10, CYCLES).collect()}
    with pytest.raises(ValueError):
        SD.due_forums(known, clock="x")


def test_refreshed_corpus_equals_full_recomputation(spark, tmp_path, monkeypatch):
    from colloquy.sources import corpus as SC
    from colloquy.streaming.corpus_refresh import RefreshedCorpus
    from tests.conftest import TWELVE, make_corpus

    def fetched(forums, at):
        c = make_corpus(spark, forums)
        c.forum = c.forum.withColumn("fetched_at", F.lit(at))
        return c

    log = [(f, NOW, 0, True, False, "unknown", True, NOW) for f in ("f01", "f02")]
    results, none = spark.createDataFrame(log, LOG), spark.createDataFrame([], LOG)
    corpus = RefreshedCorpus(spark, str(tmp_path / "c"), buckets=2, fold=2)
    with pytest.raises(ValueError):
        corpus.manifest()
    corpus.apply(0, fetched(TWELVE[:8], 1.0), results)
    newer = [(f, v, y, "accept", [5.0], 3) for f, v, y, *_ in TWELVE[6:10]]
    real = StateTable._write_commit

    def fail(self, commit):
        if "pointers" in self.path:
            raise OSError("lost")
        real(self, commit)

    monkeypatch.setattr(StateTable, "_write_commit", fail)
    with pytest.raises(OSError):
        corpus.apply(1, fetched(newer, 2.0), none)
    monkeypatch.setattr(StateTable, "_write_commit", real)
    assert {r.forum_id for r in corpus.table("forum").collect()} == {f[0] for f in TWELVE[:8]}  # the lost batch does not show
    corpus.apply(1, fetched(newer, 2.0), none)
    corpus.apply(2, fetched([(f, v, y, "reject", [1.0] * 5, 0) for f, v, y, *_ in TWELVE[5:7]], 1.5), none)
    want = make_corpus(spark, [*TWELVE[:5], ("f06", "iclr", 2024, "reject", [1.0] * 5, 0), *newer])
    now = corpus.corpus()
    for got, full in ((now.forum.drop("fetched_at"), want.forum), (now.review, want.review), (now.response, want.response)):
        assert sorted(map(str, got.select(full.columns).collect())) == sorted(map(str, full.collect()))
    full = SC.manifest(now.forum, now.review).select("record_count", "review_count", "corpus_hash").first()
    assert corpus.manifest().first() == full and full.record_count == 10
    assert corpus.corpus(public=True).review.select("text.excerpt", "text.hash").count() == full.review_count
    assert {r.forum_id for r in corpus.states().collect()} == {"f01", "f02"}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k", buckets=1)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        table.commit(0, spark.range(200_000).repartition(8).select(F.col("id").alias("k"), F.xxhash64("id").alias("v")))
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "t/delta/batch_id=0/bucket=0").glob("*.parquet"))) > 1
    assert table.states().where(F.col("v") == F.xxhash64("k")).count() == 200_000


def test_tables_of_a_batch_are_written_together(spark, tmp_path, monkeypatch):
    from threading import Barrier

    from colloquy.streaming.corpus_refresh import RefreshedCorpus
    from tests.conftest import TWELVE, make_corpus

    fetched, meet, real = make_corpus(spark, TWELVE[:2]), Barrier(3, timeout=60), RefreshedCorpus._store
    fetched.forum = fetched.forum.withColumn("fetched_at", F.lit(1.0))

    def store(self, df, name, batch_id):
        if name in ("forum", "review", "response"):
            meet.wait()
        return real(self, df, name, batch_id)

    monkeypatch.setattr(RefreshedCorpus, "_store", store)
    corpus = RefreshedCorpus(spark, str(tmp_path / "c"), buckets=2, fold=2)
    corpus.apply(0, fetched, spark.createDataFrame([], LOG))
    assert corpus.table("forum").count() == 2
