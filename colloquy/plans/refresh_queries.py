"""Queries K3, T1-T3, C6: acquisition and refresh."""

from pyspark.sql import functions as F

from colloquy.operators import refresh as R
from colloquy.operators.ingest import latest_version
from colloquy.functions.rows import with_row
from colloquy.plans.ingest_queries import _set_digest_sql
from colloquy.plans.registry import cte, query
from colloquy.sources import driver_tables as D
from colloquy.sources.corpus import scratch_dir
from colloquy.operators.ingest import Corpus
from colloquy.streaming import acquisition as AQ
from colloquy.streaming import corpus_refresh as CR
from colloquy.streaming import refresh as SR
from colloquy.streaming import schedule as SD

# Reset runs, counters and the first terminal row, one window at a time.
cte("refresh_row", """
  SELECT *, row_number() OVER w AS rn,
    CASE WHEN NOT ok THEN NULL WHEN decision = 'withdrawn' THEN 'withdrawn'
      WHEN decision = 'accept' AND NOT active THEN 'finalized'
      WHEN (ts - coalesce(nullif(fetched_at, 0), ts)) / 86400.0 > 180 AND NOT active THEN 'refresh_expired' END AS ended
  FROM refresh_log WINDOW w AS (PARTITION BY forum_id ORDER BY ts, seq)
""")
cte("refresh_run", """
  SELECT *, sum(CASE WHEN ok AND changed AND ended IS NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY forum_id ORDER BY rn) AS grp FROM refresh_row
""")
cte("refresh_count", """
  SELECT *, sum(CASE WHEN ok AND changed AND ended IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY forum_id, grp ORDER BY rn) AS attempts FROM refresh_run
""")
cte("refresh_stop", """
  SELECT *, coalesce(ended, CASE WHEN NOT ok AND attempts >= 6 THEN 'unavailable' END) AS stop FROM refresh_count
""")
cte("refresh_last", """
  SELECT *, arg_max(active, rn) FILTER (ok) OVER (PARTITION BY forum_id) AS last_open,
    coalesce(min(rn) FILTER (stop IS NOT NULL) OVER (PARTITION BY forum_id), max(rn) OVER (PARTITION BY forum_id)) AS final_rn
  FROM refresh_stop
""")
cte("refresh_state", """
  SELECT forum_id, CASE WHEN stop IS NOT NULL THEN stop WHEN last_open IS NULL THEN 'unseen'
      WHEN last_open THEN 'active' ELSE 'unresolved' END AS status,
    stop AS terminal_reason, ts AS last_checked_at,
    CAST(CASE WHEN stop IS NOT NULL AND ok THEN attempts - 1 ELSE attempts END AS INTEGER) AS refresh_attempts,
    CASE WHEN stop IS NULL THEN ts + 24.0 * pow(2, least(attempts, 6)) * 3600.0 END AS next_refresh_at
  FROM refresh_last WHERE rn = final_rn
""")


@query("T2_refresh_states_from_log", "SELECT * FROM refresh_state")
def t2(spark, path):
    # Short chunks, so that counters really cross chunk borders.
    return R.replay(D.refresh_results(spark, path), chunk_seconds=2 * 86400)


def _run(stream, writer, checkpoint, mode="append"):
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(writer).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("T2_refresh_states_streaming", "SELECT * FROM refresh_state")
def t2_stream(spark, path):
    out = scratch_dir(spark)
    results = D.as_refresh_results(D.stream(spark, path, "events"))
    _run(SR.refresh_states(results), AQ.append_versions(f"{out}/states"), f"{out}/checkpoint", "update")
    versions = spark.read.parquet(f"{out}/states")
    return latest_version(versions, "last_checked_at", "batch_id").drop("batch_id")


@query("T2_refresh_states_from_micro_batches", "SELECT * FROM refresh_state")
def t2_batches(spark, path):
    out = scratch_dir(spark)
    results = D.as_refresh_results(D.stream(spark, path, "events"))
    _run(results, SR.replay_batches(f"{out}/states"), f"{out}/checkpoint")
    return SR.current_states(spark, f"{out}/states")


@query("T2_refresh_states_from_folded_batches", "SELECT * FROM refresh_state")
def t2_folded(spark, path):
    """Seven batches in time order, the fourth one twice, over buckets that fold after three deltas."""
    out = scratch_dir(spark)
    write = SR.replay_batches(f"{out}/states", buckets=4, fold=3)
    results = D.refresh_results(spark, path)
    first, last = results.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor((F.col("ts") - first) / (last - first) * 7), F.lit(6))
    for batch_id in (0, 1, 2, 3, 3, 4, 5, 6):
        write(results.where(part == batch_id), batch_id)
    return SR.current_states(spark, f"{out}/states")


@query("T1_acquire_first_seen_forums", """
  SELECT DISTINCT user_id AS forum_id FROM events""")
def t1(spark, path):
    out = scratch_dir(spark)
    landed = D.stream(spark, path, "events").select(F.col("user_id").alias("forum_id"), "ts")
    _run(AQ.first_seen(landed), AQ.append_versions(f"{out}/forums"), f"{out}/checkpoint")
    AQ.compact(spark, f"{out}/forums", f"{out}/compact", "ts")
    return spark.read.parquet(f"{out}/compact").select("forum_id")


cte("queue_forum", """
  SELECT forum_id, venue_family, venue_year, decision, s.status, s.next_refresh_at,
    CASE WHEN decision = 'unknown' THEN 'missing_decision'
      WHEN (venue_family = '1-URGENT' AND venue_year = 2001) OR (venue_family = '2-HIGH' AND venue_year = 2000)
      THEN 'active_cycle' END AS reason
  FROM forum LEFT JOIN refresh_state s USING (forum_id)
  WHERE coalesce(s.status NOT IN ('finalized', 'withdrawn', 'desk_rejected', 'unavailable', 'refresh_expired'), TRUE)
    AND (s.next_refresh_at IS NULL OR s.next_refresh_at <= 1707000000.0)
""")
NOW = 1707000000.0
CYCLES = [("1-URGENT", 2001), ("2-HIGH", 2000)]


def _queue_input(spark, path):
    states = R.replay(D.refresh_results(spark, path)).select("forum_id", "status", "next_refresh_at")
    return D.order_forums(spark, path, False).select(
        "forum_id", "venue_family", "venue_year", "decision").join(states, "forum_id", "left")


@query("T3_refresh_candidates", """
  SELECT forum_id, reason, CASE reason WHEN 'missing_decision' THEN 0 ELSE 1 END AS priority
  FROM queue_forum WHERE reason IS NOT NULL""")
def t3(spark, path):
    return R.refresh_candidates(_queue_input(spark, path), NOW, CYCLES).select(
        "forum_id", "reason", "priority")


@query("T3_due_forums_streaming", """
  SELECT forum_id, reason, CASE reason WHEN 'missing_decision' THEN 0 ELSE 1 END AS priority
  FROM queue_forum WHERE reason IS NOT NULL""")
def t3_stream(spark, path):
    """Forums wait for their timers until the clock, an event time here, reaches NOW."""
    out = scratch_dir(spark)
    known = _queue_input(spark, path).withColumn("at", F.timestamp_seconds(F.lit(NOW - 1)))
    SD.with_tick(known, NOW).write.parquet(f"{out}/known")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/known").schema).parquet(f"{out}/known")
    _run(SD.due_forums(stream, CYCLES, clock="event"), AQ.append_versions(f"{out}/due"), f"{out}/checkpoint", "append")
    return spark.read.parquet(f"{out}/due").select("forum_id", "reason", "priority")


@query("K3_refresh_queue", """
  SELECT forum_id, reason FROM queue_forum WHERE reason IS NOT NULL
  ORDER BY CASE reason WHEN 'missing_decision' THEN 0 ELSE 1 END, forum_id LIMIT 100""")
def k3(spark, path):
    return R.refresh_queue(_queue_input(spark, path), NOW, 100, CYCLES).select("forum_id", "reason")


@query("K3_refresh_queue_per_venue", """
  SELECT forum_id, reason FROM (
    SELECT *, row_number() OVER (PARTITION BY venue_family, venue_year
      ORDER BY CASE reason WHEN 'missing_decision' THEN 0 ELSE 1 END, forum_id) AS rn
    FROM queue_forum WHERE reason IS NOT NULL) WHERE rn <= 10""")
def k3b(spark, path):
    return R.refresh_queue_per_venue(_queue_input(spark, path), NOW, 10, CYCLES).select(
        "forum_id", "reason")


@query("C6_refreshed_corpus_versions", """
  SELECT forum_id, decision, status, next_refresh_at FROM (
    SELECT forum_id, decision, coalesce(s.status, 'unseen') AS status, s.next_refresh_at
    FROM forum LEFT JOIN refresh_state s USING (forum_id))""")
def c6(spark, path):
    from colloquy.operators.ingest import upsert

    base = D.order_forums(spark, path, False).select(
        "forum_id", "decision", F.lit("unseen").alias("status"),
        F.lit(None).cast("double").alias("next_refresh_at"), F.col("fetched_at").alias("version"))
    states = R.replay(D.refresh_results(spark, path))
    touched = base.drop("status", "next_refresh_at", "version").join(states.select(
        "forum_id", "status", "next_refresh_at", F.col("last_checked_at").alias("version")), "forum_id")
    return upsert(base, touched, "version").drop("version")


cte("kept_review", """
  SELECT *, least(280, 30 * length(note)) AS shown FROM line
  WHERE l_returnflag <> 'N' AND (l_orderkey % 7 <> 0 OR l_linenumber <= 2)
""")


@query("C6_refresh_pipeline", f"""
  SELECT record_count, review_count, corpus_hash, shown, open_states, ended_states FROM
    (SELECT count(*) AS record_count FROM orders), (SELECT count(*) AS review_count, CAST(sum(shown) AS BIGINT) AS shown FROM kept_review),
    ({_set_digest_sql("m", """(SELECT CAST(forum_id AS VARCHAR) || chr(0) AS m FROM forum
      UNION ALL SELECT CAST(l_orderkey AS VARCHAR) || chr(0) || note FROM kept_review)""", "corpus_hash")}),
    (SELECT count(*) FILTER (terminal_reason IS NULL) AS open_states, count(terminal_reason) AS ended_states FROM refresh_state)""")
def c6_pipeline(spark, path):
    """Two thirds of the forums, then the others with new versions of some (fewer reviews), twice; then
    older versions without reviews, which are ignored. States come from three parts of the log."""
    corpus = CR.RefreshedCorpus(spark, f"{scratch_dir(spark)}/corpus", buckets=4, fold=2)
    c = D.orders_corpus(spark, path, False)
    texts = c.review.withColumns({"text": F.repeat("note_id", 30), "line": F.split("note_id", "-")[1].cast("int")})
    said, k = c.response.withColumn("text", F.repeat("note_id", 30)), F.col("forum_id")
    results = D.refresh_results(spark, path)
    first, last = results.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor((F.col("ts") - first) / (last - first) * 3), F.lit(2))

    def batch(n, chosen, newer, reviews):
        corpus.apply(n, Corpus(c.forum.where(chosen).withColumn("fetched_at", F.col("fetched_at") + newer),
                               reviews.where(chosen).drop("line"), said.where(chosen)), results.where(part == n))

    batch(0, k % 3 != 0, 0.0, texts)
    for _ in range(2):
        batch(1, (k % 3 == 0) | (k % 7 == 0), 60.0, texts.where((k % 7 != 0) | (F.col("line") <= 2)))
    batch(2, k % 11 == 0, -60.0, texts.limit(0))
    public, states = corpus.corpus(public=True), corpus.states()
    shown = public.review.agg(F.sum(F.length("text.excerpt")).alias("shown"))
    counts = states.agg(F.count_if(F.col("terminal_reason").isNull()).alias("open_states"), F.count("terminal_reason").alias("ended_states"))
    return with_row(with_row(corpus.manifest(), shown), counts)
