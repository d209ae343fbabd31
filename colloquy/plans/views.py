"""Oracle-side definitions of the model tables (see ``sources.driver_tables``)."""

from colloquy.plans.registry import cte

cte("forum", """
  SELECT o_orderkey AS forum_id, 'https://openreview.net/forum?id=' || o_orderkey AS url,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS venue_family,
    CASE WHEN o_totalprice >= 20000 THEN CAST(year(o_orderdate) AS INTEGER) END AS venue_year,
    CASE o_orderstatus WHEN 'F' THEN 'Accept (poster)'
      WHEN 'O' THEN CASE WHEN o_totalprice > 400000 THEN 'Desk reject' ELSE 'Reject' END
      ELSE CASE WHEN o_totalprice > 400000 THEN 'Withdrawn by the authors' ELSE '' END END AS decision_raw,
    CASE o_orderstatus WHEN 'F' THEN 'accept'
      WHEN 'O' THEN CASE WHEN o_totalprice > 400000 THEN 'desk_reject' ELSE 'reject' END
      ELSE CASE WHEN o_totalprice > 400000 THEN 'withdrawn' ELSE 'unknown' END END AS decision,
    CAST(epoch(o_orderdate) AS DOUBLE) AS fetched_at, o_custkey AS cust, o_totalprice AS price,
    CASE WHEN c_acctbal >= 0 THEN c_name ELSE '' END AS title,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS abstract,
    c_mktsegment AS segment, c_acctbal AS balance
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
cte("line", """
  SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS note,
    CAST(floor(l_quantity % 10) AS INTEGER) + 1 AS base FROM lineitem
""")
cte("review", """
  SELECT l_orderkey AS forum_id, note AS note_id,
    CASE WHEN l_tax < 0.075 THEN CAST(base AS DOUBLE) END AS initial_value,
    CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R'
      THEN CAST(least(10, base + l_partkey % 3) AS DOUBLE) END AS final_value,
    CASE WHEN l_discount < 0.095 THEN CAST(l_linenumber AS DOUBLE) END AS confidence_value
  FROM line WHERE l_returnflag <> 'N'
""")
cte("response", "SELECT l_orderkey AS forum_id, note AS note_id FROM line WHERE l_returnflag = 'N'")
cte("calibration", "SELECT forum_id FROM forum WHERE segment = 'BUILDING'")
cte("prediction", """
  SELECT forum_id, 'generic' AS system, CAST(cust % 10 + 1 AS DOUBLE) AS rating_prediction,
    CASE WHEN (cust % 101) / 100.0 >= 0.5 THEN 'accept' ELSE 'reject' END AS decision_prediction,
    CASE WHEN price >= 20000 THEN CAST(cust % 101 AS DOUBLE) / 100.0 END AS accept_probability
  FROM forum WHERE balance >= 0
  UNION ALL
  SELECT forum_id, 'calibrated',
    CASE WHEN price >= 20000 THEN CAST((cust * 7) % 10 + 1 AS DOUBLE) END,
    CASE WHEN decision = 'accept' OR (cust % 101) / 100.0 >= 0.3 THEN 'accept' ELSE 'reject' END,
    CASE WHEN decision = 'accept' THEN (CAST(cust % 101 AS DOUBLE) / 100.0 + 1) / 2
      ELSE CAST(cust % 101 AS DOUBLE) / 100.0 / 2 END
  FROM forum WHERE balance >= 0
""")
cte("scoped", """
  SELECT forum_id, CASE WHEN venue_family = '' THEN 'unknown' ELSE venue_family END AS venue_family,
    coalesce(CAST(venue_year AS VARCHAR), 'unspecified') AS venue_year, decision, title, abstract
  FROM forum
""")
cte("scoped2", """
  SELECT * FROM scoped
  UNION ALL SELECT forum_id, venue_family, 'all', decision, title, abstract FROM scoped
""")
cte("scope", "SELECT DISTINCT venue_family, venue_year FROM scoped2")
cte("answered", "SELECT DISTINCT forum_id FROM response")
cte("review2", """
  SELECT s.venue_family, s.venue_year, s.decision, r.*,
    a.forum_id IS NOT NULL AS has_response, r.final_value - r.initial_value AS delta
  FROM scoped2 s JOIN review r USING (forum_id) LEFT JOIN answered a USING (forum_id)
""")
cte("per_forum", """
  SELECT forum_id, count(*) AS n_reviews, count(initial_value) AS n_rated,
    sum(initial_value) AS sum_v, max(initial_value) - min(initial_value) AS rng,
    count(initial_value) * sum(initial_value * initial_value)
      - sum(initial_value) * sum(initial_value) AS moment
  FROM review GROUP BY forum_id
""")
cte("measure", """
  SELECT s.venue_family, s.venue_year, s.forum_id,
    CASE WHEN n_rated > 0 THEN sum_v / n_rated END AS mean_v,
    CASE WHEN n_rated >= 2 THEN moment / (n_rated * n_rated) END AS var_v,
    CASE WHEN n_rated >= 2 THEN rng END AS range_v
  FROM scoped2 s LEFT JOIN per_forum USING (forum_id)
""")
cte("doc", """
  SELECT d.*, l.quality, l.toxic, d.source || '/' || d.lang AS forum_id
  FROM documents d LEFT JOIN labels l USING (doc_id)
""")
cte("dreview", """
  SELECT forum_id, 'd' || doc_id AS note_id,
    CASE WHEN n_chars >= 200 THEN CAST(n_chars % 10 + 1 AS DOUBLE) END AS initial_value,
    CASE WHEN quality = 1 THEN CAST(least(10, n_chars % 10 + 2) AS DOUBLE) END AS final_value,
    CAST(n_chars % 5 + 1 AS DOUBLE) AS confidence_value,
    CASE WHEN quality = 0 THEN '' ELSE text END AS text,
    CASE WHEN quality = 0 THEN lang ELSE '' END AS strengths,
    CASE WHEN quality = 0 THEN text ELSE '' END AS weaknesses,
    split_part(text, chr(10), 1) AS questions, source AS summary
  FROM doc WHERE coalesce(toxic, 0) = 0
""")
cte("dhash", """
  SELECT *, substr(sha256(text || chr(0) || strengths || chr(0) || weaknesses || chr(0)
      || questions || chr(0)), 1, 16) AS content_hash,
    CASE WHEN text <> '' THEN text
      WHEN trim(strengths || ' ' || weaknesses, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> ''
        THEN trim(strengths || ' ' || weaknesses, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))
      ELSE summary END AS source_text
  FROM dreview
""")
cte("dresponse", "SELECT forum_id, 'd' || doc_id AS note_id, text FROM doc WHERE toxic = 1")
cte("dforum", """
  SELECT forum_id, 'https://openreview.net/forum?id=' || forum_id AS url, lang AS venue_family,
    CAST(CAST(substr(source, 4) AS INTEGER) % 4 + 2020 AS INTEGER) AS venue_year, source AS title,
    arg_max(text, (n_chars, doc_id)) AS abstract,
    CASE WHEN count(*) FILTER (quality = 1) > 3 * count(*) FILTER (quality = 0) THEN 'Accept (oral)'
      WHEN count(*) FILTER (quality = 0) > 0 THEN 'Reject' ELSE '' END AS decision_raw,
    CASE WHEN count(*) FILTER (quality = 1) > 3 * count(*) FILTER (quality = 0) THEN 'accept'
      WHEN count(*) FILTER (quality = 0) > 0 THEN 'reject' ELSE 'unknown' END AS decision
  FROM doc GROUP BY forum_id, source, lang
""")
cte("turn_note", """
  SELECT *, CAST(conv_id AS VARCHAR) AS forum, conv_id || '-' || turn AS id,
    CAST(length(text) AS BIGINT) AS k FROM conversations
""")
cte("refresh_log", """
  SELECT user_id AS forum_id, epoch_us(ts) / 1000000.0 AS ts, event_id AS seq,
    event_type <> 'error' AS ok, event_type = 'purchase' AS changed,
    CASE WHEN event_type = 'signup' AND value > 60
      THEN CASE WHEN value > 90 THEN 'withdrawn' ELSE 'accept' END ELSE 'unknown' END AS decision,
    user_id % 3 = 0 AS active,
    CASE user_id % 50 WHEN 7 THEN 0.0 WHEN 8 THEN NULL ELSE 1696118400.0 END AS fetched_at
  FROM events
""")
