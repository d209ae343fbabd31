"""Queries A1-A14, A27-A30, W1-W3: statistics of the orders corpus."""

from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.operators import claims as C
from colloquy.operators import order_stats as O
from colloquy.operators import statistics as ST
from colloquy.plans.registry import cte, query
from colloquy.sources import driver_tables as D

DIGITS = 10
TIDY = "metric, venue_family, venue_year, sample_size, missing_count, path, value"


def _tidy(metric: str, body: str) -> str:
    return (f"SELECT '{metric}' AS metric, venue_family, venue_year, "
            "CAST(sample_size AS BIGINT) AS sample_size, CAST(missing_count AS BIGINT) AS missing_count, "
            f"path, CAST(value AS DOUBLE) AS value FROM ({body})")


def _counts_sql() -> str:
    base = """(SELECT s.*, coalesce(p.n_reviews, 0) AS nr, coalesce(q.n, 0) AS nq FROM scoped2 s
      LEFT JOIN per_forum p USING (forum_id)
      LEFT JOIN (SELECT forum_id, count(*) AS n FROM response GROUP BY 1) q USING (forum_id))"""
    rate = lambda test: f"sum(CASE WHEN {test} THEN 1 ELSE 0 END)"
    cells = [
        ("forum_count", "0", "count(*)"),
        ("review_count", rate("nr = 0"), "sum(nr)"),
        ("response_count", rate("nq = 0"), "sum(nq)"),
    ] + [
        (f"missing_rate.{n}", rate(t), f"round({rate(t)} / count(*), {DIGITS})")
        for n, t in (("paper_title", "title IS NULL OR title = ''"),
                     ("paper_abstract", "abstract IS NULL OR abstract = ''"),
                     ("decision", "decision = 'unknown'"))
    ]
    return " UNION ALL ".join(
        _tidy(m, f"SELECT venue_family, venue_year, count(*) AS sample_size, {miss} AS missing_count, "
                 f"'' AS path, {val} AS value FROM {base} GROUP BY 1, 2")
        for m, miss, val in cells)


def _review_rates_sql() -> str:
    return " UNION ALL ".join(
        _tidy(f"missing_rate.{n}", f"""
          SELECT venue_family, venue_year, count(note_id) AS sample_size,
            count(note_id) - count({c}) AS missing_count, '' AS path,
            CASE WHEN count(note_id) > 0
              THEN round((count(note_id) - count({c})) / count(note_id), {DIGITS}) END AS value
          FROM scope LEFT JOIN review2 USING (venue_family, venue_year) GROUP BY 1, 2""")
        for n, c in (("review_rating", "initial_value"), ("review_confidence", "confidence_value")))


def _sizes(col: str) -> str:
    return f"""(SELECT venue_family, venue_year, count({col}) AS sample_size,
      count(note_id) - count({col}) AS missing_count
      FROM scope LEFT JOIN review2 USING (venue_family, venue_year) GROUP BY 1, 2)"""


def _raw_sql(metric: str, col: str) -> str:
    return _tidy(metric, f"""
      SELECT z.*, printf('%.1f', {col}) AS path, n AS value FROM {_sizes(col)} z
      LEFT JOIN (SELECT venue_family, venue_year, {col}, count(*) AS n FROM review2
        WHERE {col} IS NOT NULL GROUP BY 1, 2, 3) USING (venue_family, venue_year)""")


def _deciles_sql(metric: str, col: str) -> str:
    return _tidy(metric, f"""
      SELECT z.*, printf('%.1f-%.1f', b / 10.0, (b + 1) / 10.0) AS path, n AS value FROM {_sizes(col)} z
      LEFT JOIN (
        SELECT venue_family, venue_year, b, sum(CASE WHEN slot = b THEN 1 ELSE 0 END) AS n FROM (
          SELECT venue_family, venue_year, least(9, CAST(floor(10 * CASE WHEN hi = lo THEN 0.5
            ELSE (v - lo) / (hi - lo) END) AS INTEGER)) AS slot
          FROM (SELECT venue_family, venue_year, {col} AS v,
              min({col}) OVER (PARTITION BY venue_family, venue_year) AS lo,
              max({col}) OVER (PARTITION BY venue_family, venue_year) AS hi
            FROM review2 WHERE {col} IS NOT NULL)
        ) CROSS JOIN (SELECT unnest(range(10)) AS b) GROUP BY 1, 2, 3
      ) USING (venue_family, venue_year)""")


def _decisions_sql() -> str:
    return _tidy("decision_distribution", """
      SELECT venue_family, venue_year, sum(n) OVER (PARTITION BY venue_family, venue_year) AS sample_size,
        sum(CASE WHEN decision = 'unknown' THEN n ELSE 0 END)
          OVER (PARTITION BY venue_family, venue_year) AS missing_count,
        decision AS path, n AS value
      FROM (SELECT venue_family, venue_year, decision, count(*) AS n FROM scoped2 GROUP BY 1, 2, 3)""")


def _crosstab_sql() -> str:
    return _tidy("rating_decision_crosstab", f"""
      SELECT z.*, path, value FROM {_sizes('initial_value')} z LEFT JOIN (
        SELECT venue_family, venue_year, decision || '.' || CASE WHEN initial_value < lo THEN 'low'
            WHEN initial_value > hi THEN 'high' ELSE 'medium' END AS path, count(*) AS value
        FROM review2 JOIN (
          SELECT venue_family, venue_year, vs[len(vs) // 3 + 1] AS lo, vs[2 * len(vs) // 3 + 1] AS hi
          FROM (SELECT venue_family, venue_year, list_sort(list(initial_value)) AS vs
            FROM review2 WHERE initial_value IS NOT NULL GROUP BY 1, 2)
        ) USING (venue_family, venue_year)
        WHERE initial_value IS NOT NULL GROUP BY 1, 2, 3
      ) USING (venue_family, venue_year)""")


def _unpivot(cells: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT venue_family, venue_year, sample_size, missing_count, '{p}' AS path, "
        f"CAST({e} AS DOUBLE) AS value FROM ({source})" for p, e in cells.items())


def _summary_cells() -> dict[str, str]:
    return {"count": "n", "mean": f"round(mean, {DIGITS})", "stdev": f"round(sd, {DIGITS})",
            "median": f"round(med, {DIGITS})", "min": "lo", "max": "hi"}


def _agg(col: str) -> str:
    return (f"count({col}) AS n, avg({col}) AS mean, stddev_pop({col}) AS sd, median({col}) AS med, "
            f"min({col}) AS lo, max({col}) AS hi")


def _measure_sql(metric: str, col: str) -> str:
    source = f"""SELECT venue_family, venue_year, count({col}) AS sample_size,
      count(*) - count({col}) AS missing_count, {_agg(col)} FROM measure GROUP BY 1, 2"""
    cells = _summary_cells()
    if metric == "reviewer_disagreement":
        source = source.replace(" FROM measure", """,
          count(*) FILTER (range_v = 0) AS h0, count(*) FILTER (range_v > 0 AND range_v <= 2) AS h1,
          count(*) FILTER (range_v > 2 AND range_v <= 4) AS h3,
          count(*) FILTER (range_v > 4) AS h5 FROM measure""")
        cells |= {"histogram.0": "h0", "histogram.1-2": "h1", "histogram.3-4": "h3",
                  "histogram.5+": "h5"}
    return _tidy(metric, _unpivot(cells, source))


def _change_sql(metric: str, test: str) -> str:
    source = f"""SELECT venue_family, venue_year, count(note_id) AS sample_size,
      count(note_id) - count(delta) AS missing_count, {_agg('delta')}
      FROM scope LEFT JOIN (SELECT * FROM review2 WHERE {test}) USING (venue_family, venue_year)
      GROUP BY 1, 2"""
    return _tidy(metric, _unpivot(_summary_cells(), source))


CHANGES = dict(zip(ST.CHANGE_METRICS, ("TRUE", "has_response", "NOT has_response"), strict=True))
MEASURES = dict(zip(ST.FORUM_MEASURES, ("mean_v", "var_v", "range_v"), strict=True))
PARTS = {
    "counts": _counts_sql(),
    "review_rates": _review_rates_sql(),
    "rating_raw": _raw_sql("rating_distribution_raw", "initial_value"),
    "rating_norm": _deciles_sql("rating_distribution_normalized", "initial_value"),
    "confidence_raw": _raw_sql("confidence_distribution_raw", "confidence_value"),
    "confidence_norm": _deciles_sql("confidence_distribution_normalized", "confidence_value"),
    "decisions": _decisions_sql(),
    "crosstab": _crosstab_sql(),
    **{m: _measure_sql(m, c) for m, c in MEASURES.items()},
    **{m: _change_sql(m, t) for m, t in CHANGES.items()},
}
ALL_SQL = (f"SELECT {TIDY}, metric LIKE 'rebuttal_%' AS observational FROM ("
           + " UNION ALL ".join(PARTS.values()) + ")")
cte("stat", ALL_SQL)


def _compute(spark, path, metrics):
    """Statistics of the orders corpus. Customers are only joined for titles."""
    paper = any(m.startswith("missing_rate.paper") for m in metrics)
    c = D.orders_corpus(spark, path, paper)
    return ST.compute(c.forum, c.review, c.response, metrics, DIGITS)


def _metric(name, metrics, sql):
    @query(name, f"SELECT *, metric LIKE 'rebuttal_%' AS observational FROM ({sql})")
    def run(spark, path):
        return _compute(spark, path, metrics)
    return run


@query("A1_group_by_scope", """
  SELECT venue_family, coalesce(venue_year, 'all') AS venue_year, count(*) AS forums
  FROM scoped GROUP BY GROUPING SETS ((venue_family, venue_year), (venue_family))""")
def a1(spark, path):
    forums = ST.scoped_forums(D.order_forums(spark, path, False))
    return ST.with_all_years(forums).groupBy(*ST.SCOPE).agg(F.count(F.lit(1)).alias("forums"))


FORUM_RATES = ("missing_rate.paper_title", "missing_rate.paper_abstract", "missing_rate.decision")
_metric("A2_counts_and_A3_forum_missing_rates", (*ST.COUNT_METRICS, *FORUM_RATES), PARTS["counts"])
_metric("A3_review_missing_rates",
        ("missing_rate.review_rating", "missing_rate.review_confidence"), PARTS["review_rates"])
_metric("A4_rating_distribution_raw", ("rating_distribution_raw",), PARTS["rating_raw"])
_metric("A4_confidence_distribution_raw", ("confidence_distribution_raw",),
        PARTS["confidence_raw"])
_metric("A5_rating_distribution_normalized", ("rating_distribution_normalized",),
        PARTS["rating_norm"])
_metric("A5_confidence_distribution_normalized", ("confidence_distribution_normalized",),
        PARTS["confidence_norm"])
_metric("A6_decision_distribution", ("decision_distribution",), PARTS["decisions"])
_metric("A7_rating_decision_crosstab", ("rating_decision_crosstab",), PARTS["crosstab"])
_metric("A8_paper_mean_rating", ("paper_mean_rating",), PARTS["paper_mean_rating"])
_metric("A9_paper_rating_variance", ("paper_rating_variance",), PARTS["paper_rating_variance"])
_metric("A10_reviewer_disagreement", ("reviewer_disagreement",), PARTS["reviewer_disagreement"])
_metric("A12_initial_to_final_rating_change", ST.CHANGE_METRICS[:1], PARTS[ST.CHANGE_METRICS[0]])
_metric("A13_rebuttal_rating_change", ST.CHANGE_METRICS[1:],
        " UNION ALL ".join(PARTS[m] for m in ST.CHANGE_METRICS[1:]))


def _values(spark, path, value):
    """Histogram of one review value per scope."""
    c = D.orders_corpus(spark, path, False)
    counts = c.review.groupBy("forum_id", value).agg(F.count(F.lit(1)).alias("n"))
    rows = ST.with_all_years(counts.join(ST.scoped_forums(c.forum), "forum_id"))
    return O.histogram(rows, ST.SCOPE, value, F.col("n"))


@query("A11_distribution_summary_of_confidence", f"""
  SELECT venue_family, venue_year, n AS "count", round(mean, {DIGITS}) AS mean,
    round(sd, {DIGITS}) AS stdev, round(med, {DIGITS}) AS median, lo AS "min", hi AS "max"
  FROM (SELECT venue_family, venue_year, {_agg('confidence_value')} FROM review2
    WHERE confidence_value IS NOT NULL GROUP BY 1, 2)""")
def a11(spark, path):
    out = O.summaries(_values(spark, path, "confidence_value"), ST.SCOPE, "confidence_value")
    return out.withColumns({m: F.bround(m, DIGITS) for m in ("mean", "stdev", "median")})


def all_statistics(spark, path):
    return _compute(spark, path, tuple(ST.METRICS))


query("A14_compute_all_statistics", "SELECT * FROM stat")(all_statistics)


@query("C5_corpus_statistics_with_provenance", f"""
  SELECT {TIDY}, observational, '2026-01-01T00:00:00Z' AS generated_at, 1 AS schema_version,
    CASE WHEN observational THEN '{S.REBUTTAL_NOTE}' END AS note, (SELECT corpus_hash FROM corpus_digest) AS corpus_hash FROM stat""")
def c5(spark, path):
    from colloquy.functions.digests import corpus_digest

    digest = corpus_digest(D.order_forums(spark, path, False), D.order_reviews(spark, path)).first().corpus_hash
    return ST.with_provenance(all_statistics(spark, path), digest, "2026-01-01T00:00:00Z")


@query("S8_statistics_table_round_trip", f"SELECT {TIDY}, observational FROM stat")
def s8(spark, path):
    from colloquy.sources.corpus import scratch_dir, write_table

    out = scratch_dir(spark)
    write_table(all_statistics(spark, path), out, {"schema_version": F.lit(1)})
    return spark.read.parquet(f"{out}/rows")


# --- order statistics -------------------------------------------------------------------


@query("W1_average_rank", """
  SELECT DISTINCT initial_value AS value, (rank() OVER (ORDER BY initial_value)
    + (count(*) OVER (PARTITION BY initial_value) - 1) / 2) AS avg_rank
  FROM review WHERE initial_value IS NOT NULL""")
def w1(spark, path):
    hist = O.histogram(D.order_reviews(spark, path), [], "initial_value")
    return O.average_rank(hist, [], "initial_value").select(
        F.col("initial_value").alias("value"), F.col("rank").alias("avg_rank"))


@query("W2_tercile_cuts", """
  SELECT venue_family, venue_year, vs[len(vs) // 3 + 1] AS low_cut, vs[2 * len(vs) // 3 + 1] AS high_cut
  FROM (SELECT venue_family, venue_year, list_sort(list(initial_value)) AS vs
    FROM review2 WHERE initial_value IS NOT NULL GROUP BY 1, 2)""")
def w2(spark, path):
    return O.tercile_cuts(_values(spark, path, "initial_value"), ST.SCOPE, "initial_value")


@query("W3_median_of_forum_ranges", """
  SELECT median(rng) AS median FROM per_forum WHERE n_rated >= 2""")
def w3(spark, path):
    from colloquy.operators.evidence import median_range

    return median_range(D.order_reviews(spark, path))


# --- summaries over statistics ----------------------------------------------------------

META_SQL = """
  SELECT venue_family, string_agg(DISTINCT venue_year, ',' ORDER BY venue_year)
      FILTER (venue_year <> 'all') AS years_covered,
    CAST(count(DISTINCT venue_year) FILTER (venue_year <> 'all') AS INTEGER) AS n_years,
    CAST(max(value) FILTER (venue_year = 'all' AND metric = 'forum_count') AS BIGINT) AS forum_count,
    CAST(max(value) FILTER (venue_year = 'all' AND metric = 'review_count') AS BIGINT) AS review_count,
    CAST(sum(value) FILTER (venue_year = 'all' AND metric = 'decision_distribution'
      AND path <> 'unknown') AS BIGINT) AS decisions_resolved,
    max(value) FILTER (venue_year = 'all' AND metric = 'forum_count') < 50
      OR count(DISTINCT venue_year) FILTER (venue_year <> 'all') < 2 AS preliminary
  FROM stat GROUP BY venue_family"""
cte("family_meta", META_SQL)


def _small_stats(spark, path):
    return _compute(spark, path, (*ST.COUNT_METRICS, "decision_distribution"))


@query("A27_family_calibration_metadata", "SELECT * FROM family_meta")
def a27(spark, path):
    return C.calibration_metadata(_small_stats(spark, path))


@query("A28_years_by_family", """
  SELECT DISTINCT venue_family, venue_year FROM stat WHERE venue_year <> 'all'
  UNION SELECT venue_family, CAST(venue_year AS VARCHAR) FROM dforum""")
def a28(spark, path):
    return C.years_by_family(_small_stats(spark, path), D.document_forums(spark, path))


@query("A30_corpus_scope_summary", "SELECT venue_family, forum_count, years_covered FROM family_meta")
def a30(spark, path):
    return C.scope_summary(_small_stats(spark, path))
