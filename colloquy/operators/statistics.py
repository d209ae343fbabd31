"""Descriptive statistics per scope: (family, year) and (family, all years).

Results are tidy rows, one per metric and path: path '' for a plain number, ``mean``
for a summary, ``6.0`` for a histogram bar, ``accept.low`` for a cross-tab cell. A
histogram without any value keeps one row with path NULL.

All twenty metrics are read off one *measure histogram*: counts per (scope, measure,
label, value). It has one shuffle of its own and is as small as the number of distinct
values. Reviews reach it in two steps: they are first combined to counts per (forum,
rating values), which shrinks a forum that holds a large part of all reviews to its
few rating combinations, and only these are joined to their forum.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import labels as L
from colloquy.operators import order_stats as O

SCOPE = ["venue_family", "venue_year"]
KEYS = [*SCOPE, "measure"]
DECILES = tuple(f"{i / 10:.1f}-{(i + 1) / 10:.1f}" for i in range(10))
RANGE_BINS = ("0", "1-2", "3-4", "5+")
CHANGE_METRICS = (
    "initial_to_final_rating_change",
    "rebuttal_present_rating_change",
    "rebuttal_absent_rating_change",
)
FORUM_MEASURES = ("paper_mean_rating", "paper_rating_variance", "reviewer_disagreement")
COUNT_METRICS = ("forum_count", "review_count", "response_count")

# metric -> (measure, way of reading it)
METRICS: dict[str, tuple[str, str]] = {
    "forum_count": ("forum", "rows"),
    "review_count": ("reviews_per_forum", "sum"),
    "response_count": ("responses_per_forum", "sum"),
    "missing_rate.paper_title": ("paper_title", "rate"),
    "missing_rate.paper_abstract": ("paper_abstract", "rate"),
    "missing_rate.decision": ("decision", "rate"),
    "missing_rate.review_rating": ("rating", "rate"),
    "missing_rate.review_confidence": ("confidence", "rate"),
    "rating_distribution_raw": ("rating", "bars"),
    "rating_distribution_normalized": ("rating", "deciles"),
    "confidence_distribution_raw": ("confidence", "bars"),
    "confidence_distribution_normalized": ("confidence", "deciles"),
    "decision_distribution": ("decision", "labels"),
    "rating_decision_crosstab": ("rating_by_decision", "crosstab"),
    **{m: (m, "summary") for m in FORUM_MEASURES},
    **{m: (m, "change") for m in CHANGE_METRICS},
}
REVIEW_MEASURES = ("rating", "rating_by_decision", "confidence", *CHANGE_METRICS)


# --- forum and review roll-ups ----------------------------------------------------------


def scoped_forums(forum: DataFrame, *extra: Column) -> DataFrame:
    """Forum keys with their scope labels."""
    return forum.select(
        "forum_id",
        L.family_label().alias("venue_family"),
        L.year_label().alias("venue_year"),
        L.decision_label().alias("decision"),
        *extra,
    )


def with_all_years(df: DataFrame) -> DataFrame:
    """Every row once under its year and once under 'all', ahead of an aggregation."""
    return df.withColumn(
        "venue_year", F.explode(F.array(F.col("venue_year"), F.lit(S.YEAR_ALL))))


RATING_VALUES = ("initial_value", "final_value", "confidence_value")


def rating_counts(review: DataFrame, values: Iterable[str] = RATING_VALUES) -> DataFrame:
    """Counts per forum and distinct combination of rating values."""
    return review.groupBy("forum_id", *values).agg(F.count(F.lit(1)).alias("n"))


def response_counts(response: DataFrame) -> DataFrame:
    return response.groupBy("forum_id").agg(F.count(F.lit(1)).alias("n_responses"))


def forum_ratings(counts: DataFrame) -> DataFrame:
    """Per-forum roll-up of initial ratings from rows that stand for ``n`` reviews."""
    v, n = F.col("initial_value"), F.col("n")
    rated = F.when(v.isNotNull(), n).otherwise(0)
    return (
        counts.groupBy("forum_id")
        .agg(
            F.sum("n").alias("n_reviews"),
            F.sum(rated).alias("n_rated"),
            F.sum(v * n).alias("sum_v"),
            F.sum(v * v * n).alias("sum_vv"),
            F.min("initial_value").alias("min_v"),
            F.max("initial_value").alias("max_v"),
        )
    )


# A forum's mean, population variance and range of initial ratings; the last two need
# at least two ratings.
RATING_MEASURES = {
    "paper_mean_rating": "sum_v / nullif(n_rated, 0)",
    "paper_rating_variance":
        "if(n_rated >= 2, if(min_v = max_v, 0D, greatest(0D, (n_rated * sum_vv - sum_v * sum_v)"
        " / (n_rated * n_rated))), NULL)",
    "reviewer_disagreement": "if(n_rated >= 2, max_v - min_v, NULL)",
}


# --- the measure histogram --------------------------------------------------------------


def _unfold(df: DataFrame, rows: list[tuple[str, str, str, str]], keep: str = "TRUE") -> DataFrame:
    """(scope, measure, label, value, n) rows from (measure, label, value, n) SQL
    expressions over ``df``; ``keep`` filters the result."""
    cells = ", ".join(
        f"struct('{m}' AS measure, {label} AS label, CAST({v} AS DOUBLE) AS value, "
        f"CAST({n} AS BIGINT) AS n)" for m, label, v, n in rows)
    return df.selectExpr(*df.columns, f"inline(array({cells}))").where(keep).select(
        *KEYS, "label", "value", "n")


def forum_rows(forum: DataFrame, counts: DataFrame, response: DataFrame,
               measures: set[str]) -> DataFrame:
    """Measures of forums, one row per forum and measure."""
    texts = [c for c in ("title", "abstract") if f"paper_{c}" in measures]
    df = scoped_forums(forum, *[F.expr(f"if({c} <> '', 1, NULL) AS _{c}") for c in texts])
    rows = [("forum", "''", "NULL", "1")] if "forum" in measures else []
    rows += [(f"paper_{c}", "''", f"_{c}", "1") for c in texts]
    if "decision" in measures:
        rows.append(("decision", "decision", "if(decision <> 'unknown', 1, NULL)", "1"))
    if measures & {*FORUM_MEASURES, "reviews_per_forum"}:
        df = df.join(forum_ratings(counts), "forum_id", "left")
        rows += [(m, "''", v, "1") for m, v in RATING_MEASURES.items() if m in measures]
        if "reviews_per_forum" in measures:
            rows.append(("reviews_per_forum", "''", "coalesce(n_reviews, 0)", "1"))
    if "responses_per_forum" in measures:
        df = df.join(response_counts(response), "forum_id", "left")
        rows.append(("responses_per_forum", "''", "coalesce(n_responses, 0)", "1"))
    return _unfold(df, rows)


def review_rows(forum: DataFrame, counts: DataFrame, response: DataFrame,
                measures: set[str]) -> DataFrame:
    """Measures of reviews, from rating counts joined to their forum."""
    base = scoped_forums(forum)
    split = measures & set(CHANGE_METRICS[1:])
    if split:
        base = base.join(response_counts(response), "forum_id", "left")
    change = "final_value - initial_value"
    rows = [r for r in (
        ("rating", "''", "initial_value", "n"),
        ("rating_by_decision", "decision", "initial_value", "n"),
        ("confidence", "''", "confidence_value", "n"),
        *[(m, "''", change, "n") for m in CHANGE_METRICS],
    ) if r[0] in measures]
    present, absent = (f"measure = '{m}'" for m in CHANGE_METRICS[1:])
    keep = (f"NOT ({present} AND n_responses IS NULL) AND NOT ({absent} AND n_responses IS NOT NULL)"
            if split else "TRUE")
    joined = counts.withColumnRenamed("n", "_n").join(base, "forum_id")
    return _unfold(joined, [(m, lb, v, "_n") for m, lb, v, _ in rows], keep)


def measure_histogram(forum: DataFrame, review: DataFrame, response: DataFrame,
                      measures: set[str]) -> DataFrame:
    """Counts per (scope, measure, label, value), both kinds of scope included.

    With review measures the reviews are counted per rating combination first and both
    kinds of rows start from these counts. Forum measures alone aggregate straight to
    the forum, with a partial sum per map task. The all-years scope is summed from the
    finished years."""
    of_reviews = measures & set(REVIEW_MEASURES)
    if of_reviews:
        measures = measures | {"forum"}
    values = ["initial_value"]
    if of_reviews & set(CHANGE_METRICS):
        values.append("final_value")
    if "confidence" in of_reviews:
        values.append("confidence_value")
    if of_reviews:
        counts = rating_counts(review, values)
    else:
        counts = review.select("forum_id", "initial_value", F.lit(1).alias("n"))
    rows = forum_rows(forum, counts, response, measures)
    if of_reviews:
        rows = rows.unionByName(review_rows(forum, counts, response, measures))
    key = [*KEYS, "label", "value"]
    by_year = rows.groupBy(*key).agg(F.sum("n").alias("n"))
    if of_reviews:
        by_year = _with_empty_measures(by_year, sorted(of_reviews))
    return with_all_years(by_year).groupBy(*key).agg(F.sum("n").alias("n"))


def _with_empty_measures(hist: DataFrame, measures: list[str]) -> DataFrame:
    """Next to a scope's one ``forum`` row, a row with count zero per review measure, so
    that a scope without reviews still reports them."""
    empty = "".join(
        f", struct('{m}' AS measure, '' AS label, CAST(NULL AS DOUBLE) AS value, 0L AS n)"
        for m in measures)
    cells = f"filter(array(struct(measure, label, value, n){empty}), (x, i) -> i = 0 OR measure = 'forum')"
    return hist.select(*SCOPE, F.expr(cells).alias("_c")).selectExpr(*SCOPE, "inline(_c)")


# --- reading metrics off the histogram --------------------------------------------------


def _cell(metric: str, sample: str, missing: str, path: str, value: str,
          test: str = "TRUE") -> str:
    """SQL struct of one tidy row for the rows of a measure that pass ``test``."""
    return (
        f"CASE WHEN measure = '{METRICS[metric][0]}' AND {test} THEN struct('{metric}' AS metric, "
        f"CAST({sample} AS BIGINT) AS sample_size, CAST({missing} AS BIGINT) AS missing_count, "
        f"CAST({path} AS STRING) AS path, CAST({value} AS DOUBLE) AS value) END")


def _emit(df: DataFrame, cells: list[str]) -> DataFrame:
    """Tidy rows of several metrics in one pass over ``df``."""
    return df.selectExpr(*SCOPE, f"inline(array_compact(array({', '.join(cells)})))").select(
        "metric", *SCOPE, "sample_size", "missing_count", "path", "value")


MISSING = "rows - total"


def _figures(hist: DataFrame, kinds: set[str]) -> DataFrame:
    """One row per (scope, measure) with everything that is a single number."""
    zeros = "sum(if(value = 0, n, 0)) AS zeros"
    if not kinds & {"summary", "change", "deciles", "crosstab"}:
        return hist.groupBy(*KEYS).agg(*map(F.expr, (
            "sum(n) AS rows", "sum(if(value IS NOT NULL, n, 0)) AS total",
            "sum(value * n) AS sum_v", zeros)))
    named = [F.expr(f"max({c}) AS {c}") for c in ("rows", "total", "sum_v", "mean", "lo", "hi")]
    named.append(F.expr(zeros))
    if kinds & {"summary", "change"}:
        named += [O.stdev("value").alias("stdev"), O.median("value").alias("median")]
        tests = ("value = 0", "value > 0 AND value <= 2", "value > 2 AND value <= 4", "value > 4")
        named += [F.expr(f"sum(if({t}, n, 0)) AS range{i}") for i, t in enumerate(tests)]
    if "deciles" in kinds:
        # Min-max scaled in the scope; a constant population sits in the middle.
        slot = "least(9, floor(coalesce((value - lo) / nullif(hi - lo, 0D), 0.5D) * 10))"
        named += [F.expr(f"sum(if(value IS NOT NULL AND {slot} = {i}, n, 0)) AS d{i}")
                  for i in range(10)]
    if "crosstab" in kinds:
        named += [O.tercile("value", 1).alias("low_cut"), O.tercile("value", 2).alias("high_cut")]
    return O.positioned(hist, KEYS, "value").groupBy(*KEYS).agg(*named)


def _number_cells(kinds: dict[str, str], digits: int | None) -> list[str]:
    """Cells of all metrics that are read from the figures alone."""
    rounded = lambda x: x if digits is None else f"bround({x}, {digits})"
    cells = []
    for m, kind in kinds.items():
        if kind == "rows":
            cells.append(_cell(m, "rows", "0", "''", "rows"))
        elif kind == "sum":
            cells.append(_cell(m, "rows", "zeros", "''", "coalesce(sum_v, 0)"))
        elif kind == "rate":
            rate = rounded(f"({MISSING}) / CAST(nullif(rows, 0) AS DOUBLE)")
            cells.append(_cell(m, "rows", MISSING, "''", rate))
        elif kind == "deciles":
            cells.append(_cell(m, "total", MISSING, "NULL", "NULL", "total = 0"))
            cells += [_cell(m, "total", MISSING, f"'{d}'", f"d{i}", "total > 0")
                      for i, d in enumerate(DECILES)]
        elif kind in ("summary", "change"):
            sample = "total" if kind == "summary" else "rows"
            paths = {"count": "total", "min": "lo", "max": "hi", **{
                p: rounded(p) for p in ("mean", "stdev", "median")}}
            if m == "reviewer_disagreement":
                paths |= {f"histogram.{b}": f"range{i}" for i, b in enumerate(RANGE_BINS)}
            cells += [_cell(m, sample, MISSING, f"'{p}'", v) for p, v in paths.items()]
    return cells


def _histograms(hist: DataFrame, figures: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Bars per value, per label, and per label with tercile. The row of a missing
    value stays only where a measure has no values at all; it has the empty label."""
    cuts = ["low_cut", "high_cut"] if "crosstab" in kinds.values() else []
    rows = hist.join(figures.select(*KEYS, "rows", "total", *cuts), KEYS)
    tercile = "CASE WHEN value < low_cut THEN 'low' WHEN value > high_cut THEN 'high' ELSE 'medium' END"
    shown = "(value IS NOT NULL OR (total = 0 AND label = ''))"
    bar = "if(value IS NULL, NULL, n)"
    cells = []
    for m, kind in kinds.items():
        if kind == "labels":
            cells.append(_cell(m, "rows", MISSING, "label", "n"))
        elif kind == "bars":
            cells.append(_cell(m, "total", MISSING, "value", bar, shown))
        else:
            path = f"if(value IS NULL, NULL, concat(label, '.', {tercile}))"
            cells.append(_cell(m, "total", MISSING, path, bar, shown))
    key = ["metric", *SCOPE, "sample_size", "missing_count", "path"]
    return _emit(rows, cells).groupBy(*key).agg(F.sum("value").alias("value"))


def compute(forum: DataFrame, review: DataFrame, response: DataFrame,
            metrics: Iterable[str] = tuple(METRICS), digits: int | None = 4) -> DataFrame:
    """Statistics of every scope as tidy rows; only what ``metrics`` needs is read."""
    kinds = {m: METRICS[m][1] for m in metrics}
    bars = {m: k for m, k in kinds.items() if k in ("bars", "labels", "crosstab")}
    numbers = {m: k for m, k in kinds.items() if m not in bars}
    hist = measure_histogram(forum, review, response, {METRICS[m][0] for m in kinds})
    parts = []
    if numbers:
        parts.append(_emit(_figures(hist, set(numbers.values())), _number_cells(numbers, digits)))
    if bars:
        parts.append(_histograms(hist, _figures(hist, set(bars.values())), bars))
    return reduce(DataFrame.unionByName, parts).withColumn(
        "observational", F.col("metric").startswith("rebuttal_"))


def with_provenance(stats: DataFrame, corpus_hash: str, generated_at: str) -> DataFrame:
    """Make each row self-describing: source digest, time, schema version, caveat."""
    return stats.withColumns({
        "corpus_hash": F.lit(corpus_hash),
        "generated_at": F.lit(generated_at),
        "schema_version": F.lit(S.STATISTICS_SCHEMA_VERSION),
        "note": F.when(F.col("observational"), F.lit(S.REBUTTAL_NOTE)),
    })


def to_maps(stats: DataFrame) -> DataFrame:
    """One row per statistic with its paths as a map; the export shape. A statistic
    has as many paths as its scope has distinct rating values."""
    pairs = F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "value")))
    return stats.groupBy("metric", *SCOPE, "sample_size", "missing_count", "observational").agg(
        F.map_from_entries(F.array_sort(pairs)).alias("value"))
