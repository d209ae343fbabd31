"""Scores of prediction runs against private labels.

Pairs of label and prediction collapse to joint counts first: (system, scope, actual,
predicted) -> n. Errors, ranks and confusion counts are functions of these counts, so
the joined rows are read once, and no ranking sorts a system's forums in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import labels as L
from colloquy.functions.rows import with_row
from colloquy.operators import order_stats as O

SCOPE = ["venue_family", "venue_year"]
KEYS = ["system", *SCOPE]
# The published metrics of each task.
DELTA_METRICS = {
    "initial_rating": ("mae", "median_absolute_error", "spearman"),
    "final_decision": ("accuracy", "precision", "recall", "f1"),
    "probability": ("brier_score", "ece"),
}


def pair(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels joined to every system's prediction of the same forum."""
    return labels.select(
        "forum_id", *SCOPE, "initial_rating_eligible", "initial_rating_target",
        "final_decision_eligible", "final_decision_target",
    ).join(predictions.select(
        "system", "forum_id", "rating_prediction", "decision_prediction", "accept_probability"),
        "forum_id")


def overall_and_scopes(counts: DataFrame) -> DataFrame:
    """Counts per (family, year) plus the same counts under all/all."""
    both = F.explode(F.array(
        F.struct(*SCOPE),
        F.struct(F.lit(S.YEAR_ALL).alias("venue_family"), F.lit(S.YEAR_ALL).alias("venue_year"))))
    rest = [c for c in counts.columns if c not in (*SCOPE, "n")]
    return (
        counts.withColumn("_s", both)
        .select(*rest, "_s.*", "n")
        .groupBy(*rest, *SCOPE).agg(F.sum("n").alias("n"))
    )


def rating_pairs(paired: DataFrame) -> DataFrame:
    """Joint counts of (target, prediction) for the rating task."""
    return (
        paired.where(F.col("initial_rating_eligible") & F.col("rating_prediction").isNotNull())
        .groupBy(*KEYS, F.col("initial_rating_target").alias("actual"),
                 F.col("rating_prediction").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def decision_pairs(paired: DataFrame) -> DataFrame:
    return (
        paired.where(F.col("final_decision_eligible") & F.col("decision_prediction").isNotNull())
        .groupBy(*KEYS, F.col("final_decision_target").alias("actual"),
                 F.col("decision_prediction").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- rating metrics ---------------------------------------------------------------------


def rating_metrics(pairs: DataFrame, keys: list[str], digits: int | None = 4) -> DataFrame:
    """n, mean and median absolute error and Spearman correlation per group of joint
    counts.

    Error, target and prediction are three sides of one histogram, so a single pass
    orders all of them. Spearman is the Pearson correlation of average ranks: each
    distinct pair looks its two ranks up, centres them at (total + 1) / 2, which is
    exact, and the sums run over the joint counts. It is NULL below two pairs or
    without spread."""
    sides = F.expr("""inline(array(
        struct('err' AS side, abs(predicted - actual) AS value),
        struct('actual' AS side, actual AS value),
        struct('predicted' AS side, predicted AS value)))""")
    rows = pairs.select(*keys, "actual", "predicted", F.col("n").alias("pairs_n"), sides)
    side = [*keys, "side"]
    placed = O.positioned(
        rows.groupBy(*side, "value").agg(F.sum("pairs_n").alias("n")), side, "value"
    ).select(*side, "value", "n", "total", "mean", "upto")

    err = F.col("side") == "err"
    at = lambda pos: F.max(F.when(
        err & (pos >= F.col("upto") - F.col("n")) & (pos < F.col("upto")), F.col("value")))
    total = F.col("total")
    median = (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2
    errors = placed.groupBy(*keys).agg(
        F.max("total").alias("sample_size"),
        L.rounded(F.max(F.when(err, F.col("mean"))), digits).alias("mae"),
        L.rounded(median, digits).alias("median_absolute_error"))

    centred = F.expr("upto - n + (n + 1) / 2 - (total + 1) / 2")
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("rank")))
    ranked = (
        rows.join(placed.select(*side, "value", centred.alias("rank")), [*side, "value"])
        .groupBy(*keys, "actual", "predicted")
        .agg(of("actual").alias("a"), of("predicted").alias("p"), F.max("pairs_n").alias("n"))
    )
    sums = ranked.groupBy(*keys).agg(*map(F.expr, (
        "sum(n * a * p) AS cov", "sum(n * a * a) AS va", "sum(n * p * p) AS vp", "sum(n) AS total")))
    rho = F.expr("if(total >= 2, cov / nullif(sqrt(va) * sqrt(vp), 0D), NULL)")
    return O.attach(errors, sums.select(*keys, L.rounded(rho, digits).alias("spearman")), keys)


def pearson(pairs: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """Pearson correlation of joint counts, centred in a second pass."""
    n = F.col("n")
    means = pairs.groupBy(*keys).agg(
        (F.sum(n * F.col("actual")) / F.sum("n")).alias("_ma"),
        (F.sum(n * F.col("predicted")) / F.sum("n")).alias("_mp"), F.sum("n").alias("_n"))
    a, p = F.col("actual") - F.col("_ma"), F.col("predicted") - F.col("_mp")
    sums = O.attach(pairs, means, keys).groupBy(*keys).agg(
        F.sum(n * a * p).alias("_c"), F.sum(n * a * a).alias("_va"),
        F.sum(n * p * p).alias("_vp"), F.max("_n").alias("_n"),
        (F.min("actual") == F.max("actual")).alias("_ka"),
        (F.min("predicted") == F.max("predicted")).alias("_kp"))
    spread = F.sqrt(F.col("_va")) * F.sqrt(F.col("_vp"))
    flat = (F.col("_n") < 2) | F.col("_ka") | F.col("_kp")
    value = F.when(~flat, F.col("_c") / F.nullif(spread, F.lit(0.0)))
    return sums.select(*keys, L.rounded(value, digits).alias("pearson"))


# --- decision metrics -------------------------------------------------------------------


def confusion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fn, fp, tn with accept as the positive class."""
    cell = lambda a, p: F.sum(F.when(
        (F.col("actual") == a) & (F.col("predicted") == p), F.col("n")).otherwise(0))
    return pairs.groupBy(*keys).agg(
        cell("accept", "accept").alias("tp"), cell("accept", "reject").alias("fn"),
        cell("reject", "accept").alias("fp"), cell("reject", "reject").alias("tn"))


def classification(cm: DataFrame, digits: int | None = 4) -> DataFrame:
    """accuracy, precision, recall and F1; NULL on zero denominators. F1 is computed
    from the published (rounded) precision and recall."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    p, r = F.col("precision"), F.col("recall")
    return cm.withColumns({
        "sample_size": tp + fn + fp + tn,
        "accuracy": L.rounded(L.ratio(tp + tn, tp + fn + fp + tn), digits),
        "precision": L.rounded(L.ratio(tp, tp + fp), digits),
        "recall": L.rounded(L.ratio(tp, tp + fn), digits),
    }).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(
        L.rounded(2 * p * r / F.nullif(p + r, F.lit(0.0)), digits)))


def decision_metrics(pairs: DataFrame, keys: list[str], digits: int | None = 4) -> DataFrame:
    return classification(confusion(pairs, keys), digits)


# --- probabilities ----------------------------------------------------------------------


def probability_bins(paired: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Per probability bin: count, sums and squared error. A probability is never
    derived from another prediction field."""
    prob = F.col("accept_probability")
    actual = (F.col("final_decision_target") == "accept").cast("double")
    return (
        paired.where(F.col("final_decision_eligible") & prob.isNotNull())
        .groupBy(*keys, F.least(F.lit(bins - 1), F.floor(prob * bins).cast("int")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(prob).alias("sum_prob"),
             F.sum(actual).alias("sum_actual"), F.sum(F.pow(prob - actual, F.lit(2))).alias("sq"))
    )


def probability_metrics(paired: DataFrame, systems: DataFrame, digits: int | None = 4,
                        min_n: int = S.PROBABILITY_MIN_N) -> DataFrame:
    """Brier score and expected calibration error, or the reason they are withheld."""
    sums = probability_bins(paired, ["system"]).groupBy("system").agg(
        F.sum("n").alias("n"),
        F.sum("sq").alias("sq"),
        F.sum(F.abs(F.col("sum_actual") - F.col("sum_prob"))).alias("gap"))
    n = F.coalesce("n", F.lit(0))
    ok = n >= min_n
    return systems.select("system").distinct().join(sums, "system", "left").select(
        "system", n.alias("sample_size"), ok.alias("computed"),
        F.when(n == 0, "no accept_probability values present")
        .when(~ok, F.concat(F.lit(f"sample_size_below_{min_n} (n="), n.cast("string"), F.lit(")")))
        .alias("reason"),
        F.when(ok, L.rounded(F.col("sq") / n, digits)).alias("brier_score"),
        F.when(ok, L.rounded(F.col("gap") / n, digits)).alias("ece"))


# --- assembly ---------------------------------------------------------------------------


def breakdown(metrics: DataFrame, min_n: int = S.BREAKDOWN_MIN_N) -> DataFrame:
    """Per-scope metrics; small scopes are marked as skipped, not dropped."""
    small = F.col("sample_size") < min_n
    scoped = metrics.where(F.col("venue_family") != S.YEAR_ALL)
    values = [c for c in metrics.columns if c not in (*KEYS, "sample_size")]
    return scoped.select(
        *KEYS, "sample_size",
        F.when(small, f"sample_size_below_{min_n}").alias("skipped_reason"),
        *[F.when(~small, F.col(c)).alias(c) for c in values])


def coverage(labels: DataFrame, paired: DataFrame, systems: DataFrame,
             digits: int | None = 4) -> DataFrame:
    """Predicted over eligible forums, per system and task."""
    tasks = (
        ("initial_rating", "initial_rating_eligible", "rating_prediction"),
        ("final_decision", "final_decision_eligible", "decision_prediction"),
    )
    eligible = labels.agg(*[F.count_if(F.col(e)).alias(t) for t, e, _ in tasks])
    predicted = paired.groupBy("system").agg(*[
        F.count_if(F.col(e) & F.col(p).isNotNull()).alias(f"_{t}") for t, e, p in tasks])
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(t).alias("eligible"),
                 F.coalesce(F.col(f"_{t}"), F.lit(0)).alias("predicted")) for t, _, _ in tasks]))
    return (
        with_row(systems.select("system").distinct().join(predicted, "system", "left"), eligible)
        .select("system", rows.alias("_r")).select("system", "_r.*")
        .withColumn("coverage", L.rounded(L.ratio(F.col("predicted"), F.col("eligible")), digits))
    )


def long_metrics(df: DataFrame, task: str, names: tuple[str, ...]) -> DataFrame:
    """(system, task, metric, value) rows."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
    return df.select("system", F.lit(task).alias("task"), "sample_size", cells.alias("_c")).select(
        "system", "task", "sample_size", "_c.*")


def score(labels: DataFrame, predictions: DataFrame, digits: int | None = 4) -> DataFrame:
    """Headline metrics of every system and task as tidy rows."""
    return score_pairs(pair(labels, predictions), predictions, digits)


def score_pairs(paired: DataFrame, predictions: DataFrame, digits: int | None = 4) -> DataFrame:
    """The same from pairs that were joined, and perhaps written, before."""
    overall = lambda df: df.groupBy(
        "system", "actual", "predicted").agg(F.sum("n").alias("n"))
    parts = [
        long_metrics(rating_metrics(overall(rating_pairs(paired)), ["system"], digits),
                     "initial_rating", DELTA_METRICS["initial_rating"]),
        long_metrics(decision_metrics(overall(decision_pairs(paired)), ["system"], digits),
                     "final_decision", DELTA_METRICS["final_decision"]),
        long_metrics(probability_metrics(paired, predictions, digits),
                     "probability", DELTA_METRICS["probability"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def deltas(scores: DataFrame, base: str = S.SYSTEM_GENERIC, other: str = S.SYSTEM_CALIBRATED,
           digits: int | None = 4) -> DataFrame:
    """other - base per task and metric; NULL when either is missing."""
    side = lambda s: F.max(F.when(F.col("system") == s, F.col("value")))
    return scores.groupBy("task", "metric").agg(
        side(base).alias("base"), side(other).alias("other")
    ).withColumn("delta", L.rounded(F.col("other") - F.col("base"), digits))


def warnings(cov: DataFrame, inputs: DataFrame, small: int = S.SMALL_SAMPLE_N) -> DataFrame:
    """Small-sample warnings per system and task, and one for a single-family set."""
    few = cov.where((F.col("predicted") > 0) & (F.col("predicted") < small)).select(
        "system", "task", F.lit("small_sample").alias("warning"),
        F.col("predicted").cast("bigint").alias("n"))
    families = inputs.agg(F.countDistinct("venue_family").alias("_f"))
    single = with_row(cov.select("system").distinct(), families).where(F.col("_f") <= 1).select(
        "system", F.lit("").alias("task"), F.lit("single_venue_family").alias("warning"),
        F.col("_f").cast("bigint").alias("n"))
    return few.unionByName(single)
