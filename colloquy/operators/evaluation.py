"""The evaluation of two runs as a whole: a gate, then all scores from one written join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import runs as R
from colloquy.operators import scoring as SC
from colloquy.operators.split import EvaluationDataset, baseline_predictions

PREDICTED = ("system", "forum_id", "rating_prediction", "decision_prediction", "accept_probability")


class EvaluationRefused(ValueError):
    """The dataset or a run breaks a rule; ``violations`` holds every case."""

    def __init__(self, violations: DataFrame):
        rules = sorted(r.rule for r in violations.select("rule").distinct().collect())  # names of rules
        super().__init__(f"not scored: {', '.join(rules)}")
        self.violations = violations


@dataclass
class Evaluation:
    scores: DataFrame
    rating_breakdown: DataFrame
    decision_breakdown: DataFrame
    coverage: DataFrame
    warnings: DataFrame
    deltas: DataFrame
    missing: DataFrame


def evaluate(dataset: EvaluationDataset, calibration: DataFrame, aggregate: DataFrame, runs: DataFrame,
             predictions: DataFrame, path: str, *, split_manifest: DataFrame | None = None,
             digits: int | None = 4) -> Evaluation:
    """Score both runs and the baseline, or raise `EvaluationRefused`.

    ``aggregate`` is the calibration set's one row (see `split.calibration_aggregate`).
    Violations, the pairs of label and prediction, and every result are tables under
    ``path``; results are written only when there is no violation."""
    spark = predictions.sparkSession

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    if "position" not in predictions.columns:
        predictions = predictions.withColumn("position", F.lit(0))
    violations = store(R.leakage_report(
        dataset.inputs, dataset.labels, calibration, dataset.manifest,
        dataset.manifest if split_manifest is None else split_manifest, runs, predictions), "violations")
    if not violations.isEmpty():
        raise EvaluationRefused(violations)

    every = store(predictions.select(*PREDICTED).unionByName(
        baseline_predictions(dataset.inputs, aggregate).select(*PREDICTED)), "predictions")
    paired = store(SC.pair(dataset.labels, every), "pairs")
    ratings = SC.overall_and_scopes(SC.rating_pairs(paired))
    decisions = SC.overall_and_scopes(SC.decision_pairs(paired))
    scores = store(SC.score_pairs(paired, every, digits), "scores")
    coverage = store(SC.coverage(dataset.labels, paired, every, digits), "coverage")
    return Evaluation(
        scores,
        store(SC.breakdown(SC.rating_metrics(ratings, SC.KEYS, digits)), "rating_breakdown"),
        store(SC.breakdown(SC.decision_metrics(decisions, SC.KEYS, digits)), "decision_breakdown"),
        coverage,
        store(SC.warnings(coverage, dataset.inputs), "warnings"),
        store(SC.deltas(scores, digits=digits), "deltas"),
        store(R.missing_predictions(predictions, dataset.inputs), "missing"),
    )
