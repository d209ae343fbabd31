"""Checks on prediction runs: schema, membership, comparability, consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import labels as L
from colloquy.functions.digests import set_digest
from colloquy.functions.rows import with_row
from colloquy.functions.text import is_blank
from colloquy.operators.evidence import explode_rules, union_violations
from colloquy.operators.split import overlap
from colloquy.sources.json_document import json_elements

RUN_FIELDS = tuple(S.RUN.fieldNames())


def _is(col: str, kind: str) -> Column:
    """Type test of a VARIANT field; NULL and JSON null count as absent."""
    return F.coalesce(F.schema_of_variant(col).rlike(kind), F.lit(False))


PREDICTION_VALUES = ("rating_prediction", "decision_prediction", "accept_probability")


def _prediction(record: Column) -> list[Column]:
    return [F.try_variant_get(record, "$.forum_id", "string").alias("forum_id"),
            *[F.try_variant_get(record, f"$.{c}", "variant").alias(c) for c in PREDICTION_VALUES]]


def parse_predictions(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Prediction rows from JSON payloads, with fields left as VARIANT for checking."""
    v = F.try_parse_json(column)
    return (
        payloads.select(
            "system",
            F.posexplode(F.try_variant_get(v, "$.predictions", "array<variant>"))
            .alias("position", "p"))
        .select("system", "position", *_prediction(F.col("p")))
    )


def load_predictions(spark: SparkSession, path: str, system: str, split_bytes: int = 128 << 20,
                     parts: bool = False) -> DataFrame:
    """The rows of `parse_predictions` from a run file, or a folder of its parts, read by as many tasks as it has splits."""
    elements = json_elements(spark, path, split_bytes, parts).where(F.col("key") == "predictions")
    return elements.select(F.lit(system).alias("system"), "position", F.try_parse_json("json").alias("p")).select(
        "system", "position", *_prediction(F.col("p")))


NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
ABSENT = "^VOID"


def typed_predictions(rows: DataFrame) -> DataFrame:
    """Values with the types a valid file has; anything else becomes NULL."""
    num = lambda c: F.when(_is(c, NUMERIC), F.try_variant_get(c, "$", "double"))
    return rows.select(
        "system", "forum_id", num("rating_prediction").alias("rating_prediction"),
        F.when(_is("decision_prediction", "^STRING"),
               F.try_variant_get("decision_prediction", "$", "string")).alias("decision_prediction"),
        num("accept_probability").alias("accept_probability"))


def _label(row: Column | str = "forum_id") -> Column:
    return F.coalesce(F.nullif(F.col(row) if isinstance(row, str) else row, F.lit("")),
                      F.concat(F.lit("#"), F.col("position").cast("string")))


def variant_schema_rules(rows: DataFrame) -> DataFrame:
    """Schema violations of raw (VARIANT) prediction rows. A boolean is no number."""
    bad_number = lambda c: (
        F.col(c).isNotNull() & ~_is(c, ABSENT) & ~_is(c, NUMERIC))
    prob = F.try_variant_get("accept_probability", "$", "double")
    decision = F.try_variant_get("decision_prediction", "$", "string")
    has_decision = F.col("decision_prediction").isNotNull() & ~_is("decision_prediction", ABSENT)
    return explode_rules(rows, _label(), [
        ("missing_forum_id", is_blank("forum_id"), None),
        ("rating_not_numeric", bad_number("rating_prediction"), None),
        ("decision_not_allowed",
         has_decision & ~(_is("decision_prediction", "^STRING") & decision.isin(*S.RESOLVED_DECISIONS)),
         None),
        ("probability_not_in_range", bad_number("accept_probability")
         | (_is("accept_probability", NUMERIC) & ~prob.between(0.0, 1.0)), None),
    ])


def prediction_rules(predictions: DataFrame) -> DataFrame:
    """Schema violations of typed prediction rows with a ``position`` in their file."""
    prob, rating = F.col("accept_probability"), F.col("rating_prediction")
    rows = explode_rules(
        predictions.withColumn("_label", F.concat_ws(":", "system", _label(
            F.col("forum_id").cast("string")))),
        "_label", [
            ("missing_forum_id", is_blank(F.col("forum_id").cast("string")), None),
            ("rating_not_numeric", F.isnan(rating), None),
            ("decision_not_allowed", F.col("decision_prediction").isNotNull()
             & ~F.col("decision_prediction").isin(*S.RESOLVED_DECISIONS), "decision_prediction"),
            ("probability_not_in_range", prob.isNotNull() & ~prob.between(0.0, 1.0), prob),
        ])
    repeated = (
        predictions.where(~is_blank(F.col("forum_id").cast("string")))
        .groupBy("system", "forum_id").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(*L.violation(F.concat_ws(":", "system", F.col("forum_id").cast("string")),
                             "duplicate_forum_id", n=F.col("_n") - 1))
    )
    return rows.unionByName(repeated)


def run_rules(runs: DataFrame) -> DataFrame:
    """Header violations: required fields and the system vocabulary."""
    return explode_rules(runs, "run_id", [
        *[(f"missing_run_field.{f}", is_blank(F.col(f).cast("string")), None) for f in RUN_FIELDS],
        ("system_not_allowed", F.col("system").isNotNull() & ~F.col("system").isin(*S.SYSTEMS),
         "system"),
        ("settings_not_an_object", ~is_blank("settings")
         & ~F.coalesce(F.schema_of_variant(F.try_parse_json("settings")).startswith("OBJECT"),
                       F.lit(False)), None),
    ])


def outside_dataset(predictions: DataFrame, inputs: DataFrame) -> DataFrame:
    """Predictions for forums that are not in the evaluation set: fatal."""
    return (
        predictions.where(F.col("forum_id").isNotNull()).select("system", "forum_id").distinct()
        .join(inputs.select("forum_id"), "forum_id", "left_anti")
        .select(*L.violation(F.concat_ws(":", "system", F.col("forum_id").cast("string")),
                             "outside_evaluation_set"))
    )


def missing_predictions(predictions: DataFrame, inputs: DataFrame,
                        systems: Sequence[str] = (S.SYSTEM_GENERIC, S.SYSTEM_CALIBRATED)) -> DataFrame:
    """Evaluation forums a system says nothing about: for information."""
    wanted = inputs.select("forum_id", F.explode(F.array(*map(F.lit, systems))).alias("system"))
    return wanted.join(
        predictions.select("system", "forum_id").distinct(), ["system", "forum_id"], "left_anti")


def forum_set_differences(predictions: DataFrame, left: str, right: str) -> DataFrame:
    """Forums that only one of two systems predicts."""
    has = lambda s: F.max((F.col("system") == s).cast("int"))
    return (
        predictions.where(F.col("system").isin(left, right)).groupBy("forum_id")
        .agg(has(left).alias("_l"), has(right).alias("_r"))
        .where(F.col("_l") != F.col("_r"))
        .select("forum_id", F.when(F.col("_l") == 1, left).otherwise(right).alias("only_in"))
    )


def comparability(runs: DataFrame, manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Two runs may only differ in their calibration. ``runs`` holds one row each for
    the generic and the calibrated system; ``manifest`` is the dataset's one row."""
    side = lambda system, p: runs.where(F.col("system") == system).agg(*[
        F.min(c).alias(f"{p}_{c}") for c in RUN_FIELDS], F.count(F.lit(1)).alias(f"{p}_runs"))
    both = with_row(
        with_row(side(S.SYSTEM_GENERIC, "g"), side(S.SYSTEM_CALIBRATED, "c")),
        manifest.select("model_inputs_hash", F.col("calibration_hash").alias("frozen")))
    ne = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    # a parsed object holds its keys in order, whatever the order in the text
    parsed = lambda c: F.coalesce(F.to_json(F.try_parse_json(F.col(c).cast("string"))),
                                  F.col(c).cast("string"))
    rules = explode_rules(both, F.lit("run"), [
        ("generic_run_missing", F.col("g_system").isNull(), None),
        ("calibrated_run_missing", F.col("c_system").isNull(), None),
        ("generic_run_repeated", F.col("g_runs") > 1, None),
        ("calibrated_run_repeated", F.col("c_runs") > 1, None),
        ("model_mismatch", ne("g_model", "c_model"), None),
        ("settings_mismatch", ~parsed("g_settings").eqNullSafe(parsed("c_settings")), None),
        ("input_hash_mismatch", ne("g_input_hash", "c_input_hash"), None),
        ("generic_input_hash_stale", ne("g_input_hash", "model_inputs_hash"), None),
        ("calibrated_input_hash_stale", ne("c_input_hash", "model_inputs_hash"), None),
        ("generic_run_is_calibrated",
         F.coalesce("g_calibration_hash", F.lit(S.NO_CALIBRATION)) != S.NO_CALIBRATION, None),
        ("calibration_hash_stale", ne("c_calibration_hash", "frozen"), None),
    ])
    differ = forum_set_differences(predictions, S.SYSTEM_GENERIC, S.SYSTEM_CALIBRATED).agg(
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0).select(
        *L.violation(F.lit("run"), "forum_sets_differ", n=F.col("_n")))
    return rules.unionByName(differ)


def dataset_consistency(inputs: DataFrame, labels: DataFrame, calibration: DataFrame,
                        manifest: DataFrame, split_manifest: DataFrame) -> DataFrame:
    """Recompute every digest of a dataset and compare it with its manifests."""
    from colloquy.operators.split import inputs_digest, labels_digest

    now = manifest.select(
        "model_inputs_hash", "private_labels_hash", "calibration_hash", "corpus_hash", "seed")
    for one_row in (
        split_manifest.select(*[F.col(c).alias(f"s_{c}")
                                for c in ("calibration_hash", "corpus_hash", "seed")]),
        inputs_digest(inputs, "_inputs"), labels_digest(labels, "_labels"),
        set_digest(calibration.select("forum_id").distinct(), F.col("forum_id"), name="_cal"),
    ):
        now = with_row(now, one_row)
    ne = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    extra = sorted(set(inputs.columns) - set(S.MODEL_INPUT_FIELDS))
    parts = [
        explode_rules(now, F.lit("dataset"), [
            ("model_inputs_tampered", ne("model_inputs_hash", "_inputs"), None),
            ("private_labels_tampered", ne("private_labels_hash", "_labels"), None),
            *[(f"manifests_disagree.{c}", ne(c, f"s_{c}"), None)
              for c in ("calibration_hash", "corpus_hash", "seed")],
            ("calibration_ids_tampered", ne("_cal", "s_calibration_hash"), None),
            ("disallowed_fields", F.lit(bool(extra)), F.lit(", ".join(extra))),
        ]),
        overlap(inputs, calibration).select(
            *L.violation("forum_id", "calibration_evaluation_overlap")),
    ]
    return union_violations(parts)


def leakage_report(inputs: DataFrame, labels: DataFrame, calibration: DataFrame,
                   manifest: DataFrame, split_manifest: DataFrame, runs: DataFrame,
                   predictions: DataFrame) -> DataFrame:
    """All violations of a dataset and two runs; metrics are only worth computing when
    this is empty."""
    parts = {
        "dataset": dataset_consistency(inputs, labels, calibration, manifest, split_manifest),
        "run": run_rules(runs),
        "schema": prediction_rules(predictions),
        "membership": outside_dataset(predictions, inputs),
        "comparability": comparability(runs, manifest, predictions),
    }
    return union_violations([union_violations([df], name) for name, df in parts.items()])
