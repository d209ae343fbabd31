"""Evidence, splits, prediction checks and scores, with published example numbers."""

import pytest
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.operators import evaluation as EV
from colloquy.operators import evidence as E
from colloquy.operators import runs as R
from colloquy.operators import scoring as SC
from colloquy.operators import split as SP
from colloquy.sources.corpus import canonical_order
from tests.conftest import lit_row, make_corpus, rules

# Predictions of the worked example, (rating, decision) for eval_001 .. eval_008.
GENERIC = [(6.0, "accept"), (5.0, "accept"), (7.0, "accept"), (3.5, "accept"), (5.8, "accept"),
           (4.5, "accept"), (6.5, "accept"), (5.0, "accept")]
CALIBRATED = [(6.7, "accept"), (3.7, "reject"), (7.7, "accept"), (2.2, "reject"), (6.5, "accept"),
              (3.2, "reject"), (5.2, "accept"), (5.7, "accept")]
PREDICTION = ("system string, forum_id string, rating_prediction double, decision_prediction string, "
              "accept_probability double")


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame([
        (s, f"eval_00{i}", r, d, None) for s, ps in (("generic", GENERIC), ("calibrated", CALIBRATED))
        for i, (r, d) in enumerate(ps, 1)], PREDICTION)


@pytest.fixture(scope="module")
def dataset(evaluation, calibration, tmp_path_factory):
    return SP.prepare_dataset(evaluation.forum, evaluation.review, evaluation.response, calibration,
                              str(tmp_path_factory.mktemp("ds")), seed=42)


# --- evidence ---------------------------------------------------------------------------


def pick(c, **kw):
    return E.select_evidence(c.forum, c.review, c.response, **kw)


def test_evidence_is_seeded_and_independent_of_partitioning(spark, twelve):
    ids = lambda df: sorted(r.evidence_id for r in df.collect())
    base = ids(pick(twelve, seed=42, per_bucket=2))
    moved = type(twelve)(twelve.forum.repartition(5), twelve.review.repartition(7), twelve.response)
    assert ids(pick(moved, seed=42, per_bucket=2)) == base
    assert ids(pick(twelve, seed=7, per_bucket=2)) != base
    assert len(ids(pick(twelve, seed=42, max_items=5))) == 5
    assert ids(pick(twelve, seed=42, per_bucket=0)) == []
    assert len(ids(pick(twelve, seed=1, per_bucket=1000, max_items=1000))) == 21


def test_evidence_categories(twelve):
    rows = {r.note_id: r for r in E.candidates(twelve.forum, twelve.review, twelve.response).collect()}
    designated = sorted(r.rating_value for r in rows.values())
    lo, hi = designated[len(designated) // 3], designated[2 * len(designated) // 3]
    for r in rows.values():
        assert r.rating_bucket == ("low" if r.rating_value < lo else "high" if r.rating_value > hi else "medium")
    assert rows["f03_r2"].rating_designation == "final" and rows["f03_r2"].rating_value == 7.0
    # ranges: f01 2, f03 2, f05 2, f07 1, f08 1, f09 1, f10 1, f12 4 -> median 1.5
    assert rows["f12_r1"].disagreement_bucket == "high" and rows["f07_r1"].disagreement_bucket == "low"
    assert rows["f02_r1"].disagreement_bucket == "insufficient_data"
    assert rows["f01_r1"].rebuttal_bucket == "present" and rows["f02_r1"].decision_bucket == "rejected"


def test_evidence_skips_empty_text_and_held_out(spark, twelve):
    empty = make_corpus(spark, [("only", "v", 2024, "accept", [5.0], 0)], text="")
    blank = empty.review.withColumns({c: F.lit("") for c in ("strengths", "weaknesses", "summary")})
    assert E.select_evidence(empty.forum, blank, empty.response, seed=1).count() == 0
    held = spark.createDataFrame([("f01",), ("f03",)], "forum_id string")
    got = pick(twelve, seed=42, per_bucket=100, held_out=held)
    assert not {"f01", "f03"} & {r.forum_id for r in got.collect()}
    assert "strata" in E.with_strata(got).columns


def test_reviews_without_an_id_share_one_item(twelve):
    bare = twelve.review.withColumn("note_id", F.lit(None).cast("string"))
    ids = [r.evidence_id for r in E.select_evidence(twelve.forum, bare, twelve.response, seed=1).collect()]
    assert len(ids) == len(set(ids)) == 12


def test_large_buckets_use_cutoffs(twelve):
    cands = E.candidates(twelve.forum, twelve.review, twelve.response)
    pairs = lambda df: {(r.axis, r.category, r.note_id) for r in df.collect()}
    assert pairs(E.stratified_sample(cands, 1, 5000)) == pairs(E.by_axis(cands))


def test_quotas_are_exact_whatever_their_size(spark, twelve):
    ids = [str(i) for i in range(3000)]
    rows = spark.createDataFrame([("f01", i, i, "initial", float(int(i) % 7), "a") for i in ids],
                                 "forum_id string, note_id string, content_hash string, "
                                 "rating_designation string, rating_value double, axis_a string")
    sizes = {k: E.stratified_sample(rows, 3, k, ["axis_a"]).count() for k in (0, 1, 1000, 1001, 2999, 5000)}
    assert sizes == {k: min(k, 3000) for k in sizes}
    few, many = ({r.note_id for r in E.stratified_sample(rows, 3, k, ["axis_a"]).collect()} for k in (1000, 1001))
    assert few < many
    bare = rows.withColumn("note_id", F.lit(""))
    for k in (1000, 1001):
        (row,) = E.stratified_sample(bare, 3, k, ["axis_a"]).collect()
        assert row.content_hash == min(ids)


def test_canonical_order(twelve):
    rows = canonical_order(twelve.forum.repartition(5)).collect()
    assert [r.forum_id for r in rows] == [
        "f01", "f02", "f03", "f04", "f05", "f06", "f12", "f07", "f08", "f09", "f10", "f11"]


def test_redacted_tier_is_refused(twelve):
    cut = twelve.review.withColumn("text", F.struct(F.lit("a").alias("excerpt")))
    with pytest.raises(ValueError):
        E.select_evidence(twelve.forum, cut, twelve.response, seed=1)


def test_valid_bundle_has_no_violation(twelve):
    items = pick(twelve, seed=42).withColumn("corpus_hash", F.lit("h"))
    assert E.validate_bundle(items, twelve.forum, twelve.review).count() == 0
    header = E.bundle_header(items, seed=42, corpus_hash="h", generated_at="t").first()
    assert header["count"] == items.count() and len(header.bundle_hash) == 16


@pytest.mark.parametrize("change,rule", [
    ({"forum_id": "nope"}, "unknown_forum"), ({"note_id": "nope"}, "unknown_note"),
    ({"content_hash": "0"}, "content_hash_mismatch"), ({"excerpt_text": "zzz"}, "excerpt_not_prefix"),
    ({"venue_family": "zz"}, "venue_year_mismatch"), ({"source_url": ""}, "missing_field.source_url"),
])
def test_tampered_bundle(twelve, change, rule):
    items = pick(twelve, seed=42, max_items=1).withColumn("corpus_hash", F.lit("h"))
    bad = items.withColumns({k: F.lit(v) for k, v in change.items()})
    assert [r for _, r in rules(E.validate_bundle(bad, twelve.forum, twelve.review))] == [rule]


def test_bundle_duplicates_and_overlap(spark, twelve):
    items = pick(twelve, seed=42, max_items=1).withColumn("corpus_hash", F.lit("h"))
    got = E.validate_bundle(items.union(items).union(items), twelve.forum, twelve.review, twelve.forum)
    rows = {r.rule: r.n for r in got.groupBy("rule").agg(F.sum("n").alias("n")).collect()}
    assert rows == {"duplicate_evidence_id": 2, "held_out_overlap": 3}


# --- split ------------------------------------------------------------------------------


def test_reasons_and_labels(spark):
    c = make_corpus(spark, [
        ("e01", "iclr", 2025, "accept", [6.0, 8.0], 0), ("e03", "iclr", 2024, "withdrawn", [5.0], 0),
        ("e04", "iclr", 2024, "desk_reject", [], 0), ("e06", "n", 2025, "accept", [(9.0, 7.0)], 0),
        ("e07", "n", 2024, "unknown", [], 0), ("c01", "iclr", 2025, "accept", [7.0], 0),
        ("e08", "n", None, "reject", [], 0)])
    c.forum = c.forum.withColumns({t: F.when(F.col("forum_id") == "e08", "").otherwise(F.col(t))
                                   for t in ("title", "abstract")})
    cal = spark.createDataFrame([("c01",), ("c01",), ("zz",)], "forum_id string")
    got = {r.forum_id: r.reason for r in SP.select_evaluation_forums(c.forum, c.review, cal).collect()}
    assert got == {"e01": None, "e03": None, "e04": "no_usable_labels", "e06": None, "e07": "no_usable_labels",
                   "c01": "in_calibration_set", "e08": "missing_paper_content"}
    labels = {r.forum_id: r for r in SP.private_labels(c.forum, c.review).collect()}
    assert labels["e01"].initial_rating_target == 7.0 and labels["e06"].initial_rating_target == 9.0
    assert labels["e03"].final_decision_excluded_reason == "withdrawn" and not labels["e03"].final_decision_eligible
    assert labels["e07"].final_decision_excluded_reason == "unresolved"
    assert labels["e08"].venue_year == "unspecified"


def test_quotas_are_proportional_and_exact(spark):
    forums = [(f"a{i}", "iclr", 2025, "accept", [5.0], 0) for i in range(15)]
    forums += [(f"b{i}", "iclr", 2024, "accept", [5.0], 0) for i in range(10)]
    forums += [(f"c{i}", "neurips", 2025, "accept", [5.0], 0) for i in range(5)]
    c = make_corpus(spark, forums)
    none = spark.createDataFrame([], "forum_id string")

    def run(n, seed=1):
        df = SP.select_evaluation_forums(c.forum, c.review, none, max_forums=n, seed=seed)
        return {r.forum_id for r in df.where("reason is null").collect()}

    kept = run(12)
    assert [sum(x.startswith(p) for x in kept) for p in "abc"] == [6, 4, 2]
    assert len(run(7)) == 7 and len(run(30)) == 30 and len(run(99)) == 30 and len(run(1)) == 1
    assert run(12) == kept and run(12, seed=2) != kept
    with pytest.raises(ValueError):
        run(0)


def test_dataset(spark, dataset, evaluation, calibration):
    assert dataset.inputs.columns == list(S.MODEL_INPUT_FIELDS)
    m = dataset.manifest.first()
    assert (m.eval_forum_count, m.initial_rating_eligible_count, m.final_decision_eligible_count) == (8, 8, 6)
    assert SP.overlap(dataset.inputs, calibration).isEmpty()
    counts = {r.reason: r.n for r in SP.exclusion_counts(dataset.split).collect()}
    assert counts == {"in_calibration_set": 4}


def test_leak_detection(spark, evaluation, calibration, tmp_path):
    leaky = evaluation.forum.withColumn("abstract", F.when(
        F.col("forum_id") == "eval_003",
        F.lit("PREFIX REVIEW eval_003_r1: THE METHOD IS CLEARLY DESCRIBED.")).otherwise(F.col("abstract")))
    got = SP.text_leaks(SP.model_inputs(leaky), evaluation.review, evaluation.response, leaky).collect()
    assert [(r.entity_id, r.detail) for r in got] == [("eval_003", "review.text:eval_003_r1")]
    with pytest.raises(ValueError, match="leaked"):
        SP.prepare_dataset(leaky, evaluation.review, evaluation.response, calibration, str(tmp_path), seed=1)
    assert not (tmp_path / "manifest").exists()


@pytest.mark.parametrize("table,column", [("review", "questions"), ("response", "text"), ("forum", "decision_raw")])
def test_leak_check_needs_all_texts(evaluation, calibration, tmp_path, table, column):
    given = {t: getattr(evaluation, t) for t in ("forum", "review", "response")}
    given[table] = given[table].drop(column)
    with pytest.raises(ValueError, match=column):
        SP.prepare_dataset(*given.values(), calibration, str(tmp_path), seed=1)


def test_empty_split_raises(evaluation, tmp_path):
    with pytest.raises(ValueError, match="no evaluation forums"):
        SP.prepare_dataset(evaluation.forum, evaluation.review, evaluation.response,
                           evaluation.forum.select("forum_id"), str(tmp_path), seed=1)


# --- scores -----------------------------------------------------------------------------


def test_worked_example(dataset, predictions, evaluation, calibration):
    got = {(r.system, r.metric): r.value for r in SC.score(dataset.labels, predictions).collect()}
    want = {"mae": (1.0042, 0.1958), "median_absolute_error": (1.0167, 0.2), "spearman": (0.8383, 1.0),
            "accuracy": (0.5, 1.0), "precision": (0.5, 1.0), "recall": (1.0, 1.0), "f1": (0.6667, 1.0)}
    for metric, (generic, calibrated) in want.items():
        assert (got["generic", metric], got["calibrated", metric]) == (generic, calibrated)
    assert got["generic", "brier_score"] is None

    base = SP.calibration_aggregate(evaluation.forum, evaluation.review, calibration)
    assert tuple(base.first()) == (4, 5.1429, "accept")
    constant = SP.baseline_predictions(dataset.inputs, base)
    got = {r.metric: r.value for r in SC.score(dataset.labels, constant).collect()}
    assert (got["mae"], got["median_absolute_error"], got["spearman"]) == (1.5417, 1.5, None)
    assert (got["accuracy"], got["f1"]) == (0.5, 0.6667)

    deltas = {r.metric: r.delta for r in SC.deltas(SC.score(dataset.labels, predictions)).collect()}
    assert deltas["mae"] == -0.8084 and deltas["spearman"] == 0.1617 and deltas["ece"] is None


def test_no_calibration_forum_in_corpus_gives_no_baseline(spark, evaluation):
    other = spark.createDataFrame([("zz",)], "forum_id string")
    assert SP.calibration_aggregate(evaluation.forum, evaluation.review, other).count() == 0


def pairs(spark, rows):
    return spark.createDataFrame([("g", a, p, 1) for a, p in rows],
                                 "system string, actual double, predicted double, n bigint")


@pytest.mark.parametrize("rows,mae,median,rho", [
    ([(1, 2), (2, 2), (3, 6)], 1.3333, 1.0, 0.866), ([(0, 1), (0, 3), (0, 5), (0, 9)], 4.5, 4.0, None),
    ([(1, 2), (2, 1), (3, 3)], 0.6667, 1.0, 0.5), ([(1, 10), (2, 20), (3, 30), (4, 40)], 22.5, 22.5, 1.0),
    ([(1, 1)], 0.0, 0.0, None),
])
def test_rating_metrics(spark, rows, mae, median, rho):
    rows = [(float(a), float(p)) for a, p in rows]
    r = SC.rating_metrics(pairs(spark, rows), ["system"]).first()
    assert (r.mae, r.median_absolute_error, r.spearman) == (mae, median, rho)
    assert r.sample_size == len(rows)


def test_pearson_of_constant_is_null(spark):
    assert SC.pearson(pairs(spark, [(1.0, 5.0), (2.0, 5.0)]), ["system"]).first().pearson is None
    r = SC.pearson(pairs(spark, [(1.0, 1.0), (2.0, 3.0), (3.0, 5.0)]), ["system"]).first()
    assert r.pearson == pytest.approx(1.0)


def test_confusion(spark):
    rows = [("accept", "accept", 2), ("accept", "reject", 1), ("reject", "accept", 1), ("reject", "reject", 1)]
    df = spark.createDataFrame([("g", *r) for r in rows], "system string, actual string, predicted string, n bigint")
    r = SC.decision_metrics(df, ["system"]).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.6, 0.6667, 0.6667, 0.6667)
    none = SC.classification(lit_row(spark, tp=0, fn=0, fp=0, tn=0)).first()
    assert (none.accuracy, none.precision, none.recall, none.f1) == (None, None, None, None)
    bad = SC.classification(lit_row(spark, tp=0, fn=2, fp=2, tn=0)).first()
    assert (bad.precision, bad.recall, bad.f1) == (0.0, 0.0, 0.0)


def paired(spark, rows, system="g"):
    return spark.createDataFrame(
        [(system, True, "accept" if a else "reject", p) for a, p in rows],
        "system string, final_decision_eligible boolean, final_decision_target string, accept_probability double")


def test_probability_gate(spark):
    exact = paired(spark, [(1, 1.0), (1, 1.0), (0, 0.0), (0, 0.0)] * 5)
    r = SC.probability_metrics(exact, exact).first()
    assert (r.computed, r.brier_score, r.ece) == (True, 0.0, 0.0)
    some = paired(spark, [(1, 0.8), (0, 0.3), (1, 0.4)])
    r = SC.probability_metrics(some, some).first()
    assert (r.computed, r.reason, r.brier_score) == (False, "sample_size_below_20 (n=3)", None)
    assert SC.probability_metrics(some, some, min_n=3).first().brier_score == 0.1633
    none = paired(spark, [(1, None)])
    assert SC.probability_metrics(none, none).first().reason == "no accept_probability values present"


def test_breakdown_coverage_and_warnings(dataset, predictions):
    p = SC.pair(dataset.labels, predictions)
    metrics = SC.rating_metrics(SC.overall_and_scopes(SC.rating_pairs(p)), SC.KEYS)
    rows = SC.breakdown(metrics).collect()
    assert len(rows) == 8 and {r.skipped_reason for r in rows} == {"sample_size_below_5"}
    assert all(r.mae is None for r in rows)
    cov = SC.coverage(dataset.labels, p, predictions)
    assert {(r.task, r.eligible, r.predicted, r.coverage) for r in cov.collect()} == {
        ("initial_rating", 8, 8, 1.0), ("final_decision", 6, 6, 1.0)}
    warned = SC.warnings(cov, dataset.inputs).collect()
    assert len(warned) == 4 and {r.warning for r in warned} == {"small_sample"}
    one = SC.warnings(cov, dataset.inputs.where("venue_family = 'iclr'")).collect()
    assert sum(r.warning == "single_venue_family" for r in one) == 2


# --- run checks -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def runs(spark, dataset):
    m = dataset.manifest.first()
    row = lambda s, cal: (f"{s}_run", s, "m", '{"temperature": 0}', m.model_inputs_hash, cal, "t")
    return spark.createDataFrame([row("generic", "none"), row("calibrated", m.calibration_hash)], S.RUN)


def report(dataset, cal, headers, preds, **swap):
    parts = {"inputs": dataset.inputs, "labels": dataset.labels, "calibration": cal,
             "manifest": dataset.manifest, "split_manifest": dataset.manifest, "runs": headers,
             "predictions": preds.withColumn("position", F.lit(0))} | swap
    return sorted({r.rule for r in R.leakage_report(**parts).collect()})


def test_clean_report(dataset, calibration, runs, predictions):
    assert report(dataset, calibration, runs, predictions) == []


def test_report_collects_everything(spark, dataset, calibration, runs, predictions):
    p = predictions.withColumn("position", F.lit(0))
    extra = p.limit(1).withColumn("forum_id", F.lit("stranger"))
    assert report(dataset, calibration, runs, predictions, predictions=p.union(extra)) == [
        "forum_sets_differ", "outside_evaluation_set"]
    assert report(dataset, calibration, runs, predictions, predictions=p.union(p.limit(1))) == ["duplicate_forum_id"]
    assert report(dataset, calibration, runs, predictions, labels=dataset.labels.limit(3)) == ["private_labels_tampered"]
    assert report(dataset, calibration, runs, predictions, inputs=dataset.inputs.withColumn(
        "decision", F.lit("x"))) == ["disallowed_fields"]
    forged = calibration.union(spark.createDataFrame([("eval_001",)], "forum_id string"))
    assert report(dataset, forged, runs, predictions) == ["calibration_evaluation_overlap", "calibration_ids_tampered"]
    swapped = runs.withColumn("calibration_hash", F.lit("zz"))
    assert report(dataset, calibration, swapped, predictions) == ["calibration_hash_stale", "generic_run_is_calibrated"]
    one = runs.where("system = 'generic'").withColumn("model", F.lit(""))
    assert "calibrated_run_missing" in report(dataset, calibration, one, predictions)


@pytest.mark.parametrize("change,rule", [
    ({"decision_prediction": "maybe"}, "decision_not_allowed"), ({"accept_probability": 1.5}, "probability_not_in_range"),
    ({"forum_id": ""}, "missing_forum_id"), ({"rating_prediction": float("nan")}, "rating_not_numeric"),
])
def test_prediction_rules(predictions, change, rule):
    one = predictions.limit(1).withColumn("position", F.lit(3)).withColumns({k: F.lit(v) for k, v in change.items()})
    assert [r for _, r in rules(R.prediction_rules(one))] == [rule]


def test_json_predictions(spark):
    body = ('{"predictions": [{"forum_id": "a", "rating_prediction": true}, {"forum_id": "b", "rating_prediction": 5, '
            '"accept_probability": 0.5, "decision_prediction": null}, {"rating_prediction": "x", '
            '"decision_prediction": "maybe", "accept_probability": -1}]}')
    rows = R.parse_predictions(lit_row(spark, system="generic", json=body))
    assert rules(R.variant_schema_rules(rows)) == [
        ("#2", "decision_not_allowed"), ("#2", "missing_forum_id"), ("#2", "probability_not_in_range"),
        ("#2", "rating_not_numeric"), ("a", "rating_not_numeric")]
    typed = {r.forum_id: r.rating_prediction for r in R.typed_predictions(rows).collect()}
    assert typed == {"a": None, "b": 5.0, None: None}


def test_membership(predictions, dataset):
    fewer = predictions.where("forum_id <> 'eval_002' or system = 'generic'")
    got = R.missing_predictions(fewer, dataset.inputs).collect()
    assert [(r.system, r.forum_id) for r in got] == [("calibrated", "eval_002")]
    assert R.outside_dataset(fewer, dataset.inputs).count() == 0
    differ = R.forum_set_differences(fewer, "generic", "calibrated").collect()
    assert [(r.forum_id, r.only_in) for r in differ] == [("eval_002", "generic")]


def test_evaluate_scores_or_refuses(spark, dataset, calibration, runs, predictions, tmp_path):
    aggregate = spark.createDataFrame([(2, 5.0, "accept")], "calibration_forum_count bigint, mean_initial_rating double, majority_decision string")
    ev = EV.evaluate(dataset, calibration, aggregate, runs, predictions, str(tmp_path / "ok"))
    assert {r.system for r in ev.scores.select("system").distinct().collect()} == {"generic", "calibrated", "baseline"}
    assert ev.missing.isEmpty() and not ev.coverage.isEmpty() and not ev.deltas.isEmpty() and not ev.warnings.isEmpty()
    plain = SC.score(dataset.labels, predictions).collect()
    assert set(plain) <= set(ev.scores.collect())
    stale = runs.withColumn("input_hash", F.lit("stale"))
    with pytest.raises(EV.EvaluationRefused, match="stale") as refused:
        EV.evaluate(dataset, calibration, aggregate, stale, predictions, str(tmp_path / "no"))
    assert not refused.value.violations.isEmpty() and not (tmp_path / "no" / "scores").exists()
