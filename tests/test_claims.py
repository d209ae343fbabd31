"""Claim rules, reference resolution, attribution and venue look-up."""

import pytest

from colloquy import schema as S
from colloquy.operators import claims as C
from tests.conftest import lit_row, rules

STATS = [
    ("forum_count", "fam", "2024", "", 5.0), ("forum_count", "fam", "2025", "", 3.0),
    ("forum_count", "fam", "all", "", 8.0), ("paper_mean_rating", "fam", "2024", "mean", 5.0),
    ("missing_rate.decision", "fam", "2024", "", 0.5), ("rating_distribution_raw", "fam", "2024", "6.0", 2.0),
    ("rating_decision_crosstab", "fam", "2024", "accept.low", 1.0),
    ("decision_distribution", "fam", "all", "accept", 6.0), ("decision_distribution", "fam", "all", "unknown", 2.0),
]
GOOD = {"claim_id": "c1", "section": "score_calibration", "claim_type": "deterministic_fact",
        "text": "The mean rating is 5.0.", "evidence_ids": [], "statistic_refs": ["fam/2024/paper_mean_rating.mean"],
        "year_scope": ["2024"], "support_level": "strong", "limitations": ["small sample"]}


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame(STATS, "metric string, venue_family string, venue_year string, path string, value double")


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame(
        [("ev1", "fam", "2024", "f1", "n1", "u1", "The paper lacks sufficient baselines for comparison.")],
        "evidence_id string, venue_family string, venue_year string, forum_id string, note_id string, "
        "source_url string, excerpt_text string")


def claims(spark, *changes):
    rows = [tuple((GOOD | c)[f] for f in S.CLAIM.fieldNames()) + (i,) for i, c in enumerate(changes)]
    from pyspark.sql.types import LongType, StructField, StructType

    return spark.createDataFrame(rows, StructType([*S.CLAIM.fields, StructField("claim_no", LongType())]))


EXCERPT = {"claim_type": "evidence_excerpt", "evidence_ids": ["ev1"], "statistic_refs": [],
           "text": '"lacks sufficient baselines"'}


@pytest.mark.parametrize("change,want", [
    ({}, []), (EXCERPT, []), ({"statistic_refs": ["fam/all/forum_count"], "year_scope": ["2024", "2025"]}, []),
    ({"claim_id": ""}, ["missing_claim_id"]), ({"section": "x"}, ["unknown_section"]),
    ({"claim_type": "x"}, ["unknown_claim_type"]), ({"support_level": None}, ["unknown_support_level"]),
    ({"limitations": []}, ["missing_limitations"]),
    ({"evidence_ids": ["nope"]}, ["unknown_evidence"]),
    ({"statistic_refs": ["fam/2024/nope"], "year_scope": []}, ["unresolved_reference"]),
    ({"statistic_refs": [], "year_scope": []}, ["number_without_reference"]),
    (EXCERPT | {"evidence_ids": [], "year_scope": []}, ["excerpt_without_evidence"]),
    (EXCERPT | {"text": "invented quote"}, ["quote_not_verbatim"]),
    (EXCERPT | {"text": '""'}, ["quote_not_verbatim"]),
    (EXCERPT | {"evidence_ids": ["nope"], "year_scope": []}, ["quote_not_verbatim", "unknown_evidence"]),
    ({"year_scope": ["1999"]}, ["unknown_year"]), ({"year_scope": ["2025"]}, ["year_beyond_evidence"]),
])
def test_rules(spark, stats, evidence, change, want):
    got = C.validate_claims(claims(spark, change), stats, evidence)
    assert sorted(r for _, r in rules(got)) == want


def test_duplicates_are_counted(spark, stats, evidence):
    got = C.validate_claims(claims(spark, {}, {}, {}), stats, evidence).collect()
    assert [(r.rule, r.n) for r in got] == [("duplicate_claim_id", 2)]


@pytest.mark.parametrize("ref,literal,strict,value", [
    ("fam/2024/forum_count", True, True, 5.0), ("fam/2024/paper_mean_rating.mean", True, True, 5.0),
    ("fam/2024/paper_mean_rating", True, True, None), ("fam/2024/paper_mean_rating.mode", False, False, None),
    ("fam/2024/missing_rate.decision", True, False, 0.5), ("fam/2024/rating_distribution_raw.6.0", True, False, 2.0),
    ("fam/2024/rating_decision_crosstab.accept", True, True, None),
    ("fam/2024/rating_decision_crosstab.accept.low", True, True, 1.0),
    ("fam/2024", False, False, None), ("fam//forum_count", False, False, None), ("x/2024/forum_count", False, False, None),
])
def test_references(spark, stats, ref, literal, strict, value):
    c = claims(spark, {"statistic_refs": [ref]})
    row = C.resolve_refs(c, stats).first()
    assert (row.resolved, row.ref_value) == (literal, value)
    assert C.resolve_refs(c, stats, dotted_keys=False).first().resolved == strict


def test_attribution_and_packs(spark, stats, evidence):
    loose = {"statistic_refs": [], "claim_id": "c2", "text": "no number"}
    c = claims(spark, {}, loose)
    assert [r.venue_family for r in C.claim_families(c, stats, evidence).collect()] == ["fam", "fam"]
    two = stats.union(spark.createDataFrame([("forum_count", "other", "all", "", 1.0)], stats.schema))
    got = {r.claim_id: r.venue_family for r in C.claim_families(c, two, evidence).collect()}
    assert got == {"c1": "fam", "c2": None}  # NULL is the ambiguous attribution
    pack = C.venue_packs(c, stats, evidence).first()
    assert (pack.years_covered, pack.forum_count, pack.decisions_resolved, pack.preliminary,
            pack.evidence_count, pack.claim_count) == ("2024,2025", 8, 6, True, 1, 2)


def test_packs_need_valid_claims(spark, stats, evidence):
    head = lambda corpus: lit_row(spark, corpus_hash=corpus, schema_version=1)
    packs = lambda change, corpus="a": C.checked_venue_packs(
        claims(spark, change), stats, evidence, head("a"), head(corpus))
    assert packs({}).first().claim_count == 1
    with pytest.raises(ValueError, match="claims are refused: unknown_section"):
        packs({"section": "x"})
    with pytest.raises(ValueError, match="inputs are refused: corpora_differ"):
        packs({}, "b")


def test_report_order_and_sources(spark, evidence):
    c = claims(spark, {"section": "reject_signals", "claim_id": "b"}, EXCERPT | {"claim_id": "a"})
    rows = C.report_rows(c, evidence).orderBy("section_no", "claim_id").collect()
    assert [(r.section_no, r.claim_id, r.sources) for r in rows] == [(1, "a", "f1 n1 u1"), (3, "b", "")]


def test_inputs_match(spark):
    h = lambda corpus, v: lit_row(spark, corpus_hash=corpus, schema_version=v)
    assert C.inputs_match(h("a", 1), h("a", 1)).count() == 0
    assert [r for _, r in rules(C.inputs_match(h("a", 2), h("b", 1)))] == ["corpora_differ", "statistics_schema_version"]
    assert [r for _, r in rules(C.inputs_match(h("", 1), h("", 1)))] == ["corpora_differ"]


@pytest.mark.parametrize("text,error,n", [
    ('{"claims": [1, 2]}', None, 2), ('```json\n{"claims": []}\n```', None, 0), ("oops", "not_json", None),
    ("[1]", "no_claims", None), ('{"a": 1}', "no_claims", None), ('{"claims": 3}', "claims_not_a_list", None),
])
def test_parse_generated(spark, text, error, n):
    r = C.parse_responses(lit_row(spark, raw_text=text)).first()
    assert r.error == error and (n is None or len(r.claims) == n)


def test_venue_lookup(spark):
    aliases = S.venue_aliases(spark).union(spark.createDataFrame([("acl", "nips")], "family string, alias string"))
    names = [" ICLR ", "neural", "nips", "International  conference on LEARNING representations", "", None]
    q = spark.createDataFrame([(n,) for n in names], "query string")
    got = {r.query: (r.status, r.family, r.candidates) for r in C.resolve_venues(q, aliases).collect()}
    assert got[" ICLR "] == ("supported", "iclr", None) and got[names[3]] == ("supported", "iclr", None)
    assert got["nips"] == ("ambiguous", None, "acl,neurips")
    assert got["neural"] == got[""] == got[None] == ("unsupported", None, None)
    assert [(r.name, r.families) for r in C.alias_collisions(aliases).collect()] == [("nips", "acl,neurips")]
