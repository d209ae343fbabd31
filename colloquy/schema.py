"""Table schemas, registries and fixed vocabularies of the peer-review model.

Compute happens on three flat tables, so that a discussion with very many
reviews is many rows and never one huge record:

``forum``     one row per paper, with decision and refresh state
``review``    one row per review, keyed by ``forum_id``
``response``  one row per author or committee reply, keyed by ``forum_id``

The nested record (reviews and responses as arrays) is the exchange format; see
``sources.corpus`` for how oversized forums are cut into parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values: formats, limits and defaults that results depend on ------------------

SCHEMA_VERSION = 1
STATISTICS_SCHEMA_VERSION = 1
EVIDENCE_SCHEMA_VERSION = 1
EVALUATION_SCHEMA_VERSION = 1
PRODUCER_VERSION = "0.1.0"

FORUM_URL_PREFIX = "https://openreview.net/forum?id="

YEAR_ALL = "all"
YEAR_UNSPECIFIED = "unspecified"
FAMILY_UNKNOWN = "unknown"

PUBLIC_EXCERPT_CHARS = 280
EVIDENCE_EXCERPT_CHARS = 600
EVIDENCE_MAX_ITEMS = 60
EVIDENCE_PER_BUCKET = 4

REFRESH_MAX_ATTEMPTS = 6
REFRESH_BASE_HOURS = 24
REFRESH_EXPIRY_DAYS = 180
REFRESH_BACKOFF_CAP = 6

MIN_LEAK_CHARS = 25
BREAKDOWN_MIN_N = 5
PROBABILITY_MIN_N = 20
SMALL_SAMPLE_N = 20
NO_CALIBRATION = "none"
PRELIMINARY_FORUMS = 50
PRELIMINARY_YEARS = 2

RATING_AGGREGATION = "mean_of_initial_ratings"
INPUT_TIER = "abstract_only"

EVIDENCE_AXES = (
    "decision_bucket",
    "rating_bucket",
    "year",
    "disagreement_bucket",
    "rebuttal_bucket",
)

TERMINAL_STATUSES = (
    "finalized",
    "withdrawn",
    "desk_rejected",
    "unavailable",
    "refresh_expired",
)

CLAIM_SECTIONS = (
    "score_calibration",
    "accept_signals",
    "reject_signals",
    "hidden_criteria",
    "reviewer_language_patterns",
    "year_over_year_drift",
    "rebuttal_effectiveness",
)
CLAIM_TYPES = (
    "deterministic_fact",
    "evidence_excerpt",
    "statistical_pattern",
    "llm_interpretation",
    "insufficient_evidence",
)
SUPPORT_LEVELS = ("strong", "limited", "single_instance", "none")

RESOLVED_DECISIONS = ("accept", "reject")
SYSTEM_GENERIC = "generic"
SYSTEM_CALIBRATED = "calibrated"
SYSTEM_BASELINE = "baseline"
SYSTEMS = (SYSTEM_GENERIC, SYSTEM_CALIBRATED, SYSTEM_BASELINE)
EXCLUDED_CALIBRATION = "in_calibration_set"
EXCLUDED_NO_LABELS = "no_usable_labels"
EXCLUDED_NO_PAPER = "missing_paper_content"

# (display name, venue id, API version, family)
VENUES = (
    ("ICLR 2026", "ICLR.cc/2026/Conference", "v2", "iclr"),
    ("ICLR 2025", "ICLR.cc/2025/Conference", "v2", "iclr"),
    ("ICLR 2024", "ICLR.cc/2024/Conference", "v2", "iclr"),
    ("ICLR 2023", "ICLR.cc/2023/Conference", "v2", "iclr"),
    ("NeurIPS 2025", "NeurIPS.cc/2025/Conference", "v2", "neurips"),
    ("NeurIPS 2024", "NeurIPS.cc/2024/Conference", "v2", "neurips"),
    ("NeurIPS 2023", "NeurIPS.cc/2023/Conference", "v2", "neurips"),
    ("ICML 2025", "ICML.cc/2025/Conference", "v2", "icml"),
    ("ICML 2024", "ICML.cc/2024/Conference", "v2", "icml"),
    ("ICML 2023", "ICML.cc/2023/Conference", "v1", "icml"),
    ("TMLR", "TMLR", "v1", "icml"),
    ("ACL 2025", "aclweb.org/ACL/2025/Conference", "v2", "acl"),
    ("ACL 2024", "aclweb.org/ACL/2024/Conference", "v2", "acl"),
    ("ACL 2023", "aclweb.org/ACL/2023/Conference", "v2", "acl"),
    ("EMNLP 2025", "EMNLP/2025/Conference", "v2", "acl"),
    ("EMNLP 2024", "EMNLP/2024/Conference", "v2", "acl"),
    ("EMNLP 2023", "EMNLP/2023/Conference", "v2", "acl"),
    ("NAACL 2025", "NAACL/2025/Conference", "v2", "acl"),
    ("NAACL 2024", "NAACL/2024/Conference", "v2", "acl"),
    ("CoLM 2024", "colmweb.org/COLM/2024/Conference", "v2", "acl"),
    ("CVPR 2025", "thecvf.com/CVPR/2025/Conference", "v2", "cvpr"),
    ("CVPR 2024", "thecvf.com/CVPR/2024/Conference", "v2", "cvpr"),
    ("CVPR 2023", "thecvf.com/CVPR/2023/Conference", "v2", "cvpr"),
    ("ICCV 2023", "thecvf.com/ICCV/2023/Conference", "v2", "cvpr"),
    ("ECCV 2024", "thecvf.com/ECCV/2024/Conference", "v2", "cvpr"),
    ("AAAI 2026", "AAAI.org/2026/Conference", "v2", "aaai"),
    ("AAAI 2025", "AAAI.org/2025/Conference", "v2", "aaai"),
    ("AAAI 2024", "AAAI.org/2024/Conference", "v2", "aaai"),
    ("AAAI 2023", "AAAI.org/2023/Conference", "v2", "aaai"),
    ("IJCAI 2024", "ijcai.org/2024/Conference", "v2", "aaai"),
    ("IJCAI 2023", "ijcai.org/2023/Conference", "v2", "aaai"),
    ("KDD 2024", "KDD.org/2024/Conference", "v2", "kdd"),
    ("KDD 2023", "KDD.org/2023/Conference", "v2", "kdd"),
)
ACTIVE_CYCLES = ("ICLR 2026", "AAAI 2026")

# (family, alias)
VENUE_ALIASES = (
    ("iclr", "International Conference on Learning Representations"),
    ("neurips", "NeurIPS"),
    ("neurips", "Conference on Neural Information Processing Systems"),
    ("neurips", "NIPS"),
    ("icml", "International Conference on Machine Learning"),
    ("cvpr", "Conference on Computer Vision and Pattern Recognition"),
    ("acl", "Association for Computational Linguistics"),
    ("aaai", "Association for the Advancement of Artificial Intelligence"),
    ("kdd", "Knowledge Discovery and Data Mining"),
)
# --- End of fixed values ----------------------------------------------------------------

REBUTTAL_NOTE = (
    "Observational, not causal: a forum counts as rebuttal-present when it has at least "
    "one response note, which is a proxy for a rebuttal and not a treatment assignment."
)

_TYPES = {
    "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(),
    "BIGINT": T.LongType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _struct(fields: str) -> T.StructType:
    """A struct from ``name TYPE, ...``; unlike DDL parsing it needs no session."""
    out = T.StructType()
    for field in fields.split(", "):
        name, kind = field.split(" ")
        out.add(name, _TYPES[kind])
    return out


RATING = _struct(
    "raw STRING, value DOUBLE, label STRING, scale_min DOUBLE, scale_max DOUBLE"
)
EXCERPT = _struct("excerpt STRING, length INT, hash STRING")
PAPER = _struct("title STRING, abstract STRING, keywords STRING, authors STRING")
DECISION = _struct(
    "raw_text STRING, normalized STRING, category STRING, note_id STRING"
)
REFRESH = _struct(
    "status STRING, terminal_reason STRING, last_checked_at DOUBLE, "
    "refresh_attempts INT, next_refresh_at DOUBLE"
)
REVIEW_TEXTS = ("text", "strengths", "weaknesses", "questions", "summary")


def _review(text_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("note_id", "string")
        .add("invitation", "string")
        .add("initial_rating", RATING)
        .add("final_rating", RATING)
        .add("confidence", RATING)
        .add("summary", text_type)
        .add("text", text_type)
        .add("strengths", text_type)
        .add("weaknesses", text_type)
        .add("questions", text_type)
        .add("modified_at", "double")
        .add("content_hash", "string")
    )


def _response(text_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("note_id", "string")
        .add("kind", "string")
        .add("text", text_type)
        .add("modified_at", "double")
        .add("content_hash", "string")
    )


def _forum(text_type: T.DataType) -> T.StructType:
    return (
        T.StructType()
        .add("forum_id", "string")
        .add("part", "integer")  # 0, or the number of a part of an oversized record
        .add("url", "string")
        .add("venue_family", "string")
        .add("venue_id", "string")
        .add("venue_year", "integer")
        .add("api_version", "string")
        .add("paper", PAPER)
        .add("decision", DECISION)
        .add("reviews", T.ArrayType(_review(text_type)))
        .add("responses", T.ArrayType(_response(text_type)))
        .add("schema_version", "integer")
        .add("fetched_at", "double")
        .add("producer_version", "string")
        .add("sampling_method", "string")
        .add("sampling_seed", "integer")
        .add("retrieval_errors", T.ArrayType(T.StringType()))
        .add("refresh", REFRESH)
    )


# The tier is a property of the schema: full text, or excerpt structs in its place.
REVIEW_FULL, REVIEW_PUBLIC = _review(T.StringType()), _review(EXCERPT)
RESPONSE_FULL, RESPONSE_PUBLIC = _response(T.StringType()), _response(EXCERPT)
FORUM_FULL, FORUM_PUBLIC = _forum(T.StringType()), _forum(EXCERPT)

NOTE = _struct(
    "id STRING, forum STRING, invitation STRING, invitations ARRAY<STRING>, "
    "content STRING, mdate BIGINT, tmdate BIGINT, tcdate BIGINT"
)
MODEL_INPUT = _struct(
    "forum_id STRING, venue_family STRING, venue_year STRING, title STRING, "
    "abstract STRING, input_tier STRING, schema_version INT"
)
MODEL_INPUT_FIELDS = tuple(MODEL_INPUT.fieldNames())
CLAIM = _struct(
    "claim_id STRING, section STRING, claim_type STRING, text STRING, "
    "evidence_ids ARRAY<STRING>, statistic_refs ARRAY<STRING>, year_scope ARRAY<STRING>, "
    "support_level STRING, limitations ARRAY<STRING>"
)
RUN = _struct(
    "run_id STRING, system STRING, model STRING, settings STRING, input_hash STRING, "
    "calibration_hash STRING, created_at STRING"
)
PREDICTION = _struct(
    "forum_id STRING, rating_prediction DOUBLE, decision_prediction STRING, "
    "accept_probability DOUBLE, reasoning_summary STRING"
)


def is_public_tier(corpus: DataFrame) -> bool:
    """Read the tier of a nested corpus from its schema; no rows are touched."""
    reviews = corpus.schema["reviews"].dataType.elementType
    return isinstance(reviews["text"].dataType, T.StructType)


def venue_registry(spark: SparkSession) -> DataFrame:
    """The venue dimension: 33 rows, so it is always safe to broadcast."""
    import re

    rows = [
        (name, venue_id, api, family, int(m.group()) if (m := re.search(r"\d{4}", name)) else None,
         name in ACTIVE_CYCLES)
        for name, venue_id, api, family in VENUES
    ]
    return spark.createDataFrame(
        rows,
        "display_name STRING, venue_id STRING, api_version STRING, family STRING, "
        "year INT, is_active BOOLEAN",
    )


def venue_aliases(spark: SparkSession) -> DataFrame:
    """(family, alias) pairs; every family is also an alias of itself."""
    families = sorted({family for *_, family in VENUES})
    return spark.createDataFrame(
        [(f, f) for f in families] + list(VENUE_ALIASES), "family STRING, alias STRING"
    )
