"""Expressions that turn a raw note (JSON content) into typed columns.

A content field may be a scalar, a list, or ``{"value": scalar-or-list}``. Content
is parsed once per row into VARIANT; the fields below are then path reads on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


from colloquy.functions.text import first_non_empty, strip

# The regular expressions that define the vocabulary.
REVIEW_INVITATION = r"(?i)/official[_-]?review$|/review$"
REBUTTAL_INVITATION = r"(?i)/author|/rebuttal|/official_comment"
DECISION_INVITATION = r"(?i)/meta_review$|/decision$"
ACCEPT_WORDS = r"(?i)\baccept(ed|ance|ing|s)?\b"
REJECT_WORDS = r"(?i)\breject(ed|ion|ing|s)?\b"
WITHDRAW_WORDS = r"(?i)\bwithdraw"
DESK_REJECT_WORDS = r"(?i)\bdesk[\s-]?reject"
CATEGORY_WORDS = r"(?i)\b(oral|spotlight|poster)\b"
NUMBER = r"[-+]?\d+(\.\d+)?"
VENUEID_WITHDRAWN = r"/Withdrawn_Submission$"
VENUEID_DESK_REJECTED = r"/Desk_Rejected_Submission$"
VENUEID_REJECTED = r"/Rejected_Submission$"
VENUEID_ACTIVE = r"/Submission$"
# JSON texts of values that a fall-through chain skips.
_FALSY_JSON = ("null", '""', "0", "0.0", "-0.0", "false", "[]", "{}")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_content(col: Column | str) -> Column:
    """JSON text to VARIANT; malformed text becomes NULL and so an empty note."""
    return F.try_parse_json(_c(col))


def field(content: Column, key: str) -> Column:
    """Raw value of a content field as VARIANT, unwrapped from ``{"value": ...}``."""
    direct = F.try_variant_get(content, f"$.{key}", "variant")
    wrapper = F.try_variant_get(content, f"$.{key}", "map<string,variant>")
    return F.when(
        F.map_contains_key(wrapper, "value"),
        F.try_variant_get(content, f"$.{key}.value", "variant"),
    ).otherwise(direct)


def variant_text(value: Column) -> Column:
    """Text of a VARIANT: lists are joined with ', ', NULL becomes ''."""
    return F.coalesce(
        F.array_join(F.try_variant_get(value, "$", "array<string>"), ", "),
        F.try_variant_get(value, "$", "string"),
        F.lit(""),
    )


def field_text(content: Column, key: str) -> Column:
    return variant_text(field(content, key))


def first_field(content: Column, *keys: str) -> Column:
    """First field with a truthy value. The number 0 and empty values fall through,
    the string "0" does not, hence the test on the JSON text."""
    tests = [
        F.when(~F.to_json(value).isin(*_FALSY_JSON), value)
        for value in (field(content, key) for key in keys)
    ]
    return F.coalesce(*tests)


def first_field_text(content: Column, *keys: str) -> Column:
    return first_non_empty(*[field_text(content, key) for key in keys])


def note_invitation(invitation="invitation", invitations="invitations") -> Column:
    """The single invitation if set, else the first of the list, else ''."""
    return first_non_empty(invitation, F.try_element_at(_c(invitations), F.lit(1)))


def classify_invitation(invitation: Column | str) -> Column:
    inv = F.coalesce(_c(invitation), F.lit(""))
    return (
        F.when(inv.rlike(REVIEW_INVITATION), "review")
        .when(inv.rlike(REBUTTAL_INVITATION), "rebuttal")
        .when(inv.rlike(DECISION_INVITATION), "decision")
        .otherwise("other")
    )


def rating(raw: Column | str) -> Column:
    """Rating struct from text such as ``"6: marginally above ..."``."""
    text = F.coalesce(_c(raw), F.lit(""))
    number = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit(""))
    after_colon = strip(F.split(text, ":", 2)[1])
    after_dash = strip(F.split(text, "-", 2)[1])
    label = (
        F.when(F.contains(text, F.lit(":")), after_colon)
        .when(F.contains(text, F.lit("-")) & number.isNotNull(), after_dash)
        .otherwise("")
    )
    return F.struct(
        text.alias("raw"),
        number.cast("double").alias("value"),
        label.alias("label"),
        F.lit(None).cast("double").alias("scale_min"),
        F.lit(None).cast("double").alias("scale_max"),
    )


def category(text: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), CATEGORY_WORDS, 1))


def decision_outcome(text: Column | str) -> Column:
    """Outcome named by free text. Tests run in a fixed order, and a text that only
    mentions the word acceptance reads as an accept."""
    raw = F.coalesce(_c(text), F.lit(""))
    return (
        F.when(raw.rlike(WITHDRAW_WORDS), "withdrawn")
        .when(raw.rlike(DESK_REJECT_WORDS), "desk_reject")
        .when(raw.rlike(ACCEPT_WORDS), "accept")
        .when(raw.rlike(REJECT_WORDS), "reject")
        .otherwise("unknown")
    )


def decision_category(text: Column | str) -> Column:
    raw = _c(text)
    ruled_out = decision_outcome(raw).isin("withdrawn", "desk_reject")
    return F.when(ruled_out, "").otherwise(category(raw))


def decision(raw: Column | str, note_id: Column | None = None) -> Column:
    """Decision struct from free text."""
    text = F.coalesce(_c(raw), F.lit(""))
    note_id = F.lit(None) if note_id is None else note_id
    return F.struct(
        text.alias("raw_text"),
        decision_outcome(text).alias("normalized"),
        decision_category(text).alias("category"),
        note_id.cast("string").alias("note_id"),
    )


def decision_from_venueid(venueid: Column | str, venue: Column | str) -> Column:
    """Decision struct from a submission's venue id; NULL while it is still active."""
    vid, name = F.coalesce(_c(venueid), F.lit("")), _c(venue)
    outcome = (
        F.when(vid == "", F.lit(None))
        .when(vid.rlike(VENUEID_WITHDRAWN), "withdrawn")
        .when(vid.rlike(VENUEID_DESK_REJECTED), "desk_reject")
        .when(vid.rlike(VENUEID_REJECTED), "reject")
        .when(vid.rlike(VENUEID_ACTIVE), F.lit(None))
        .otherwise("accept")
    )
    return F.when(
        outcome.isNotNull(),
        F.struct(
            first_non_empty(name, vid).alias("raw_text"),
            outcome.alias("normalized"),
            F.when(outcome == "accept", category(name)).otherwise("").alias("category"),
            F.lit(None).cast("string").alias("note_id"),
        ),
    )


def note_modified_at(mdate="mdate", tmdate="tmdate") -> Column:
    return F.coalesce(F.nullif(_c(mdate), F.lit(0)), F.nullif(_c(tmdate), F.lit(0))).cast("double")


def review_columns(content: Column) -> list[Column]:
    """Columns of a review note, without its hash."""
    return [
        rating(variant_text(first_field(content, "rating", "recommendation", "score", "overall")))
        .alias("initial_rating"),
        F.lit(None).cast("struct<raw:string,value:double,label:string,scale_min:double,"
                         "scale_max:double>").alias("final_rating"),
        rating(field_text(content, "confidence")).alias("confidence"),
        first_field_text(content, "summary", "title").alias("summary"),
        first_field_text(content, "review", "comment", "main_review").alias("text"),
        field_text(content, "strengths").alias("strengths"),
        field_text(content, "weaknesses").alias("weaknesses"),
        first_field_text(content, "questions", "limitations").alias("questions"),
    ]


def response_text(content: Column) -> Column:
    return first_field_text(content, "comment", "reply", "text")


def decision_text(content: Column) -> Column:
    return first_field_text(content, "decision", "metareview", "comment", "text")


def paper(content: Column) -> Column:
    return F.struct(*[field_text(content, k).alias(k)
                      for k in ("title", "abstract", "keywords", "authors")])


