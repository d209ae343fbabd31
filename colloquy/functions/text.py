"""String, regular-expression and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.hashing import short_sha

# Patterns and character sets.
_SPACE = " \t\n\r\u000b\f"
_QUOTES = "\"'“”‘’"
YEAR_PATTERN = r"\d{4}"
DIGIT_PATTERN = r"\d"
FENCE_PATTERN = r"(?m)^```(?:json)?\s*|\s*```$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    return F.btrim(_c(col), F.lit(_SPACE))


def strip_quotes(col: Column | str) -> Column:
    """Trim blanks, then quotation marks, then blanks again."""
    return strip(F.btrim(strip(col), F.lit(_QUOTES)))


def normalize_name(col: Column | str) -> Column:
    """Lower case with runs of blanks collapsed; the key of venue look-ups."""
    return strip(F.regexp_replace(F.lower(_c(col)), r"\s+", " "))


def first_non_empty(*cols: Column | str) -> Column:
    """First value that is neither NULL nor the empty string, else ''."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(""))


def is_blank(col: Column | str) -> Column:
    """NULL or empty. Blanks alone count as content."""
    return F.coalesce(_c(col), F.lit("")) == ""


def has_digit(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit("")).rlike(DIGIT_PATTERN)


def year_of(col: Column | str) -> Column:
    """First run of four digits in a display name, else NULL."""
    return F.nullif(F.regexp_extract(_c(col), YEAR_PATTERN, 0), F.lit("")).cast("int")


def forum_id_from_url(col: Column | str) -> Column:
    """The ``id`` query parameter of an http(s) address, else the value itself."""
    raw = _c(col)
    return F.when(
        raw.startswith("http"),
        F.coalesce(F.nullif(F.try_parse_url(raw, F.lit("QUERY"), F.lit("id")), F.lit("")), raw),
    ).otherwise(raw)


def strip_code_fence(col: Column | str) -> Column:
    return strip(F.regexp_replace(strip(col), FENCE_PATTERN, ""))


def excerpt(col: Column | str, max_chars: int) -> Column:
    """Redacted text: the first characters, the full length and a short hash."""
    text = F.coalesce(_c(col), F.lit(""))
    return F.struct(
        F.substring(text, 1, max_chars).alias("excerpt"),
        F.length(text).cast("int").alias("length"),
        short_sha(text).alias("hash"),
    )


def excerpt_source(text="text", strengths="strengths", weaknesses="weaknesses",
                   summary="summary") -> Column:
    """Text an evidence excerpt is cut from: the body, else strengths with
    weaknesses, else the summary, else ''."""
    both = strip(F.concat(F.coalesce(_c(strengths), F.lit("")), F.lit(" "),
                          F.coalesce(_c(weaknesses), F.lit(""))))
    return first_non_empty(text, both, summary)


def assessment_prompt(family="venue_family", year="venue_year", title="title",
                      abstract="abstract", reference: Column | None = None) -> Column:
    """One request text per model input, with an optional reference block."""
    head = F.concat(F.lit("Venue: "), F.upper(_c(family)), F.lit(" "), _c(year).cast("string"))
    block = F.lit(None).cast("string") if reference is None else F.concat(
        F.upper(_c(family)), F.lit(" reference:\n"), F.nullif(reference, F.lit("")))
    return F.concat_ws(
        "\n\n", head, block,
        F.concat(F.lit("Title: "), F.coalesce(_c(title), F.lit(""))),
        F.concat(F.lit("Abstract: "), F.coalesce(_c(abstract), F.lit(""))),
    )
