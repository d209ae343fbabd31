"""Hash expressions. Everything is a built-in expression and stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUL = "\u0000"


def _text(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def short_sha(col: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col, 256), 1, 16)


def content_hash(*parts: Column | str) -> Column:
    """SHA-256 over the parts, each followed by a NUL; 16 hex digits."""
    pieces = [piece for part in parts for piece in (_text(part), F.lit(_NUL))]
    return short_sha(F.concat(*pieces))


def content_hash_of_array(parts: Column) -> Column:
    """`content_hash` over an array of strings, in array order."""
    joined = F.array_join(parts, _NUL, "")
    return short_sha(F.when(F.size(parts) > 0, F.concat(joined, F.lit(_NUL))).otherwise(F.lit("")))


def review_hash(text="text", strengths="strengths", weaknesses="weaknesses",
                questions="questions") -> Column:
    return content_hash(text, strengths, weaknesses, questions)


def response_hash(text="text") -> Column:
    return content_hash(text)


def evidence_id(forum_id="forum_id", note_id="note_id",
                designation="rating_designation") -> Column:
    return F.concat(F.lit("ev_"), content_hash(forum_id, note_id, designation))


def seeded_key(seed: int, *parts: Column | str) -> Column:
    """Sampling order. It depends on the seed and the row's identity only, so a
    sample is the same on any partitioning and after any task retry."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[_text(p) for p in parts]), 256)


def sha60(col: Column) -> Column:
    """60 bits of SHA-256 as a non-negative BIGINT."""
    return F.conv(F.substring(F.sha2(col, 256), 1, 15), 16, 10).cast("bigint")
