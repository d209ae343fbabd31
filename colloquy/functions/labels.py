"""Small semantic expressions: buckets, scopes, eligibility, backoff, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import schema as S


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def family_label(col="venue_family") -> Column:
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(S.FAMILY_UNKNOWN))


def year_label(col="venue_year") -> Column:
    """Year as text. NULL is named before any roll-up, so that it cannot be mistaken
    for the all-years scope."""
    return F.coalesce(_c(col).cast("string"), F.lit(S.YEAR_UNSPECIFIED))


def decision_label(col="decision") -> Column:
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit("unknown"))


def is_undecided(col="decision") -> Column:
    return decision_label(col) == "unknown"


def decision_bucket(col="decision") -> Column:
    d = _c(col)
    return (
        F.when(d == "accept", "accepted")
        .when(d.isin("reject", "desk_reject"), "rejected")
        .otherwise("unknown")
    )


def tercile_bucket(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """Values equal to a cut are medium."""
    v = _c(value)
    return (
        F.when(v.isNull(), "unknown")
        .when(v < _c(low), "low")
        .when(v > _c(high), "high")
        .otherwise("medium")
    )


def rating_designation(final="final_value") -> Column:
    return F.when(_c(final).isNotNull(), "final").otherwise("initial")


def designated_rating(final="final_value", initial="initial_value") -> Column:
    return F.coalesce(_c(final), _c(initial))


def is_resolved(col="decision") -> Column:
    return F.coalesce(_c(col).isin(*S.RESOLVED_DECISIONS), F.lit(False))


def exclusion_reason(col="decision") -> Column:
    """Why a forum has no decision label; NULL when it has one."""
    d = _c(col)
    return F.when(
        ~is_resolved(d),
        F.when(d == "withdrawn", "withdrawn")
        .when(d == "desk_reject", "desk_reject")
        .otherwise("unresolved"),
    )


def is_active_cycle(family="venue_family", year="venue_year", cycles=None) -> Column:
    """Membership in the list of open review cycles ((family, year) pairs). The list
    is a handful of constants, so it folds into the expression; a NULL year is never
    active."""
    import re

    if cycles is None:
        cycles = [
            (fam, int(m.group()))
            for name, _, _, fam in S.VENUES
            if name in S.ACTIVE_CYCLES and (m := re.search(r"\d{4}", name))
        ]
    test = F.lit(False)
    for fam, y in cycles:
        test = test | ((_c(family) == fam) & (_c(year) == y))
    return F.coalesce(test, F.lit(False))


def backoff_hours(attempts: Column | str, base_hours: float = S.REFRESH_BASE_HOURS) -> Column:
    return F.lit(float(base_hours)) * F.pow(
        F.lit(2.0), F.least(_c(attempts), F.lit(S.REFRESH_BACKOFF_CAP)))


def age_days(since: Column | str, now: Column | float) -> Column:
    """Days since a time; a missing or zero time is age 0."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    return F.coalesce((now - F.nullif(_c(since), F.lit(0.0))) / F.lit(86400.0), F.lit(0.0))


def rounded(col: Column, digits: int | None = 4) -> Column:
    """Half-even rounding as published results use; ``None`` leaves values alone."""
    return col if digits is None else F.bround(col, digits)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL on a zero denominator (plain division raises under ANSI)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def violation(entity: Column | str, rule: str | Column, detail: Column | str | None = None,
              n: Column | None = None) -> list[Column]:
    """The columns of a violation row: one rule set, one shape."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    detail = F.lit("") if detail is None else (F.lit(detail) if isinstance(detail, str) else detail)
    return [
        F.coalesce(_c(entity).cast("string"), F.lit("<missing>")).alias("entity_id"),
        rule.alias("rule"),
        F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
        (F.lit(1) if n is None else n).cast("bigint").alias("n"),
    ]
