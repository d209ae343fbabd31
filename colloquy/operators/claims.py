"""Claims: references to statistics and evidence, rule checks, attribution to venues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import labels as L
from colloquy.functions.digests import set_digest
from colloquy.functions.hashing import content_hash
from colloquy.functions.rows import with_row
from colloquy.functions.text import has_digit, is_blank, normalize_name, strip_code_fence, strip_quotes
from colloquy.operators.evidence import duplicates, explode_rules, union_violations

NESTED_METRICS = ("rating_decision_crosstab", "reviewer_disagreement")
NUMERIC_CLAIMS = ("deterministic_fact", "statistical_pattern")


# --- references -------------------------------------------------------------------------


def statistic_keys(stats: DataFrame, dotted_keys: bool = True) -> DataFrame:
    """Everything a reference may name: (family, year, metric[.path]) with a value
    where the path is a leaf. ``dotted_keys=False`` drops names that contain a dot of
    their own, such as ``missing_rate.*`` or the bar ``6.0``."""
    metric, path = F.col("metric"), F.col("path")
    inner = F.when(metric.isin(*NESTED_METRICS) & F.contains(path, F.lit(".")),
                   F.substring_index(path, ".", 1))
    names = F.array_distinct(F.array_compact(F.array(
        F.struct(metric.alias("k"), F.when(path == "", F.col("value")).alias("v")),
        F.when(inner.isNotNull(), F.struct(
            F.concat_ws(".", metric, inner).alias("k"), F.lit(None).cast("double").alias("v"))),
        F.when(path != "", F.struct(
            F.concat_ws(".", metric, path).alias("k"), F.col("value").alias("v"))))))
    keys = stats.select("venue_family", F.col("venue_year").cast("string").alias("venue_year"),
                        metric, path, F.explode(names).alias("n"))
    if not dotted_keys:
        tail = F.when(metric.isin(*NESTED_METRICS), F.substring_index(path, ".", -1)).otherwise(path)
        keys = keys.where(~F.contains(metric, F.lit("."))
                          & ((F.col("n.k") == metric) | ~F.contains(tail, F.lit("."))))
    return keys.groupBy("venue_family", "venue_year", F.col("n.k").alias("ref_key")).agg(
        F.max("n.v").alias("ref_value"))


def split_refs(claims: DataFrame) -> DataFrame:
    """One row per statistic reference ``family/year/metric[.path]``; parts are NULL
    when the reference is malformed."""
    parts = F.split("ref", "/")
    good = (F.size(parts) == 3) & (parts[0] != "") & (parts[1] != "") \
        & (F.substring_index(parts[2], ".", 1) != "")
    part = lambda i: F.when(good, F.get(parts, F.lit(i)))
    return claims.select("claim_no", "claim_id", F.explode("statistic_refs").alias("ref")).select(
        "claim_no", "claim_id", "ref", part(0).alias("venue_family"),
        part(1).alias("venue_year"), part(2).alias("ref_key"))


def resolve_refs(claims: DataFrame, stats: DataFrame, dotted_keys: bool = True) -> DataFrame:
    """References with ``resolved`` and, for leaves, their value. An equi-join."""
    keys = statistic_keys(stats, dotted_keys).withColumn("resolved", F.lit(True))
    return split_refs(claims).join(keys, ["venue_family", "venue_year", "ref_key"], "left").withColumn(
        "resolved", F.coalesce("resolved", F.lit(False)))


def cited_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per cited evidence id; evidence columns are NULL when it is unknown."""
    items = evidence.select(
        "evidence_id", F.col("venue_family").alias("ev_family"),
        F.col("venue_year").cast("string").alias("ev_year"), "excerpt_text",
        F.lit(True).alias("known"))
    return claims.select(
        "claim_no", "claim_id", "claim_type", "text",
        F.explode("evidence_ids").alias("evidence_id"),
    ).join(items, "evidence_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def years_by_family(stats: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct (family, year) pairs seen in statistics or evidence."""
    pairs = lambda df: df.select(
        "venue_family", F.col("venue_year").cast("string").alias("venue_year"))
    return pairs(stats).union(pairs(evidence)).where(
        F.col("venue_year") != S.YEAR_ALL).distinct()


def covered_years(refs: DataFrame, cited: DataFrame, years: DataFrame) -> DataFrame:
    """(claim, year) pairs backed by a citation. ``all`` covers every year of its
    family."""
    resolved = refs.where("resolved").select("claim_no", "venue_family", "venue_year")
    one = resolved.where(F.col("venue_year") != S.YEAR_ALL).select("claim_no", "venue_year")
    every = resolved.where(F.col("venue_year") == S.YEAR_ALL).select(
        "claim_no", "venue_family").distinct().join(years, "venue_family").select(
        "claim_no", "venue_year")
    quoted = cited.where("known").select("claim_no", F.col("ev_year").alias("venue_year"))
    return one.union(every).union(quoted).distinct()


# --- rules ------------------------------------------------------------------------------


def validate_claims(claims: DataFrame, stats: DataFrame, evidence: DataFrame,
                    dotted_keys: bool = True) -> DataFrame:
    """Every violation of a set of claims. ``claim_no`` identifies a row, since ids may
    be missing or repeated."""
    label = F.coalesce(F.nullif("claim_id", F.lit("")),
                       F.concat(F.lit("#"), F.col("claim_no").cast("string")))
    claims = claims.withColumn("_label", label)
    ids, refs_ = F.coalesce(F.size("evidence_ids"), F.lit(0)), F.coalesce(
        F.size("statistic_refs"), F.lit(0))
    is_quote = F.coalesce(F.col("claim_type") == "evidence_excerpt", F.lit(False))
    allowed = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    local = explode_rules(claims, "_label", [
        ("missing_claim_id", is_blank("claim_id"), None),
        ("unknown_section", ~allowed("section", S.CLAIM_SECTIONS), "section"),
        ("unknown_claim_type", ~allowed("claim_type", S.CLAIM_TYPES), "claim_type"),
        ("unknown_support_level", ~allowed("support_level", S.SUPPORT_LEVELS), "support_level"),
        ("missing_limitations", F.coalesce(F.size("limitations"), F.lit(0)) <= 0, None),
        ("excerpt_without_evidence", is_quote & (ids <= 0), None),
        ("number_without_reference", allowed("claim_type", NUMERIC_CLAIMS) & has_digit("text")
         & (refs_ <= 0), None),
    ])

    cited = cited_evidence(claims.withColumn("claim_id", F.col("_label")), evidence)
    refs = resolve_refs(claims.withColumn("claim_id", F.col("_label")), stats, dotted_keys)
    years = years_by_family(stats, evidence)
    known_years = years.select("venue_year").distinct()

    quoted = strip_quotes("text")
    verbatim = F.col("known") & (quoted != "") & F.contains(F.col("excerpt_text"), quoted)
    scope = claims.select(
        "claim_no", "_label", (ids + refs_ > 0).alias("cites"),
        F.explode(F.col("year_scope").cast("array<string>")).alias("venue_year"))
    known_scope = scope.join(known_years, "venue_year", "left_semi")
    return union_violations([
        local,
        duplicates(claims, "claim_id", "duplicate_claim_id"),
        cited.where(~F.col("known")).select(
            *L.violation("claim_id", "unknown_evidence", F.col("evidence_id"))),
        refs.where(~F.col("resolved")).select(
            *L.violation("claim_id", "unresolved_reference", F.col("ref"))),
        cited.where(F.col("claim_type") == "evidence_excerpt")
        .groupBy("claim_no", "claim_id").agg(F.max(F.coalesce(verbatim, F.lit(False))).alias("_ok"))
        .where(~F.col("_ok")).select(*L.violation("claim_id", "quote_not_verbatim")),
        scope.join(known_years, "venue_year", "left_anti").select(
            *L.violation("_label", "unknown_year", F.col("venue_year"))),
        known_scope.where("cites").join(
            covered_years(refs, cited, years), ["claim_no", "venue_year"], "left_anti")
        .select(*L.violation("_label", "year_beyond_evidence", F.col("venue_year"))),
    ])


def inputs_match(stats_header: DataFrame, evidence_header: DataFrame) -> DataFrame:
    """Statistics and evidence must come from one corpus and known schema versions."""
    both = with_row(
        stats_header.select(F.col("corpus_hash").alias("s"), F.col("schema_version").alias("sv")),
        evidence_header.select(F.col("corpus_hash").alias("e"), F.col("schema_version").alias("ev")))
    return explode_rules(both, F.lit("inputs"), [
        ("corpora_differ", is_blank("s") | ~F.col("s").eqNullSafe(F.col("e")), None),
        ("statistics_schema_version",
         ~F.col("sv").eqNullSafe(F.lit(S.STATISTICS_SCHEMA_VERSION)), F.col("sv")),
        ("evidence_schema_version",
         ~F.col("ev").eqNullSafe(F.lit(S.EVIDENCE_SCHEMA_VERSION)), F.col("ev")),
    ])


def provenance(stats: DataFrame, evidence: DataFrame, corpus_hash: str, *,
               provider: str | None = None, model: str | None = None,
               params: str = "{}", generated_at: str = "") -> DataFrame:
    """One row that identifies what claims were generated from. ``content_hash`` leaves
    the time out, so equal inputs give equal hashes."""
    columns = ("metric", "venue_family", "venue_year", "path", "value")
    row = with_row(
        set_digest(stats, *[F.col(c) for c in columns], name="statistics_hash"),
        set_digest(evidence, F.col("evidence_id"), name="evidence_bundle_hash")
    ).withColumns({
        "corpus_hash": F.lit(corpus_hash), "provider": F.lit(provider).cast("string"),
        "model": F.lit(model).cast("string"), "params": F.lit(params),
        "schema_version": F.lit(S.STATISTICS_SCHEMA_VERSION)})
    return row.withColumn("content_hash", content_hash(*sorted(row.columns))).withColumn(
        "generated_at", F.lit(generated_at))


def parse_responses(raw: DataFrame, text: str = "raw_text") -> DataFrame:
    """Claims arrays from generated text. One code fence is removed, nothing else is
    repaired: ``error`` says why a response was refused."""
    body = F.try_parse_json(strip_code_fence(text))
    claims = F.try_variant_get(body, "$.claims", "variant")
    listed = F.try_variant_get(claims, "$", "array<variant>")
    is_object = F.schema_of_variant(body).startswith("OBJECT")
    return raw.select(
        *[c for c in raw.columns if c != text],
        F.when(body.isNull(), "not_json")
        .when(~is_object | claims.isNull(), "no_claims")
        .when(listed.isNull(), "claims_not_a_list").alias("error"),
        listed.alias("claims"))


# --- attribution and packs --------------------------------------------------------------


def claim_families(claims: DataFrame, stats: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim, family) rows: families named by references or cited evidence, limited to
    those in scope. A claim that names none belongs to the only family in scope; with
    several in scope its family is NULL, which is a violation."""
    scope = stats.select("venue_family").union(evidence.select("venue_family")).distinct()
    from_refs = split_refs(claims).where(F.size(F.split("ref", "/")) == 3).select(
        "claim_no", F.split("ref", "/")[0].alias("venue_family"))
    from_evidence = claims.select("claim_no", F.explode("evidence_ids").alias("evidence_id")).join(
        evidence.select("evidence_id", "venue_family"), "evidence_id").select(
        "claim_no", "venue_family")
    named = from_refs.union(from_evidence).distinct().join(scope, "venue_family", "left_semi")
    sole = scope.agg(F.count(F.lit(1)).alias("_n"), F.min("venue_family").alias("_f"))
    return (
        with_row(claims.select("claim_no", "claim_id").join(named, "claim_no", "left"), sole)
        .select("claim_no", "claim_id", F.coalesce(
            "venue_family", F.when(F.col("_n") == 1, F.col("_f"))).alias("venue_family"))
    )


def calibration_metadata(stats: DataFrame) -> DataFrame:
    """Per family: years, sizes, resolved decisions and whether it is preliminary."""
    at_all = F.col("venue_year") == S.YEAR_ALL
    pick = lambda m: F.max(F.when(at_all & (F.col("metric") == m), F.col("value")))
    resolved = at_all & (F.col("metric") == "decision_distribution") & (F.col("path") != "unknown")
    return (
        stats.groupBy("venue_family").agg(
            F.array_sort(F.collect_set(F.when(~at_all, F.col("venue_year").cast("string"))))
            .alias("years"),
            pick("forum_count").cast("bigint").alias("forum_count"),
            pick("review_count").cast("bigint").alias("review_count"),
            F.coalesce(F.sum(F.when(resolved, F.col("value"))), F.lit(0)).cast("bigint")
            .alias("decisions_resolved"),
        )
        .select("venue_family", F.array_join("years", ",").alias("years_covered"),
                F.size("years").alias("n_years"), "forum_count", "review_count",
                "decisions_resolved",
                (F.coalesce(F.col("forum_count") < S.PRELIMINARY_FORUMS, F.lit(False))
                 | (F.size("years") < S.PRELIMINARY_YEARS)).alias("preliminary"))
    )


def scope_summary(stats: DataFrame) -> DataFrame:
    """Family, forum count and years: the corpus description of a request."""
    return calibration_metadata(stats).select("venue_family", "forum_count", "years_covered")


def venue_packs(claims: DataFrame, stats: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per family: calibration metadata with evidence and claim counts."""
    n = lambda df, name: df.groupBy("venue_family").agg(F.count(F.lit(1)).alias(name))
    attributed = claim_families(claims, stats, evidence).where(F.col("venue_family").isNotNull())
    families = stats.select("venue_family").union(evidence.select("venue_family")).distinct()
    return (
        families.join(calibration_metadata(stats), "venue_family", "left")
        .join(n(evidence, "evidence_count"), "venue_family", "left")
        .join(n(attributed, "claim_count"), "venue_family", "left")
        .fillna(0, ["evidence_count", "claim_count"])
    )


def checked_venue_packs(claims: DataFrame, stats: DataFrame, evidence: DataFrame, stats_header: DataFrame,
                        evidence_header: DataFrame, dotted_keys: bool = True) -> DataFrame:
    """`venue_packs` of claims without violations, from inputs that belong together;
    anything else raises."""
    for name, found in (("inputs", inputs_match(stats_header, evidence_header)),
                        ("claims", validate_claims(claims, stats, evidence, dotted_keys))):
        rules = sorted(r.rule for r in found.select("rule").distinct().collect())  # names of rules
        if rules:
            raise ValueError(f"no packs, {name} are refused: {', '.join(rules)}")
    return venue_packs(claims, stats, evidence)


def report_rows(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims in report order with their sources. The order is carried by columns
    (``section_no``, ``claim_id``), so a section is never gathered in one place."""
    section_no = F.array_position(F.array(*[F.lit(s) for s in S.CLAIM_SECTIONS]), F.col("section"))
    # F.array_position is 1-based and 0 for an unknown section, which validation rejects.
    sources = (
        claims.select("claim_no", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
        .join(evidence.select("evidence_id", "forum_id", "note_id", "source_url"), "evidence_id")
        .groupBy("claim_no")
        .agg(F.array_sort(F.collect_list(F.struct(
            "pos", F.concat_ws(" ", F.col("forum_id").cast("string"), "note_id", "source_url")
            .alias("s")))).alias("_s"))
        .select("claim_no", F.array_join(F.col("_s.s"), "; ").alias("sources"))
    )
    return claims.join(sources, "claim_no", "left").select(
        section_no.cast("int").alias("section_no"), "section", "claim_id", "claim_type", "text",
        "support_level", F.array_join("year_scope", ",").alias("years"),
        F.coalesce("sources", F.lit("")).alias("sources"),
        F.array_join("statistic_refs", ", ").alias("statistics"),
        F.array_join("limitations", "; ").alias("limitations"))


# --- venue look-up ----------------------------------------------------------------------


def alias_index(aliases: DataFrame) -> DataFrame:
    """Distinct (name, family) pairs under normalised names."""
    return aliases.select(normalize_name("alias").alias("name"), "family").where(
        F.col("name") != "").distinct()


def resolve_venues(queries: DataFrame, aliases: DataFrame, query: str = "query") -> DataFrame:
    """Exact, case- and blank-insensitive look-up: supported, ambiguous or unsupported.

    Names are reduced to their family set first, so a query meets at most one row and
    a frequent query does not multiply."""
    per_name = alias_index(aliases).groupBy("name").agg(
        F.array_sort(F.collect_set("family")).alias("_families"))
    n = F.coalesce(F.size("_families"), F.lit(0))
    return (
        queries.withColumn("name", normalize_name(query)).join(per_name, "name", "left")
        .select(*queries.columns,
                F.when(n <= 0, "unsupported").when(n == 1, "supported").otherwise("ambiguous")
                .alias("status"),
                F.when(n == 1, F.get("_families", F.lit(0))).alias("family"),
                F.when(n > 1, F.array_join("_families", ",")).alias("candidates"))
    )


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Names that lead to more than one family."""
    return (
        alias_index(aliases).groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",")
             .alias("families"))
        .where(F.col("n") > 1)
    )
