"""Queries J11, J12, J15, J16, A29, U2, U5, F13, F15, Q2, Q9, C7, C8: claims and venues."""

from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions.digests import corpus_digest
from colloquy.operators import claims as C
from colloquy.operators import statistics as ST
from colloquy.plans.registry import cte, query
from colloquy.sources import driver_tables as D
from colloquy.sources.corpus import scratch_dir, write_table

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
SECTIONS = (*S.CLAIM_SECTIONS, "bogus")
TYPES = (*S.CLAIM_TYPES, "guess")
LEVELS = (*S.SUPPORT_LEVELS, "huge")

cte("cstat", "SELECT * FROM stat")
cte("citem", """
  SELECT 'e' || p_partkey AS evidence_id, CASE WHEN p_size % 3 = 0 THEN '1-URGENT' WHEN p_size % 3 = 1 THEN 'unknown' ELSE 'zz' END AS venue_family,
    CAST(1995 + p_size % 10 AS VARCHAR) AS venue_year, p_name || ' said the reviewer' AS excerpt_text,
    'f' || p_partkey AS forum_id, 'n' || p_partkey AS note_id, 'u' || p_partkey AS source_url
  FROM part WHERE p_type <> 'ECONOMY'
""")
cte("claim", f"""
  SELECT p_partkey AS claim_no,
    CASE p_size % 10 WHEN 0 THEN '' WHEN 1 THEN 'dup' ELSE 'c' || p_partkey END AS claim_id,
    {_LIST(SECTIONS)}[CAST(p_partkey % 8 AS INTEGER) + 1] AS section, {_LIST(TYPES)}[p_size % 6 + 1] AS claim_type,
    {_LIST(LEVELS)}[p_size % 5 + 1] AS support_level,
    CASE WHEN p_size % 4 = 0 THEN '"' || p_name || '"' WHEN p_size % 4 = 1 THEN p_name || ' 5' ELSE p_type END AS text,
    CASE WHEN p_size % 7 = 0 THEN []::VARCHAR[] ELSE ['e' || p_partkey, 'e' || (p_partkey + 1)] END AS evidence_ids,
    CASE WHEN p_size % 11 = 0 THEN []::VARCHAR[] WHEN p_size % 11 = 1 THEN ['bad/ref', '2-HIGH//x', '//']
      WHEN p_size % 11 = 2 THEN ['unknown/all/missing_rate.decision', 'unknown/all/rating_decision_crosstab.accept']
      WHEN p_size % 11 = 3 THEN ['3-MEDIUM/all/rating_decision_crosstab.reject.low', '5-LOW/all/none']
      ELSE ['2-HIGH/' || (1995 + p_size % 9) || '/forum_count', '5-LOW/1996/decision_distribution.accept'] END AS statistic_refs,
    [CAST(1995 + p_size % 12 AS VARCHAR), '1996'] AS year_scope,
    CASE WHEN p_size % 13 = 0 THEN []::VARCHAR[] ELSE ['small'] END AS limitations
  FROM part
""")
cte("cref", """
  SELECT *, len(string_split(ref, '/')) = 3 AND string_split(ref, '/')[1] <> '' AND string_split(ref, '/')[2] <> ''
      AND split_part(string_split(ref, '/')[3], '.', 1) <> '' AS good
  FROM (SELECT claim_no, claim_id, unnest(statistic_refs) AS ref FROM claim)
""")
cte("ckey", """
  SELECT venue_family, venue_year, k, max(v) AS v FROM (
    SELECT venue_family, venue_year, metric AS k, CASE WHEN path = '' THEN value END AS v FROM cstat
    UNION ALL SELECT venue_family, venue_year, metric || '.' || path, value FROM cstat WHERE path <> ''
    UNION ALL SELECT venue_family, venue_year, metric || '.' || split_part(path, '.', 1), NULL FROM cstat
      WHERE metric = 'rating_decision_crosstab' AND contains(path, '.')) GROUP BY 1, 2, 3
""")
cte("cresolved", """
  SELECT r.claim_no, r.claim_id, r.ref, CASE WHEN good THEN string_split(ref, '/')[1] END AS venue_family,
    CASE WHEN good THEN string_split(ref, '/')[2] END AS venue_year,
    CASE WHEN good THEN string_split(ref, '/')[3] END AS ref_key, k.k IS NOT NULL AS resolved, k.v AS ref_value
  FROM cref r LEFT JOIN ckey k ON good AND string_split(ref, '/')[1] = k.venue_family
    AND string_split(ref, '/')[2] = k.venue_year AND string_split(ref, '/')[3] = k.k
""")
cte("ccited", """
  SELECT c.claim_no, c.claim_id, c.claim_type, c.text, c.evidence_id, i.venue_family AS ev_family, i.venue_year AS ev_year,
    i.excerpt_text, i.evidence_id IS NOT NULL AS known
  FROM (SELECT claim_no, claim_id, claim_type, text, unnest(evidence_ids) AS evidence_id FROM claim) c
  LEFT JOIN citem i USING (evidence_id)
""")
cte("cyears", """
  SELECT DISTINCT venue_family, venue_year FROM cstat WHERE venue_year <> 'all'
  UNION SELECT venue_family, venue_year FROM citem
""")
cte("ccovered", """
  SELECT claim_no, venue_year FROM cresolved WHERE resolved AND venue_year <> 'all'
  UNION SELECT claim_no, y.venue_year FROM cresolved r JOIN cyears y USING (venue_family) WHERE resolved AND r.venue_year = 'all'
  UNION SELECT claim_no, ev_year FROM ccited WHERE known
""")
cte("cscope", """
  SELECT claim_no, CASE WHEN claim_id = '' THEN '#' || claim_no ELSE claim_id END AS label,
    len(evidence_ids) + len(statistic_refs) > 0 AS cites, unnest(year_scope) AS venue_year FROM claim
""")


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _claims(spark, path):
    """Claims generated from parts, good and bad ones."""
    p, size, key = D.table(spark, path, "part"), F.col("p_size"), F.col("p_partkey")
    none = F.array().cast("array<string>")
    text = lambda c: c.cast("string")
    m = size % 11
    refs = (
        F.when(m == 0, none)
        .when(m == 1, F.array(*[F.lit(r) for r in ("bad/ref", "2-HIGH//x", "//")]))
        .when(m == 2, F.array(F.lit("unknown/all/missing_rate.decision"),
                              F.lit("unknown/all/rating_decision_crosstab.accept")))
        .when(m == 3, F.array(F.lit("3-MEDIUM/all/rating_decision_crosstab.reject.low"),
                              F.lit("5-LOW/all/none")))
        .otherwise(F.array(F.concat(F.lit("2-HIGH/"), text(size % 9 + 1995), F.lit("/forum_count")),
                           F.lit("5-LOW/1996/decision_distribution.accept"))))
    return p.select(
        key.alias("claim_no"),
        F.when(size % 10 == 0, "").when(size % 10 == 1, "dup").otherwise(
            F.concat(F.lit("c"), text(key))).alias("claim_id"),
        _pick(SECTIONS, key % 8).alias("section"), _pick(TYPES, size % 6).alias("claim_type"),
        _pick(LEVELS, size % 5).alias("support_level"),
        F.when(size % 4 == 0, F.concat(F.lit('"'), "p_name", F.lit('"')))
        .when(size % 4 == 1, F.concat("p_name", F.lit(" 5"))).otherwise(F.col("p_type")).alias("text"),
        F.when(size % 7 == 0, none).otherwise(F.array(
            F.concat(F.lit("e"), text(key)), F.concat(F.lit("e"), text(key + 1)))).alias("evidence_ids"),
        refs.alias("statistic_refs"),
        F.array(text(size % 12 + 1995), F.lit("1996")).alias("year_scope"),
        F.when(size % 13 == 0, none).otherwise(F.array(F.lit("small"))).alias("limitations"))


def _evidence(spark, path):
    p, size = D.table(spark, path, "part").where(F.col("p_type") != "ECONOMY"), F.col("p_size")
    tag = lambda c: F.concat(F.lit(c), F.col("p_partkey").cast("string"))
    return p.select(
        tag("e").alias("evidence_id"),
        F.when(size % 3 == 0, "1-URGENT").when(size % 3 == 1, "unknown").otherwise("zz").alias("venue_family"),
        (size % 10 + 1995).cast("string").alias("venue_year"),
        F.concat("p_name", F.lit(" said the reviewer")).alias("excerpt_text"),
        tag("f").alias("forum_id"), tag("n").alias("note_id"), tag("u").alias("source_url"))


def _stats(spark, path):
    """Statistics as claims meet them: computed once and stored."""
    c, out = D.orders_corpus(spark, path), scratch_dir(spark)
    write_table(ST.compute(c.forum, c.review, c.response, digits=10), out)
    return spark.read.parquet(f"{out}/rows")


@query("J11_cited_evidence", """
  SELECT claim_no, claim_id, evidence_id, known, ev_family, ev_year FROM ccited""")
def j11(spark, path):
    return C.cited_evidence(_claims(spark, path), _evidence(spark, path)).select(
        "claim_no", "claim_id", "evidence_id", "known", "ev_family", "ev_year")


@query("J12_F15_resolve_statistic_references", "SELECT * FROM cresolved")
def j12(spark, path):
    return C.resolve_refs(_claims(spark, path), _stats(spark, path))


@query("J12_references_without_dotted_keys", """
  SELECT claim_no, ref, resolved AND NOT contains(ref_key, 'missing_rate.') AS resolved FROM cresolved""")
def j12b(spark, path):
    return C.resolve_refs(_claims(spark, path), _stats(spark, path), dotted_keys=False).select(
        "claim_no", "ref", "resolved")


@query("U5_years_covered_by_claims", "SELECT claim_no, venue_year FROM ccovered")
def u5(spark, path):
    claims, stats, items = _claims(spark, path), _stats(spark, path), _evidence(spark, path)
    return C.covered_years(C.resolve_refs(claims, stats), C.cited_evidence(claims, items),
                           C.years_by_family(stats, items))


QUOTE = "trim(trim(trim(text), '\"''“”‘’'))"


@query("Q2_U6_validate_claims", f"""
  SELECT * FROM (WITH v AS (
    SELECT *, CASE WHEN claim_id = '' THEN '#' || claim_no ELSE claim_id END AS label FROM claim)
  SELECT label AS entity_id, 'missing_claim_id' AS rule, '' AS detail, CAST(1 AS BIGINT) AS n FROM v WHERE claim_id = ''
  UNION ALL SELECT label, 'unknown_section', section, 1 FROM v WHERE section = 'bogus'
  UNION ALL SELECT label, 'unknown_claim_type', claim_type, 1 FROM v WHERE claim_type = 'guess'
  UNION ALL SELECT label, 'unknown_support_level', support_level, 1 FROM v WHERE support_level = 'huge'
  UNION ALL SELECT label, 'missing_limitations', '', 1 FROM v WHERE len(limitations) = 0
  UNION ALL SELECT label, 'excerpt_without_evidence', '', 1 FROM v WHERE claim_type = 'evidence_excerpt' AND len(evidence_ids) = 0
  UNION ALL SELECT label, 'number_without_reference', '', 1 FROM v
    WHERE claim_type IN ('deterministic_fact', 'statistical_pattern') AND regexp_matches(text, '[0-9]') AND len(statistic_refs) = 0
  UNION ALL SELECT claim_id, 'duplicate_claim_id', '', count(*) - 1 FROM v WHERE claim_id <> '' GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT label, 'unknown_evidence', evidence_id, 1 FROM ccited JOIN v USING (claim_no) WHERE NOT known
  UNION ALL SELECT label, 'unresolved_reference', ref, 1 FROM cresolved JOIN v USING (claim_no) WHERE NOT resolved
  UNION ALL SELECT label, 'quote_not_verbatim', '', 1 FROM (
    SELECT v.label, claim_no, bool_or(known AND {QUOTE.replace('text', 'c.text')} <> ''
      AND contains(excerpt_text, {QUOTE.replace('text', 'c.text')})) AS hit
    FROM ccited c JOIN v USING (claim_no) WHERE c.claim_type = 'evidence_excerpt' GROUP BY 1, 2) WHERE NOT coalesce(hit, FALSE)
  UNION ALL SELECT label, 'unknown_year', venue_year, 1 FROM cscope WHERE venue_year NOT IN (SELECT venue_year FROM cyears)
  UNION ALL SELECT label, 'year_beyond_evidence', venue_year, 1 FROM cscope s
    WHERE cites AND venue_year IN (SELECT venue_year FROM cyears)
      AND NOT EXISTS (SELECT 1 FROM ccovered x WHERE x.claim_no = s.claim_no AND x.venue_year = s.venue_year))
""")
def q2(spark, path):
    return C.validate_claims(_claims(spark, path), _stats(spark, path), _evidence(spark, path))


cte("cfamily", """
  SELECT c.claim_no, c.claim_id, n.venue_family FROM claim c LEFT JOIN (
    SELECT DISTINCT claim_no, venue_family FROM (
      SELECT claim_no, string_split(ref, '/')[1] AS venue_family FROM cref WHERE len(string_split(ref, '/')) = 3
      UNION ALL SELECT claim_no, ev_family FROM ccited WHERE known)
    WHERE venue_family IN (SELECT venue_family FROM cstat UNION SELECT venue_family FROM citem)) n USING (claim_no)
""")


@query("J16_claim_families", "SELECT * FROM cfamily")
def j16(spark, path):
    return C.claim_families(_claims(spark, path), _stats(spark, path), _evidence(spark, path))


@query("C7_venue_packs", """
  SELECT f.venue_family, years_covered, n_years, forum_count, review_count, decisions_resolved, preliminary,
    (SELECT count(*) FROM citem i WHERE i.venue_family = f.venue_family) AS evidence_count,
    (SELECT count(*) FROM cfamily c WHERE c.venue_family = f.venue_family) AS claim_count
  FROM (SELECT venue_family FROM cstat UNION SELECT venue_family FROM citem) f LEFT JOIN family_meta USING (venue_family)""")
def c7(spark, path):
    return C.venue_packs(_claims(spark, path), _stats(spark, path), _evidence(spark, path))


@query("C8_claims_in_report_order", f"""
  SELECT CAST(coalesce(list_position({_LIST(S.CLAIM_SECTIONS)}, section), 0) AS INTEGER) AS section_no, section, claim_id, claim_type, text,
    support_level, array_to_string(year_scope, ',') AS years, coalesce(s.sources, '') AS sources,
    array_to_string(statistic_refs, ', ') AS statistics, array_to_string(limitations, '; ') AS limitations
  FROM claim c LEFT JOIN (
    SELECT claim_no, string_agg(forum_id || ' ' || note_id || ' ' || source_url, '; ' ORDER BY pos) AS sources
    FROM (SELECT claim_no, unnest(evidence_ids) AS evidence_id, generate_subscripts(evidence_ids, 1) AS pos FROM claim)
    JOIN citem USING (evidence_id) GROUP BY 1) s USING (claim_no)""")
def c8(spark, path):
    return C.report_rows(_claims(spark, path), _evidence(spark, path))


@query("Q9_inputs_match", """
  SELECT 'inputs' AS entity_id, 'corpora_differ' AS rule, '' AS detail, CAST(1 AS BIGINT) AS n FROM corpus_digest
  UNION ALL SELECT 'inputs', 'evidence_schema_version', '9', 1 FROM corpus_digest""")
def q9(spark, path):
    full = corpus_digest(D.order_forums(spark, path, False), D.order_reviews(spark, path))
    part = corpus_digest(D.document_forums(spark, path), D.document_reviews(spark, path))
    return C.inputs_match(full.withColumn("schema_version", F.lit(1)),
                          part.withColumn("schema_version", F.lit(9)))


def _provenance_sql():
    from colloquy.plans.ingest_queries import _set_digest_sql

    stat = ("(SELECT metric || chr(0) || venue_family || chr(0) || venue_year || chr(0) || path || chr(0) || value AS m "
            "FROM stat WHERE metric IN ('forum_count', 'decision_distribution'))")
    return f"""
      SELECT *, substr(sha256(corpus_hash || chr(0) || evidence_bundle_hash || chr(0) || 'm1' || chr(0) || '{{}}' || chr(0)
        || chr(0) || '1' || chr(0) || statistics_hash || chr(0)), 1, 16) AS content_hash, 't' AS generated_at
      FROM (SELECT s.statistics_hash, e.evidence_bundle_hash, d.corpus_hash, CAST(NULL AS VARCHAR) AS provider,
          'm1' AS model, '{{}}' AS params, 1 AS schema_version
        FROM ({_set_digest_sql('m', stat, 'statistics_hash')}) s,
 corpus_digest d,
          ({_set_digest_sql('evidence_id', 'citem', 'evidence_bundle_hash')}) e)"""


@query("F4_generation_provenance", _provenance_sql())
def f4b(spark, path):
    c = D.orders_corpus(spark, path, False)
    stats = ST.compute(c.forum, c.review, c.response, ("forum_count", "decision_distribution"))
    digest = corpus_digest(c.forum, c.review).first().corpus_hash
    return C.provenance(stats, _evidence(spark, path), digest, model="m1", generated_at="t")


@query("F13_parse_generated_claims", """
  SELECT conv_id, turn, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END IS NULL AS refused,
    CASE k % 4 WHEN 1 THEN 'not_json' WHEN 2 THEN 'no_claims' WHEN 3 THEN 'claims_not_a_list' END AS error,
    CAST(CASE k % 4 WHEN 0 THEN 2 END AS INTEGER) AS n_claims FROM turn_note""")
def f13(spark, path):
    t = D.table(spark, path, "conversations").withColumn("m", F.length("text") % 4)
    claim = F.to_json(F.struct("text"))
    raw = (
        F.when(F.col("m") == 0, F.concat(F.lit('```json\n{"claims": ['), claim, F.lit(", "), claim,
                                         F.lit("]}\n```")))
        .when(F.col("m") == 1, F.concat(F.lit("Sure: "), claim))
        .when(F.col("m") == 2, claim).otherwise(F.lit(' {"claims": {"a": 1}} ')))
    return C.parse_responses(t.select("conv_id", "turn", raw.alias("raw_text"))).select(
        "conv_id", "turn", F.col("error").isNotNull().alias("refused"), "error",
        F.size("claims").alias("n_claims"))


# --- venue look-up ----------------------------------------------------------------------

cte("alias", """
  SELECT n_name AS family, n_name AS alias FROM nation
  UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
""")
cte("alias_family", """
  SELECT lower(alias) AS name, count(DISTINCT family) AS k, string_agg(DISTINCT family, ',' ORDER BY family) AS families
  FROM alias GROUP BY 1
""")


def _aliases(spark, path):
    n, t = D.table(spark, path, "nation"), lambda x: D.table(spark, path, x)
    own = n.select(F.col("n_name").alias("family"), F.col("n_name").alias("alias"))
    suppliers = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("family"), F.col("s_name").alias("alias"))
    regions = n.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("family"), F.col("r_name").alias("alias"))
    return own.unionByName(suppliers).unionByName(regions)


@query("J15_resolve_venues", """
  SELECT c_custkey, query, CASE WHEN a.name IS NULL THEN 'unsupported' WHEN k = 1 THEN 'supported' ELSE 'ambiguous' END AS status,
    CASE WHEN k = 1 THEN families END AS family, CASE WHEN k > 1 THEN families END AS candidates
  FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  nation_' || c_nationkey || ' ' WHEN 1 THEN upper(r_name)
        WHEN 2 THEN 'SUPPLIER#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE '' END AS query
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  LEFT JOIN alias_family a ON lower(trim(query)) = a.name""")
def j15(spark, path):
    t = lambda x: D.table(spark, path, x)
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = F.col("c_custkey") % 4
    q = (F.when(m == 0, F.concat(F.lit("  nation_"), F.col("c_nationkey").cast("string"), F.lit(" ")))
         .when(m == 1, F.upper("r_name"))
         .when(m == 2, F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
         .otherwise(""))
    queries = t("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", q.alias("query"))
    return C.resolve_venues(queries, _aliases(spark, path))


@query("A29_alias_collisions", """
  SELECT name, k AS n, families FROM alias_family WHERE k > 1""")
def a29(spark, path):
    return C.alias_collisions(_aliases(spark, path))


@query("U2_set_difference", """
  SELECT o_orderkey AS forum_id FROM orders EXCEPT SELECT forum_id FROM calibration""")
def u2(spark, path):
    return D.table(spark, path, "orders").select(F.col("o_orderkey").alias("forum_id")).join(
        D.calibration_ids(spark, path), "forum_id", "left_anti")
