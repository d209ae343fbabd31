"""Reading and writing corpora, datasets and reports.

Nested records are the exchange format. A forum with very many children is written
as several parts (``part`` of ``n_parts``), each with about ``chunk`` children, so
that no task ever builds one huge array; ordinary forums have one part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import labels as L
from colloquy.functions.digests import corpus_digest
from colloquy.functions.rows import with_row
from colloquy.functions.text import excerpt
from colloquy.operators.ingest import Corpus
from colloquy.operators.order_stats import latest

CHUNK = 5_000


# --- nested <-> flat --------------------------------------------------------------------


def flatten_forums(nested: DataFrame) -> DataFrame:
    """Forum rows with the decision and paper fields that operators read. A record in parts
    is one forum: its facts are those of part 0, its children those of all parts."""
    if "part" in nested.columns:
        nested = nested.where(F.coalesce("part", F.lit(0)) == 0)
    return nested.select(
        *[c for c in nested.columns if c not in ("reviews", "responses", "paper", "decision")],
        F.col("paper.title").alias("title"), F.col("paper.abstract").alias("abstract"),
        F.col("decision.normalized").alias("decision"),
        F.col("decision.raw_text").alias("decision_raw"),
    )


def flatten_reviews(nested: DataFrame) -> DataFrame:
    """Review rows. Only the fields a query uses are read from the file."""
    return nested.select("forum_id", F.explode("reviews").alias("r")).select(
        "forum_id", "r.*",
        F.col("r.initial_rating.value").alias("initial_value"),
        F.col("r.final_rating.value").alias("final_value"),
        F.col("r.confidence.value").alias("confidence_value"),
    )


def flatten_responses(nested: DataFrame) -> DataFrame:
    return nested.select("forum_id", F.explode("responses").alias("r")).select("forum_id", "r.*")


def flatten(nested: DataFrame) -> Corpus:
    return Corpus(flatten_forums(nested), flatten_reviews(nested), flatten_responses(nested))


def _chunked(children: DataFrame, fields: Sequence[str], name: str, chunk: int) -> DataFrame:
    """Arrays of children per (forum, part). The number of parts follows the forum's
    size and a child's part follows from its fields, so this needs no ordering. Only
    oversized forums are looked up; the explicit repartition by part lets Spark split
    a skewed look-up join, as nothing after it relies on the join's partitioning."""
    oversized = (
        children.groupBy("forum_id").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_parts"))
        .where(F.col("_parts") > 1)
    )
    part = F.pmod(F.xxhash64(*fields), F.coalesce("_parts", F.lit(1)))
    return (
        children.join(oversized, "forum_id", "left").withColumn("part", part.cast("int"))
        .repartition("forum_id", "part")
        .groupBy("forum_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    )


def nest(corpus: Corpus, chunk: int = CHUNK) -> DataFrame:
    """Nested records from flat tables."""
    reviews = _chunked(corpus.review, S.REVIEW_FULL.fieldNames(), "reviews", chunk)
    responses = _chunked(corpus.response, S.RESPONSE_FULL.fieldNames(), "responses", chunk)
    empty_reviews = F.array().cast(reviews.schema["reviews"].dataType)
    empty_responses = F.array().cast(responses.schema["responses"].dataType)
    children = reviews.join(responses, ["forum_id", "part"], "full_outer")
    parts = (
        corpus.forum.select("forum_id", F.lit(0).alias("part"))
        .unionByName(children.select("forum_id", "part")).distinct()
    )
    return (
        corpus.forum.join(parts, "forum_id")
        .join(children, ["forum_id", "part"], "left")
        .withColumns({
            "reviews": F.coalesce("reviews", empty_reviews),
            "responses": F.coalesce("responses", empty_responses),
        })
    )


# --- redaction --------------------------------------------------------------------------


def redact(nested: DataFrame, max_chars: int = S.PUBLIC_EXCERPT_CHARS,
           redact_decision: bool = False) -> DataFrame:
    """Replace review and response texts by excerpt structs. A corpus that already is
    public passes through unchanged. The raw decision text may be a whole meta-review;
    ``redact_decision`` cuts it to the excerpt length too."""
    if S.is_public_tier(nested):
        return nested
    out = nested.withColumns({
        "reviews": F.transform("reviews", lambda r: r.withField(
            "text", excerpt(r["text"], max_chars)).withField(
            "strengths", excerpt(r["strengths"], max_chars)).withField(
            "weaknesses", excerpt(r["weaknesses"], max_chars)).withField(
            "questions", excerpt(r["questions"], max_chars)).withField(
            "summary", excerpt(r["summary"], max_chars))),
        "responses": F.transform("responses", lambda r: r.withField(
            "text", excerpt(r["text"], max_chars))),
    })
    if redact_decision:
        out = out.withColumn("decision", F.col("decision").withField(
            "raw_text", F.substring("decision.raw_text", 1, max_chars)))
    return out


def redact_texts(rows: DataFrame, fields: Sequence[str],
                 max_chars: int = S.PUBLIC_EXCERPT_CHARS) -> DataFrame:
    """The same on a flat table."""
    return rows.withColumns({f: excerpt(f, max_chars) for f in fields})


# --- corpus files -----------------------------------------------------------------------


def parse_corpus_lines(lines: DataFrame, column: str = "value", public: bool = False) -> DataFrame:
    """Nested records from JSON lines; blank lines are skipped."""
    schema = S.FORUM_PUBLIC if public else S.FORUM_FULL
    return (
        lines.where(F.trim(column) != "")
        .select(F.from_json(F.col(column), schema, {"mode": "FAILFAST"}).alias("r"))
        .select("r.*")
    )


def load_corpus(spark: SparkSession, path: str, public: bool = False,
                version: str = "fetched_at") -> DataFrame:
    """Read a JSON-lines corpus; of several records of a forum the newest wins. A
    missing path is an empty corpus. A line that is no record fails the read; for keys
    outside the schema, which the reader skips, see `unknown_keys`."""
    schema = S.FORUM_PUBLIC if public else S.FORUM_FULL
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return latest_records(spark.read.schema(schema).json(path, mode="FAILFAST"), version)


def unknown_keys(lines: DataFrame, column: str = "value", public: bool = False) -> DataFrame:
    """Violation rows: JSON lines that are no object, and keys that a record does not have."""
    known = (S.FORUM_PUBLIC if public else S.FORUM_FULL).fieldNames()
    keys = F.json_object_keys(column)
    problem = F.when(keys.isNull(), F.array(F.lit(""))).otherwise(
        F.array_except(keys, F.array(*map(F.lit, known))))
    return (
        lines.where(F.trim(column) != "")
        .select(F.get_json_object(column, "$.forum_id").alias("forum_id"),
                F.explode(problem).alias("key"))
        .select(*L.violation("forum_id", F.when(F.col("key") == "", "not_a_record").otherwise("unknown_key"),
                             F.col("key")))
    )


def latest_records(nested: DataFrame, version: str = "fetched_at") -> DataFrame:
    """Newest record of every forum, with all of its parts. Both windows keep one
    version per forum on the map side, before the shuffle. Of different records with
    the same forum, version and part, a hash of the content decides; it is taken first, so
    that the windows sort and shuffle it and the columns the caller reads, not whole records."""
    newest = W.partitionBy("forum_id").orderBy(F.col(version).desc_nulls_last())
    hashed = nested.withColumn("part", F.coalesce("part", F.lit(0))).withColumn("_tie", F.xxhash64(*nested.columns))
    kept = hashed.withColumn("_v", F.rank().over(newest)).where(F.col("_v") == 1).drop("_v")
    return latest(kept, ["forum_id", "part"], [F.col(version).desc_nulls_last(), F.col("_tie")]).drop("_tie")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_corpus(nested: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a corpus, one directory per venue family for pruning."""
    nested.write.mode("overwrite").partitionBy("venue_family").format(fmt).save(path)


def save_public_index(nested: DataFrame, path: str, max_chars: int = S.PUBLIC_EXCERPT_CHARS,
                      redact_decision: bool = False, fmt: str = "parquet") -> None:
    save_corpus(redact(nested, max_chars, redact_decision), path, fmt)


def manifest(forum: DataFrame, review: DataFrame, *, seed: int | None = None,
             generated_at: float | None = None) -> DataFrame:
    """One row: counts and digest of a corpus."""
    counts = with_row(forum.agg(F.count(F.lit(1)).alias("record_count")),
                      review.agg(F.count(F.lit(1)).alias("review_count")))
    return with_row(counts, corpus_digest(forum, review)).withColumns({
        "schema_version": F.lit(S.SCHEMA_VERSION),
        "producer_version": F.lit(S.PRODUCER_VERSION),
        "seed": F.lit(seed).cast("int"),
        "generated_at": F.lit(generated_at).cast("double"),
    })


def write_table(df: DataFrame, path: str, header: dict[str, Column] | None = None,
                fmt: str = "parquet") -> None:
    """Write result rows under ``path/rows`` and a one-row header next to them. The row
    count in the header comes from the written files, not from a second run."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/rows")
    rows = df.sparkSession.read.format(fmt).schema(df.schema).load(f"{path}/rows")
    head = rows.agg(F.count(F.lit(1)).alias("row_count")).withColumns(header or {})
    head.write.mode("overwrite").format(fmt).save(f"{path}/header")


def canonical_order(df: DataFrame) -> DataFrame:
    """Published order of result rows: family, year as text, then the ids present. A
    range-partitioned sort for exports; the ids break up even the largest scope."""
    ids = [c for c in ("metric", "forum_id", "note_id", "path") if c in df.columns]
    return df.orderBy("venue_family", F.col("venue_year").cast("string"), *ids)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables under the shared folder that the cluster
    names in ``spark.checkpoint.dir``. Only a session inside one JVM, as in tests, may
    leave that unset and gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")

        base = tempfile.gettempdir() + "/colloquy-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table that the caller wrote into a scratch folder of its own and nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings inside the block."""
    before = {n: spark.conf.get(n, None) for n in values}
    try:
        for n, v in values.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


#: Shuffle files of a write go when it has ended, not when the driver happens to collect its garbage.
SHORT_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


# --- calibration ids --------------------------------------------------------------------


def parse_calibration_ids(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Distinct forum ids from JSON payloads: a list, ``{"forum_ids": [...]}`` or an
    evidence bundle ``{"items": [{"forum_id": ...}]}``. Non-strings are dropped."""
    v = F.try_parse_json(column)
    items = F.transform(
        F.try_variant_get(v, "$.items", "array<variant>"),
        lambda e: F.try_variant_get(e, "$.forum_id", "variant"))
    ids = F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        F.try_variant_get(v, "$.forum_ids", "array<variant>"), items)
    return (
        payloads.select(F.explode(ids).alias("e"))
        .where(F.schema_of_variant("e") == "STRING")
        .select(F.try_variant_get("e", "$", "string").alias("forum_id"))
        .where(F.col("forum_id") != "")
        .distinct()
    )


def load_calibration_ids(spark: SparkSession, path: str, split_bytes: int = 128 << 20, parts: bool = False) -> DataFrame:
    """Calibration ids from a file, or a folder of its parts, read by as many tasks as it has splits; an empty set is an error."""
    from colloquy.sources.json_document import calibration_ids, json_elements

    ids = calibration_ids(json_elements(spark, path, split_bytes, parts))
    if ids.isEmpty():
        raise ValueError(f"{path}: calibration forum set is empty")
    return ids
