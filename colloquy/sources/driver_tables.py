"""Peer-review corpora read from the test tables, so that every operator runs on them.

Two corpora. The *orders* corpus is structured and large: orders are forums, returned
line items are reviews, the other line items are responses. The *documents* corpus has
text: a forum is a (source, language) pair and its documents are reviews. Raw notes
come from ``conversations``, refresh results from ``events``.

The library does not depend on this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import notes as N
from colloquy.functions.hashing import review_hash
from colloquy.operators.ingest import Corpus


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def epoch_seconds(col: str) -> Column:
    """Epoch seconds of a zone-less timestamp, whatever the session time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, F.col(col)) / 1000000.0


# --- orders corpus ----------------------------------------------------------------------


def order_forums(spark: SparkSession, path: str, paper: bool = True) -> DataFrame:
    """One forum per order. The join to customers only supplies title and abstract."""
    o = table(spark, path, "orders")
    price = F.col("o_totalprice")
    raw = (
        F.when(F.col("o_orderstatus") == "F", "Accept (poster)")
        .when(F.col("o_orderstatus") == "O", F.when(price > 400000, "Desk reject").otherwise("Reject"))
        .otherwise(F.when(price > 400000, "Withdrawn by the authors").otherwise(""))
    )
    out = o.select(
        F.col("o_orderkey").alias("forum_id"),
        F.concat(F.lit(S.FORUM_URL_PREFIX), F.col("o_orderkey").cast("string")).alias("url"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .otherwise(F.col("o_orderpriority")).alias("venue_family"),
        F.when(price >= 20000, F.year("o_orderdate")).alias("venue_year"),
        raw.alias("decision_raw"),
        N.decision_outcome(raw).alias("decision"),
        epoch_seconds("o_orderdate").alias("fetched_at"),
        F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"),
    )
    if not paper:
        return out
    c = table(spark, path, "customer").select(
        F.col("c_custkey").alias("cust"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("").alias("title"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("abstract"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
    )
    return out.join(c, "cust", "left")


def _line_note() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def order_reviews(spark: SparkSession, path: str) -> DataFrame:
    base = F.floor(F.col("l_quantity") % 10) + 1
    revised = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    return (
        table(spark, path, "lineitem").where(F.col("l_returnflag") != "N")
        .select(
            F.col("l_orderkey").alias("forum_id"), _line_note().alias("note_id"),
            F.when(F.col("l_tax") < 0.075, base.cast("double")).alias("initial_value"),
            F.when(revised, F.least(F.lit(10), base + F.col("l_partkey") % 3).cast("double"))
            .alias("final_value"),
            F.when(F.col("l_discount") < 0.095, F.col("l_linenumber").cast("double"))
            .alias("confidence_value"),
        )
    )


def order_responses(spark: SparkSession, path: str) -> DataFrame:
    return (
        table(spark, path, "lineitem").where(F.col("l_returnflag") == "N")
        .select(F.col("l_orderkey").alias("forum_id"), _line_note().alias("note_id"))
    )


def orders_corpus(spark: SparkSession, path: str, paper: bool = True) -> Corpus:
    return Corpus(order_forums(spark, path, paper), order_reviews(spark, path),
                  order_responses(spark, path))


def calibration_ids(spark: SparkSession, path: str) -> DataFrame:
    """Forums of customers in one market segment were used for calibration."""
    f = order_forums(spark, path)
    return f.where(F.col("segment") == "BUILDING").select("forum_id")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of two systems; neither covers customers with a negative balance."""
    f = order_forums(spark, path).where(F.col("balance") >= 0)
    cust = F.col("cust")
    prob = (cust % 101) / 100.0
    generic = f.select(
        "forum_id", F.lit(S.SYSTEM_GENERIC).alias("system"),
        (cust % 10 + 1).cast("double").alias("rating_prediction"),
        F.when(prob >= 0.5, "accept").otherwise("reject").alias("decision_prediction"),
        F.when(F.col("price") >= 20000, prob).alias("accept_probability"))
    calibrated = f.select(
        "forum_id", F.lit(S.SYSTEM_CALIBRATED).alias("system"),
        F.when(F.col("price") >= 20000, ((cust * 7) % 10 + 1).cast("double"))
        .alias("rating_prediction"),
        F.when(F.col("decision") == "accept", "accept")
        .when(prob >= 0.3, "accept").otherwise("reject").alias("decision_prediction"),
        F.when(F.col("decision") == "accept", (prob + 1) / 2).otherwise(prob / 2)
        .alias("accept_probability"))
    return generic.unionByName(calibrated)


# --- documents corpus -------------------------------------------------------------------


def _documents(spark: SparkSession, path: str) -> DataFrame:
    labels = table(spark, path, "labels")
    return table(spark, path, "documents").join(labels, "doc_id", "left").withColumn(
        "forum_id", F.concat_ws("/", "source", "lang"))


def document_reviews(spark: SparkSession, path: str) -> DataFrame:
    d = _documents(spark, path).where(F.coalesce("toxic", F.lit(0)) == 0)
    weak = F.coalesce(F.col("quality") == 0, F.lit(False))
    n = F.col("n_chars")
    return d.select(
        "forum_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("note_id"),
        F.when(n >= 200, (n % 10 + 1).cast("double")).alias("initial_value"),
        F.when(F.col("quality") == 1, F.least(F.lit(10), n % 10 + 2).cast("double"))
        .alias("final_value"),
        (n % 5 + 1).cast("double").alias("confidence_value"),
        F.when(weak, "").otherwise(F.col("text")).alias("text"),
        F.when(weak, F.col("lang")).otherwise("").alias("strengths"),
        F.when(weak, F.col("text")).otherwise("").alias("weaknesses"),
        F.substring_index("text", "\n", 1).alias("questions"),
        F.col("source").alias("summary"),
    ).withColumn("content_hash", review_hash())


def document_responses(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path).where(F.col("toxic") == 1).select(
        "forum_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("note_id"), "text")


def document_forums(spark: SparkSession, path: str) -> DataFrame:
    """A forum per (source, language); its abstract is its longest document."""
    g = _documents(spark, path).groupBy("forum_id", "source", "lang").agg(
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("quality") == 0).alias("bad"),
        F.max_by("text", F.struct("n_chars", "doc_id")).alias("abstract"))
    raw = (F.when(F.col("good") > 3 * F.col("bad"), "Accept (oral)")
           .when(F.col("bad") > 0, "Reject").otherwise(""))
    return g.select(
        "forum_id", F.concat(F.lit(S.FORUM_URL_PREFIX), "forum_id").alias("url"),
        F.col("lang").alias("venue_family"),
        (F.substring("source", 4, 9).cast("int") % 4 + 2020).alias("venue_year"),
        F.col("source").alias("title"), "abstract", raw.alias("decision_raw"),
        N.decision_outcome(raw).alias("decision"))


def documents_corpus(spark: SparkSession, path: str) -> Corpus:
    return Corpus(document_forums(spark, path), document_reviews(spark, path),
                  document_responses(spark, path))


# --- raw notes --------------------------------------------------------------------------


def _turns(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "conversations").withColumns({
        "forum": F.col("conv_id").cast("string"),
        "id": F.concat_ws("-", "conv_id", "turn"),
        "k": F.length("text"),
    })


def child_notes(spark: SparkSession, path: str) -> DataFrame:
    """Turns as review, comment and decision notes with JSON content."""
    wrap = lambda c, name: F.struct(c.alias("value")).alias(name)
    k = F.col("k")
    score = F.concat((k % 10 + 1).cast("string"), F.lit(": score of a turn"))
    review = F.to_json(F.struct(
        wrap(F.when(k % 2 == 0, score), "rating"), wrap(score, "recommendation"),
        wrap((k % 5 + 1).cast("string"), "confidence"), wrap(F.col("text"), "review"),
        F.col("role").alias("summary"),
        F.array(F.col("role"), F.col("forum")).alias("questions")),
        {"ignoreNullFields": "false"})
    comment = F.to_json(F.struct(F.lit("").alias("comment"), wrap(F.col("text"), "reply")))
    verdict = (F.when(k % 4 == 0, "Accept (Poster)").when(k % 4 == 1, "We are rejecting this")
               .when(k % 4 == 2, "desk-reject").otherwise("No verdict yet"))
    decision = F.to_json(F.struct(wrap(verdict, "decision")))
    kind = F.when(F.col("role") == "user", "Official_Review").when(
        F.col("role") == "assistant", "Official_Comment").otherwise("Decision")
    inv = F.concat(F.lit("venue/-/"), kind)
    return _turns(spark, path).select(
        "id", "forum",
        F.when(k % 3 > 0, inv).alias("invitation"),
        F.when(k % 3 == 0, F.array(inv, F.lit("venue/-/Edit"))).alias("invitations"),
        F.when(F.col("role") == "user", review).when(F.col("role") == "assistant", comment)
        .otherwise(decision).alias("content"),
        (F.col("turn") * 1000).alias("mdate"), (F.col("turn") * 1000 + 7).alias("tmdate"),
        F.col("turn").alias("tcdate"))


def paper_notes(spark: SparkSession, path: str) -> DataFrame:
    """First turns as submission notes; the venue id depends on the text length."""
    k = F.col("k")
    venueid = (F.when(k % 7 == 0, "v/Withdrawn_Submission").when(k % 7 == 1, "v/Desk_Rejected_Submission")
               .when(k % 7 == 2, "v/Rejected_Submission").when(k % 7 == 3, "v/Conference")
               .when(k % 7 == 4, "v/Submission"))
    content = F.to_json(F.struct(
        F.struct(F.substring("text", 1, 30).alias("value")).alias("title"),
        F.col("text").alias("abstract"),
        F.struct(F.array(F.col("role"), F.lit("x")).alias("value")).alias("keywords"),
        F.array("role").alias("authors"),
        F.struct(venueid.alias("value")).alias("venueid"),
        F.struct(F.when(k % 2 == 0, "v 2024 Spotlight").alias("value")).alias("venue")),
        {"ignoreNullFields": "false"})
    return _turns(spark, path).where(F.col("turn") == 0).select(
        F.col("forum").alias("id"), "forum", content.alias("content"),
        F.col("turn").alias("tcdate"), F.col("k").alias("size"))


# --- refresh results --------------------------------------------------------------------


def refresh_results(spark: SparkSession, path: str) -> DataFrame:
    return as_refresh_results(table(spark, path, "events"))


def stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as a stream of files."""
    schema = table(spark, path, name).schema
    return spark.readStream.schema(schema).format("parquet").option(
        "pathGlobFilter", f"{name}.parquet").load(path)


def as_refresh_results(events: DataFrame) -> DataFrame:
    """Events as refresh results: an error is a failed fetch, a purchase a change; a
    sign-up of some value carries a decision. Some first fetch times are 0 or missing."""
    return events.select(
        F.col("user_id").alias("forum_id"),
        epoch_seconds("ts").alias("ts"), F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("event_type") == "purchase").alias("changed"),
        F.when((F.col("event_type") == "signup") & (F.col("value") > 60),
               F.when(F.col("value") > 90, "withdrawn").otherwise("accept"))
        .otherwise("unknown").alias("decision"),
        (F.col("user_id") % 3 == 0).alias("active"),
        F.when(F.col("user_id") % 50 == 7, 0.0).when(F.col("user_id") % 50 != 8, 1696118400.0).alias("fetched_at"))
