"""Fixtures: a local session and small corpora built by hand."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from colloquy.functions.hashing import review_hash  # noqa: E402
from colloquy.operators.ingest import Corpus  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("colloquy-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_corpus(spark, forums, *, text=None):
    """Corpus from (id, family, year, decision, [rating | (initial, final)], responses)."""
    f, r, p = [], [], []
    for fid, family, year, decision, ratings, responses in forums:
        f.append((fid, f"https://openreview.net/forum?id={fid}", family, year, f"Paper {fid}",
                  f"A synthetic abstract for {fid}.", decision, decision))
        for i, rating in enumerate(ratings, 1):
            initial, final = rating if isinstance(rating, tuple) else (rating, None)
            note = f"{fid}_r{i}"
            body = f"Review {note}: the method is clearly described." if text is None else text
            r.append((fid, note, initial, final, 4.0, body, "Solid results.", "Few ablations.", "", "Fine."))
        p += [(fid, f"{fid}_p{i}", f"Thank you for the feedback on {fid}, response {i}.")
              for i in range(responses)]
    forum = spark.createDataFrame(
        f, "forum_id string, url string, venue_family string, venue_year int, title string, "
           "abstract string, decision string, decision_raw string")
    review = spark.createDataFrame(
        r, "forum_id string, note_id string, initial_value double, final_value double, "
           "confidence_value double, text string, strengths string, weaknesses string, "
           "questions string, summary string").withColumn("content_hash", review_hash())
    response = spark.createDataFrame(p, "forum_id string, note_id string, text string")
    return Corpus(forum, review, response)


TWELVE = [
    ("f01", "iclr", 2024, "accept", [6.0, 8.0], 1), ("f02", "iclr", 2024, "reject", [3.0], 0),
    ("f03", "iclr", 2024, "unknown", [5.0, (5.0, 7.0), 7.0], 0), ("f04", "iclr", 2024, "accept", [9.0], 1),
    ("f05", "iclr", 2024, "reject", [2.0, 4.0], 0), ("f06", "iclr", 2024, "unknown", [6.0], 1),
    ("f07", "iclr", 2025, "accept", [8.0, (7.0, 8.0)], 1), ("f08", "iclr", 2025, "reject", [2.0, 1.0], 0),
    ("f09", "iclr", 2025, "unknown", [5.0, 6.0], 0), ("f10", "iclr", 2025, "accept", [9.0, (10.0, 9.0)], 1),
    ("f11", "iclr", 2025, "reject", [3.0], 0), ("f12", "iclr", 2024, "unknown", [4.0, 8.0], 0),
]
EVALUATION = [
    ("cal_001", "iclr", 2025, "accept", [7.0, 8.0], 0), ("cal_002", "iclr", 2025, "reject", [3.0], 0),
    ("cal_003", "iclr", 2024, "accept", [6.0, 6.0], 0), ("cal_004", "iclr", 2024, "reject", [2.0, 4.0], 0),
    ("eval_001", "iclr", 2025, "accept", [7.0, 6.0], 0), ("eval_002", "iclr", 2025, "reject", [3.0, 4.0], 0),
    ("eval_003", "iclr", 2024, "accept", [8.0, 7.0], 0), ("eval_004", "iclr", 2024, "reject", [2.0], 0),
    ("eval_005", "neurips", 2025, "accept", [6.0, 7.0, 6.0], 0), ("eval_006", "neurips", 2025, "reject", [3.0, 3.0], 0),
    ("eval_007", "neurips", 2024, "withdrawn", [5.0], 0), ("eval_008", "neurips", 2024, "unknown", [5.0, 6.0], 0),
]


@pytest.fixture(scope="session")
def twelve(spark):
    return make_corpus(spark, TWELVE)


@pytest.fixture(scope="session")
def evaluation(spark):
    return make_corpus(spark, EVALUATION)


@pytest.fixture(scope="session")
def calibration(spark):
    return spark.createDataFrame([(f"cal_00{i}",) for i in range(1, 5)], "forum_id string")


def rules(df):
    return sorted((r.entity_id, r.rule) for r in df.collect())


def value(df, column=0):
    return df.collect()[0][column]


def lit_row(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
