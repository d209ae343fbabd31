"""Note parsing, assembly, migration, storage and keyed maintenance."""

import hashlib
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.functions import digests as DG
from colloquy.functions import hashing as H
from colloquy.functions import labels as L
from colloquy.functions import notes as N
from colloquy.functions import text as TX
from colloquy.operators import ingest as I
from colloquy.plans import QUERIES
from colloquy.sources import corpus as SC
from tests.conftest import lit_row


def field(spark, content, key):
    df = lit_row(spark, c=json.dumps(content)).select(N.field_text(N.parse_content("c"), key).alias("x"))
    return df.first().x


@pytest.mark.parametrize("content,key,want", [
    ({"title": "Hello"}, "title", "Hello"),
    ({"title": {"value": "Hello"}}, "title", "Hello"),
    ({"authors": {"value": ["Alice", "Bob"]}}, "authors", "Alice, Bob"),
    ({"k": ["a", "b", "c"]}, "k", "a, b, c"),
    ({}, "authors", ""),
    ({"a": {"value": None}}, "a", ""),
    ({"a": None}, "a", ""),
    ({"a": 6}, "a", "6"),
])
def test_get_field(spark, content, key, want):
    assert field(spark, content, key) == want


def test_malformed_content_is_an_empty_note(spark):
    df = lit_row(spark, c="{not json").select(N.field_text(N.parse_content("c"), "a").alias("x"))
    assert df.first().x == ""


@pytest.mark.parametrize("content,want", [
    ({"rating": 0, "recommendation": "7"}, "7"), ({"rating": "0", "recommendation": "7"}, "0"),
    ({"rating": "", "score": {"value": 3}}, "3"), ({"rating": [], "overall": "x"}, "x"), ({}, ""),
])
def test_fall_through(spark, content, want):
    df = lit_row(spark, c=json.dumps(content)).select(N.variant_text(N.first_field(
        N.parse_content("c"), "rating", "recommendation", "score", "overall")).alias("x"))
    assert df.first().x == want


def test_rating(spark):
    texts = ["6: marginally above the acceptance threshold", "7", None, "-1 - poor", "4.5: ok", "good", "a-b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(N.rating("t").alias("r"))
    got = [(r.r.value, r.r.label) for r in df.collect()]
    assert got == [(6.0, "marginally above the acceptance threshold"), (7.0, ""), (None, ""),
                   (-1.0, "1 - poor"), (4.5, "ok"), (None, ""), (None, "")]


@pytest.mark.parametrize("text,want", [
    ("Accept (Oral)", ("accept", "oral")), ("The paper is accepted for publication", ("accept", "")),
    ("Reject", ("reject", "")), ("Withdrawn by authors", ("withdrawn", "")),
    ("Desk Rejected", ("desk_reject", "")), ("", ("unknown", "")),
    ("the AC recommend accepting this work", ("accept", "")),
    ("the committee is rejecting this submission", ("reject", "")),
    ("falls short of the acceptance threshold", ("accept", "")),
])
def test_decision(spark, text, want):
    r = lit_row(spark, t=text).select(N.decision("t").alias("d")).first().d
    assert (r.normalized, r.category) == want


@pytest.mark.parametrize("inv,want", [
    ("X/2026/-/Official_Review", "review"), ("X/-/Rebuttal", "rebuttal"), ("X/-/Decision", "decision"),
    ("X/-/Public_Comment", "other"), ("X/-/Official_Comment", "rebuttal"), ("X/-/Meta_Review", "decision"),
])
def test_invitation(spark, inv, want):
    assert lit_row(spark, i=inv).select(N.classify_invitation("i").alias("k")).first().k == want


@pytest.mark.parametrize("venueid,venue,want", [
    ("V/Conference/Submission", None, None), (None, None, None),
    ("V/Withdrawn_Submission", "w", ("withdrawn", "")), ("V/Desk_Rejected_Submission", None, ("desk_reject", "")),
    ("V/Rejected_Submission", "s", ("reject", "")), ("V/Conference", "V 2024 spotlight", ("accept", "spotlight")),
])
def test_venueid(spark, venueid, venue, want):
    df = spark.createDataFrame([(venueid, venue)], "a string, b string")
    d = df.select(N.decision_from_venueid("a", "b").alias("d")).first().d
    assert (d and (d.normalized, d.category)) == want


def notes(spark, *rows):
    return spark.createDataFrame(
        [(i, f, inv, None, json.dumps(c), m, None, t) for i, f, inv, c, m, t in rows], S.NOTE)


def test_assembly(spark):
    papers = notes(spark, ("f1", "f1", None, {"title": {"value": "A Great Paper"}, "authors": {"value": ["Alice", "Bob"]}}, None, 0),
                   ("f2", "f2", None, {"venueid": {"value": "V/Rejected_Submission"}}, None, 0))
    kids = notes(
        spark, ("r1", "f1", "V/-/Official_Review", {"rating": {"value": "6: ok"}}, 5, 1),
        ("r2", "f1", "V/-/Official_Review", {"rating": {"value": "3: reject"}}, 6, 2),
        ("d1", "f1", "V/-/Decision", {"decision": {"value": "Reject"}}, 7, 3),
        ("d2", "f1", "V/-/Decision", {"decision": {"value": "Accept (poster)"}}, 8, 4),
        ("c1", "f1", "V/-/Rebuttal", {"comment": {"value": "thanks"}}, 9, 5),
        ("m2", "f2", "V/-/Meta_Review", {"metareview": "falls short of the acceptance threshold"}, 1, 6))
    c = I.assemble(papers, kids, venue_family=F.lit("iclr"), venue_id=F.lit("V"), venue_year=F.lit(2026),
                   api_version=F.lit("v2"), fetched_at=F.lit(1.0), order=[F.col("tcdate"), F.col("id")])
    forums = {r.forum_id: r for r in c.forum.collect()}
    assert forums["f1"].decision.normalized == "accept" and forums["f1"].decision.category == "poster"
    assert forums["f1"].paper.authors == "Alice, Bob" and forums["f1"].decision.note_id == "d2"
    assert forums["f2"].decision.normalized == "reject"  # the venue id outranks the note
    nested = {r.forum_id: r for r in SC.nest(c).collect()}
    assert [x.initial_rating.value for x in nested["f1"].reviews] == [6.0, 3.0]
    assert len(nested["f1"].responses) == 1 and nested["f2"].reviews == []


LEGACY = {"ICLR 2024": [
    {"note_id": "rev_a1", "forum_id": "forumA", "rating": "6: above", "rating_num": 6.0, "text": "Review text A"},
    {"note_id": "rev_a2", "forum_id": "forumA", "rating": "3: reject", "rating_num": 3.0, "text": "A2"},
    {"note_id": "rev_b1", "forum_id": "forumB", "rating_num": 8.0},
    {"note_id": "rev_a1", "forum_id": "forumA", "rating_num": 1.0},
    {"forum_id": "forumB", "rating_num": 5.0}, {"forum_id": "forumB", "rating_num": 5.0},
    {"note_id": "x"}], "_forum_z": [{"forum_id": "q"}], "note": "text", "Other": [{"forum_id": "o", "note_id": "n"}]}


def test_legacy_migration(spark):
    dumps = spark.createDataFrame([(json.dumps(LEGACY), 0)], "json string, dump_order int")
    c = I.migrate_legacy(dumps, S.venue_registry(spark))
    assert {(r.forum_id, r.venue_family, r.venue_year) for r in c.forum.collect()} == {
        ("forumA", "iclr", 2024), ("forumB", "iclr", 2024), ("o", "unknown", None)}
    got = sorted((r.forum_id, r.note_id or "", r.initial_value) for r in c.review.where("venue_family = 'iclr'").collect())
    assert got == [("forumA", "rev_a1", 6.0), ("forumA", "rev_a2", 3.0), ("forumB", "", 5.0),
                   ("forumB", "", 5.0), ("forumB", "rev_b1", 8.0)]


def test_legacy_names_keep_document_order(spark):
    text = '{"ICLR 2024": [{"forum_id": "f", "note_id": "n", "rating_num": 2}], "ICLR 2023": [{"forum_id": "f", "note_id": "n", "rating_num": 1}]}'
    c = I.migrate_legacy(spark.createDataFrame([(text, 0)], "json string, dump_order int"), S.venue_registry(spark))
    assert (c.forum.first().venue_year, c.review.first().initial_value) == (2024, 2.0)


def test_legacy_reviews_are_shuffled_once_and_sorted_by_a_hash(spark):
    review = lambda n, v: {"forum_id": "f", "note_id": n, "rating_num": v}
    rows = [(json.dumps({name: [review("n", v), review(f"n{v}", v), review(None, v)]}), v)
            for v, name in enumerate(("ICLR 2024", "ICLR 2023", "Other", "Other"))]
    c = I.migrate_legacy(spark.createDataFrame(rows[::-1], "json string, dump_order int").repartition(4), S.venue_registry(spark))
    text = c.review._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.venue_family, r.note_id or "", r.initial_value) for r in c.review.collect())
    assert got == [("iclr", "", 0.0), ("iclr", "", 1.0), ("iclr", "n", 0.0), ("iclr", "n0", 0.0), ("iclr", "n1", 1.0),
                   ("unknown", "", 2.0), ("unknown", "", 3.0), ("unknown", "n", 2.0), ("unknown", "n2", 2.0), ("unknown", "n3", 3.0)]
    shuffles, sorts = re.findall(r"Exchange hashpartitioning\((\w+)", text), re.findall(r" Sort \[(\w+)", text)
    assert shuffles == ["_hash"] and set(sorts) == {"_hash"} and "BroadcastHashJoin" in text


def test_legacy_document_is_dropped_once_it_is_read(spark, tmp_path):
    lines = spark.range(300).selectExpr(
        "id div 3 AS l_orderkey", "cast(id % 3 + 1 AS int) AS l_linenumber", "id * 7 % 90 AS l_partkey", "id % 11 AS l_suppkey",
        "(id % 4) / 100.0D AS l_discount", "(id % 5) / 100.0D AS l_tax", "timestamp_ntz '1996-01-01' AS l_shipdate",
        "cast(array('N', 'R')[id % 2] AS string) AS l_returnflag")
    lines.unionByName(lines.where("l_orderkey < 20 AND l_discount > 0.005")).write.parquet(f"{tmp_path}/lineitem.parquet")  # some dumps come twice
    scratch = Path(spark.conf.get("spark.checkpoint.dir"))
    before, shuffles = set(scratch.glob("*/*")), local_shuffles(spark)
    got = QUERIES["S5_migrate_legacy_reviews_from_one_file"](spark, str(tmp_path))
    names = {p.name for p in set(scratch.glob("*/*")) - before}
    assert names and not names & {"reviews", "document"}
    assert local_shuffles(spark) - shuffles < 20_000  # the document's lines were 70 kB of them
    text = got._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)", text) == ["_hash"]
    want = QUERIES["S5_migrate_legacy_reviews"](spark, str(tmp_path)).select(*got.columns)
    assert got.count() > 250 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def local_shuffles(spark):
    """Bytes of shuffle data on the disk of this session."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in Path(d).glob("*/shuffle_*.data"))


def test_corrupt_lines_and_unknown_keys(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"forum_id": "a", "fetched_at": 1.0}\n{"forum_id": \n')
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        SC.load_corpus(spark, str(tmp_path)).collect()
    lines = spark.createDataFrame([('{"forum_id": "a", "fetched_at": 1}',), ('{"forum_id": "b", "x": 1}',), ("[1]",), ("{",), (" ",)], "value string")
    got = sorted((r.entity_id, r.rule, r.detail) for r in SC.unknown_keys(lines).collect())
    assert got == [("<missing>", "not_a_record", ""), ("<missing>", "not_a_record", ""), ("b", "unknown_key", "x")]


def test_equal_versions_are_decided_by_content(spark):
    rows = [("a", 1.0, v, 0) for v in ("x", "y", "z")]
    one, two = (SC.latest_records(spark.createDataFrame(r, "forum_id string, fetched_at double, v string, part int")).collect()
                for r in (rows, rows[::-1]))
    assert one == two and len(one) == 1


def test_newest_records_sort_only_what_is_read(spark):
    lines = spark.createDataFrame([('{"forum_id": "a", "venue_family": "x", "fetched_at": 1}',)], "value string")
    got = SC.latest_records(SC.parse_corpus_lines(lines)).select("forum_id", "venue_family", "fetched_at")
    node, sorted_columns = got._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        if node.nodeName() == "Window":
            sorted_columns.append(node.child().output().mkString(" "))
        node = node.children().apply(0)
    assert len(sorted_columns) == 2 and not any("reviews" in c or "paper" in c for c in sorted_columns)
    assert [tuple(r) for r in got.collect()] == [("a", "x", 1.0)]


def test_hashes_equal_hashlib(spark):
    def want(*parts):
        h = hashlib.sha256()
        for p in parts:
            h.update(p.encode() + b"\0")
        return h.hexdigest()[:16]

    row = lit_row(spark, a="é", b="").select(
        H.content_hash("a", "b").alias("x"), H.content_hash(F.lit(None)).alias("y")).first()
    assert (row.x, row.y) == (want("é", ""), want(""))
    ids = spark.createDataFrame([("b",), ("a",), ("b",)], "forum_id string")
    assert DG.exact_id_hash(ids).first()["hash"] == want("a", "b")
    with pytest.raises(ValueError):
        DG.exact_id_hash(ids, limit=1)
    frozen = DG.id_digest(ids).first()["hash"]
    assert frozen == DG.id_digest(ids.distinct().repartition(3)).first()["hash"]
    assert frozen != DG.id_digest(ids.where("forum_id = 'a'")).first()["hash"]


def test_corpus_hashes(spark, twelve):
    h = hashlib.sha256()
    rows = {}
    for r in twelve.review.select("forum_id", "note_id").collect():
        rows.setdefault(r.forum_id, []).append(r.note_id)
    for f in sorted(x.forum_id for x in twelve.forum.collect()):
        h.update(f.encode() + b"".join(n.encode() for n in sorted(rows.get(f, []))))
    assert DG.exact_corpus_hash(twelve.forum, twelve.review).first()[0] == h.hexdigest()[:16]
    one = DG.corpus_digest(twelve.forum, twelve.review).first()[0]
    assert one == DG.corpus_digest(twelve.forum.repartition(7), twelve.review.repartition(5)).first()[0]
    assert one != DG.corpus_digest(twelve.forum, twelve.review.where("note_id <> 'f01_r1'")).first()[0]


def nested(spark, corpus, **kw):
    none = F.lit(None).cast("string")
    rating = lambda c: F.struct(
        F.col(c).cast("string").alias("raw"), F.col(c).alias("value"), F.lit("").alias("label"),
        F.lit(None).cast("double").alias("scale_min"), F.lit(None).cast("double").alias("scale_max"))
    review = corpus.review.withColumns({
        "invitation": none, "modified_at": F.lit(None).cast("double"), "initial_rating": rating("initial_value"),
        "final_rating": rating("final_value"), "confidence": rating("confidence_value")})
    response = corpus.response.withColumns({
        "kind": F.lit("rebuttal"), "modified_at": F.lit(None).cast("double"), "content_hash": H.response_hash()})
    forum = corpus.forum.select(
        "forum_id", "url", "venue_family", "venue_year", F.struct("title", "abstract", none.alias("keywords"),
                                                                   none.alias("authors")).alias("paper"),
        F.struct(F.col("decision_raw").alias("raw_text"), F.col("decision").alias("normalized"),
                 F.lit("").alias("category"), none.alias("note_id")).alias("decision"))
    return SC.nest(I.Corpus(forum, review, response), **kw)


def test_round_trip_redaction_and_parts(spark, twelve, tmp_path):
    full = nested(spark, twelve, chunk=2)
    assert full.where("forum_id = 'f03'").count() >= 2  # three reviews do not fit one part
    SC.save_corpus(full, str(tmp_path / "full"))
    back = SC.flatten(spark.read.parquet(str(tmp_path / "full")))
    assert back.review.count() == twelve.review.count()
    public = SC.redact(full, 10)
    assert S.is_public_tier(public) and not S.is_public_tier(full)
    assert SC.redact(public, 3).schema == public.schema
    text = SC.flatten_reviews(public).where("note_id = 'f01_r1'").first().text
    original = twelve.review.where("note_id = 'f01_r1'").first().text
    assert (text.excerpt, text.length) == (original[:10], len(original))
    assert text.hash == hashlib.sha256(original.encode()).hexdigest()[:16]


def test_load_corpus_newest_record_wins(spark, tmp_path):
    path = tmp_path / "c"
    path.mkdir()
    lines = [{"forum_id": "a", "venue_family": "x", "fetched_at": 1.0}, {"forum_id": "a", "venue_family": "y", "fetched_at": 2.0},
             {"forum_id": "b", "venue_family": "z", "fetched_at": 1.0}]
    (path / "p.json").write_text("\n\n".join(json.dumps(x) for x in lines) + "\n")
    got = {r.forum_id: r.venue_family for r in SC.load_corpus(spark, str(path)).collect()}
    assert got == {"a": "y", "b": "z"}
    assert SC.load_corpus(spark, str(tmp_path / "missing")).count() == 0


def test_newest_record_keeps_all_its_parts(spark, tmp_path):
    path = tmp_path / "c"
    path.mkdir()
    rec = lambda part, at, tag: {"forum_id": "a", "part": part, "fetched_at": at, "venue_id": tag}
    lines = [rec(0, 1.0, "old"), rec(1, 1.0, "old"), rec(2, 1.0, "old"), rec(0, 2.0, "x"), rec(1, 2.0, "y"), rec(1, 2.0, "y")]
    (path / "p.json").write_text("\n".join(map(json.dumps, lines)))
    assert sorted(r.venue_id for r in SC.load_corpus(spark, str(path)).collect()) == ["x", "y"]


def test_upsert_unseen_and_changes(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 5.0)], "forum_id string, v int, fetched_at double")
    new = spark.createDataFrame([("a", 2, 1.0), ("b", 2, 4.0), ("c", 2, 1.0)], "forum_id string, v int, fetched_at double")
    assert {r.forum_id: r.v for r in I.upsert(old, new).collect()} == {"a": 2, "b": 1, "c": 2}
    assert [r.forum_id for r in I.unseen(new, old).collect()] == ["c"]
    h = "forum_id string, content_hash string"
    a = spark.createDataFrame([("x", "1"), ("x", "1"), ("y", "1")], h)
    b = spark.createDataFrame([("x", "1"), ("y", "1")], h)
    assert [r.forum_id for r in I.changed_forums(a, b).collect()] == ["x"]


def test_run_log_and_registry(spark):
    lines = ["noise", 'S=[{"venue": "old"}]', 'S=[{"venue": "A", "new": 2, "errors": 1, "status": "partial"}]', "end"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    assert [(r.venue, r.new, r.status) for r in I.parse_run_log(df, "S=").collect()] == [("A", 2, "partial")]
    reg = S.venue_registry(spark)
    assert reg.count() == 33
    got = {r.display_name for r in I.venue_entries(reg, ["icml"], [2024]).collect()}
    assert got == {"ICML 2024", "TMLR"}


def test_calibration_ids(spark, tmp_path):
    for payload in (["a", "a", "b", "", 3], {"forum_ids": ["a", "b"]}, {"items": [{"forum_id": "a"}, {"forum_id": "b"}]}):
        p = tmp_path / "c.json"
        p.write_text(json.dumps(payload))
        assert {r.forum_id for r in SC.load_calibration_ids(spark, str(p)).collect()} == {"a", "b"}
    p.write_text("[]")
    with pytest.raises(ValueError):
        SC.load_calibration_ids(spark, str(p))


def test_small_expressions(spark):
    row = lit_row(spark, n="  ICLR \t 2024 ", q=' “x y” ', u="https://o.net/forum?id=abc&n=1", v="plain",
                  f='```json\n{"a": 1}\n```').select(
        TX.normalize_name("n").alias("n"), TX.strip_quotes("q").alias("q"), TX.forum_id_from_url("u").alias("u"),
        TX.forum_id_from_url("v").alias("v"), TX.year_of("n").alias("y"), TX.strip_code_fence("f").alias("f"),
        L.backoff_hours(F.lit(20)).alias("b"), L.is_active_cycle(F.lit("iclr"), F.lit(2026)).alias("on"),
        L.is_active_cycle(F.lit("iclr"), F.lit(None).cast("int")).alias("off")).first()
    assert tuple(row) == ("iclr 2024", "x y", "abc", "plain", 2024, '{"a": 1}', 24.0 * 64, True, False)
