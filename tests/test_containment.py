"""Containment against `in` on all pairs."""

import random

import pytest

from colloquy.operators import containment as CT


def case(seed):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "the", "Quick", "fox", "ÉTÉ", "x.", "lazy", "dogs", "dog"]
    space = [" ", " ", " ", "  ", "\n", "\t "]

    def text(n):
        return "".join(rng.choice(words) + rng.choice(space) for _ in range(n))

    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(3, text(20)), (None, text(30)), (70, None), (71, ""), (72, " \n ")]
    needles = []
    for k in range(120):
        source = rng.choice(docs)[1] or "none"
        at = rng.randint(0, len(source))
        needles.append((k, source[at : at + rng.randint(1, 30)].upper() if k % 3 else text(rng.randint(1, 4))))
    return docs, needles + [(500, None), (501, ""), (502, " "), (503, "the"), (503, "dog"), (None, "fox")]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"broadcast_rows": 3, "tile_rows": 5}), (3, {"min_chars": 7})])
def test_containment_equals_all_pairs(spark, seed, options):
    docs, needles = case(seed)
    least = options.get("min_chars", 1)
    got = CT.contained(spark.createDataFrame(docs, "doc_id int, text string").repartition(3),
                       spark.createDataFrame(needles, "item_id int, text string"), **{"min_chars": least, **options}).collect()
    want = {(d, n) for d, t in docs for n, p in needles
            if t is not None and p is not None and len(p) >= least and p.strip() and p.lower() in t.lower()}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 50


def test_containment_without_texts_or_passages(spark):
    docs, needles = case(1)
    d = spark.createDataFrame(docs, "doc_id int, text string")
    n = spark.createDataFrame(needles, "item_id int, text string")
    assert CT.contained(d.limit(0), n, min_chars=1).count() == 0
    assert CT.contained(d, n.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [3, 200_000])
def test_anchored_passages_meet_no_text_by_a_nested_loop(spark, rows):
    docs, needles = case(4)
    out = CT.contained(spark.createDataFrame(docs, "doc_id int, text string"),
                       spark.createDataFrame(needles, "item_id int, text string"), broadcast_rows=rows)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_texts_are_cut_once_and_pieces_of_the_vocabulary_are_not_shuffled(spark, monkeypatch, tmp_path):
    docs, needles = case(5)
    d = spark.createDataFrame(docs, "doc_id int, text string")
    asked = CT.needle_table(spark.createDataFrame(needles, "item_id int, text string"), "item_id", "text", 1)
    short = asked.where("size(parts) < 3")
    words = CT.text_words(d, "doc_id", "text", str(tmp_path))
    plan = CT._short_anchors(short, words.select("token").distinct(), 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.index("Join") < plan.index("Generate") and "strategy=broadcast" in plan
    first = plan[plan.index("Join"):]
    assert "Aggregate" not in first[:first.index("Generate")]  # distinct after the join, not on all pieces
    cuts, cut = [], CT._tokens
    monkeypatch.setattr(CT, "_tokens", lambda c: cuts.append(c) or cut(c))
    CT.contained(d, spark.createDataFrame(needles, "item_id int, text string"), min_chars=1)
    assert len(cuts) == 2  # passages once, texts once
