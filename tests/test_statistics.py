"""Hand-computed statistics, order independence and skew."""

import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from colloquy.operators import order_stats as O
from colloquy.operators import statistics as ST
from tests.conftest import make_corpus


@pytest.fixture(scope="module")
def abc(spark):
    c = make_corpus(spark, [("A", "testv", 2025, "accept", [6.0, (4.0, 6.0)], 1),
                            ("B", "testv", 2025, "reject", [8.0], 0),
                            ("C", "testv", 2026, "unknown", [], 0)])
    c.forum = c.forum.withColumns({t: F.when(F.col("forum_id") == "C", "").otherwise(F.col(t))
                                   for t in ("title", "abstract")})
    c.review = c.review.withColumn("confidence_value", F.expr(
        "case note_id when 'A_r1' then 4D when 'A_r2' then 2D else 5D end"))
    return c


@pytest.fixture(scope="module")
def stats(abc):
    df = ST.compute(abc.forum, abc.review, abc.response)
    out = {}
    for r in df.collect():
        out.setdefault((r.metric, r.venue_year), {})[r.path] = r
    return out


def read(stats, metric, year="2025"):
    return {p: r.value for p, r in stats[metric, year].items()}


def sizes(stats, metric, year="2025"):
    row = next(iter(stats[metric, year].values()))
    return row.sample_size, row.missing_count


def test_scopes_and_metric_names(stats):
    assert {y for _, y in stats} == {"2025", "2026", "all"}
    assert {m for m, _ in stats} == set(ST.METRICS)
    assert len(stats) == 60


def test_counts(stats):
    assert read(stats, "forum_count") == {"": 2.0} and sizes(stats, "forum_count") == (2, 0)
    assert read(stats, "review_count") == {"": 3.0}
    assert read(stats, "response_count") == {"": 1.0} and sizes(stats, "response_count") == (2, 1)
    assert read(stats, "review_count", "2026") == {"": 0.0}
    assert sizes(stats, "review_count", "2026") == (1, 1)


def test_missing_rates(stats):
    assert read(stats, "missing_rate.paper_title") == {"": 0.0}
    assert read(stats, "missing_rate.paper_title", "2026") == {"": 1.0}
    assert read(stats, "missing_rate.review_rating", "2026") == {"": None}
    assert sizes(stats, "missing_rate.review_rating", "2026") == (0, 0)
    assert read(stats, "missing_rate.decision", "all") == {"": 0.3333}


def test_histograms(stats):
    assert read(stats, "rating_distribution_raw") == {"4.0": 1, "6.0": 1, "8.0": 1}
    assert read(stats, "confidence_distribution_raw") == {"2.0": 1, "4.0": 1, "5.0": 1}
    assert read(stats, "rating_distribution_raw", "2026") == {None: None}
    deciles = read(stats, "rating_distribution_normalized")
    assert len(deciles) == 10 and sum(deciles.values()) == 3
    assert deciles["0.0-0.1"] == deciles["0.5-0.6"] == deciles["0.9-1.0"] == 1


def test_crosstab_and_decisions(stats):
    assert read(stats, "rating_decision_crosstab") == {
        "accept.low": 1, "accept.medium": 1, "reject.medium": 1}
    assert read(stats, "decision_distribution", "all") == {"accept": 1, "reject": 1, "unknown": 1}
    assert sizes(stats, "decision_distribution", "all") == (3, 1)


def test_summaries(stats):
    means = read(stats, "paper_mean_rating")
    assert (means["mean"], means["min"], means["max"], means["stdev"]) == (6.5, 5.0, 8.0, 1.5)
    var = read(stats, "paper_rating_variance")
    assert (var["count"], var["mean"], var["stdev"]) == (1, 1.0, 0.0)
    assert sizes(stats, "paper_rating_variance") == (1, 1)
    spread = read(stats, "reviewer_disagreement")
    assert [spread[f"histogram.{b}"] for b in ST.RANGE_BINS] == [0, 1, 0, 0]


def test_rating_changes(stats):
    assert sizes(stats, "initial_to_final_rating_change") == (3, 2)
    assert read(stats, "initial_to_final_rating_change")["mean"] == 2.0
    assert sizes(stats, "rebuttal_present_rating_change") == (2, 1)
    assert sizes(stats, "rebuttal_absent_rating_change") == (1, 1)
    assert stats["rebuttal_absent_rating_change", "2025"]["count"].observational
    assert not stats["forum_count", "2025"][""].observational


def test_constant_population_sits_in_the_middle(spark):
    c = make_corpus(spark, [("x", "v", 2024, "accept", [7.0, 7.0, 7.0], 0)])
    df = ST.compute(c.forum, c.review, c.response, ["rating_distribution_normalized"])
    assert {r.path for r in df.collect() if r.value} == {"0.5-0.6"}


def test_same_result_on_any_partitioning(twelve):
    def run(n):
        return sorted(map(tuple, ST.compute(
            twelve.forum.repartition(n), twelve.review.repartition(n),
            twelve.response.repartition(n)).collect()), key=repr)
    assert run(1) == run(7)


def test_provenance_and_maps(abc):
    df = ST.compute(abc.forum, abc.review, abc.response, ["rating_distribution_raw", "forum_count"])
    rows = ST.with_provenance(df, "h", "t0").collect()
    assert {(r.corpus_hash, r.generated_at, r.schema_version) for r in rows} == {("h", "t0", 1)}
    maps = {(r.metric, r.venue_year): r.value for r in ST.to_maps(df).collect()}
    assert maps["rating_distribution_raw", "all"] == {"4.0": 1.0, "6.0": 1.0, "8.0": 1.0}
    assert maps["rating_distribution_raw", "2026"] == {}


# --- order statistics against brute force -----------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_order_statistics_match_sorting(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: float(rng.randint(1, 10)), lambda: rng.gauss(0, 1e6), lambda: rng.random() - 0.5,
            lambda: rng.choice([-3.0, 0.0, 1e-9, 1e12])][seed]
    groups = {k: sorted(draw() for _ in range(rng.randint(1, 90))) for k in "abc"}
    groups["a"] = groups["a"] + [groups["a"][0]] * 200  # one value holds most rows
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    hist = O.histogram(df, ["k"], "v")
    got = {r.k: r for r in O.summaries(hist, ["k"], "v").collect()}
    cuts = {r.k: r for r in O.tercile_cuts(hist, ["k"], "v").collect()}
    for k, vs in groups.items():
        vs = sorted(vs)
        n = len(vs)
        assert got[k]["count"] == n and got[k]["min"] == vs[0] and got[k]["max"] == vs[-1]
        assert got[k]["median"] == pytest.approx(st.median(vs), rel=1e-12)
        assert got[k]["mean"] == pytest.approx(st.fmean(vs), rel=1e-9, abs=1e-9)
        assert got[k]["stdev"] == pytest.approx(st.pstdev(vs), rel=1e-6, abs=1e-9)
        assert (cuts[k]["low_cut"], cuts[k]["high_cut"]) == (vs[n // 3], vs[2 * n // 3])
    ranks = {(r.k, r.v): r["rank"] for r in O.average_rank(hist, ["k"], "v").collect()}
    for k, vs in groups.items():
        vs = sorted(vs)
        for v in set(vs):
            places = [i + 1 for i, x in enumerate(vs) if x == v]
            assert ranks[k, v] == sum(places) / len(places)


def test_bucket_is_monotone(spark):
    values = sorted([0.0, 1e-300, -1e-300, 1.0, -1.0, 1e300, -1e300, 3.25, 3.26, -7.5, 0.1])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.b for r in df.select("v", O.bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


def test_key_cutoffs_match_sorting(spark):
    import hashlib

    rows = [("big" if i < 400 else f"s{i % 5}", hashlib.sha256(str(i).encode()).hexdigest())
            for i in range(600)]
    df = spark.createDataFrame(rows, "g string, key string")
    got = {r.g: r.cutoff for r in O.key_cutoffs(
        df, ["g"], "key", lambda s: s.withColumn("quota", F.expr("size div 3"))).collect()}
    for g in {g for g, _ in rows}:
        keys = sorted(k for h, k in rows if h == g)
        assert got[g] == keys[len(keys) // 3 - 1]


def test_hot_forum_holds_a_third_of_all_reviews(spark):
    forums = [(f"n{i}", "v", 2024, "accept", [float(1 + i % 10), float(1 + i % 7)], 0) for i in range(60)]
    forums.append(("hot", "v", 2024, "reject", [float(1 + i % 9) for i in range(60)], 3))
    c = make_corpus(spark, forums)
    df = ST.compute(c.forum, c.review, c.response, ["paper_mean_rating", "rating_distribution_raw"], None)
    got = {(r.metric, r.path): r.value for r in df.where("venue_year = 'all'").collect()}
    means = [st.fmean(r) for *_, r, _ in forums]
    assert got["paper_mean_rating", "mean"] == pytest.approx(st.fmean(means))
    assert got["paper_mean_rating", "median"] == pytest.approx(st.median(means))
    everything = [v for *_, r, _ in forums for v in r]
    assert got["rating_distribution_raw", "3.0"] == everything.count(3.0)
    # The hot forum is down to its rating combinations before it meets the forum table.
    assert ST.rating_counts(c.review).where("forum_id = 'hot'").count() == 9
