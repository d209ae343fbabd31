"""The operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import bpe, chat, exact_dedup, packing, pii, quality, queries, segments, sharding, simhash, topk, toxicity
from colloquy.llm.queries import tokenizer_file

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, KEPT string"
TEXTS = [
    (1, "Alpha beta gamma"), (2, "ALPHA beta gamma"), (3, None), (4, ""), (None, "alpha BETA gamma"), (5, "Été"),
    (6, "été"), (7, "mail a@b.co and 10.0.0.1, +49 1234 567 890, 4111 1111 1111 1111."), (7, "twice"), (7, "twice"),
    (8, "x" * 5000 + " tail  \n\n end "), (9, "a<|endoftext|>b \x1c c\x85 d’s it's"), (10, "one two three " * 900),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "clash", "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3, "text")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(40)], "doc_id long, quality int, toxic boolean") \
        .withColumn("toxic", F.col("toxic").cast("int"))


def test_feistel_is_a_permutation_and_inverts():
    for n in (1, 2, 3, 5, 64, 1000):
        p = sharding.permute(np.arange(n), n, seed=3)
        assert sorted(p) == list(range(n))
        assert (sharding.permute(p, n, seed=3, inverse=True) == np.arange(n)).all()


def test_shards(docs, nothing):
    rows = sharding.shard(docs, shards=3).collect()
    assert len(rows) == len(TEXTS)
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in TEXTS)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    assert {(r.text_crc32, r.position) for r in rows} == {
        (r.text_crc32, r.position) for r in sharding.shard(docs.repartition(7), shards=3).collect()}
    assert sharding.shard(nothing).count() == 0


def norm(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(c, 1, 1)])
def test_exact_copies(docs, nothing, digest):
    rows = exact_dedup.deduplicate(docs, digest=digest).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((i or 0, best[norm(t)], len(groups[norm(t)])) for i, t in TEXTS)
    assert sorted((r["id"] or 0, r.keep_id, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.deduplicate(nothing).count() == 0
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


@pytest.mark.parametrize("module", [exact_dedup, simhash])
def test_kept_rows_stay_the_same_when_later_scans_are_split_otherwise(spark, tmp_path, monkeypatch, module):
    words = [hashlib.md5(str(i).encode()).hexdigest() for i in range(400)]
    rows = [(i, " ".join(words[i % 40 * 10 : i % 40 * 10 + 10])) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").write.parquet(f"{tmp_path}/docs")
    write, size = module.staged, "spark.sql.files.maxPartitionBytes"

    def split(df, label):
        out = write(df, label)
        spark.conf.set(size, "1g" if label in ("rows", "components") else "1k")
        return out

    monkeypatch.setattr(module, "staged", split)
    try:
        spark.conf.set(size, "1k")
        kept = module.kept_documents(spark.read.parquet(f"{tmp_path}/docs")).collect()
    finally:
        spark.conf.unset(size)
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def test_base_spans(docs, nothing):
    found = {r["id"]: r for r in pii.find_spans(docs).select("id", pii.listed("spans").alias("s")).collect()
             if r.s}
    assert list(found) == [7]
    assert found[7].s == "email:5:11,ip:16:24,phone:26:42,card:44:63"
    assert pii.find_spans(nothing).count() == 0


def test_disclosing_terms_are_cut(spark):
    rows = [(i, f"Write to Zebedee at z{0}@mail.org today, number {i}") for i in range(4)]
    rows += [(10 + i, "we write to people today") for i in range(20)] + [(50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N", F.lit(1))
    out = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zebedee" not in out[0] and "[email]" in out[0] and out[0].startswith("Write to ")
    assert out[10] == "we write to people today" and out[50] is None
    assert pii.sanitise(docs).columns == docs.columns


def test_terms_of_an_entity_seen_once_are_cut(spark):
    rows = [(0, "we write to Ottokar at o@mail.org today")] + [(i, "we write to people at home today") for i in range(1, 9)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == "we write to  at [email] today" and out[1] == rows[1][1]


def test_terms_are_cut_in_whole_documents_and_without_the_entity(spark):
    far = "word " * 300
    rows = [(0, f"Ottokar {far} lives in R2D2 at no 7, o@mail.org"), (1, f"Ottokar {far} is away")]
    rows += [(i, f"{far} lives in town at no 7, is away from mail org o") for i in range(2, 9)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == f"[term] {far} lives in  at no 7, [email]" and out[1] == f"[term] {far} is away"
    assert out[2] == rows[2][1]


def test_codec_matches_the_library(docs, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file())
    rows = bpe.decode(bpe.encode(docs, tokenizer_file(), lexicon_words=4), tokenizer_file()).collect()
    want = sorted((lib.encode(t or "", add_special_tokens=False).ids, t or "") for _, t in TEXTS)
    assert sorted((list(r.ids), r.decoded) for r in rows) == want
    assert bpe.encode(nothing, tokenizer_file()).count() == 0


def test_lexicon_shares_suffixes():
    words = {w.encode(): [i] for i, w in enumerate(["nation", "ration", "station", "na", ""] ) if w}
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon(words), np.uint8))
    numbers = lexicon.numbers([*words, b"natio", b"x", b""])
    assert numbers[-3:].tolist() == [-1, -1, -1]
    assert [lexicon.ids[lexicon.ends[n]] for n in numbers[:-3]] == [i for (i,) in words.values()]
    assert len(lexicon.final) < sum(map(len, words))


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file())
    rows = packing.pack(docs, tokenizer_file(), window=64, most_open=2).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length > 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([0, *(r.length for r in pieces)])
        assert [r.offset for r in pieces] == ends[:-1].tolist() and ends[-1] == pieces[0].sequence_length <= 64
    assert sum(r.length for r in rows) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    long = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 10)
    want = np.array([*lib.encode(dict(TEXTS)[10], add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert b"".join(x for _, x in long) == want
    assert packing.pack(nothing, tokenizer_file()).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).round(2).tolist()) for i in [*range(60), 20, 20]]
    rows += [(None, [0.5] * 8), (61, None), (62, [float("nan")] * 8), (63, [None] * 8), (64, [1.0]), (80, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    good = [(i, np.array([*np.floor(64 * np.array(v, float)), *[0] * 8])[:8]) for i, v in rows
            if v is not None and not any(x is None or x != x for x in v)]
    want = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            near = sorted((-int(v @ w), j if j is not None else 1 << 62) for m, (j, w) in enumerate(good) if m != n)[:5]
            want += [(i, -s) for s, _ in near]
    for sizes in ({}, {"range_rows": 7, "tile_rows": 2, "block_rows": 3}):
        got = topk.top_k(table, F.col("id") % 20 == 0, k=5, **sizes).collect()
        assert sorted((r.query_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(table.limit(0), F.col("id") % 20 == 0).count() == 0


def brute_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", norm(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, nothing):
    rows = simhash.near_duplicates(docs).collect()
    assert sorted(r.fp % 2**64 for r in rows) == sorted(brute_simhash(t) for _, t in TEXTS)
    assert {r.component_id for r in rows if r["id"] in (1, 2, None)} == {1}
    assert {r.component_id for r in rows if r["id"] in (3, 4)} == {3}
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.kept_documents(docs).columns == docs.columns


@pytest.mark.parametrize("tile_rows", [5, 16_384])
def test_all_links_are_found(spark, tile_rows):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64))
                                            for _ in range(40))]))
    label = np.arange(len(fps))
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 3
    simhash.unite(label, i[near], j[near])
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(table, tile_rows)).collect()}
    of = {}
    for x, n in zip(fps.view(np.int64).tolist(), label.tolist()):
        of.setdefault(n, []).append(x)
    assert got == {x: min(g) for g in of.values() if len(g) > 1 for x in g}


def test_near_copies_of_similarity_are_merged_and_others_are_kept(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        rows.append((i, " ".join(w)))
        for k, edits in ((1, 3), (2, 30)):
            v = list(w)
            for at in np.linspace(5, 194, edits).astype(int):
                v[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((100 * k + i, " ".join(v)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    want = {i for i in sets if i < 100 or len(sets[i] & sets[i % 100]) < 0.8 * len(sets[i] | sets[i % 100])}
    assert len(want) == 120
    fp = {i: brute_simhash(t) for i, t in rows}
    far = {i for i in sets if (fp[i] ^ fp[i % 100]).bit_count() > 11}
    assert len(far - want) <= 3 and len({i for i in set(sets) - want if (fp[i] ^ fp[i % 100]).bit_count() > 3}) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = simhash.kept_documents(docs, distance=11, similarity=0.8)
    assert {r.doc_id for r in near.collect()} == want | far
    pieces = spark.createDataFrame([(i, int(np.uint64(simhash.simhash(t)).view(np.int64)), 0, t) for i, t in rows],
                                   "row_id long, fp long, root long, text string")
    got = simhash.components(simhash.checked_links(pieces, 64, 0.8, 5, tile_rows=50)).collect()
    assert {r.node for r in got if r.node != r.root} == set(sets) - want


def near_families(rng, families, copies, words, changed):
    """(texts, word lists): families of near copies, each with some words replaced."""
    out = []
    for f in range(families):
        base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        for _ in range(copies):
            w = list(base)
            for i in rng.choice(words, int(rng.integers(0, changed + 1)), replace=False):
                w[i] = f"x{rng.integers(0, 10**9)}"
            out.append(w)
    return out


def test_near_copies_equal_exact_similarity_over_all_pairs(spark):
    rng = np.random.default_rng(3)
    lists = near_families(rng, 200, 4, 120, 3) + near_families(rng, 1, 40, 300, 6) + [[]] * 3 + [["one"]] * 2
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lists)], "doc_id long, text string").repartition(5)
    sets = [set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} for w in lists]
    label, pairs = list(range(len(sets))), []
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    near = {(i, j) for same in by.values() for i in same for j in same if i < j}
    for i, j in sorted(near):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            pairs.append((i, j))
            x, y = sorted((label[i], label[j]))
            label = [x if v == y else v for v in label]
    prints = simhash.fingerprints(docs, words=5).collect()
    fp = {r.id: (r.fp % 2**64, r.sketch % 2**64) for r in prints}
    bits, seal = (np.array([(fp[i][k] ^ fp[j][k]).bit_count() for i, j in pairs]) for k in range(2))
    assert len(pairs) > 500 and seal.max() <= simhash.sketch_distance(0.8)
    assert (bits <= 11).mean() >= 0.95  # 0.96: SimHash gives no guarantee
    got = {r.doc_id for r in simhash.kept_documents(docs, distance=11, similarity=0.8).collect()}
    want = set(label)
    assert want <= got and len(got - want) <= 0.05 * len(sets)


@pytest.mark.parametrize("n, tile_rows", [(300, 10_000), (3000, 10_000), (3000, 100)])
def test_candidate_links_join_what_all_pairs_join(spark, n, tile_rows):
    rng = np.random.default_rng(n)
    base, seal = (rng.integers(0, 2**63, n // 5, dtype=np.uint64) for _ in range(2))
    of = rng.integers(0, len(base), n)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for k in rng.integers(1, 6, n)])
    fps, marks = base[of] ^ flips, np.where(rng.random(n) < 0.9, seal[of], rng.integers(0, 2**63, n, dtype=np.uint64))
    label = np.arange(n)
    i, j = np.triu_indices(n, 1)
    near = (np.bitwise_count(fps[i] ^ fps[j]) <= 11) & (np.bitwise_count(marks[i] ^ marks[j]) <= 18)
    simhash.unite(label, i[near], j[near])
    table = spark.createDataFrame([(int(f), int(s), k) for k, (f, s) in enumerate(zip(fps.view(np.int64), marks.view(np.int64)))],
                                  "fp long, sketch long, id long").repartition(4)
    got = {r.node: r.root for r in simhash.components(simhash.candidate_links(table, 11, 0.8, tile_rows)).collect()}
    right = np.array([got.get(k, k) == label[k] for k in range(n)])
    assert all(label[k] == label[v] for k, v in got.items())  # nothing is joined that should not be
    assert right.all() if n <= simhash.KEY_ROWS else right.mean() >= 0.98


def test_sketches_of_alike_texts_are_near_and_of_others_are_not():
    rng = np.random.default_rng(9)
    lists = near_families(rng, 200, 2, 200, 3)
    seals = [simhash.sketch(" ".join(w), 5) for w in lists]
    alike = [(a ^ b).bit_count() for a, b in zip(seals[::2], seals[1::2])]
    others = [(a ^ b).bit_count() for a, b in zip(seals[::2], seals[3::2])]
    assert max(alike) <= simhash.sketch_distance(0.8) == 18 and 28 < np.mean(others) < 36
    assert simhash.sketch("", 5) == simhash.sketch("  ", 5) and len(simhash.shingle_set("", 5)) == 0
    long = " ".join(str(i) for i in range(70_000))
    assert len(simhash.shingle_set(long, 5)) == 69_996
    words = long.encode().split()
    import xxhash
    assert int(simhash.shingle_set(long, 5)[0]) == min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(69_996))


def test_toxicity_learns_and_scores_every_row(spark, docs, nothing):
    rows = [(i, f"plain words {i} here" + (" you utter scoundrel" if i % 3 == 0 else " thank you")) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("clash"))
    marks = texts.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(texts, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(300))
    assert toxicity.score(docs, model).count() == len(TEXTS) and toxicity.score(nothing, model).count() == 0
    blank = toxicity.fit(nothing, marks, F.lit(True))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.5}


def test_quality_rejects_junk_and_keeps_clean_documents(spark, docs, nothing):
    rows = [(i, "Some clean words stand here and there, in order." if i % 4 else f"BUY!! NOW!! {i}!! $$$ ***", "en", f"s{i % 3}", 9)
            for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = table.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("quality"))
    out = quality.score(table, quality.fit(table, marks)).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in out)
    unfit = quality.score(docs, quality.fit(docs, marks.limit(0)))
    assert unfit.where("kept and score = 0.5").count() == len(TEXTS)
    assert quality.score(nothing, None).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_copies_of_a_sampled_id_leave_room_for_the_others(spark, monkeypatch, module):
    rows = [(0, f"hot words {k}") for k in range(500)] + [(i, f"plain words {i} here") for i in range(1, 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"),
                                   (F.col("id") % 2).cast("int").alias("toxic"))
    counts, write = {}, module.staged

    def count(df, label):
        out = write(df, label)
        counts[label] = out.count(), out.select(out.columns[0]).distinct().count()
        return out

    monkeypatch.setattr(module, "staged", count)
    model = toxicity.fit(table, marks, F.lit(True), max_rows=40) if module is toxicity else quality.fit(
        table, marks, max_rows=40)
    assert model is not None
    if module is toxicity:
        assert counts["toxic-features"] == (40, 40)
    else:
        assert counts["quality-features"][0] == 539 and counts["quality-pool"][0] == 0


def test_quality_hands_pseudo_labels_of_the_whole_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 3000)
    a, b = (np.c_[truth * 2.0 - 1 + rng.normal(0, 0.9, 3000), rng.normal(0, 1, 3000)] for _ in range(2))
    write = spark.createDataFrame([(x.tolist(), z.tolist()) for x, z in zip(a[200:], b[200:])], "a array<double>, b array<double>")
    write.write.parquet(str(tmp_path / "pool"))
    pool = spark.read.parquet(str(tmp_path / "pool"))
    aside = np.arange(200) % 5 == 0
    model = quality.co_train([a[:200], b[:200]], truth[:200].astype(float), aside, pool)
    content, page, both = ((s >= 0.5) == truth for s in model([a, b]))
    assert both.mean() > 0.92 and both.mean() >= max(content.mean(), page.mean()) - 0.01

    # one round by hand: the cutoffs take at least the quota, and only of sure documents
    views = [quality.Logistic(v[:200]).fit(v[:200], truth[:200]) for v in (a, b)]
    odds = views[0].log_odds(a[200:])
    bins = np.bincount(np.floor(odds * quality.BINS).astype(int) + quality.BINS * quality.LIMIT)
    cuts = quality._cutoffs({i: n for i, n in enumerate(bins.tolist()) if n}, [100, 150], 0.9)
    assert 100 <= (odds <= -cuts[0]).sum() <= 110 and 150 <= (odds >= cuts[1]).sum() <= 165
    none = quality._cutoffs({quality.BINS * quality.LIMIT: 7}, [100, 100], 0.9)
    assert none == (np.inf, np.inf)
    labels = quality.taught([a[200:], b[200:]], [quality.Round(views, [cuts, none])])
    assert (labels[0] == -1).all()
    assert np.array_equal(labels[1], np.where(odds >= cuts[1], 1, np.where(odds <= -cuts[0], 0, -1)))


@pytest.mark.parametrize("n, cells, distance", [(0, 1, 3), (1, 1, 3), (9, 1, 3), (31, 1, 3), (40, 1, 3), (700, 90, 3), (900, 7, 11)])
def test_gray_index_finds_every_pair_of_cells_of_any_size(n, cells, distance):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, n // 6 + 1, dtype=np.uint64)
    flip = [np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) for _ in range(2)]
    fps = np.unique(base[rng.integers(0, len(base), n)] ^ flip[0] ^ flip[1])
    cell = np.sort(rng.integers(0, cells, len(fps)))
    order = np.lexsort((simhash.gray_rank(fps), cell))
    tree = simhash.GrayTree(fps[order], cell[order])
    got = [(min(p), max(p)) for i, j in tree.links(distance) for p in zip(order[i].tolist(), order[j].tolist())]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if cell[i] == cell[j]]
    assert sorted(got) == [(i, j) for i, j in pairs if int(fps[i] ^ fps[j]).bit_count() <= distance]
    assert tree.compared <= len(pairs)
    if n > 30 and distance == 3:
        assert tree.compared < 0.7 * len(pairs)  # the rest is pruned in upper nodes


def test_segments_of_a_column_encode_as_the_library_does():
    from tokenizers import Tokenizer

    file = queries.tokenizer_file()
    library = Tokenizer.from_file(file)
    draw = random.Random(1)
    signs = [*" \n\t  aé漢1!'s<|>", "\x85", "\u3000", "<|endoftext|>", "'re", "don't", "Ab9"]
    texts = ["", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endof", "text|> q", "don't!!'s  they're", "語" * 500, "a" * 9000]
    texts += ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(1500)]
    whole = pa.array(["cut off", *texts])
    coder = bpe.Encoder(bpe.vocabulary(file), most=500)
    for part in segments.pieces(whole.slice(1), most_bytes=2000):
        flat, ends = coder.encode_column(part)
        for text, low, high in zip(part.to_pylist(), [0, *ends], ends):
            assert flat[low:high].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_decoding_replaces_a_column_of_the_same_name(spark):
    coded = spark.createDataFrame([(1, "old", [64, 65]), (2, None, None)], "doc_id long, Decoded string, ids array<int>")
    out = bpe.decode(coded, queries.tokenizer_file())
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert [r.decoded != "old" for r in out.orderBy("doc_id").collect()] == [True, True]


def test_transcripts(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Is it {t}?" if t % 2 == 0 else "It is so, and here is why " * 4)
            for c in range(20) for t in range(6)]
    rows += [(50, 0, "human", "Is it?"), (50, 1, None, "It is so, and here is why " * 4), (50, 2, "??", "Is it 5?"),
             (51, 0, None, "User: Is it?\nAssistant: It is.\nIndeed."), (None, None, None, None), (52, 0, "USER", "a<|im_end|>")]
    rows += [(60, t, "user" if t % 2 == 0 else None, "Is it?" if t % 2 == 0 else "It is so, and here is why " * 4) for t in range(50)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Part", F.lit(1))
    got = chat.parse(table).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.row_id, r.part)):
        by.setdefault(r.conv, []).append((r.role, r.content))
    assert [r for r, _ in by[50]] == ["user", "assistant", "user"]
    assert by[51] == [("user", "Is it?"), ("assistant", "It is.\nIndeed.")]
    assert len(by[None]) == 1 and [r for r, _ in by[60]] == ["user", "assistant"] * 25
    assert [r.rendered for r in got if r.conv == 52] == ["<|im_start|>user\na<| im_end |><|im_end|>\n"]
    small = chat.parse(table, chunk_rows=3).collect()
    assert sorted((r.row_id, r.part, r.role) for r in small) == sorted((r.row_id, r.part, r.role) for r in got)
    assert chat.parse(table.limit(0)).count() == 0


def test_pipeline_against_its_stages_by_hand(spark, tmp_path):
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(900)]
    texts = [" ".join(words[12 * i : 12 * i + 40]).capitalize() + "." for i in range(70)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i].upper().capitalize()) for i in range(5)]
    rows += [(200 + i, f"BUY!! NOW!! {i}!! $$$ *** " * 5) for i in range(30)] + [(300, texts[9] + " Mail me@home.org")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.when(F.col("doc_id").between(200, 299), 0).otherwise(1).alias("quality"),
                F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {i: t for i, t in rows if not 200 <= i < 300}
    last = {norm(t): i for i, t in sorted(good.items())}
    stay = {i: good[i] for i in last.values()}
    sets = {i: set(zip(*(t.lower().split()[k:] for k in range(5)))) for i, t in stay.items()}
    seen, kept = list(stay), set()
    while seen:
        group = [seen.pop()]
        for g in group:
            near = [i for i in seen if len(sets[i] & sets[g]) >= 0.8 * len(sets[i] | sets[g])]
            seen = [i for i in seen if i not in near]
            group += near
        kept.add(min(group))
    assert 300 not in kept and len(kept) < len(stay)
    assert {r.doc_id for r in out} == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "pii", "packing"]
    assert public_tokenizers.path("byte_bpe_50k.json") == tokenizer_file()
