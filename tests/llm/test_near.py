"""Embedding near-duplicates and spelling variants against brute force."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import embedding_dedup, queries, spelling

COLUMNS = "vec_id long, embedding array<float>, label int, node long, key string, Weight int"


def brute_links(rows, threshold=0.95):
    """(id, n_links, component_id, kept) per row, from all pairs."""
    usable = [k for k, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max((len(rows[k][1]) for k in usable), default=1)
    m = np.zeros((len(usable), size))
    for at, k in enumerate(usable):
        m[at, : len(rows[k][1])] = np.array(rows[k][1], np.float32)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= threshold
    label = np.arange(len(usable))
    for _ in range(len(usable)):
        label = np.array([label[near[i]].min() for i in range(len(usable))], int)
    out = [(i, 0, i) for i, _ in rows]
    for at, k in enumerate(usable):
        ids = [rows[usable[j]][0] for j in np.flatnonzero(label == label[at])]
        out[k] = (rows[k][0], int(near[at].sum()) - 1, min((i for i in ids if i is not None), default=None))
    return sorted(((i, n, c, i is not None and i == c) for i, n, c in out), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "clash", 3) for i, v in rows], COLUMNS)


def found(df):
    return sorted(((r.id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def clustered():
    """Clusters of near copies, some exact, among unrelated vectors; vectors that take no part."""
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for size in (1, 1, 2, 3, 40, 120):
        for _ in range(60 if size == 1 else 2):
            base = rng.standard_normal(64)
            for _ in range(size):
                v = base + 0.2 * rng.standard_normal(64) * (size > 1)
                rows.append((n * 7 % 1009, [float(x) for x in v / np.linalg.norm(v)]))
                n += 1
    rows += [(2000 + k, rows[200][1]) for k in range(30)] + [rows[-1], rows[-1], (None, rows[-1][1])]
    unit = [1.0] + [0.0] * 63
    return rows + [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] * 64), (3004, [None, 1.0]),
                   (3005, [float("inf")] + unit), (3006, unit), (3007, [1e30]), (3008, [1e-30, -0.0]), (None, None), (None, [-1.0])]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 16, "miss": 1e-4}, {"tile_rows": 25}, {"cell_rows": 64, "tile_rows": 30}])
def test_embedding_links_equal_brute_force(spark, clustered, options):
    table = vectors(spark, clustered).repartition(5)
    got, want = found(embedding_dedup.near_duplicates(table, **options)), brute_links(clustered)
    if "cell_rows" not in options:
        assert got == want  # one table: every pair meets
    share = sum(n for _, n, _, _ in got) / sum(n for _, n, _, _ in want)
    assert len(got) == len(want) and 0.98 <= share <= 1


def test_embedding_edge_cases(spark):
    assert found(embedding_dedup.near_duplicates(vectors(spark, []))) == []
    rows = [(1, [3.0]), (2, [0.5]), (3, [-1.0]), (3, [-1.0]), (4, None), (None, [2.0]), (5, [0.0])]
    assert found(embedding_dedup.near_duplicates(vectors(spark, rows))) == brute_links(rows)
    wide = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert found(embedding_dedup.near_duplicates(wide)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(1)
    coder = embedding_dedup.Coder(64, seed=2)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    query, _, _ = coder.decode(coder.encode(a, np.arange(4000)))
    _, guess, least = coder.decode(coder.encode(b, np.arange(4000, 8000)))
    estimate = (query * guess).sum(1)
    assert abs(estimate.mean() - 0.95) < 0.003
    assert (estimate >= least).mean() > 0.9995 and least.min() > 0.75
    assert (rng.permutation(query)[:2000] * guess[:2000]).sum(1).max() < least.min()


def test_tables_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    coder = embedding_dedup.Coder(64, seed=2)
    tables = coder.plan(50_000_000, 512, 0.02)
    a = rng.standard_normal((1000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((1000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    one, two = (coder.keys(coder.encode(x, np.arange(1000)), tables) for x in (a, b))
    assert (one == two).any(1).mean() > 0.95


def brute_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), m[0])
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :]))


def brute_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= 2 * counts[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w] or "", counts.get(form[w], 0), root(w)) for w, n in counts.items())


def variants(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(8)
    parts = ["ar", "be", "cé", "do", "Ça", "üb", "no", "ss", "é", "t"]
    words = ["".join(rng.choice(parts, rng.integers(2, 6))) for _ in range(300)]
    words += [w[:2] + c + w[2 + k :] for w in words[:120] for c, k in (("x", 1), ("y", 0), ("", 1))]
    odds = np.r_[np.full(300, 10.0), np.full(360, 1.0)] * rng.uniform(0.2, 1, 660)
    texts = [" ".join(rng.choice(words, 60, p=odds / odds.sum())) for _ in range(150)]
    return [*enumerate(texts), (900, None), (901, ""), (902, "12 3456 !!"), (903, "receive " * 500 + "recieve reçeive receives " * 4),
            (904, "×÷abcÿ " * 5), (905, "Ab" * 40_000 + " " + "ab" * 40_000), (None, "receive receeve"), (7, texts[7]), (7, texts[7])]


@pytest.mark.parametrize("tile_rows", [spelling.TILE_ROWS, 3])
def test_spelling_variants_equal_brute_force(spark, prose, tile_rows):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in prose], "doc_id long, text string, word string, sig int")
    words = spelling.count_words(docs.repartition(4), change=queries.misspelt)
    counts = brute_words(prose)
    assert {r.word: r.n for r in words.collect()} == counts
    got = variants(spelling.group_variants(words, tile_rows=tile_rows))
    assert got == brute_variants(counts) and sum(1 for r in got if r[3]) > 50


def test_chains_of_forms(spark):
    names = ["aaaaa" + "b" * k for k in range(12)]
    words = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(names)], "word string, n long")
    got = {r.word: r for r in spelling.group_variants(words).collect()}
    assert all(got[w].root == names[-1] and got[w].form == (names + [None])[k + 1] for k, w in enumerate(names))
    assert spelling.group_variants(words.limit(0)).count() == 0


def test_words_one_edit_apart_share_a_signature():
    rng = np.random.default_rng(5)
    letters = "abcdeé"
    for _ in range(300):
        w = "".join(rng.choice(list(letters), rng.integers(5, 10)))
        k = int(rng.integers(0, len(w)))
        for v in (w[:k] + "z" + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + w[k + 1 :]):
            a, b = set(spelling.signatures(w)), set(spelling.signatures(v))
            pairs = {(0, 0), (1, 2), (2, 1)}
            assert v == w or any(s == t and (r, q) in pairs for r, s in a for q, t in b), (w, v)


def test_queries_over_tables(spark, tmp_path, prose, clustered):
    spark.createDataFrame([(i, t) for i, t in prose], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors(spark, clustered).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_spelling_variants(spark, str(tmp_path))
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert variants(out) == brute_variants(brute_words(prose))
    out = queries.op11_embedding_near_dedup(spark, str(tmp_path))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert found(out.withColumnRenamed("vec_id", "id")) == brute_links(clustered)
    assert out.where(F.col("kept")).count() > 100
