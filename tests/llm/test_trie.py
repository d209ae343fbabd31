"""The prefix trie against a trie built turn by turn."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from colloquy.llm import queries, trie

COLUMNS = "conv_id long, turn long, role string, text string, part int, Depth string"


def brute_rebuilt(rows):
    """The rebuilt turns of each conversation, texts with their words."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2])}:{t[2]}:{t[3]}".encode()).hexdigest())
    turns = {c: [t[2:] for t in sorted(v, key=key)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: turns.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in turns.items()}


def brute_trie(convs):
    nodes = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    ordered = sorted(nodes, key=len, reverse=True)
    kids, leaves, saved = ({k: 0 for k in nodes} for _ in range(3))
    for k in ordered:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] += not kids[k]
        saved[k] += (len(nodes[k]) - 1) * words
        if k:
            kids[k[:-1]] += 1
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    ends = {k: ",".join(map(str, sorted(c for c in v if len(convs[c]) == len(k)))) for k, v in nodes.items()}
    return sorted((min(v), len(k), min(nodes[k[:-1]]) if k else -1, len(v), kids[k], leaves[k], saved[k],
                   hashlib.sha256(ends[k].encode()).hexdigest()) for k, v in nodes.items())


def listed(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for c in range(160):
        for t in range(int(rng.integers(0, 6))):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", f"word {rng.integers(0, 1 + 2 * (t > 0))}  and\n{t}" * (1 + t % 3)))
    out += [(c, t, "user", f"the same {t}") for c in range(400, 480) for t in range(4)]  # a large group of equal conversations
    out += [(c, t, "user", f"turn {t}") for c in (500, 501, 503) for t in range(23 - (c == 501))]  # long ones
    out += [(600, None, None, None), (600, 3, "a", None), (600, 3, "a", None), (600, 3, "b", ""), (600, -1, None, "x y"),
            (None, 0, "user", "no id"), (-7, 0, "user", "negative"), (700, 0, "user", "z " * 200_000), (701, 0, "a:", "b"), (702, 0, "a", ":b")]
    return [out[i] for i in rng.permutation(len(out))]


@pytest.mark.parametrize("depth,shard_turns", [(512, 65_536), (512, 40), (8, 25)])
def test_trie_equals_brute_force(spark, rows, depth, shard_turns):
    turns, convs = queries.rebuilt(trie.numbered_turns(table(spark, rows).repartition(6)))
    got = listed(trie.prefix_trie(turns, convs, depth=depth, shard_turns=shard_turns).select(trie.NODE))
    assert got == brute_trie(brute_rebuilt(rows))


def test_small_tables(spark, tmp_path):
    for k, rows in enumerate(([], [(21, 0, "u", "x")], [(5, 0, "u", "x"), (5, 1, "u", "y")], [(None, 0, "u", "x")],
                              [(c, 0, "u", "x") for c in range(30)])):
        table(spark, rows).write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        out = queries.op12_prefix_trie(spark, f"{tmp_path}/{k}")
        assert listed(out) == brute_trie(brute_rebuilt(rows)), k
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert listed(queries.op12_prefix_trie(spark, sf)) == brute_trie(brute_rebuilt(rows))


def test_a_conversation_over_many_tasks(spark, rows):
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        long = [(1, t // 3, "u", str(t)) for t in range(900)]
        got = {(r.conv, r.pos): r.digest for r in trie.numbered_turns(table(spark, long).repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", few)
    digest = [hashlib.md5(f"1:u:{t}".encode()).hexdigest() for t in range(900)]
    assert got == {(1, k): d for k, d in enumerate(x for t in range(0, 900, 3) for x in sorted(digest[t : t + 3]))}
