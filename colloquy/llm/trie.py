"""Prefix trie of conversations from sorted matrices of turn ids.

A conversation is the path of its turns' digests. Paths are cut into levels of `depth` turns, and a row
holds what one conversation has on one level, with a hash of all levels above. Rows are sorted in
ranges (shards) of bounded size. A shard is a padded matrix of turn ids: after a lexsort, the columns'
changes from row to row, OR-accumulated along a row, mark where nodes start, and reduceat over these
starts gives every node's members, children, leaves and savings, from the deepest column up. Only the
nodes on the paths of a shard's first and last row can reach into other shards: these are given out in
parts and recombined by equality, and what they add goes to their ancestors among them. Levels are taken
from the deepest one up; each hands the totals below its paths to the level above, so that memory does
not depend on the longest conversation.

Numbers of turns come from a range partitioning too, so a conversation that holds a large part of all
rows is spread over tasks. Digests of members are computed in the shard, or, where equal paths cross
shards, by a task that streams over the sorted ids.

Defined results: rows without a conversation id take no part; null roles and texts are empty; turns are
ordered with null first, ties by a digest of role and text, so repeated rows count as repeated turns; a
conversation without turns is a member of the root alone; without conversations there are no nodes; very
long texts take part as digests and word counts; other columns are ignored. Equality of turns is that
of a 128-bit digest of role and text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import row_id, staged, text_of

DEPTH = 512
SHARD_TURNS = 65_536
DIGEST = 32  # characters of a turn's digest
WHOLE, UNDER, PART, MEMBER, ABOVE = range(5)  # kinds of rows that a shard gives out
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
NODE = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"]
SHARD = ("kind int, shard long, side int, node string, p1 long, p2 long, path string, conv long, depth long, parent long, "
         "n_convs long, n_children long, n_leaves long, saved long, ends string, words long, more_children long, "
         "more_leaves long, more_saved long")


def numbered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, words): the turns of each conversation, numbered from 0."""
    role, text = text_of(role_col), text_of(text_col)
    turns = staged(rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.md5(F.concat_ws(":", F.char_length(role), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"), row_id().alias("row")), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = staged(turns.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()), "ordered")
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(first, ["conv", "part"]).select(
        "conv", (F.col("first") + F.col("inside")).alias("pos"), "digest", "words")


def _levels(turns: DataFrame, convs: DataFrame, depth: int) -> DataFrame:
    """One row per conversation and level: the path there, hashes of the levels before and with it."""
    turn = F.struct("pos", "digest", "words")
    rows = turns.withColumn("level", F.floor(F.col("pos") / depth).cast("int")).groupBy("conv", "level").agg(
        F.array_sort(F.collect_list(turn)).alias("t"),
        F.bit_xor(F.xxhash64("pos", "digest")).alias("x1"), F.bit_xor(F.xxhash64("digest", "pos")).alias("x2"))
    whole = Window.partitionBy("conv").orderBy("level")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)

    def above(x: str) -> F.Column:
        return F.coalesce(F.bit_xor(x).over(before), F.lit(0).cast("long"))

    rows = rows.select(
        "conv", "level", F.array_join("t.digest", "").alias("path"), F.col("t.words").alias("words"),
        above("x1").alias("p1"), above("x2").alias("p2"), "x1", "x2", F.lead("level").over(whole).isNull().alias("last"))
    rows = rows.select("*", F.expr("p1 ^ x1").alias("n1"), F.expr("p2 ^ x2").alias("n2")).drop("x1", "x2")
    zero = F.lit(0).cast("long")
    bare = convs.select("conv").distinct().join(turns.select("conv").distinct(), "conv", "left_anti").select(
        "conv", F.lit(0).alias("level"), F.lit("").alias("path"), F.array().cast("array<long>").alias("words"),
        zero.alias("p1"), zero.alias("p2"), F.lit(True).alias("last"), zero.alias("n1"), zero.alias("n2"))
    return staged(rows.unionByName(bare), "levels")


def _named(p1: int, p2: int, path: str) -> str:
    return hashlib.md5(f"{p1}:{p2}:{path}".encode()).hexdigest()


def shard_nodes(rows: pa.Table, shard: int, offset: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, as rows of SHARD; depth 0 stands for the path above when offset > 0."""
    paths = rows.column("path").to_pylist()
    length = np.array([len(p) // DIGEST for p in paths])
    n, width = len(paths), int(length.max())
    ids = np.unique(np.frombuffer("".join(paths).encode(), f"S{DIGEST}"), return_inverse=True)[1].astype(np.int32) + 1
    matrix = np.zeros((n, width + 1), np.int32)
    words = np.zeros((n, width + 1), np.int64)
    at = np.repeat(np.arange(n), length), np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)
    matrix[at] = ids
    words[at] = np.concatenate([np.array(w, np.int64) for w in rows.column("words").to_pylist()])
    column = {c: rows.column(c).to_numpy() for c in ("p1", "p2", "conv", "more_children", "more_leaves", "more_saved", "above")}
    order = np.lexsort((column["conv"], *(matrix[:, d] for d in range(width - 1, -1, -1)), column["p2"], column["p1"]))
    matrix, words, length = matrix[order], words[order], length[order]
    column = {c: v[order] for c, v in column.items()}
    last = rows.column("last").to_numpy(zero_copy_only=False)[order]
    conv, p1, p2 = column["conv"], column["p1"], column["p2"]
    texts = [str(c) for c in conv.tolist()]
    changed = np.ones((n, width + 1), bool)
    changed[1:, 0] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    changed[1:, 1:] = matrix[1:, :width] != matrix[:-1, :width]
    changed = np.logical_or.accumulate(changed, axis=1)
    changed = np.concatenate([changed, np.ones((n, 1), bool)], axis=1)
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    found, shared = [], np.zeros(0, np.int64)
    for d in range(width, -1, -1):
        start = np.flatnonzero(changed[:, d])
        real = matrix[start, d - 1] > 0 if d else np.ones(len(start), bool)
        end = np.r_[start[1:], n]

        def total(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x.astype(np.int64), start)[real]

        begun = changed[:, d + 1] & (matrix[:, d] > 0)
        begun[shared] = False  # children that reach into other shards are counted once recombined
        children = total(begun)
        size, least = (end - start)[real], np.minimum.reduceat(conv, start)[real]
        more = {c: np.maximum.reduceat(np.where(length == d, column[c], 0), start)[real]
                for c in ("more_children", "more_leaves", "more_saved")}
        start, end = start[real], end[real]
        weight = words[start, d - 1] if d else np.zeros(len(start), np.int64)
        edge = (start == 0) | (end == n)
        whole, shared = start[~edge], start[edge]
        leaves[whole] += ((children + more["more_children"] == 0) + more["more_leaves"])[~edge]
        saved[whole] += ((size - 1) * weight + more["more_saved"])[~edge]
        if len(start):
            pick = np.stack([start, end], 1).ravel()
            pick = pick[:-1] if pick[-1] == n else pick
            sums = [np.add.reduceat(x, pick)[::2] for x in (leaves, saved)]
            found.append((d, start, end, edge, children, size, least, weight, more, sums))
    found = {f[0]: f for f in found}
    # members that end in a node are its first rows: their paths are shorter than all others there
    for d, (_, start, end, edge, children, size, least, weight, more, (leaf, save)) in found.items():
        short = [int(np.searchsorted(length[a:b] > d, True)) for a, b in zip(start, end)]
        ends, spread = [], []
        for k, (a, m) in enumerate(zip(start.tolist(), short)):
            member = np.flatnonzero(last[a : a + m]) + a
            if len(member) and edge[k] and (a == 0 or a + m == n):
                spread.append((k, member))
                ends.append(None)
            else:
                ends.append(hashlib.sha256(",".join([texts[i] for i in member]).encode()).hexdigest() if len(member)
                            else NO_MEMBERS if not edge[k] else None)
        if d:
            _, up_start, _, up_edge, _, _, up_least, *_ = found[d - 1]
            up = np.searchsorted(up_start, start, side="right") - 1
            parent, under = up_least[up], up_edge[up]
            side = (up_start[up] > 0).astype(np.int32)
            if d == 1 and offset:
                parent, under = column["above"][start], np.zeros(len(start), bool)
        else:
            parent, under, side = np.zeros(len(start), np.int64), np.zeros(len(start), bool), np.zeros(len(start), np.int32)
        kind = np.where(edge, PART, np.where(under, UNDER, WHOLE))
        if not d and offset:
            kind[~edge] = ABOVE
        side = np.where(edge, start > 0, side).astype(np.int32)
        path = ["".join(paths[order[s]][: DIGEST * d]) if e else None for s, e in zip(start.tolist(), edge.tolist())]
        node = [None if p is None else _named(a, b, p) for p, a, b in zip(path, p1[start].tolist(), p2[start].tolist())]
        known = d == 1 and offset > 0
        no_parent = np.array([d == 0 or (k in (UNDER, PART) and not known) for k in kind.tolist()], bool)
        out = {
            "kind": kind.astype(np.int32), "shard": np.full(len(start), shard), "side": side, "node": node,
            "p1": p1[start], "p2": p2[start], "path": path, "conv": least, "depth": np.full(len(start), offset + d),
            "parent": pa.array(parent, mask=no_parent), "n_convs": size,
            "n_children": children + np.where(edge, 0, more["more_children"]), "n_leaves": leaf, "saved": save,
            "ends": ends, "words": weight, **more}
        yield _batch(out)
        for k, member in spread:
            yield _batch({"kind": np.full(len(member), MEMBER, np.int32), "node": [node[k]] * len(member), "conv": conv[member]})


def _batch(columns: dict) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split(" ") for f in SHARD.split(", ")]
    size = len(columns["kind"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], types[t]) if c in columns else pa.nulls(size, types[t]) for c, t in fields],
        [c for c, _ in fields])


def member_digests(members: DataFrame) -> DataFrame:
    """(node, ends) from rows (node, conv): ids in order, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            nodes, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = []
            cuts = [0, *[i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]], len(nodes)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                ids = ",".join(map(str, convs[a:b])).encode()
                if nodes[a] == at:
                    state.update(b"," + ids)
                    continue
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state = nodes[a], hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()),
                                              pa.array([e for _, e in done], pa.string())], ["node", "ends"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], ["node", "ends"])

    return members.select("node", "conv").repartition("node").sortWithinPartitions("node", "conv").mapInArrow(
        run, "node string, ends string")


def _level(rows: DataFrame, shards: int, level: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals below each path above) of one level."""
    offset = level * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            yield from shard_nodes(pa.Table.from_batches(held), TaskContext.get().partitionId(), offset)

    out = staged(rows.repartitionByRange(shards, "p1", "p2", "path", "conv").mapInArrow(run, SHARD), "shards")
    parts = out.where(F.col("kind") == PART).groupBy("node").agg(
        *[F.max(c).alias(c) for c in ("p1", "p2", "path", "depth", "parent", "words", "ends",
                                      "more_children", "more_leaves", "more_saved")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.min("conv").alias("conv"))
    here = F.col("depth") - offset

    def named(path: F.Column) -> F.Column:
        return F.md5(F.concat_ws(":", "p1", "p2", path).cast("binary"))

    parts = staged(parts.withColumn("up", F.when(here > 0, named(F.substring("path", F.lit(1), ((here - 1) * DIGEST).cast("int"))))),
                   "parts")
    kids = parts.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("kids"))
    parts = parts.join(kids, "node", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)) + F.col("more_children"))
    own_leaves = F.when(F.col("n_children") == 0, 1).otherwise(0) + F.col("more_leaves")
    own_saved = (F.col("n_convs") - 1) * F.col("words") + F.col("more_saved")
    prefixes = F.transform(F.sequence(F.lit(0), here.cast("int")),
                           lambda i: named(F.substring("path", F.lit(1), i * DIGEST)))
    added = parts.select(own_leaves.alias("l"), own_saved.alias("s"), prefixes.alias("ids")).where("l > 0 or s > 0").select(
        "l", "s", F.explode("ids").alias("node")).groupBy("node").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    streamed = member_digests(out.where(F.col("kind") == MEMBER)).withColumnRenamed("ends", "streamed")
    parts = staged(
        parts.join(added, "node", "left").join(streamed, "node", "left")
        .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("l", F.lit(0)))
        .withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0)))
        .withColumn("ends", F.coalesce("ends", "streamed", F.lit(NO_MEMBERS))), "joined")
    up = parts.select(F.col("node").alias("up"), F.col("conv").alias("up_conv"))
    edge = parts.where(F.lit(level == 0) | (here > 0)).join(up, "up", "left").withColumn(
        "parent", F.coalesce("parent", "up_conv"))
    # a node under a shared parent finds it through its own shard: no key is more frequent than a shard is large
    links = out.where(F.col("kind") == PART).select("shard", "side", (F.col("depth") + 1).alias("depth"), "node").join(
        parts.select("node", F.col("conv").alias("up_conv")), "node").drop("node")
    under = out.where(F.col("kind") == UNDER).join(links, ["shard", "side", "depth"]).withColumn("parent", F.col("up_conv"))
    nodes = out.where(F.col("kind") == WHOLE).select(NODE).unionByName(under.select(NODE)).unionByName(edge.select(NODE))
    totals = out.where(F.col("kind") == ABOVE).unionByName(parts.where(here == 0), allowMissingColumns=True).select(
        F.col("p1").alias("n1"), F.col("p2").alias("n2"), F.col("n_children").alias("more_children"),
        F.col("n_leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    return nodes, totals


def prefix_trie(turns: DataFrame, convs: DataFrame, depth: int = DEPTH, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node, from turns (conv, pos, digest, words) numbered from 0 and all conversations (conv):
    conv (smallest member), depth, parent (its smallest member), n_convs, n_children, n_leaves, saved, ends."""
    rows = _levels(turns, convs, depth)
    sizes = {r.level: r.n for r in rows.groupBy("level").agg(F.sum(F.size("words") + 1).alias("n")).collect()}
    zero, nodes, below = F.lit(0).cast("long"), None, None
    for level in range(max(sizes, default=0), -1, -1):
        here = rows.where(F.col("level") == level)
        more = ["more_children", "more_leaves", "more_saved"]
        if below is None:
            here = here.withColumns({c: zero for c in more})
        else:  # only paths that go on find totals
            here = here.withColumn("goes_on", ~F.col("last")).join(
                below.withColumn("goes_on", F.lit(True)), ["n1", "n2", "goes_on"], "left").withColumns(
                {c: F.coalesce(c, zero) for c in more})
        if level:
            full = rows.where((F.col("level") == level - 1) & (F.size("words") == depth))
            parents = full.groupBy(F.col("n1").alias("p1"), F.col("n2").alias("p2")).agg(F.min("conv").alias("above"))
            here = here.join(parents, ["p1", "p2"])
        else:
            here = here.withColumn("above", zero)
        found, below = _level(here.select("p1", "p2", "path", "words", "conv", "last", *more, "above"),
                              math.ceil(sizes.get(level, 1) / shard_turns), level, depth)
        nodes = found if nodes is None else nodes.unionByName(found)
    return nodes
