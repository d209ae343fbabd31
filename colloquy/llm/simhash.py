"""SimHash near-duplicates through Gray-order hierarchical indexes.

Fingerprints that differ in at most three of 64 bits agree in one of four blocks of 16 bits, and for
other distances in one of as many blocks as the distance and one. So the index is a forest of trees, whose first level below the root has one node per value of the
tree's block: the shared masked pattern of all fingerprints there. Two fingerprints are compared
in the trees where they share that node, which loses no link. Below, a node's fingerprints are
sorted by Gray rank, so that neighbours share most bits; two neighbours form a node, and two
nodes the next one up, in nodes of every size. A node keeps the bits its members have in common. For two nodes, the common
bits in which they differ are differences that all their pairs have accumulated; beyond the
distance, the whole group of pairs is pruned.

Spark deals the first-level nodes to tasks. A node of more than `tile_rows` fingerprints is split
by hash into tiles, and every pair of its tiles becomes a cell of its own. Cells hand out a spanning
forest of their links, never all pairs; components follow by alternating large-star and small-star
rounds over tables in the shared folder. Copies of a fingerprint are one node all the way.

With a `similarity`, links are only candidates, and blocks of equal bits would be too narrow for the distance
that it needs: cells would grow with the square of the table. So the trees' first levels are then masks of sampled
bits, as many as keep a cell of unrelated fingerprints at some `KEY_ROWS`, in so many trees that a pair at the
very distance is missed with probability `MISS`, a nearer one far less. A candidate link must also hold in a sketch of 64
one-bit minima of the shingles, which pairs of the similarity miss about once in 10^5 and chance links
hardly ever reach, so that candidate components are families of similar texts at any size of the table. All rows of a
component that are not yet joined are compared by their sets of word shingles, in tiles too, and
components follow from the links that hold.

Defined results: a text without words, or null, has fingerprint zero and is linked like others;
null ids are ignored for component ids, a component of null ids only has none; repeated rows share
fingerprint and component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ROW, numbered, row_id, staged, text_of

DISTANCE = 3
FAN = 2
TILE_ROWS = 16_384
CHECK_ROWS = 1024
KEY_ROWS = 512
MISS = 0.02
ODD = np.random.default_rng(64).integers(0, 2**63, (64, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, words: int, seed: int = 0) -> Iterator[np.ndarray]:
    """The hashes of the word shingles in order, in pieces; a shorter text is one shingle, an empty one has none."""
    import xxhash

    split = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not split:
        return
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(split) - words + 1)
    starts, ends = (ends - size)[:n].tolist(), ends[min(words, len(split)) - 1 :].tolist()
    for at in range(0, n, 65_536):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536])], "<u8")


def simhash(text: str, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half the hashes of the word shingles."""
    count, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle, 42):
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def sketch(text: str, words: int) -> int:
    """64 bits, one of the least shingle under each of 64 hash functions: texts of similarity s differ in (1 - s) / 2 of them."""
    least = np.full(64, 2**64 - 1, np.uint64)
    for h in shingle_hashes(text, words):
        for at in range(0, len(h), 2048):
            np.minimum(least, (ODD * h[at : at + 2048]).min(1), out=least)
    return int(np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")[0])


def sketch_distance(similarity: float) -> int:
    """Differing bits of two sketches that pairs of the similarity exceed about once in 10^5."""
    p = (1 - similarity) / 2
    return math.ceil(64 * p + 4.7 * math.sqrt(64 * p * (1 - p)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 row_col: str | None = None, shingle: int = 3, words: int | None = None) -> DataFrame:
    """(row_id, id, fp): the 64 bits as a signed long; row_id is row_col, or else the place in the scan.

    With `words`, also the sketch of the shingles of so many words."""

    def longs(values: list[int]) -> pa.Array:
        return pa.array(np.array(values, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out = {"row_id": batch.column(0), "id": batch.column(1), "fp": longs([simhash(t, shingle) for t in texts])}
            if words is not None:
                out["sketch"] = longs([sketch(t, words) for t in texts])
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    row = F.col(row_col) if row_col else row_id()
    return docs.select(row.alias("row_id"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(
        run, "row_id long, id long, fp long" + ("" if words is None else ", sketch long"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of linked places; a label is the smallest place of its set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


class GrayTree:
    """A hierarchical index over fingerprints in Gray order, inside runs of equal cells."""

    def __init__(self, sorted_fps: np.ndarray, cell: np.ndarray | None = None):
        self.both, self.some = [sorted_fps], [sorted_fps]  # bits that all, and that some members have
        self.first = [np.arange(len(sorted_fps) + 1)]  # a node's first child, one level down
        self.compared = 0  # pairs of fingerprints that no upper node pruned
        cell = np.zeros(len(sorted_fps), np.int64) if cell is None else cell
        while True:
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
            place = np.arange(len(cell)) - np.repeat(starts, np.diff(np.r_[starts, len(cell)]))
            if place.max(initial=0) < FAN:
                break
            cut = np.flatnonzero(place % FAN == 0)
            self.first.append(np.r_[cut, len(cell)])
            self.both.append(np.bitwise_and.reduceat(self.both[-1], cut))
            self.some.append(np.bitwise_or.reduceat(self.some[-1], cut))
            cell = cell[cut]
        self.cell = cell  # of the roots, at most FAN a cell

    def links(self, distance: int = DISTANCE, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of places at the distance or nearer, in pieces."""
        roots = len(self.cell)
        same = [np.flatnonzero(self.cell[gap:] == self.cell[: roots - gap]) for gap in range(FAN)]
        stack = [(len(self.both) - 1, np.concatenate(same), np.concatenate([i + gap for gap, i in enumerate(same)]))]
        child = np.arange(FAN)
        while stack:
            level, i, j = stack.pop()
            if len(i) > most:
                stack += [(level, i[:most], j[:most]), (level, i[most:], j[most:])]
                continue
            if level == 0:
                i, j = i[i != j], j[i != j]
                self.compared += len(i)
            both, some = self.both[level], self.some[level]
            common = ~(both[i] ^ some[i]) & ~(both[j] ^ some[j])
            near = np.bitwise_count((both[i] ^ both[j]) & common) <= distance
            i, j = i[near], j[near]
            if level == 0:
                if len(i):
                    yield i, j
                continue
            first = self.first[level]
            a, b = np.broadcast_arrays(first[i][:, None, None] + child[:, None], first[j][:, None, None] + child)
            ok = (a < first[i + 1][:, None, None]) & (b < first[j + 1][:, None, None]) & (a <= b)
            stack.append((level - 1, a[ok], b[ok]))


def cell_links(cell: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, sketches: np.ndarray | None = None,
               apart: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of places, of the links inside the cells; cells are runs of equal numbers.

    Sketches of linked places differ in at most `apart` bits."""
    label = np.arange(len(fps))
    order = np.lexsort((gray_rank(fps), cell))
    for a, b in GrayTree(fps[order], cell[order]).links(distance):
        a, b = order[a], order[b]
        if sketches is not None:
            near = np.bitwise_count(sketches[a] ^ sketches[b]) <= apart
            a, b = a[near], b[near]
        unite(label, a, b)
    tied = np.flatnonzero(label != np.arange(len(fps)))
    return tied, label[tied]


def _cell_edges(cells: DataFrame, distance: int, apart: int | None) -> DataFrame:
    """Edges (a, b) of cells (node, low, high, fp), sorted by cell, or (node, low, high, fp, id, sketch) if sketches count.

    Edges join fingerprints, or ids."""
    width = 4 if apart is None else 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, width), np.int64)]

        def out(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)] if len(rows) else np.zeros(0, bool)
            fps = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
            extra = () if apart is None else (np.ascontiguousarray(rows[:, 5]).view(np.uint64), apart)
            a, b = cell_links(np.cumsum(new), fps, distance, *extra)
            name = rows[:, 3 if apart is None else 4]
            return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(width)], 1)
            rows = np.concatenate([*held, rows])
            last = len(rows) - int((rows[::-1, :3] == rows[-1, :3]).all(1).cumprod().sum()) if len(rows) else 0
            if last:
                yield out(rows[:last])
            held = [rows[last:]]
        yield out(np.concatenate(held))

    return cells.mapInArrow(run, "a long, b long").distinct()


def _cells(blocks: DataFrame, sizes: DataFrame, how: str, tile_rows: int, *columns: str) -> DataFrame:
    """Blocks with their sizes n, in tiles: a pair of tiles has a cell, and so has each tile."""
    tiles = F.ceil(F.coalesce("n", F.lit(1)) / tile_rows).cast("int")
    return (
        blocks.join(sizes, "node", how)
        .withColumn("tile", F.pmod(F.xxhash64(*columns), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select("node", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), *columns)
        .repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", *columns)
    )


def links(distinct: DataFrame, tile_rows: int = TILE_ROWS, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between fingerprints, which connect exactly what links connect."""
    cuts = [max(1, 64 * b // (distance + 1)) if b else 0 for b in range(distance + 2)]
    blocks = distinct.select("fp", F.posexplode(F.array(*[
        F.shiftrightunsigned("fp", a).bitwiseAND((1 << min(b - a, 16)) - 1).cast("int")
        for a, b in zip(cuts, cuts[1:])])).alias("block", "value"))
    blocks = blocks.select("fp", (F.col("block") * 65_536 + F.col("value")).alias("node"))
    sizes = blocks.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    # at most 65,536 nodes a block
    return _cell_edges(_cells(blocks, F.broadcast(sizes), "inner", tile_rows, "fp"), distance, None)


def bit_samples(n: int, distance: int) -> list[int]:
    """Masks of sampled bits: n fingerprints make cells of some KEY_ROWS, and all masks miss a pair at the distance
    with probability MISS. A table of up to KEY_ROWS has one empty mask, which misses none."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / KEY_ROWS)))
    share = math.comb(64 - distance, bits) / math.comb(64, bits)
    tables = 1 if share == 1 else math.ceil(math.log(MISS) / math.log1p(-share))
    draw = random.Random(bits)
    return [sum(1 << b for b in draw.sample(range(64), bits)) for _ in range(tables)]


def candidate_links(distinct: DataFrame, distance: int, similarity: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) between the ids of distinct rows (fp, sketch, id), which connect what candidate links connect."""
    masks = bit_samples(distinct.count(), distance)
    signed = [m - 2**64 if m >> 63 else m for m in masks]
    blocks = distinct.select("fp", "id", "sketch", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "value"))
    blocks = blocks.select("fp", "id", "sketch", F.xxhash64("mask", "value").alias("node"))
    # written, so that the join knows the size of this table of nodes that are cut into tiles
    sizes = staged(blocks.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows), "large-cells")
    return _cell_edges(_cells(blocks, sizes, "left", tile_rows, "fp", "id", "sketch"), distance, sketch_distance(similarity))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge: root is the smallest node of its component.

    Large-star and small-star rounds; each writes its edges and reads them again.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return staged(e.where("a <> b").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = state(e)
    while before[0]:
        around = both(e)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = tidy(large)
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        e = tidy(small)
        now = state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _rooted(rows: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints (fp, least_id), and (fp, root) of those with a link."""
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    roots = staged(components(staged(links(distinct, distance=distance), "links")), "roots")
    return distinct, roots.withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                    shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(row_id, id, fp, component_id) for every row of docs."""
    rows = staged(fingerprints(docs, id_col, text_col, row_col, shingle), "fingerprints")
    distinct, roots = _rooted(rows, distance)
    tied = distinct.join(roots, "fp")
    tied = tied.select("fp", "root").join(
        tied.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    ids = distinct.join(tied, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(staged(ids, "components"), "fp").select("row_id", "id", "fp", "component_id")


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets is at least so much; empty sets are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def checked_links(rows: DataFrame, distance: int, similarity: float, words: int, tile_rows: int = CHECK_ROWS) -> DataFrame:
    """Edges (a, b) between the row_ids of rows (row_id, fp, root, text), which connect exactly what similar links connect."""

    def edges(cell: list[tuple]) -> Iterator[tuple[int, int]]:
        fps = np.array([c[1] for c in cell], np.int64).view(np.uint64)
        tile, sets = np.array([c[2] for c in cell]), [shingle_set(c[3], words) for c in cell]
        within, label = tile.min() == tile.max(), np.arange(len(cell))
        for i in range(len(cell)):
            near = (np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) & (within | (tile[i + 1 :] != tile[i]))
            for j in (i + 1 + np.flatnonzero(near)).tolist():
                if label[i] != label[j] and similar(sets[i], sets[j], similarity):
                    label[label == label[j]] = label[i]
                    yield cell[i][0], cell[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cell: list[tuple]) -> pa.RecordBatch:
            found = np.array(list(edges(cell)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        at, cell = None, []
        for batch in batches:
            for *key, row, fp, tile, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at and cell:
                    yield out(cell)
                    cell = []
                at = key
                cell.append((row, fp, tile, text))
        if cell:
            yield out(cell)

    sizes = rows.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select(
        "root", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    cells = (
        rows.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("row_id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
                "row_id", "fp", "tile", "text")
        # a pair of tiles has a cell, which compares across; a tile's own cell compares inside
        .repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "row_id")
    )
    return cells.mapInArrow(run, "a long, b long")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   distance: int = DISTANCE, similarity: float | None = None, words: int = 5) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest id, the first of equals.

    With a `similarity`, links must also reach it as Jaccard similarity of shingles of `words` words, and
    null ids come last in a component. Without, components of null ids only keep the first row of each
    fingerprint.
    """
    rows = numbered(docs)
    if similarity is not None:
        prints = staged(fingerprints(rows, id_col, text_col, ROW, shingle, words), "fingerprints")
        distinct = staged(prints.groupBy("fp", "sketch").agg(F.min("row_id").alias("id")), "distinct")
        roots = components(staged(candidate_links(distinct, distance, similarity), "links"))
        roots = staged(distinct.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
            "fp", "sketch", F.coalesce("root", "id").alias("root")), "roots")
        found = prints.join(roots, ["fp", "sketch"]).drop("sketch")
        shared = found.join(found.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "root").drop("n")
        texts = rows.select(F.col(ROW).alias("row_id"), text_of(text_col).alias("text"))
        held = staged(checked_links(shared.join(texts, "row_id"), distance, similarity, words), "checked")
        tied = staged(components(held), "components").withColumnsRenamed({"node": "row_id", "root": "component"})
        tied = tied.join(prints, "row_id").withColumn("order", F.struct(F.col("id").isNull(), "id", "row_id"))
        first = tied.groupBy("component").agg(F.min("order").alias("first"))
        gone = tied.join(first, "component").where(F.col("order") != F.col("first"))
        return rows.join(gone.select(F.col("row_id").alias(ROW)), ROW, "left_anti").drop(ROW)
    found = near_duplicates(rows, id_col, text_col, ROW, shingle, distance)
    of_null = F.when(F.col("component_id").isNull(), F.col("fp"))
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id", of_null.alias("of")).agg(
        F.min("row_id").alias(ROW))
    return rows.join(stay, ROW, "left_semi").drop(ROW)
