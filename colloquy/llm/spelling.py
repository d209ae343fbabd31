"""Spelling variants of frequent words through PartEnum signatures.

A word is the multiset of its letters, seen as a binary vector with one element per letter and
occurrence (the second `a` is an element of its own). One replaced letter changes two elements, one
inserted or deleted letter changes one, so words one edit apart have vectors at Hamming distance two
or less. Elements are dealt by hash into parts, and a signature is what a word has in one choice of
parts: of four parts, two changed elements leave two untouched, so words of equal length share one of
the six signatures over two parts; of two parts, one changed element leaves one, for words whose
lengths differ by one. A single edit also leaves the first or the last half of a word as it was, so
each signature is emitted once with either half, which loses no pair and keeps signatures selective.

Signatures are 64-bit hashes and joined by equality. A signature of more than `tile_rows` words is cut
into tiles by word: one side keeps its tile, the other one is sent to all tiles, so no task meets all
pairs of a frequent signature. Pairs are verified inside the join by their edit distance, which also
drops equal hashes of different signatures; only near pairs leave it.

Each word's form is its near word of the largest count, if that is `factor` times its own or more.
Counts grow along forms, so they have no cycles; roots follow by pointer jumping in as many rounds as
the logarithm of the longest chain.

Defined results: null and empty texts have no words; repeated rows count each time; a null id is
written as the empty string where an id is asked for; very long texts are cut between runs, never
inside; ties go to the word that is first in code-point order; words of count null are ignored; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ascii_lower, staged, text_of

LETTERS = "A-Za-zÀ-ÿ"
PIECE = 65_536
TILE_ROWS = 2048
SAME, SHORTER, LONGER = 0, 1, 2


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
                shortest: int = 5, least: int = 3, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): the maximal runs of letters, A-Z lower-cased, of `shortest` code points and `least` occurrences.

    `change` maps the id and a run to the word that is counted; it may shorten a run, but not lengthen it.
    """
    # a piece ends where a run ends, so no run is cut and no array holds a whole long text
    pieces = F.regexp_extract_all(text_of(text_col), F.lit(f"(?s).{{1,{PIECE}}}[{letters}]*"), 0)
    runs = F.regexp_extract_all(ascii_lower(F.col("piece")), F.lit(f"[{letters}]{{{shortest},}}"), 0)
    found = docs.select(text_of(id_col).alias("id"), F.explode(pieces).alias("piece")).select(
        "id", F.explode(runs).alias("run"))
    word = F.col("run") if change is None else change(F.col("id"), F.col("run"))
    return found.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= least)


def elements(word: str, parts: int) -> list[str]:
    """The elements of a word's vector in each part, in order."""
    import xxhash

    seen, out = Counter(), [""] * parts
    for letter in sorted(word):
        element = f"{letter}{seen[letter]}."
        seen[letter] += 1
        out[xxhash.xxh32_intdigest(element, 7) % parts] += element
    return out


def signatures(word: str, same: tuple[int, int] = (4, 2), other: tuple[int, int] = (2, 1)) -> Iterator[tuple[int, int]]:
    """(role, signature): two words one edit apart share a signature, in role SAME or as SHORTER and LONGER.

    `same` and `other` are (parts, parts in a signature) for equal lengths and lengths one apart; two
    and one fewer of the parts, or less, must be in a signature.
    """
    import xxhash

    n = len(word)

    def of(role: int, length: int, half: int, rest: int, count: int, take: int) -> Iterator[tuple[int, int]]:
        held = elements(word, count)
        for i, chosen in enumerate(combinations(held, take)):
            kind = f"{role == SAME:d}{length}:{i}:{'|'.join(chosen)}"
            for end in (f"<{word[:half]}", f">{word[n - rest:]}"):
                yield role, xxhash.xxh64_intdigest(kind + end, 11)

    yield from of(SAME, n, n // 2, n - n // 2, *same)
    yield from of(SHORTER, n, n // 2, n - n // 2, *other)
    yield from of(LONGER, n - 1, (n - 1) // 2, n - 1 - (n - 1) // 2, *other)


def signed(words: DataFrame) -> DataFrame:
    """(sig, role, word, n) for every signature of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                found = [list(signatures(w)) for w in part.column(0).to_pylist()]
                row = np.repeat(np.arange(len(part)), [len(f) for f in found])
                flat = [s for f in found for s in f]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array([s for _, s in flat], np.uint64).view(np.int64)),
                    pa.array(np.array([r for r, _ in flat], np.int8)),
                    part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                ], ["sig", "role", "word", "n"])

    return words.mapInArrow(run, "sig long, role byte, word string, n long")


def near_pairs(words: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one insertion, deletion or replacement apart, once."""
    rows = staged(signed(words), "signatures")
    hot = rows.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > tile_rows).select(
        "sig", F.ceil(F.col("size") / tile_rows).cast("int").alias("tiles"))
    hot = staged(hot, "frequent")
    if hot.count() <= 100_000:  # a few MB; beyond, Spark joins by shuffle
        hot = F.broadcast(hot)
    rows = rows.join(hot, "sig", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    left = rows.where(F.col("role") != LONGER).select(
        "sig", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int").alias("tile"), "role",
        F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = rows.where(F.col("role") != SHORTER).select(
        "sig", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
        F.col("word").alias("b"), F.col("n").alias("n_b"))
    once = (F.col("role") == SHORTER) | (F.col("a") < F.col("b"))
    met = left.join(right, ["sig", "tile"]).where(once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) without cycles, by pointer jumping."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = staged(at.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        at = after.drop("moved")


def group_variants(words: DataFrame, factor: float = 2.0, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every distinct word of rows (word, n); repeated words add up."""
    words = staged(words.where("word is not null and n is not null").groupBy("word").agg(
        F.sum("n").cast("long").alias("n")), "words")
    pairs = staged(near_pairs(words, tile_rows), "near")
    both = pairs.unionByName(pairs.select(
        F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    larger = -F.col("best.less") >= F.col("n") * factor
    known = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(larger, F.col("best.form")).alias("form"), F.when(larger, -F.col("best.less")).alias("form_n")), "forms")
    return known.join(roots(known.where("form is not null")), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))
