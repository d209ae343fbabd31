"""Verbatim containment of passages in a corpus of texts, without a common key.

The plain condition `contains(text, passage)` has no equality to join on, so every text would meet
every passage. But a token that stands between two others inside a passage is a whole token of every
text that contains the passage. So each passage gets an anchor, the interior token found in the fewest
texts; texts and passages are joined on anchors, and only these pairs are compared.

Passages of one or two tokens have no interior. A passage of two has a token that begins or ends a
token of the text, a passage of one is part of a token; the vocabulary of the corpus, which is small
against the corpus, says which tokens these are, by equality on their beginnings, ends or parts, and
each of them is an anchor.

Small tables of tokens and passages are broadcast after counting them; beyond `broadcast_rows` they
are shuffled, and frequent anchors are cut into tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schema as S
from colloquy.sources.corpus import scratch_dir

SPACE = r"\s+"


def _tokens(text: Column) -> Column:
    """Tokens between white space; the first and the last are empty where white space begins or ends a text."""
    return F.split(text, SPACE, -1)


def _store(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def needle_table(needles: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(needle_id, needle, parts, n) per distinct passage that is long enough and not blank."""
    return (
        needles.select(F.col(key).alias("needle_id"), F.lower(text).alias("needle"))
        .where((F.length(text) >= min_chars) & F.col("needle").rlike(r"\S")).distinct()
        .select("needle_id", "needle", _tokens(F.col("needle")).alias("parts"), F.monotonically_increasing_id().alias("n"))
    )


def _short_anchors(short: DataFrame, vocabulary: DataFrame, broadcast_rows: int) -> DataFrame:
    """(n, token): the tokens of which one must stand in a text that contains a short passage. Few asked
    parts are broadcast, so the pieces of the vocabulary, far more than its tokens, are not shuffled."""
    head, tail = F.element_at("parts", 1), F.element_at("parts", -1)
    ends = F.char_length(head) >= F.char_length(tail)
    asked = short.select(
        "n", F.when(F.size("parts") == 1, "in").when(ends, "end").otherwise("start").alias("kind"),
        F.when((F.size("parts") == 1) | ends, head).otherwise(tail).alias("part"))
    few, found = _small(asked, broadcast_rows), None
    for kind in ("in", "end", "start"):
        # one number per length of a token
        lengths = [r.n for r in asked.where(F.col("kind") == kind).select(F.char_length("part").alias("n")).distinct().collect()]
        if not lengths:
            continue
        sized = vocabulary.select("token", F.explode(F.array(*map(F.lit, lengths))).alias("size")).where(
            F.col("size") <= F.char_length("token"))
        if kind == "in":
            sized = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("token") - F.col("size") + 1)))
        else:
            sized = sized.withColumn("at", F.lit(1) if kind == "start" else F.char_length("token") - F.col("size") + 1)
        pieces = sized.select("token", F.substring("token", F.col("at"), F.col("size")).alias("part"))
        wanted = asked.where(F.col("kind") == kind)
        one = pieces.join(F.broadcast(wanted), "part").select("n", "token").distinct() if few else wanted.join(
            pieces.distinct(), "part").select("n", "token")
        found = one if found is None else found.unionByName(one)
    return found


def text_words(haystack: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """(key, token): the distinct tokens of every text, cut once for the vocabulary and for the candidates.
    Texts are dealt evenly first, as a file of few row groups is read by few tasks."""
    texts = haystack.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).hint("rebalance")
    return _store(texts.select("_key", F.explode(F.array_distinct(_tokens(F.col("_text")))).alias("token")).where(
        "token <> ''"), folder, "words")


def anchors(words: DataFrame, asked: DataFrame, folder: str, broadcast_rows: int) -> DataFrame:
    """(token, n, texts): the tokens to look for, with the number of texts that hold them."""
    interior = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))
    inner = _store(asked.select("n", F.explode(F.array_distinct(interior)).alias("token")), folder, "interior")
    short = asked.where(F.size("parts") < 3)
    wanted = _store(inner.select("token").distinct(), folder, "wanted")
    none_short = short.isEmpty()
    if none_short and _small(wanted, broadcast_rows):
        words = words.join(F.broadcast(wanted), "token", "left_semi")
    counts = _store(words.groupBy("token").agg(F.count("*").alias("texts")), folder, "vocabulary")
    rarest = inner.join(counts, "token", "left").groupBy("n").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "token")).alias("a"))
    out = rarest.where("a.texts > 0").select("a.token", "n", "a.texts")
    if not none_short:
        out = out.unionByName(_short_anchors(short, counts, broadcast_rows).join(counts, "token").select("token", "n", "texts"))
    return _store(out, folder, "anchors")


def candidates(words: DataFrame, found: DataFrame, broadcast_rows: int, tile_rows: int) -> DataFrame:
    """Distinct (_key, n): texts that hold an anchor of a passage."""
    if _small(found, broadcast_rows):
        return words.join(F.broadcast(found), "token").select("_key", "n").distinct()
    tiles = found.groupBy("token").agg(F.ceil(F.max("texts") / tile_rows).cast("int").alias("tiles"))
    hot = tiles.where("tiles > 1")
    hot = F.broadcast(hot) if _small(hot, broadcast_rows) else hot
    count = F.coalesce("tiles", F.lit(1))
    spread = found.join(tiles, "token").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    held = words.join(hot, "token", "left").withColumn("tile", F.pmod(F.xxhash64("_key"), count).cast("int"))
    return held.select("_key", "token", "tile").join(spread.select("token", "tile", "n"), ["token", "tile"]).select("_key", "n").distinct()


def contained(haystack: DataFrame, needles: DataFrame, *, key: str = "doc_id", text: str = "text",
              needle_key: str = "item_id", needle_text: str = "text", min_chars: int = S.MIN_LEAK_CHARS,
              broadcast_rows: int = 200_000, tile_rows: int = 100_000) -> DataFrame:
    """Distinct pairs (key, needle_key) of a text and a passage that stands in it, ignoring case.

    Blank passages and passages under ``min_chars`` characters are not looked for; a NULL text
    contains nothing. Texts of one key are looked through one by one."""
    folder = scratch_dir(haystack.sparkSession)
    asked = _store(needle_table(needles, needle_key, needle_text, min_chars), folder, "needles")
    words = text_words(haystack, key, text, folder)
    found = anchors(words, asked, folder, broadcast_rows)
    pairs = _store(candidates(words, found, broadcast_rows, tile_rows), folder, "pairs")
    passages = asked.select("n", "needle_id", "needle", (F.size("parts") == 1).alias("sure"))
    passages = F.broadcast(passages) if _small(passages, broadcast_rows // 20) else passages
    met = pairs.join(passages, "n")
    # a passage of one token stands in every text that holds a token it is part of; the others are compared
    open_ = met.where(~F.col("sure"))
    texts = haystack.select(F.col(key), F.lower(text).alias("_text"))
    keys = open_.select("_key").distinct()
    if _small(keys, broadcast_rows):  # only texts with a candidate travel
        texts = texts.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    compared = open_.join(texts, F.col("_key").eqNullSafe(F.col(key))).where(F.contains("_text", "needle"))
    return met.where("sure").unionByName(compared.select(met.columns)).select(
        F.col("_key").alias(key), F.col("needle_id").alias(needle_key)).distinct()
