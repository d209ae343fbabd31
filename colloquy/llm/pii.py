"""Information-theoretic sanitisation of personal data, on built-in functions only.

Protected entities are the values of four kinds of base spans. Terms (runs of letters and digits)
that share documents with an entity may give it away even when it is cut out. How strongly a term
t reveals an entity v is measured over the whole corpus: with document counts n(v, t), where both
occur, and n(t), the uncertainty that is left about v once t is seen is
IC(v) - PMI(v; t) = log2(n(t) / n(v, t)) bits. A pair that leaves at most `generalise_bits` is
disclosing, however few documents it is seen in, as most values stand in one or two; its term is
generalised to a placeholder, or removed where at most `remove_bits` are left, in every document
that holds it, with or without the entity.

Only documents with entities make pairs, and entities that stand in one document alone count as
one there, since their counts agree. Of a term's pairs the most frequent one decides, so that
terms meet their counts and documents in equi-joins on words; a bitmap of the disclosing terms'
hashes leaves most other words out before these move.

Defined results: a null text is empty and has no spans; positions are code points, the end
exclusive; spans of different kinds may overlap, terms inside base spans are counted, but not
reported; an empty table gives an empty result; repeated rows and ids are told apart by their
place in the table; other columns are ignored by `find_spans` and kept by `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import row_id, staged, text_of

# The contract's kinds, in its order, and their patterns. The patterns are written
# without backtracking: runs are possessive and only start at a run's beginning or where the last
# match ended, which finds the same leftmost matches.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that every match passes.
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

MARK, INSTEAD = "\u0001", "\u0002"
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
WORD = r"[\p{L}\p{M}\p{N}]++"
BITMAP = 1 << 17  # of 64 bits each


def _digits(value: str) -> str:
    return f"translate({value}, ' ().+-', '')"


def _luhn(digits: str) -> str:
    digit = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    doubled = f"if(i % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + {doubled}) % 10 = 0"


VALID = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 "
          "and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": f"length({_digits('s.value')}) between 14 and 19 and {_luhn(_digits('s.value'))}",
    "phone": f"length({_digits('s.value')}) between 10 and 15",
}


def _words(rows: DataFrame) -> DataFrame:
    """(row_id, term): the distinct words of each text."""
    found = F.regexp_extract_all("txt", F.lit(WORD), F.lit(0))
    return rows.select("row_id", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("term"))


def _matches(text: str, pattern: Column, kind: str, number: int, only: str = "true") -> tuple[Column, Column]:
    """All matches of a pattern with positions, from the column pieces_<kind>; and that column.

    `only` is a condition on the match p.

    Marks go around the matches, the text is split there, and lengths of pieces add up to places.
    """
    marked = F.regexp_replace(F.col(text), F.concat(F.lit("("), pattern, F.lit(")")),
                              F.lit(f"{MARK}$1{MARK}"))
    guard = GUARDS.get(kind)
    if kind == "card":
        marked = F.when(F.col(text).rlike("[0-9]{2}|[0-9][ -][0-9]"), marked).otherwise(F.col(text))
    elif guard:
        marked = F.when(F.contains(F.col(text), F.lit(guard)), marked).otherwise(F.col(text))
    pieces = F.split(marked, MARK)
    one = (f"named_struct('start', a.at, 'kind', {number}, 'end', a.at + length(p), 'value', p)")
    return F.expr(
        f"aggregate(pieces_{kind}, named_struct('at', 0, 'i', 0, 'found', cast(array() as {SPANS})), "
        f"(a, p) -> named_struct('at', a.at + length(p), 'i', a.i + 1, 'found', "
        f"if(a.i % 2 = 1 and {only}, concat(a.found, array({one})), a.found)), a -> a.found)"
    ), pieces


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """Adds `spans`: the valid matches of the four kinds, by start and kind."""
    safe = rows.withColumn("safe_text", F.translate(F.col(text), MARK, INSTEAD))
    for number, kind in enumerate(PATTERNS):
        found, pieces = _matches("safe_text", F.lit(PATTERNS[kind]), kind, number)
        safe = safe.withColumn(f"pieces_{kind}", pieces).withColumn(f"found_{kind}", found)
    names = ", ".join(f"filter(found_{k}, s -> {VALID[k]})" for k in PATTERNS)
    return safe.withColumn("spans", F.expr(f"array_sort(concat({names}))")).drop("safe_text", *(f"{p}_{k}" for k in PATTERNS for p in ("pieces", "found")))


def disclosing(found: DataFrame, min_support: int = 1, generalise_bits: float = 1.0,
               remove_bits: float = 0.25) -> DataFrame:
    """(term, removed): terms that disclose an entity; found has row_id, txt and spans."""
    holders = found.where("size(spans) > 0")
    entities = staged(
        holders.select("row_id", F.explode("spans").alias("s"))
        .select("row_id", F.col("s.kind").alias("kind"), F.lower("s.value").alias("entity")).distinct(), "entities")
    counts = entities.groupBy("kind", "entity").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))
    shared = entities.join(counts.where("n > 1").select("kind", "entity"), ["kind", "entity"]).select(
        "row_id", F.lit(-1).cast("long").alias("alone"), "kind", "entity")
    alone = counts.where("n = 1").select("row_id").distinct().select(
        "row_id", F.col("row_id").alias("alone"), F.lit(-1).alias("kind"), F.lit("").alias("entity"))
    best = (
        shared.unionByName(alone).join(_words(holders), "row_id")
        .groupBy("alone", "kind", "entity", "term").agg(F.count("*").alias("n_pair"))
        .where(F.col("n_pair") >= min_support)
        .groupBy("term").agg(F.max("n_pair").alias("n_pair"))
    )
    terms = _words(found).groupBy("term").agg(F.count("*").alias("n_term"))
    bits = F.log2(F.col("n_term") / F.col("n_pair"))
    return best.join(terms, "term").where(bits <= generalise_bits).select(
        "term", (bits <= remove_bits).alias("removed"))


def _holding(found: DataFrame, telling: DataFrame) -> DataFrame:
    """(row_id, told): the telling terms of every text that holds some."""
    h = F.xxhash64("term")
    slot, bit = F.pmod(h, F.lit(BITMAP)).cast("int"), F.expr("shiftleft(1L, cast(xxhash64(term) >> 17 & 63 as int))")
    none = found.sparkSession.range(BITMAP).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("bits"))
    bitmap = (
        telling.select(slot.alias("slot"), bit.alias("bits")).unionByName(none)
        .groupBy("slot").agg(F.bit_or("bits").alias("bits"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"]).alias("bitmap"))
    )
    likely = _words(found).where(F.get(bitmap.scalar(), slot).bitwiseAND(bit) != 0)
    return likely.join(telling, "term").groupBy("row_id").agg(F.collect_list(F.struct("term", "removed")).alias("told"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False,
               **thresholds) -> DataFrame:
    """Per row: row_id, id, txt, spans (base), terms (spans of disclosing terms; kind 4 with `removed`).

    With `keep` the columns of docs come along, as the struct `document`.
    """
    rows = docs.select(
        row_id().alias("row_id"), F.col(id_col).alias("id"), text_of(text_col).alias("txt"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if keep else []))
    found = base_spans(rows, "txt")
    if keep:  # the text is written once
        found = staged(found.drop("txt"), "spans").withColumn("txt", text_of(f"document.`{text_col}`"))
    else:
        found = staged(found, "spans")
    told = _holding(found, staged(disclosing(found, **thresholds), "telling"))
    flagged = (
        found.join(told, "row_id", "left")
        .withColumn("known", F.col("told.term"))
        .withColumn("cut", F.expr("transform(filter(told, t -> t.removed), t -> t.term)"))
        .withColumn("safe_text", F.when(F.col("told").isNotNull(), F.translate("txt", MARK, INSTEAD)))
    )
    spot, pieces = _matches("safe_text", F.lit(WORD), "term", 4, "array_contains(known, lower(p))")
    apart = ("filter(hits, h -> not exists(spans, s -> s.start < h.end and h.start < s.end))")
    return flagged.withColumn("pieces_term", pieces).withColumn("hits", spot).withColumn("terms", F.coalesce(
        F.expr(f"transform({apart}, h -> named_struct('start', h.start, 'kind', h.kind, 'end', h.end, 'removed', "
               "array_contains(cut, lower(h.value))))"),
        F.expr("cast(array() as array<struct<start:int,kind:int,end:int,removed:boolean>>)"),
    )).drop("told", "known", "cut", "safe_text", "pieces_term", "hits")


def listed(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined; expects their order."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at({names}, s.kind + 1), "
                  "s.start, s.end)), ',')")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """The rows of docs with their personal data replaced by [kind], and disclosing terms by [term] or nothing."""
    found = find_spans(docs, id_col, text_col, keep=True, **thresholds)
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    cuts = ("array_sort(concat(transform(spans, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end, "
            "'removed', false)), terms))")
    put = f"if(s.removed, '', element_at({names}, s.kind + 1))"
    clean = F.expr(
        f"aggregate({cuts}, named_struct('at', 0, 'out', ''), (a, s) -> named_struct("
        "'at', greatest(a.at, s.end), 'out', if(s.start >= a.at, "
        f"concat(a.out, substring(txt, a.at + 1, s.start - a.at), {put}), a.out)), "
        "a -> concat(a.out, substring(txt, a.at + 1, length(txt))))")
    kinds = dict(docs.dtypes)
    out = []
    for c in docs.columns:
        old = F.col(f"document.`{c}`")
        if c == text_col:
            old = F.when(F.size("spans") + F.size("terms") > 0, clean).otherwise(old)
        out.append(old.alias(c))
    done = found.select(*out)
    if "n_chars" in kinds:
        done = done.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(
            F.char_length(text_col)).cast(kinds["n_chars"]))
    return done
