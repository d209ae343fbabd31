"""Exact top-k inner products with block-at-a-time pruning.

Candidates are dealt by hash into ranges of about `range_rows`, queries into tiles, and each pair
of tile and range is one cell: rows against rows only meet inside cells, whose size is fixed, and
no cell sees a pair twice. In a cell the range is ordered by its rows' strongest components and
cut into blocks, each with its forward index (the rows' components) and the largest and smallest
value per component. A query's bound for a block is the sum of what each component can give at
most. Every query takes the blocks by falling bound and scores them whole, until the next bound is
below its k-th score. The cells' lists are merged per query.

Defined results: vectors that are null, or hold null, non-finite or components beyond 64-bit
range, take no part; missing components of shorter vectors count as zero; a repeated row is a
candidate of its own, told apart from the query by its place in the table; ties go to the smaller
id, null ids last, then to the earlier row; an empty table gives an empty result; other columns
are ignored. Scores must fit 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import row_id, staged

SCHEMA = "query_id long, query_row long, vec_id long, row_id long, score long"
NO_ID = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row_id, id, v): each component as floor(scale * x)."""
    x = f"cast(x as double) * {scale}"
    usable = F.expr(f"forall(`{vector_col}`, x -> x is not null and not isnan({x}) and abs({x}) < 9.2e18D)")
    return (
        vectors.select(row_id().alias("row_id"), F.col(id_col).cast("long").alias("id"), F.col(vector_col))
        .where(F.col(vector_col).isNotNull() & usable)
        .select("row_id", "id", F.expr(f"transform(`{vector_col}`, x -> cast(floor({x}) as bigint))").alias("v"))
    )


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def search_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int, block_rows: int) -> pd.DataFrame:
    """The k best rows of one range for each query of one tile."""
    empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="Int64") for c in SCHEMA.split(", ")})
    if not len(queries) or not len(rows):
        return empty
    width = max(queries.v.map(len).max(), rows.v.map(len).max(), 1)
    q, d = _matrix(queries.v, width), _matrix(rows.v, width)
    top = float(np.abs(q.astype(float)).max()) * float(np.abs(d.astype(float)).max()) * width
    exact = top < 2**53
    order = np.lexsort((d.argmin(1), d.argmax(1)))
    d = d[order]
    ids = rows.id.astype("Int64").fillna(NO_ID).to_numpy(np.int64)[order]
    places = rows.row_id.to_numpy(np.int64)[order]
    own = queries.row_id.to_numpy(np.int64)
    if exact:
        q, d = q.astype(float), d.astype(float)
    starts = np.arange(0, len(d), block_rows)
    high = np.maximum.reduceat(d, starts).astype(float)
    low = np.minimum.reduceat(d, starts).astype(float)
    bound = np.maximum(q, 0).astype(float) @ high.T + np.minimum(q, 0).astype(float) @ low.T
    if not exact:
        bound += 1e-9 * top
    turn = np.argsort(-bound, axis=1, kind="stable")
    kth = np.full(len(q), -np.inf)
    best = [np.zeros(0, np.int64)] * 3  # query, row in the range, score
    for step in range(len(starts)):
        block = turn[:, step]
        active = np.flatnonzero(bound[np.arange(len(q)), block] >= kth)
        if not len(active):
            break
        new = []
        for b in np.unique(block[active]):
            who = active[block[active] == b]
            first = starts[b]
            score = q[who] @ d[first : first + block_rows].T
            i, j = np.nonzero((score >= kth[who, None]) & (places[first : first + block_rows] != own[who, None]))
            new.append((who[i], first + j, score[i, j].astype(np.int64)))
        who, row, score = (np.concatenate([x, *y]) for x, y in zip(best, zip(*new)))
        rank = np.lexsort((places[row], ids[row], -score, who))
        who, row, score = who[rank], row[rank], score[rank]
        begin = np.searchsorted(who, who)
        nth = np.arange(len(who)) - begin
        full = nth == k - 1
        kth[who[full]] = score[full]
        best = [x[nth < k] for x in (who, row, score)]
    who, row, score = best
    found = pd.Series(ids[row], dtype="Int64")
    return pd.DataFrame({
        "query_id": queries.id.to_numpy(np.int64)[who], "query_row": own[who],
        "vec_id": found.mask(found == NO_ID), "row_id": places[row], "score": score})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding", range_rows: int = 16_384, tile_rows: int = 8_192,
          block_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best other rows. `is_query` tests `id`."""
    rows = staged(quantised(vectors, id_col, vector_col, scale), "vectors")
    queries = rows.where(is_query)
    ranges = max(1, math.ceil(rows.count() / range_rows))
    tiles = max(1, math.ceil(queries.count() / tile_rows))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = queries.withColumn("tile", F.pmod(F.xxhash64("row_id"), F.lit(tiles)).cast("int")).withColumn(
        "range", each(ranges))
    given = rows.withColumn("range", F.pmod(F.xxhash64("row_id"), F.lit(ranges)).cast("int")).withColumn(
        "tile", each(tiles))
    cells = asked.groupBy("tile", "range").cogroup(given.groupBy("tile", "range")).applyInPandas(
        lambda a, b: search_cell(a, b, k, block_rows), SCHEMA)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_id")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
