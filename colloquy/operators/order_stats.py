"""Exact order statistics that never sort a whole group in one task.

Input is a value histogram: ``keys``, a value column and a count ``n``. Repeated
values collapse in the map-side combine, so the largest group costs its number of
distinct values. These are spread over buckets by magnitude; only bucket totals meet
in one window per group (there are at most a few hundred for values of one scale), and
the values of a bucket are ordered in a task of their own. Bucketing is a monotone
function of the value, hence the results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.rows import with_row

PER_OCTAVE = 64  # buckets between a value and its double
_EXPONENTS = 1100  # more than the exponent range of a double


def histogram(df: DataFrame, keys: list[str], value: str, n: Column | None = None) -> DataFrame:
    """Counts per key and value; NULL values are left out."""
    weight = F.lit(1) if n is None else n
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(weight).cast("bigint").alias("n"))
    )


def bucket(value: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Monotone bucket number of a value; NULL values share one of their own."""
    size = F.floor(F.log2(F.abs(value)) * per_octave) + _EXPONENTS * per_octave
    return F.coalesce(
        F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * size).cast("bigint"),
        F.lit(-(2**62)))


def attach(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys; without keys ``other`` is a one-row aggregate."""
    return df.join(other, keys, how) if keys else with_row(df, other)


def positioned(hist: DataFrame, keys: list[str], value: str,
               per_octave: int = PER_OCTAVE) -> DataFrame:
    """Histogram rows with the figures of their group and their place in its order.

    ``rows`` counts everything, ``total`` only rows with a value; ``sum_v``, ``mean``,
    ``lo`` and ``hi`` describe the values. A row with a value covers the 0-based
    positions from ``upto - n`` to ``upto - 1`` of the sorted group."""
    v, n = F.col(value), F.col("n")
    h = hist.withColumn("_b", bucket(v, per_octave))
    counted = F.when(v.isNotNull(), n).otherwise(0)
    per_bucket = h.groupBy(*keys, "_b").agg(
        F.sum(n).alias("_r"), F.sum(counted).alias("_n"), F.sum(v * n).alias("_s"),
        F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    group = W.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    figures = per_bucket.select(
        *keys, "_b",
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        F.sum("_r").over(group).alias("rows"), F.sum("_n").over(group).alias("total"),
        F.sum("_s").over(group).alias("sum_v"),
        F.min("_lo").over(group).alias("lo"), F.max("_hi").over(group).alias("hi"),
    ).withColumn("mean", F.col("sum_v") / F.nullif(F.col("total"), F.lit(0)))
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        h.join(figures, [*keys, "_b"])
        .withColumn("upto", F.when(v.isNotNull(), F.col("_before") + F.sum(n).over(inside)))
        .drop("_b", "_before")
    )


def at_position(value: str, position: Column) -> Column:
    """Aggregate over positioned rows: the value at a position of the group."""
    hit = (position >= F.col("upto") - F.col("n")) & (position < F.col("upto"))
    return F.max(F.when(hit, F.col(value)))


def median(value: str) -> Column:
    """Exact median: the mean of the two middle elements, one and the same on an odd
    count."""
    total = F.col("total")
    return (at_position(value, F.floor((total - 1) / 2)) + at_position(value, F.floor(total / 2))) / 2


def tercile(value: str, k: int) -> Column:
    """The element at k * total // 3 of the sorted group."""
    return at_position(value, F.floor(F.col("total") * k / 3))


def stdev(value: str) -> Column:
    """Population deviation, summed around the finished mean; exactly 0 for a constant."""
    around = F.sum(F.col("n") * F.pow(F.col(value) - F.col("mean"), F.lit(2)))
    return F.when(F.max("lo") == F.max("hi"), 0.0).otherwise(F.sqrt(around / F.max("total")))


def average_rank(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1-based rank per value of a histogram; ties share the mean of their ranks."""
    return positioned(hist, keys, value).select(
        *keys, value, "n", "total",
        (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def tercile_cuts(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    return positioned(hist, keys, value).groupBy(*keys).agg(
        tercile(value, 1).alias("low_cut"), tercile(value, 2).alias("high_cut"))


def medians(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    return positioned(hist, keys, value).groupBy(*keys).agg(median(value).alias("median"))


def summaries(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, population stdev, median, min and max per group."""
    return positioned(hist, keys, value).groupBy(*keys).agg(
        F.max("total").alias("count"), F.max("mean").alias("mean"), stdev(value).alias("stdev"),
        median(value).alias("median"), F.max("lo").alias("min"), F.max("hi").alias("max"))


def key_cutoffs(df: DataFrame, groups: list[str], key: str,
                quotas: Callable[[DataFrame], DataFrame], prefix: int = 3) -> DataFrame:
    """Per group, the largest ``key`` among its ``quota`` smallest ones.

    ``quotas`` maps group sizes (columns ``groups`` and ``size``) to a table with a
    ``quota`` per group. The key is a hexadecimal hash, so its first digits cut every
    group into even slices. Slice counts decide which slice a quota ends in, and only
    that slice, 1/16**prefix of the group, is ordered. A group with quota 0 has no
    cutoff. Keeping ``key <= cutoff`` then needs no shuffle of the rows."""
    sliced = df.select(*groups, key, F.substring(key, 1, prefix).alias("_s"))
    counts = sliced.groupBy(*groups, "_s").agg(F.count(F.lit(1)).alias("_n"))
    quota = quotas(counts.groupBy(*groups).agg(F.sum("_n").alias("size"))).select(*groups, "quota")
    before = W.partitionBy(*groups).orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = (
        counts.withColumn("_upto", F.sum("_n").over(before)).join(quota, groups)
        .where((F.col("quota") <= F.col("_upto")) & (F.col("quota") > F.col("_upto") - F.col("_n")))
        .select(*groups, "_s", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_k"))
    )
    return (
        sliced.join(last, [*groups, "_s"])
        .withColumn("_r", F.row_number().over(W.partitionBy(*groups, "_s").orderBy(key)))
        .where(F.col("_r") == F.col("_k"))
        .select(*groups, F.col(key).alias("cutoff"))
    )


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, first in the given order. Spark limits each map partition to
    one row per key before the shuffle, so a hot key does not travel whole."""
    return (
        df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows per group, limited on the map side before the shuffle. For larger
    k over hashed keys see `key_cutoffs`."""
    return (
        df.withColumn("_rn", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
        .where(F.col("_rn") <= k)
        .drop("_rn")
    )
