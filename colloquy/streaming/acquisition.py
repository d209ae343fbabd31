"""Incremental acquisition of landed submissions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.functions.hashing import seeded_key
from colloquy.operators.order_stats import top_k


def next_unseen(candidates: DataFrame, n: int, groups: Sequence[str], *, created: str = "tcdate",
                key: str = "forum_id", seed: int | None = None) -> DataFrame:
    """The next ``n`` candidates per venue: oldest first, or by seeded order when the
    source has no usable creation time."""
    first = F.col(created) if seed is None else seeded_key(seed, key)
    return top_k(candidates, list(groups), [first, F.col(key)], n)


def read_landed(spark: SparkSession, path: str, schema: StructType, fmt: str = "json",
                max_files: int = 1000) -> DataFrame:
    """Landed note files as a stream. The checkpoint remembers which files were read;
    it takes the place of a cursor per venue."""
    return (
        spark.readStream.schema(schema).format(fmt)
        .option("maxFilesPerTrigger", max_files).load(path)
    )


def first_seen(stream: DataFrame, key: str = "forum_id", event_time: str | None = None,
               delay: str | None = None) -> DataFrame:
    """Drop forums that were seen before. With an event time and a delay the state of
    old forums expires; without, every forum is remembered."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def append_versions(path: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                    fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps versions: each batch has a directory of its
    own and a retried batch replaces it. Readers take the latest version of a forum
    (`ingest.latest_version`), so no batch rewrites the corpus."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if transform is None else transform(batch)
        out.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")

    return write


def compact(spark: SparkSession, path: str, target: str, version: str = "fetched_at",
            fmt: str = "parquet") -> None:
    """Fold all batches into one table with the latest version of every forum."""
    from colloquy.operators.ingest import latest_version

    versions = spark.read.format(fmt).load(path)
    latest_version(versions, version, "batch_id").drop("batch_id").write.mode(
        "overwrite").format(fmt).save(target)
