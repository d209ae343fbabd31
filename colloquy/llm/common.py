"""Helpers of the operators: shared folder, staged tables, row identity."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROW = "__row_id__"
_created: list[str] = []  # folders of staged tables, in order


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Only a session inside one JVM, as in tests, may go without; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="colloquy-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{label}"
    atexit.register(_delete, spark, path)
    _created.append(path)
    return path


@contextmanager
def staging() -> Iterator[list[str]]:
    """The folders of the tables staged inside the block."""
    start, paths = len(_created), []
    yield paths
    paths += _created[start:]


def release(docs: DataFrame, paths: list[str]) -> None:
    """Delete folders of staged tables that docs does not read, and take them off the list."""
    read = "\n".join(docs.inputFiles())
    for path in [p for p in paths if p not in read]:
        _delete(docs.sparkSession, path)
        paths.remove(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """A text column as string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_id() -> Column:
    """Identity of a row by its place in this scan. Another scan may be split elsewhere: see `numbered`."""
    return F.monotonically_increasing_id()


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a written number per row in ROW: equal in every scan, however each one is split."""
    return staged(docs.withColumn(ROW, row_id()), "numbered")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, low))
