"""The latest state of every key as a table of snapshots and deltas, for micro-batch writers.

Keys are dealt by hash into a fixed number of buckets. A batch writes the new states of the keys it
touched as a delta. Once a bucket has `fold` deltas, the batch that adds the last one also folds them and
the bucket's snapshot into a new snapshot, so a bucket is always one snapshot and fewer than `fold`
deltas, whatever the number of batches before. A batch reads only the buckets it touches, and pays for
folding one bucket once in `fold` times that it is touched.

A commit is one small JSON document per batch that names the snapshot and the deltas of every bucket; it
is written last. A batch starts from the newest commit of an earlier batch, and files count only if a
commit names them, so a batch that failed at any point or is repeated gives the same outcome: it writes
the same paths again. Files that the newest commits no longer name can be removed by `vacuum`.

Layout: ``commits/<batch>.json``, ``delta/batch_id=<n>/bucket=<b>``, ``base/batch_id=<n>/bucket=<b>``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, FOLD = 64, 8


@dataclass
class Commit:
    """The files that make up the table after a batch."""

    batch_id: int = -1
    base: dict[int, int] = field(default_factory=dict)  # bucket to batch of its snapshot
    deltas: dict[int, list[int]] = field(default_factory=dict)  # bucket to batches since

    def to_json(self) -> str:
        return json.dumps({"batch_id": self.batch_id, "base": self.base, "deltas": self.deltas})

    @staticmethod
    def from_json(text: str) -> Commit:
        d = json.loads(text)
        return Commit(d["batch_id"], {int(b): n for b, n in d["base"].items()}, {int(b): n for b, n in d["deltas"].items()})


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


class StateTable:
    """States under ``path``, one row per key."""

    def __init__(self, spark: SparkSession, path: str, key: str = "forum_id", buckets: int = BUCKETS, fold: int = FOLD):
        if buckets < 1 or fold < 2:
            raise ValueError("a state table needs a bucket or more, and folds two deltas or more")
        self.spark, self.path, self.key, self.buckets, self.fold = spark, path.rstrip("/"), key, buckets, fold
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # --- commits ------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        return names_in(self.spark, f"{self.path}/{folder}")

    def batches(self) -> list[int]:
        """Committed batches in order."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json") and n[0] != ".")

    def commit_of(self, batch_id: int) -> Commit:
        text = self._fs.open(self._at(f"commits/{batch_id}.json"))
        try:
            return Commit.from_json(self._jvm.org.apache.commons.io.IOUtils.toString(text, "UTF-8"))
        finally:
            text.close()

    def latest(self, before: int | None = None) -> Commit:
        """The newest commit, or the newest one of a batch before the given one."""
        done = [b for b in self.batches() if before is None or b < before]
        return self.commit_of(done[-1]) if done else Commit()

    def _write_commit(self, commit: Commit) -> None:
        """Written beside its place and renamed, so that readers see a whole commit or none."""
        part, whole = self._at(f"commits/.{commit.batch_id}.tmp"), self._at(f"commits/{commit.batch_id}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(commit.to_json().encode()))
        out.close()
        if self._fs.exists(whole):
            self._fs.delete(whole, False)
        if not self._fs.rename(part, whole):
            raise OSError(f"cannot write {whole}")

    # --- reading ------------------------------------------------------------------------

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def _files(self, kind: str, batch_buckets: dict[int, list[int]]) -> DataFrame | None:
        """The named buckets of the named batches; pruned to these folders before anything is read."""
        if not batch_buckets:
            return None
        paths = [f"{self.path}/{kind}/batch_id={n}/bucket={b}" for n, bs in sorted(batch_buckets.items()) for b in sorted(bs)]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def read(self, commit: Commit, buckets: list[int] | None = None) -> DataFrame | None:
        """The newest state of every key in the buckets (default all), None before the first state."""
        wanted = set(range(self.buckets) if buckets is None else buckets)
        base, delta = {}, {}
        for b, n in commit.base.items():
            if b in wanted:
                base.setdefault(n, []).append(b)
        for b, batches in commit.deltas.items():
            for n in batches if b in wanted else ():
                delta.setdefault(n, []).append(b)
        parts = [p for p in (self._files("base", base), self._files("delta", delta)) if p is not None]
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        state = [c for c in rows.columns if c not in ("batch_id", "bucket", self.key)]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*state), "batch_id").alias("s")).select(
            self.key, *[F.col(f"s.{c}").alias(c) for c in state])

    def states(self, before: int | None = None) -> DataFrame | None:
        return self.read(self.latest(before))

    # --- writing ------------------------------------------------------------------------

    def _write(self, rows: DataFrame, kind: str, batch_id: int) -> list[int]:
        """Write rows by bucket; the buckets that have rows. Large buckets are cut into several files, so that
        few buckets of many keys are not as few tasks."""
        target = f"{self.path}/{kind}/batch_id={batch_id}"
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        return sorted(int(n.removeprefix("bucket=")) for n in self._names(f"{kind}/batch_id={batch_id}") if n.startswith("bucket="))

    def commit(self, batch_id: int, changed: DataFrame) -> Commit:
        """Add a batch's new states, one row per key, and fold buckets whose turn it is."""
        before = self.latest(batch_id)
        touched = self._write(changed, "delta", batch_id)
        after = Commit(batch_id, dict(before.base), {b: list(n) for b, n in before.deltas.items()})
        for b in touched:
            after.deltas.setdefault(b, []).append(batch_id)
        due = [b for b in touched if len(after.deltas[b]) >= self.fold]
        if due:
            self._write(self.read(after, due), "base", batch_id)
            for b in due:
                after.base[b] = batch_id
                del after.deltas[b]
        self._write_commit(after)
        return after

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete commits but the newest ``keep`` ones, and the files that none of these name."""
        done = self.batches()
        held = [self.commit_of(b) for b in done[-keep:]]
        used = {("base", n) for c in held for n in c.base.values()} | {("delta", n) for c in held for ns in c.deltas.values() for n in ns}
        gone = [f"commits/{b}.json" for b in done[:-keep]]
        newest = done[-1] if done else -1
        for kind in ("base", "delta"):
            for name in self._names(kind):
                n = int(name.removeprefix("batch_id="))
                if n <= newest and (kind, n) not in used:  # a later batch may be writing
                    gone.append(f"{kind}/{name}")
        for name in gone:
            self._fs.delete(self._at(name), True)
        return gone
