"""A keyed table that takes micro-batches of updates bucket by bucket (ST4).

Rows lie in a fixed number of hash buckets of the key.  The manifest, one small
text, names for each bucket the version folder that holds it; a batch rewrites
the buckets it touches in a version of its own, then the manifest is replaced
by a rename.  Readers see the table before or after a batch, untouched buckets
keep their files, and versions that no manifest of the last ``keep`` batches
names are deleted.

    <path>/v=<batch>/bucket=<n>/part-*.parquet
    <path>/_MANIFEST    {"batch": .., "buckets": {n: batch}, "recent": [[batch, ..], ..]}
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.io import _jvm_fs, path_exists, read_text, write_text

BUCKETS = 256


@dataclass(frozen=True)
class KeyedTable:
    """One row per key: the greatest ``order`` of all its updates, with the columns that came with it.

    buckets: fixed for the life of the table; size it so that a bucket is a few
    hundred MB.  keep: batches whose files readers may still use.
    """

    path: str
    key: str = "user_id"
    order: str = "last_touch"
    buckets: int = BUCKETS
    keep: int = 2

    @property
    def _manifest_path(self) -> str:
        return f"{self.path.rstrip('/')}/_MANIFEST"

    def manifest(self, spark: SparkSession) -> dict | None:
        if not path_exists(spark, self._manifest_path):
            return None
        found = json.loads(read_text(spark, self._manifest_path))
        found["buckets"] = {int(b): v for b, v in found["buckets"].items()}
        return found

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path.rstrip('/')}/v={version}/bucket={bucket}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, only: Sequence[int] | None = None) -> DataFrame | None:
        """The table as the manifest has it; None before the first batch."""
        found = self.manifest(spark)
        if not found:
            return None
        paths = [self._folder(v, b) for b, v in sorted(found["buckets"].items()) if only is None or b in only]
        return spark.read.parquet(*paths) if paths else None

    def merge(self, updates: DataFrame, batch: int) -> list[int]:
        """Take the updates of micro-batch ``batch``; the touched buckets.

        Updates are reduced to a row per key before the shuffle, so a key that
        holds a third of a batch is a row per task.  A batch that the manifest
        already has (a replay after a failure) changes nothing; one that failed
        before the manifest was written is written anew.  Null keys are left out.
        """
        spark = updates.sparkSession
        found = self.manifest(spark) or {"batch": -1, "buckets": {}, "recent": []}
        if batch <= found["batch"]:
            return []
        latest = self._latest(updates.where(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket()))
        # at most ``buckets`` numbers
        touched = sorted(r[0] for r in latest.select("bucket").distinct().collect())
        if touched:
            old = self.read(spark, touched)
            merged = latest if old is None else self._latest(latest.unionByName(old.withColumn("bucket", self.bucket())))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path.rstrip('/')}/v={batch}")
        buckets = found["buckets"] | {b: batch for b in touched}
        recent = [*found["recent"], sorted(set(buckets.values()))][-self.keep :]
        write_text(spark, self._manifest_path, json.dumps({"batch": batch, "buckets": buckets, "recent": recent}))
        self._expire(spark, found, recent)
        return touched

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "bucket")]
        best = F.max_by(F.struct(*rest), F.struct(self.order, *[c for c in rest if c != self.order]))
        return rows.groupBy("bucket", self.key).agg(best.alias("_row")).select("bucket", self.key, "_row.*")

    def _expire(self, spark: SparkSession, before: dict, recent: list[list[int]]) -> None:
        named = {v for versions in recent for v in versions}
        for version in {v for versions in before["recent"] for v in versions} - named:
            fs, folder, _ = _jvm_fs(spark, f"{self.path.rstrip('/')}/v={version}")
            fs.delete(folder, True)


def start_upserts(stream: DataFrame, table: KeyedTable, ckpt: str):
    """Merge every micro-batch of ``stream`` (key, order and other columns) into the table.

    The stream itself keeps no state: what a key has is in the table.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: table.merge(batch, batch_id) and None)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
