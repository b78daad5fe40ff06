"""A stored evaluation table in hash buckets, of which an upsert rewrites those it touches.

Layout below the root: `data/<version>/bucket=<n>/` holds the rows of the buckets that a
version rewrote, and `versions/<version>` is a small table that names, for each bucket,
the version whose rows hold. A version is published by moving its finished table into
`versions`, one rename; until then readers see the version before. Folders of versions
that were never published are left over by broken runs and belong to no bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.operators.evaluations import upsert

_MANIFEST = "bucket INT, held_by STRING"


@dataclass(frozen=True)
class Published:
    """What an upsert did: its version, and how many of the buckets it rewrote."""

    version: str
    rewritten: int
    buckets: int


class EvaluationTable:
    """Evaluations of `schema`, one row for each `key`, in `buckets` hash buckets.

    The number of buckets is that of the manifest's rows and bounds what the driver
    reads; choose it so that a bucket is a few hundred MB.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: StructType, key: str = "paper_id", buckets: int = 1_024
    ) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.buckets = key, buckets
        self.fields = [f.name for f in schema.fields if f.name != key]

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Published versions, oldest first."""
        files, folder = self._files(), self._path("versions")
        if not files.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(folder))

    def _holders(self, version: str | None) -> dict[int, str]:
        """For each bucket that has rows, the version that wrote them."""
        if version is None:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/versions/{version}")
        return {r.bucket: r.held_by for r in rows.collect()}

    def _read_buckets(self, holders: dict[int, str]) -> DataFrame:
        if not holders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/data/{v}/bucket={b}" for b, v in sorted(holders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: str | None = None) -> DataFrame:
        """The table as of a version, the last published one if none is given."""
        known = self.versions()
        return self._read_buckets(self._holders(version or (known[-1] if known else None)))

    def upsert(self, patch: DataFrame) -> Published:
        """New non-null fields overwrite, others survive; rows with a null key are no records.

        `patch` has one row for each key. Only the buckets of its keys are read, merged by
        a join and written: in two phases, the rows and then the manifest. An upsert that
        starts from a version which another has replaced by the time it publishes fails
        and leaves the other's.
        """
        known = self.versions()
        before = known[-1] if known else None
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        patch = patch.where(F.col(self.key).isNotNull()).select(self.key, *self.fields)
        touched = sorted(r[0] for r in patch.select(bucket).distinct().collect())
        holders = self._holders(before)
        version = f"{int(before.split('-')[0]) + 1 if before else 0:012d}-{uuid.uuid4().hex[:12]}"
        if touched:
            old = self._read_buckets({b: holders[b] for b in touched if b in holders})
            merged = upsert(old, patch, self.fields, self.key).select(*self.schema.names)
            (
                merged.withColumn("bucket", bucket)
                .repartition("bucket")
                .write.partitionBy("bucket")
                .parquet(f"{self.root}/data/{version}")
            )
        self._publish(before, version, {**holders, **dict.fromkeys(touched, version)})
        return Published(version, len(touched), self.buckets)

    def _publish(self, before: str | None, version: str, holders: dict[int, str]) -> None:
        files = self._files()
        waiting = f"{self.root}/waiting/{version}"
        manifest = self.spark.createDataFrame(sorted(holders.items()), _MANIFEST)
        manifest.coalesce(1).write.parquet(waiting)
        files.mkdirs(self._path("versions"))
        known = self.versions()
        if (known[-1] if known else None) != before:
            raise RuntimeError(f"{self.root} has a newer version than {before}; upsert again")
        if not files.rename(self._path("waiting", version), self._path("versions", version)):
            raise RuntimeError(f"version {version} of {self.root} could not be published")

    def remove_old(self, keep: int = 1) -> list[str]:
        """Delete what only versions before the last `keep` need, and broken runs' rows.

        Not while an upsert is running: its rows are in no version yet.
        """
        known = self.versions()
        kept = known[-keep:]
        needed = {v for version in kept for v in self._holders(version).values()}
        files = self._files()
        for version in known[:-keep]:
            files.delete(self._path("versions", version), True)
        gone = []
        for folder in ("data", "waiting"):
            if files.exists(self._path(folder)):
                for status in files.listStatus(self._path(folder)):
                    name = status.getPath().getName()
                    if name not in needed:
                        files.delete(status.getPath(), True)
                        gone.append(name)
        return sorted(set(gone))
