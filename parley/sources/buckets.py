"""Tables in hash buckets, of which a change rewrites only those that it touches.

Rows lie in ``data/commit=<id>/_bucket=<n>`` by the hash of their key. A manifest,
one small file per version, names the commit that holds each bucket. A writer puts
the new rows of the touched buckets into a commit of its own and then adds the next
manifest. What a killed writer leaves behind is named by no manifest and never read,
and readers of an older version keep their files.

* The number of buckets is fixed when a table is made. The manifest has a row for
  each, so that number bounds what reaches the driver, whatever the number of rows.
* One writer at a time: a second one that started from the same version fails when
  it adds its manifest, and is to be run again.
* Missing parts of a key are a value like others. An empty table has a manifest
  without buckets; buckets that lose all rows leave the manifest.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
BUCKET = "_bucket"
MANIFEST = "_bucket int, folder string, rows bigint"
HEAD = -1  # the manifest's row with the number of buckets

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has added the version in between."""


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    folders: dict[int, tuple[str, int]]  # bucket -> commit that holds it, rows

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.folders.values())


class BucketedTable:
    """A table at ``root`` with unique ``keys``."""

    def __init__(self, spark: SparkSession, root: str, keys: Iterable[str], schema: T.StructType):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), tuple(keys), schema

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> Manifest:
        """The first version."""
        return self._swap(Manifest(1, buckets, self._written(rows, buckets)))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of ``version``."""
        every = self.spark.read.schema(f"{MANIFEST}, version bigint").parquet(f"{self.root}/manifest")
        if version is None:
            version = every.agg(F.max("version")).first()[0]
        found = {r[BUCKET]: (r.folder, r.rows) for r in every.where(F.col("version") == version).collect()}
        if HEAD not in found:
            raise ValueError(f"{self.root} has no version {version}")
        return Manifest(version, found.pop(HEAD)[1], found)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self.manifest(version)
        return self._rows(manifest, manifest.folders)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows with the keys of ``wanted``, out of the buckets that can hold them."""
        manifest = self.manifest()
        keys = wanted.select(*self.keys).distinct()
        rows = self._rows(manifest, self._touched(keys, manifest.buckets)).alias("r")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.keys]
        return rows.join(keys.alias("w"), same, "left_semi")

    def change(self, incoming: DataFrame, merge: Merge) -> Manifest:
        """Replaces the buckets that hold keys of ``incoming`` by ``merge(their rows, incoming)``."""
        before = self.manifest()
        touched = self._touched(incoming, before.buckets)
        if not touched:
            return before
        merged = merge(self._rows(before, touched), incoming)
        kept = {b: f for b, f in before.folders.items() if b not in touched}
        return self._swap(Manifest(before.version + 1, before.buckets, kept | self._written(merged, before.buckets)))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys],
                                 *[F.col(k).isNull() for k in self.keys]), F.lit(buckets)).cast("int")

    def _touched(self, rows: DataFrame, buckets: int) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(buckets)).distinct().collect()}

    def _rows(self, manifest: Manifest, wanted: Iterable[int]) -> DataFrame:
        paths = [f"{self.root}/data/commit={manifest.folders[b][0]}/{BUCKET}={b}" for b in sorted(wanted) if b in manifest.folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _written(self, rows: DataFrame, buckets: int) -> dict[int, tuple[str, int]]:
        """Writes rows into a commit of their own; the buckets that it holds."""
        commit = uuid.uuid4().hex
        folder = f"{self.root}/data/commit={commit}"
        placed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn(BUCKET, self._bucket(buckets))
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(folder)
        counts = stored.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()
        return {r[BUCKET]: (commit, r.n) for r in counts}

    def _swap(self, manifest: Manifest) -> Manifest:
        rows = [(HEAD, "", manifest.buckets), *[(b, folder, n) for b, (folder, n) in sorted(manifest.folders.items())]]
        table = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        try:
            table.write.mode("errorifexists").parquet(f"{self.root}/manifest/version={manifest.version}")
        except AnalysisException as e:
            raise Conflict(f"version {manifest.version} of {self.root} exists") from e
        return manifest
