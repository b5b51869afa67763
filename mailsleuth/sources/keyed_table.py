"""Table of the latest row per key, kept as Parquet by key bucket, for small changes to large tables.

A batch of changes is written as one file set, parted by bucket; a bucket is rewritten only when more than ``max_deltas``
batches have touched it since. Which folders make up each bucket stands in a manifest, a small table of its own written
whole for every batch after the rows it names; readers open the folders of the newest manifest and nothing else, so
that what a read costs does not grow with the number of batches, and a batch that broke off half-way is not there.
A table has one writer at a time, as a stream has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.skew import latest
from ..session import children

ENTRY = "bucket int, folder string, is_base boolean, batch_id long"


class KeyedTable:
    """``order`` are the columns by which a later row of a key wins; between equal ones the later batch does. Buckets go
    by ``bucket_by``, some of the keys, which are also what rows are looked up by; all of them by default."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], order: list[str], buckets: int = 64, max_deltas: int = 4, bucket_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.order, self.buckets, self.max_deltas, self.bucket_by = spark, path, keys, order, buckets, max_deltas, bucket_by or keys
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.stored_schema = T.StructType([*self.schema, T.StructField("_batch", T.LongType())])

    def manifest(self) -> tuple[int, int, list]:
        """Last version, last batch, and the entries: at most ``buckets`` times one base and ``max_deltas`` batches. A
        row without a bucket carries the last batch."""
        versions = sorted((int(name.split("=")[1]) for name in children(self.spark, f"{self.path}/manifest") if name.startswith("version=")), reverse=True)
        for version in versions:  # the newest may have broken off before its file was there
            rows = self.spark.read.schema(ENTRY).parquet(f"{self.path}/manifest/version={version}").collect()
            if rows:
                return versions[0], max(r["batch_id"] for r in rows), [r for r in rows if r["bucket"] is not None]
        return (versions[0] if versions else 0), -1, []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _rows(self, entries: list) -> DataFrame:
        folders = sorted({f"{self.path}/rows/{r['folder']}/bucket={r['bucket']}" for r in entries})
        if not folders:
            return self.spark.createDataFrame([], self.stored_schema)
        return self.spark.read.schema(self.stored_schema).parquet(*folders)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.keys, *[F.col(c) for c in self.order], F.col("_batch")).select(*self.stored_schema.fieldNames())

    def _write(self, rows: DataFrame, folder: str) -> list[int]:
        """Write by bucket; the buckets there are now."""
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{folder}")
        return sorted(int(name.split("=")[1]) for name in children(self.spark, f"{self.path}/rows/{folder}") if name.startswith("bucket="))

    def upsert(self, changes: DataFrame, batch_id: int) -> bool:
        """Add a batch; batches come in rising order. False for a batch that is there already."""
        version, last, entries = self.manifest()
        if batch_id <= last:
            return False
        folder = f"batch={batch_id}/{uuid.uuid4().hex}"
        rows = self._latest(changes.select(*self.schema.fieldNames()).withColumn("_batch", F.lit(batch_id).cast("long")))
        entries = [(r["bucket"], r["folder"], r["is_base"], r["batch_id"]) for r in entries] + [(b, folder, False, batch_id) for b in self._write(rows, folder)]
        deltas: dict[int, int] = {}
        for b, _, is_base, _ in entries:
            deltas[b] = deltas.get(b, 0) + (not is_base)
        full = {b for b, n in deltas.items() if n > self.max_deltas}
        if full:
            old = [{"bucket": b, "folder": f} for b, f, _, _ in entries if b in full]
            base = f"{folder}-base"
            self._write(self._latest(self._rows(old)), base)
            entries = [e for e in entries if e[0] not in full] + [(b, base, True, batch_id) for b in sorted(full)]
        # the one file of the manifest appears as a whole
        self.spark.createDataFrame([*entries, (None, None, None, batch_id)], ENTRY).coalesce(1).write.parquet(f"{self.path}/manifest/version={version + 1}")
        return True

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """The latest row of every key, or of those that ``wanted`` names by ``bucket_by``; only their buckets are opened."""
        entries = self.manifest()[2]
        if wanted is not None:
            hit = {r["b"] for r in wanted.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets`` numbers
            entries = [r for r in entries if r["bucket"] in hit]
        rows = self._rows(entries)
        if wanted is not None:
            rows = rows.join(wanted.select(*self.bucket_by).distinct(), self.bucket_by, "left_semi")
        return self._latest(rows).drop("_batch")
