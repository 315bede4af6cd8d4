"""A stored dataset that batches are merged into: one record for each key, in hash buckets of which a batch rewrites only those it touches.

Files of a batch are written first, in a folder of their own; then one new manifest names the files that make up each bucket. A batch
that stops before that leaves the dataset as it was, and readers see the manifest they began with.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import staged

ROWS_A_FILE = 1_000_000


class StoredDataset:
    """Records with a key and a preference, in order of ``place``: that of the first record of their key.

    Of the records of a key the one with the least preference is kept, of equal ones the earlier. Records without key are left
    out. The number of buckets is that of the first batch; take as many as keep a bucket within what one task can write.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self._spark, self._path, self._buckets = spark, path.rstrip("/"), buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self._path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}")

    def manifest(self) -> dict:
        """The newest: its version, the number of buckets, the folder of each that has records, and the next place."""
        folder = self._hadoop("manifests")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": {}, "next": 0, "of": self._buckets}
        return json.loads("\n".join(r.value for r in self._spark.read.text(f"{self._path}/manifests/{names[-1]}", wholetext=True).collect()))

    def _commit(self, manifest: dict) -> None:
        name = f"manifests/{manifest['version']:012d}.json"
        part = self._hadoop(name + ".part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # A rename does not replace what is there: of two batches at once one fails.
        if self._fs.exists(self._hadoop(name)) or not self._fs.rename(part, self._hadoop(name)):
            raise RuntimeError(f"version {manifest['version']} was written by another batch")

    def _read(self, folders: list[str]) -> DataFrame:
        return self._spark.read.option("recursiveFileLookup", True).parquet(*(f"{self._path}/{f}" for f in folders))

    def read(self) -> DataFrame | None:
        """All records with ``place``, or None before the first batch."""
        folders = sorted(self.manifest()["buckets"].values())
        return self._read(folders).drop("_key", "_preference") if folders else None

    @staticmethod
    def _best(rows: DataFrame, columns: list[str]) -> DataFrame:
        """One record for each key; combined on both sides of the shuffle, so a key with very many records costs each task one row."""
        row = F.struct(*(F.col(f"`{c}`") for c in columns), "_preference")
        best = rows.groupBy("_key").agg(F.min_by(row, F.struct("_preference", "place")).alias("_row"), F.min("place").alias("place"))
        return best.select("_row.*", "_key", "place")

    def merge(self, batch: DataFrame, key: Column, preference: Column, pos: str = "pos") -> list[int]:
        """Merges a batch in order of ``pos``, after all earlier records, and returns the buckets that it touched.

        Batches have the same columns. Only buckets with keys of the batch are read and written.
        """
        before = self.manifest()
        columns = [c for c in batch.columns if c != pos]
        placed = batch.select(*(F.col(f"`{c}`") for c in columns), key.alias("_key"), preference.alias("_preference"), (F.col(pos) + F.lit(before["next"])).cast("long").alias("place"))
        bucket = F.pmod(F.xxhash64("_key"), F.lit(before["of"])).cast("int")
        folder = f"data/{before['version'] + 1:012d}"
        new = staged(self._best(placed.where("_key is not null"), columns), "batch")
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())
        old = [f for b in touched if (f := before["buckets"].get(str(b)))]
        merged = self._best(self._read(old).unionByName(new), columns) if old else new
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{self._path}/{folder}")
        last = batch.agg(F.max(pos)).first()[0]
        after = {"version": before["version"] + 1, "of": before["of"], "next": before["next"] + (0 if last is None else last + 1)}
        self._commit(after | {"buckets": before["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}})
        return touched
