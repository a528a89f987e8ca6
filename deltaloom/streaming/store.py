"""Bucketed tables with atomic versions, for foreachBatch: a batch rewrites only the buckets that it touches.

    root/data/<table>/bucket=<k>/batch=<n>/   the rows of a bucket as of batch n
    root/manifest/<n>.json                    which batch each bucket of each table is at, after batch n

A batch writes its buckets first and its manifest last, by a rename, so that is where it becomes durable: a batch that
fails before is invisible, and a batch that is run again starts from the manifest before it and writes the same again.
Folders that neither the newest manifest nor the one before names are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, before: int | None = None) -> dict[str, dict[str, int]]:
        """Of the newest batch, or of the newest one before ``before``."""
        have = [v for v in self.versions() if before is None or v < before]
        if not have:
            return {}
        stream = self.fs.open(self._path(f"{self.root}/manifest/{have[-1]}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *keys: str) -> list[int]:
        """Buckets of the rows: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket(*keys)).distinct().collect())

    def read(self, manifest: dict, table: str, schema, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets; no other bucket's file is opened."""
        at = manifest.get(table, {})
        paths = [f"{self.root}/data/{table}/bucket={k}/batch={n}" for k, n in at.items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, manifest: dict, table: str, rows: DataFrame, buckets: list[int], batch: int, *keys: str) -> None:
        """The whole new contents of ``buckets``; ``manifest`` is brought up to date."""
        at = manifest.setdefault(table, {})
        if not buckets:
            return
        temp = f"{self.root}/tmp/{table}-{batch}"
        rows.withColumn("bucket", self.bucket(*keys)).repartition(min(len(buckets), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(temp)
        for k in buckets:
            new, to = self._path(f"{temp}/bucket={k}"), self._path(f"{self.root}/data/{table}/bucket={k}/batch={batch}")
            at.pop(str(k), None)
            if self.fs.exists(to):
                self.fs.delete(to, True)
            if self.fs.exists(new):
                self.fs.mkdirs(to.getParent())
                if not self.fs.rename(new, to):
                    raise OSError(f"{to} could not be written")
                at[str(k)] = batch
        self.fs.delete(self._path(temp), True)

    def commit(self, manifest: dict, batch: int) -> None:
        name, temp = (self._path(f"{self.root}/manifest/{batch}.{x}") for x in ("json", "tmp"))
        out = self.fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self.fs.delete(name, False)
        if not self.fs.rename(temp, name):
            raise OSError(f"{name} could not be written")
        self._sweep(manifest, batch)

    def _sweep(self, manifest: dict, batch: int) -> None:
        before = self.manifest(batch)
        older = [v for v in self.versions() if v < batch][:-1]
        for v in older:
            gone = self.manifest(v + 1)
            for table, at in gone.items():
                for k, n in at.items():
                    if n not in (manifest.get(table, {}).get(k), before.get(table, {}).get(k)):
                        self.fs.delete(self._path(f"{self.root}/data/{table}/bucket={k}/batch={n}"), True)
            self.fs.delete(self._path(f"{self.root}/manifest/{v}.json"), False)
