"""Structured Streaming: a file-source change log folded into a bucketed table in foreachBatch.

A batch rewrites the buckets of its keys, not the table (``store``); a repeated batch writes the same again and a reader
never sees half of one. Bad rows go to a dead-letter output. Documents of several tables: ``incremental``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changelog import last_writer
from .store import Store


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def snapshot(spark: SparkSession, target: str, schema, before: int | None = None) -> DataFrame:
    """The table as of the newest batch (or the newest before ``before``), or an empty one."""
    store = Store(spark, target)
    return store.read(store.manifest(before), "rows", schema)


def counted(df: DataFrame, name: str, **conditions: str) -> DataFrame:
    """``df`` with counters that Spark reports under ``name`` with a query's or a batch's metrics: rows, and one for each
    condition (C06). They cost no pass of their own."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *(F.count(F.when(F.expr(c), 1)).alias(k) for k, c in conditions.items()))


def upsert_stream(changes: DataFrame, target: str, checkpoint: str, keys: list[str], version: str, dlq: str | None = None, good=None, buckets: int = 64):
    """Fold each micro-batch into the table by last writer; rows failing ``good`` go to ``dlq`` as JSON lines."""
    schema = changes.schema

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if good is not None and dlq:
            batch.where(~F.coalesce(good, F.lit(False))).withColumn("reason", F.lit("rejected")).write.mode("overwrite").json(f"{dlq}/batch={n}")
            batch = batch.where(good)
        store = Store(spark, target, buckets)
        manifest = store.manifest(n)
        where = store.touched(batch, *keys)
        both = store.read(manifest, "rows", schema, where).withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        store.write(manifest, "rows", last_writer(both, keys, version, "_new").select(*[f.name for f in schema]), where, n, *keys)
        store.commit(manifest, n)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
