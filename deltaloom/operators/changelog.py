"""Folding change logs: last writer wins, versioned deletes, partial updates, truncates, key moves.

Every fold is one aggregation by key with map-side combine; only ordered partial merges keep a row's changes together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def last_writer(changes: DataFrame, keys: list[str], version: str, arrival: str) -> DataFrame:
    """The row of the highest version by key, the later arrival among equals; deletes stay, as versioned tombstones."""
    rest = [c for c in changes.columns if c not in keys]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, arrival)).alias("r"))
    return best.select(*keys, "r.*")


def live(folded: DataFrame, op: str = "op") -> DataFrame:
    return folded.where(F.col(op) != "delete")


def stale_after_version(changes: DataFrame, keys: list[str], version: str, arrival: str) -> DataFrame:
    """Arrival-order fold for stores that keep a version: a write is stale if lower than one before it, or unversioned
    once a version is stored; equal versions apply (K14). Adds ``applied``."""
    w = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(version).over(w)
    return changes.withColumn("applied", before.isNull() | F.coalesce(F.col(version) >= before, F.lit(False)))


def key_moves(changes: DataFrame, new_id: str, old_id: str, op: str = "op") -> DataFrame:
    """An update that moves the key becomes a delete of the old id and an upsert of the new."""
    moved = F.col(old_id).isNotNull() & (F.col(old_id) != F.col(new_id))
    parts = F.when(moved, F.array(F.struct(F.col(old_id).alias("doc_id"), F.lit("delete").alias("action")), F.struct(F.col(new_id).alias("doc_id"), F.lit("upsert").alias("action")))).otherwise(F.array(F.struct(F.col(new_id).alias("doc_id"), F.when(F.col(op) == "delete", "delete").otherwise("upsert").alias("action"))))
    return changes.withColumn("_m", F.explode(parts)).select(*changes.columns, "_m.doc_id", "_m.action")


def merge_present(changes: DataFrame, keys: list[str], order: str, row: str = "row") -> DataFrame:
    """Partial updates: ``row`` is map<string,string> of the columns that were sent; an absent column keeps its value,
    a null sets null (S09, J13). The latest value by key and column, so that both aggregations combine on the map side
    and no key's history is gathered."""
    cells = changes.select(*keys, order, F.explode(row).alias("_c", "_v"))
    last = cells.groupBy(*keys, "_c").agg(F.max_by(F.struct("_v"), order).alias("_s"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_c", F.col("_s._v")))).alias(row))


def after_truncate(changes: DataFrame, table: str, order: str, op: str = "op") -> DataFrame:
    """Changes of a table that no later truncate clears (J19, K22). The truncates of all tables are one row a table."""
    cut = changes.where(F.col(op) == "truncate").groupBy(table).agg(F.max(order).alias("_cut"))
    return changes.where(F.col(op) != "truncate").join(cut, table, "left").where(F.col("_cut").isNull() | (F.col(order) > F.col("_cut"))).drop("_cut")


def committed(changes: DataFrame, commits: DataFrame, tx: str = "tx_id") -> DataFrame:
    """Only transactions with a commit marker."""
    return changes.join(commits.select(tx).distinct(), tx, "left_semi")


def durable_prefix(rows: DataFrame, order: str, ok: str, watermark: str, by: list[str] | None = None) -> DataFrame:
    """Watermark over the contiguous prefix of durable rows, by stream (D02, D06): what stands before the first row that
    is not durable. Two aggregations; no stream's rows are ordered in one task, however many it has."""
    by = by or []
    late = rows.where(~F.coalesce(F.col(ok), F.lit(False)))
    if by:
        first = late.groupBy(*by).agg(F.min(order).alias("_late"))
        marked = rows.join(first, by, "left")
    else:
        marked = rows.withColumn("_late", late.agg(F.min(order)).scalar())
    return marked.where(F.col("_late").isNull() | (F.col(order) < F.col("_late"))).groupBy(*by).agg(F.max(watermark).alias("watermark"))


def runs(rows: DataFrame, order: str, same: list[str], by: list[str]) -> DataFrame:
    """Consecutive rows with equal ``same`` get one run number, by lane."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(F.lit(1)).over(w).isNull(), 1).otherwise(F.greatest(*[(~F.lag(c).over(w).eqNullSafe(F.col(c))).cast("int") for c in same], F.lit(0)))
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def batch_watermark(rows: DataFrame, batch: str, *positions: Column) -> DataFrame:
    """The highest position of each batch; a row's position is the first that it has."""
    return rows.groupBy(batch).agg(F.max(F.coalesce(*positions)).alias("watermark"))


def stamped(docs: DataFrame, changes: DataFrame, position: str, name: str) -> DataFrame:
    """Every document with the highest position of the batch's changes (J42): a scalar subquery, no join."""
    return docs.withColumn(name, changes.agg(F.max(position)).scalar())


def sized_batches(rows: DataFrame, order: str, by: list[str], size: int, most_bytes: int, nbytes: str, at: str | None = None, age_s: int | None = None) -> DataFrame:
    """Flush a lane after ``size`` events, before more than ``most_bytes`` are held, or when the first is ``age_s`` old.

    A batch begins where the one before ends, which no window function can say: rows are sorted by lane, as for a window,
    and pass by once in Arrow batches, with the open batch as the only state. Every row stays, also one of a null lane or
    of an order that another has (fewer bytes first); unknown bytes leave what is held unknown until the next batch."""
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last(), F.col(nbytes), *([at] if at else []))
    seconds = F.unix_timestamp(at) if at else F.lit(None)
    lanes = rows.select("*", F.row_number().over(w).alias("_i"), F.col(nbytes).cast("long").alias("_b"), seconds.cast("long").alias("_t"))
    names = rows.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = n = 0
        held = first = None
        for p in parts:
            out = []
            for i, b, t in zip(*(p.column(c).to_pylist() for c in ("_i", "_b", "_t")), strict=True):
                if i == 1:
                    k, n, held, first = 0, 1, b, t
                elif n >= size or (held is not None and b is not None and held + b > most_bytes) or (age_s is not None and first is not None and t is not None and t - first >= age_s):
                    k, n, held, first = k + 1, 1, b, t
                else:
                    n, held = n + 1, None if held is None or b is None else held + b
                out.append(k)
            yield pa.RecordBatch.from_arrays([*p.columns[: len(names)], pa.array(out, pa.int64())], names=[*names, "batch"])

    return lanes.mapInArrow(run, StructType([*rows.schema.fields, StructField("batch", LongType())]))


def precise_rejection(rejected: DataFrame, count: int, first: int, last: int, offset: str = "offset") -> DataFrame:
    """One row, ok and why: as many offsets as were reported, each once and in range; else the batch fails closed."""
    c = F.col(offset)
    seen = rejected.agg(F.count("*").alias("n"), F.countDistinct(offset).alias("d"), F.count(F.when(c.isNull() | (c < first) | (c > last), 1)).alias("out"))
    why = F.when(F.col("n") != count, "count").when(F.col("out") > 0, "range").when(F.col("d") != F.col("n"), "repeated")
    return seen.select(why.isNull().alias("ok"), why.alias("why"))


def batches(rows: DataFrame, order: str, by: list[str], size: int) -> DataFrame:
    """Flush every ``size`` events of a lane (D01); bounds of bytes and age: ``sized_batches``."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size))


def confirmed_position(barriers: DataFrame, progress: int, seq: str = "seq", position: str = "position") -> DataFrame:
    """One row: the position of the last barrier that the sink's progress has reached, null if none."""
    return barriers.where(F.col(seq) <= progress).agg(F.max_by(position, seq).alias(position))


def safe_ack(high: Column, sink: Column) -> Column:
    return F.least(high, sink)
