"""Shared helpers: the cluster's shared folder, written tables, and the text rules several operators use."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and its complement, as the operator contracts spell them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to Python; a longer row is a batch of its own.
BATCH = 8 << 20
#: Folders of parked tables that have not been removed.
PARKED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset in local mode.

    On a cluster a folder of the driver's machine would lose rows, so an unset one is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="deltaloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def park(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and prunes columns later.

    Results read these tables when they are run, so they stay until ``unpark`` or ``release``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.parked = path
    PARKED.add(path)
    return out


def unpark(df: DataFrame) -> None:
    """Removes a parked table that nothing reads any more."""
    remove(df.sparkSession, df.parked)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    PARKED.discard(path)


def release(spark: SparkSession) -> None:
    """Removes all parked tables of this process: to be called when the results that read them have been written."""
    for path in list(PARKED):
        remove(spark, path)


def wide(spark: SparkSession) -> int:
    """Partitions for an explicit exchange."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, so that every engine agrees; for ASCII, ``lower`` does so and is much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: float = 1.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which gives freed memory back to the system ``every`` so many seconds and when it ends.

    Python workers live on from stage to stage; what their allocators keep counts against the executor all the while.
    """

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() - last > every:
                del out
                trim()
                last = time.monotonic()
        trim()

    return task


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, trim_every: float = 1.0) -> DataFrame:
    """mapInArrow of a frugal ``run`` in batches of about BATCH bytes.

    The session's limit is lowered where it is higher: a batch is in memory in the executor's and in Python's buffers,
    several times over, for each core.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    had = conf.get(key).removesuffix("b")
    if not had.isdigit() or not 0 < int(had) <= BATCH:
        conf.set(key, f"{BATCH}b")
    return df.mapInArrow(frugal(run, trim_every), schema)
