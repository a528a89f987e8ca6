"""Packing documents into fixed windows by minimum bin slack.

Every document is cut at multiples of the window; those pieces fill windows by themselves. The remainders (1 to
window-1 ids) are packed by their length histogram alone, which has window-1 entries at any corpus size: a bitset
subset-sum dynamic program seeded with the longest length finds the multiset that fills a window closest to capacity,
backtracking gives the counts, and the pattern is repeated for as many windows as the histogram allows. Where even the
closest fill leaves slack, the slack is filled by cutting one more remainder. At most one window of the whole corpus
ends up partly filled; it is cut at powers of two, which need no padding.

Defined cases: null or empty text is a document of the end id alone; equal rows are packed row by row; null doc_id is
kept; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, park, read, text_of
from .units import encoder


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, seeded with the longest, whose sum is the largest that fits ``capacity``."""
    seed = max(counts)
    room, full = capacity - seed, (1 << (capacity - seed + 1)) - 1
    bits, steps = 1, []
    for n in sorted(counts, reverse=True):
        left = min(counts[n] - (n == seed), room // n)
        part = 1
        while left > 0 and not bits >> room & 1:  # 1, 2, 4 ... copies at a time
            take = min(part, left)
            steps.append((n, take, bits))
            bits |= bits << n * take & full
            left -= take
            part *= 2
    target = bits.bit_length() - 1
    need = defaultdict(int, {seed: 1})
    for n, take, before in reversed(steps):
        if not before >> target & 1:
            target -= n * take
            need[n] += take
    return dict(need)


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, ...]], int]:
    """Records (length, lo, hi, start, size, sequence, offset) and the number of sequences.

    Remainders of ``length`` with ranks lo..hi-1 place their ids start..start+size-1 at ``offset`` of the sequences
    ``sequence``, ``sequence`` + 1, ... The number of records depends on the window, not on the corpus.
    """
    pool: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # size -> runs (length, lo, hi, start)
    counts: dict[int, int] = {}
    for n, c in histogram.items():
        pool[n].append((n, 0, c, 0))
        counts[n] = c
    records, base = [], 0

    def take(size: int, k: int, used: int, offset: int) -> None:
        """k remainders of ``size`` give their first ``used`` ids to k sequences from ``base`` on."""
        counts[size] -= k
        if not counts[size]:
            del counts[size]
        at = base
        while k:
            length, lo, hi, start = pool[size].pop()
            n = min(k, hi - lo)
            if n < hi - lo:
                pool[size].append((length, lo + n, hi, start))
            records.append((length, lo, lo + n, start, used, at, offset))
            if used < size:
                pool[size - used].append((length, lo, lo + n, start + used))
                counts[size - used] = counts.get(size - used, 0) + n
            at += n
            k -= n

    while counts:
        need = closest_fill(counts, window)
        slack = window - sum(n * m for n, m in need.items())
        k = min(counts[n] // m for n, m in need.items())
        cut = 0
        if slack:
            spare = [n for n in counts if n > slack and counts[n] > need.get(n, 0)]
            if not spare:  # nothing is left: what would fit has been taken
                break
            cut = min(spare)
            k = min(k, counts[cut] // (need.get(cut, 0) + 1))
        offset = 0
        for n, m in sorted(need.items(), reverse=True):
            for _ in range(m):
                take(n, k, n, offset)
                offset += n
        if cut:
            take(cut, k, slack, offset)
        base += k
    if counts:  # less than one window in all: sequences of its powers of two
        left = sum(n * c for n, c in counts.items())
        sizes = [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
        room, offset = sizes.pop(0), 0
        for n in sorted(counts, reverse=True):
            for length, lo, hi, start in pool[n]:
                for rank in range(lo, hi):
                    done = 0
                    while done < n:
                        size = min(room - offset, n - done)
                        records.append((length, rank, rank + 1, start + done, size, base, offset))
                        done, offset = done + size, offset + size
                        if offset == room:
                            base, offset, room = base + 1, 0, sizes.pop(0) if sizes else 0
    return records, base


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_documents(df: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str, memo: int) -> DataFrame:
    """Per row: its task, the full windows and the remainders of its length before it there, its tokens, checksums and remainder."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path, memo=memo), TaskContext.get().partitionId(), 0
        seen = [0] * window
        for b in batches:
            nths, befores, tokens, fulls, tails, sizes = [], [], [], [], [], []
            for ids in encode(b.column("text")):
                ids = np.append(ids, ids.dtype.type(end_id))
                n = len(ids) // window
                size = len(ids) - n * window
                nths.append(seen[size])
                seen[size] += 1
                befores.append(before)
                tokens.append(len(ids))
                fulls.append([crc(ids[i * window : (i + 1) * window]) for i in range(n)])
                tails.append(ids[n * window :].astype("<u4").tobytes())
                sizes.append(size)
                before += n
            cols = [b.column("id"), pa.array(nths, pa.int64()), pa.array([part] * len(nths), pa.int32()), pa.array(befores, pa.int64()), pa.array(tokens, pa.int64()), pa.array(fulls, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.record_batch(cols, names=["id", "nth", "part", "full_before", "doc_tokens", "full_crcs", "tail", "tail_len"])

    narrow = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return arrow_map(narrow, run, f"id {kind}, nth long, part int, full_before long, doc_tokens long, full_crcs array<long>, tail binary, tail_len int")


def pack(df: DataFrame, path: str, end_id: int, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", memo: int = 500_000) -> DataFrame:
    """Pieces: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are encoded once and written to the shared folder. The driver sees the length histogram (window-1 rows)
    and one row for each task; the plan it sends out has a number of records that depends on the window alone. A
    remainder's rank among those of its length is its place in its task after those of the tasks before, so no group of
    a length is ever in one task. ``memo`` trades a worker's memory (some 150 MB at the default) for time.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = park(encode_documents(df, path, end_id, window, id_col, text_col, memo), "encoded")
    tails = docs.where("tail_len > 0")
    histogram = {r.tail_len: r.n for r in tails.groupBy("tail_len").agg(F.count("*").alias("n")).collect()}
    records, n_packed = plan(histogram, window)

    # Ranks within a length: how many the tasks before have, and the place in the own task.
    own = tails.groupBy("part", "tail_len").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tail_len").orderBy("part")) - F.col("n")
    firsts = own.select("part", "tail_len", before.alias("first"))
    ranked = tails.join(firsts, ["part", "tail_len"]).select("id", "doc_tokens", "tail", "tail_len", (F.col("first") + F.col("nth")).alias("rank"))
    by_length: dict[int, list] = defaultdict(list)
    for r in records:
        by_length[r[0]].append(r[1:])
    sent = spark.sparkContext.broadcast(dict(by_length))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = sent.value
        for b in batches:
            length = b.column("tail_len").to_numpy(zero_copy_only=False)
            ranks = b.column("rank").to_numpy(zero_copy_only=False)
            rows, out = [], []
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                at = at[np.argsort(ranks[at], kind="stable")]
                have = ranks[at]
                for lo, hi, start, size, sequence, offset in placed[int(n)]:
                    i, j = np.searchsorted(have, (lo, hi))
                    rows += at[i:j].tolist()
                    out += [(start, size, sequence + int(r) - lo, offset) for r in have[i:j]]
            tail, tokens = b.column("tail"), b.column("doc_tokens").to_numpy(zero_copy_only=False)
            sums = [zlib.crc32(tail[i].as_buffer()[s * 4 : (s + z) * 4]) for i, (s, z, _, _) in zip(rows, out)]
            fixed = [int(tokens[i] - length[i]) + s for i, (s, _, _, _) in zip(rows, out)]
            long = lambda v: pa.array(v, pa.int64())
            yield pa.record_batch([b.column("id").take(pa.array(rows, pa.int64())), long(fixed), long([o[1] for o in out]), long(sums), long(tokens[rows] if rows else []), long([o[2] for o in out]), long([o[3] for o in out])], names=names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    small = arrow_map(ranked, place, schema)

    # Full windows: numbered after the packed ones, task by task.
    runs = docs.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("n")).orderBy("part").collect()
    bases, base = [], n_packed
    for r in runs:
        bases.append((r.part, base))
        base += r.n
    first_of = spark.createDataFrame(bases, "part int, base long")
    full = docs.where(F.size("full_crcs") > 0).join(first_of, "part").select("id", "doc_tokens", "full_before", "base", F.posexplode("full_crcs").alias("i", "ids_crc32"))
    full = full.select("id", (F.col("i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("full_before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.unionByName(full).withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), P.path("byte_bpe_50k.json"), end_id=0, window=1024)


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
