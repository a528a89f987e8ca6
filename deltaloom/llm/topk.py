"""Exact top-k inner products, norm-sorted.

Vectors become integers, sorted by descending length into blocks, which are files in the shared folder; an SVD of their
second moments (d x d, summed over all rows) gives a rotation that puts most of a product into its first coordinates. A
task takes one block of queries through a stripe of blocks in descending length. What it already holds for a query is a
threshold: by Cauchy-Schwarz the rest of the stripe is left unread when |longest query| |c| lies below all thresholds, a
chunk when |q| |c| does, and a pair when its partial product plus |q rest| |c rest| does. Survivors are scored with
whole integers, so the result is exact; ties at the threshold always survive.

Stripes do not know of each other. So the SEED longest vectors are offered to all queries first; the k-th score found
there is a lower bound of a query's k-th score overall, and each stripe starts from it: it scores and returns little
more than what can be in the result, instead of k rows a query.

Queries are a stated set; they meet all rows in blocks, but only the names of the blocks' files are joined and moved,
by stripe. Memory of a task: one block of queries and one of candidates. The driver holds SEED vectors and d x d sums,
at every size of the input.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate; a row
is not its own query's candidate (rows that share an id count as one row's); ties go to the smaller id; vectors of
different length are padded with zeros; with fewer candidates than k all are returned; an empty table gives an empty
result; further columns are ignored. Scores must fit 63 bits.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, park, read, shared_path, wide

BLOCK, QUERY_BLOCK, CHUNK, LEAD, SEED = 4096, 4096, 512, 16, 2048


def integers(c: Column) -> Column:
    """floor(64 x) by component; null where the vector takes no part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(c.isNotNull() & ~F.exists(c, odd), F.transform(c, lambda x: F.floor(x.cast("double") * 64)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as integer rows of ``dim``, padded with zeros."""
    out = np.zeros((len(column), dim), np.int64)
    off = column.offsets.to_numpy().astype(np.int64)
    n, flat = np.diff(off), column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal columns, those of the largest second moment first; dim^2 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = matrix(b.column("v"), dim).astype(np.float64)
            total += m.T @ m
        yield pa.record_batch([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = arrow_map(vectors.select("v"), run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    moments = np.zeros((dim, dim))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        moments[r.i, r.j] = r.x
    u, _, _ = np.linalg.svd(moments)
    return u


def blocks(vectors: DataFrame, dim: int, size: int, folder: str) -> DataFrame:
    """(part, nth, longest, path): files of at most ``size`` vectors in the partitions' order, in the smallest type that holds them.

    Names are unique to a task attempt, so a repeated task never touches what another wrote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, ids, rows, held = TaskContext.get().partitionId(), 0, [], [], 0

        def written() -> pa.RecordBatch:
            i, m = np.concatenate(ids)[:size], np.concatenate(rows)[:size]
            far = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max()))
            kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(m, dtype=np.float64).max(initial=0) <= np.iinfo(k).max)
            path = f"{folder}/{part:08d}-{nth:06d}-{uuid.uuid4().hex}.block"
            save(path, ids=i, vectors=m.astype(kind))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([far]), pa.array([path])], names=["part", "nth", "longest", "path"])

        for b in batches:
            ids.append(b.column("id").to_numpy(zero_copy_only=False))
            rows.append(matrix(b.column("v"), dim))
            held += len(b)
            while held >= size:
                yield written()
                nth, held = nth + 1, held - size
                ids, rows = [np.concatenate(ids)[size:]], [np.concatenate(rows)[size:]]
        if held:
            yield written()

    return arrow_map(vectors.select("id", "v"), run, "part int, nth int, longest double, path string")


def save(path: str, **arrays: np.ndarray) -> None:
    store, file = fs.FileSystem.from_uri(path)
    store.create_dir(file.rpartition("/")[0], recursive=True)
    with store.open_output_stream(file) as out:
        np.savez(out, **arrays)


def load(path: str) -> dict[str, np.ndarray]:
    store, file = fs.FileSystem.from_uri(path)
    with store.open_input_file(file) as source:
        return dict(np.load(io.BytesIO(source.read())))


class Best:
    """The k best (score descending, id ascending) of each query so far."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.n = k, n
        self.q, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min) if least is None else least.copy()

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[order][keep], ids[order][keep]
        last = rank[keep] == self.k - 1
        self.least[self.q[last]] = np.maximum(self.least[self.q[last]], self.score[last])


def search(best: Best, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray) -> None:
    """Offer a block of candidates, in descending length, to all queries."""
    lead = min(LEAD, q.shape[1])
    fq = q.astype(np.float64)
    tq, q_len = fq @ turn, np.sqrt((fq**2).sum(axis=1))
    q_rest = np.sqrt((tq[:, lead:] ** 2).sum(axis=1))
    for i in range(0, len(c), CHUNK):
        cc, ids = c[i : i + CHUNK], c_ids[i : i + CHUNK]
        fc = cc.astype(np.float64)
        c_len = np.sqrt((fc**2).sum(axis=1))
        slack = 1e-9 * (q_len * c_len.max() + 1)
        live = np.flatnonzero(q_len * c_len.max() + slack >= best.least)
        if not len(live):
            continue
        tc = fc @ turn
        c_rest = np.sqrt((tc[:, lead:] ** 2).sum(axis=1))
        bound = tq[live, :lead] @ tc[:, :lead].T + np.outer(q_rest[live], c_rest)
        a, b = np.nonzero(bound + slack[live, None] >= best.least[live, None])
        own = q_ids[live[a]] != ids[b]
        a, b = a[own], b[own]
        exact = q_len.max() * c_len.max() < 2**52
        if len(a) * 4 > len(live) * len(ids):
            all_ = fq[live] @ fc.T if exact else q[live] @ cc.T
            score = all_[a, b].astype(np.int64)
        else:
            score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q[live[a[j : j + 65536]]], cc[b[j : j + 65536]]) for j in range(0, len(a), 65536))])
        good = score >= best.least[live[a]]
        best.add(live[a[good]], score[good], ids[b[good]])


def bounded(asked: DataFrame, seed_ids: np.ndarray, seeds: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """Blocks of queries with ``least``: for each query the k-th score among the seeds (the least integer if fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                block = load(path)
                best = Best(len(block["ids"]), k)
                search(best, block["ids"], block["vectors"].astype(np.int64), seed_ids, seeds, turn)
                name = f"{path}.{uuid.uuid4().hex}.least"
                save(name, least=best.least)
                yield pa.record_batch([b.column("part").slice(i, 1), b.column("nth").slice(i, 1), b.column("path").slice(i, 1), pa.array([name])], names=["part", "nth", "path", "least"])

    return arrow_map(asked.select("part", "nth", "path"), run, "part int, nth int, path string, least string")


def top_k(df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the rows where ``is_query`` (over column id) holds against all rows."""
    spark = df.sparkSession
    some = df.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    vectors = park(some.withColumn("norm2", length), "vectors")
    n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n or not dim:
        return spark.createDataFrame([], empty)
    turn = rotation(vectors, dim)
    ordered = vectors.repartitionByRange(max(1, -(-n // BLOCK)), F.col("norm2").desc(), "id").sortWithinPartitions(F.col("norm2").desc(), "id")
    candidates = park(blocks(ordered, dim, BLOCK, shared_path(spark, "blocks")), "candidates")
    first = vectors.orderBy(F.col("norm2").desc(), "id").limit(SEED).select("id", "v").toArrow().combine_chunks()
    seed_ids, seeds = first.column("id").to_numpy(), np.concatenate([matrix(c, dim) for c in first.column("v").chunks])
    asked = park(blocks(vectors.where(is_query).repartition(max(1, -(-n // (8 * QUERY_BLOCK)))), dim, QUERY_BLOCK, shared_path(spark, "queries")), "asked")
    asked = park(bounded(asked, seed_ids, seeds, turn, k), "queries")
    # Stripes take every m-th partition of the order, so each begins with long vectors. Every block of the stated
    # queries meets every stripe: by name, as an equi-join.
    stripes = wide(spark)
    mine = candidates.groupBy((F.col("part") % stripes).alias("stripe")).agg(F.sort_array(F.collect_list(F.struct("longest", "path")), asc=False).alias("blocks"))
    turns = asked.select("path", "least", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    work = turns.join(mine, "stripe").select("path", "least", F.col("blocks.longest").alias("longest"), F.col("blocks.path").alias("names")).repartition(wide(spark), "path", F.col("names")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, least, longest, names in zip(*(b.column(c).to_pylist() for c in ("path", "least", "longest", "names")), strict=True):
                block = load(path)
                q_ids, q = block["ids"], block["vectors"].astype(np.int64)
                best = Best(len(q_ids), k, load(least)["least"])
                q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                for far, name in zip(longest, names, strict=True):
                    if (q_len * far * (1 + 1e-9) + 1e-9 < best.least).all():
                        break  # all that follows is shorter still
                    c = load(name)
                    search(best, q_ids, q, c["ids"], c["vectors"].astype(np.int64), turn)
                if len(best.q):
                    yield pa.record_batch([pa.array(q_ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    parts = arrow_map(work, run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=20, is_query=F.col("id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op4_top_k": op4_top_k}
ORACLE_SQL = {"op4_top_k": SQL}
