"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (the text's size).

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), linear in the features.
It is fitted on the driver to a sample of at most ``sample_rows`` labelled rows (the bound is a parameter; the sample
is those of smallest id hash), and scores whole texts in one scan with the model of fixed size sent along.

Defined cases: null or empty text has no words and its own statistics, and gets a score; null labels are not learnt;
repeated rows are scored each (of the texts of one id the least is learnt); with no usable label every score is 0.5; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read, text_of
from .units import slices

BUCKETS, SIZES, SAMPLE_ROWS, RANK, ROWS = 2048, 24, 6000, 8, 1024
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32], "feed": [10], "stop": [46, 63], "bang": [33], "comma": [44, 59, 58], "mark": [*range(35, 39), 42, 43, 60, 61, 62, 64, 94, 95, 96, 126], "bar": [124], "brace": [40, 41, 91, 93, 123, 125], "quote": [34, 39], "dash": [45, 47, 92], "high": range(128, 256)}
_CLASS_OF = np.zeros((256, len(_CLASSES)), np.float64)
for _j, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes), _j] = 1
WORD_STATS = ("length", "square", "upper", "title", "alpha", "tail", "short", "digit", "one")
STATS = len(_CLASSES) + len(WORD_STATS) + 12
FEATURES = BUCKETS + STATS + SIZES


def _word(w: str) -> tuple[float, ...]:
    n = len(w)
    core = w.rstrip(".,;:!?\"')")
    return (min(n, 64), min(n, 64) ** 2, w.isupper() and n > 1, w.istitle(), core.isalpha(), not w[-1].isalnum() and w[-1] not in ".,;:?\"')", n <= 3, any(c.isdigit() for c in w), n == 1)


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of FEATURES float32 values, ROWS rows at a time: sqrt term frequencies by hashed word, statistics, size class."""
    for s in slices(texts):
        flat = s.cast(pa.large_string())
        for space in "\t\n\v\f\r":
            flat = pc.replace_substring(flat, space, " ")
        parts = pc.split_pattern(flat, " ")
        begin = parts.offsets.to_numpy().astype(np.int64)
        begin = begin - begin[0]
        coded = parts.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if "" in words:
            keep = codes != words.index("")
            begin = np.concatenate([[0], np.cumsum(keep)])[begin]
            codes = codes[keep]
        traits = np.array([_word(w) if w else (0,) * len(WORD_STATS) for w in words], np.float64).reshape(-1, len(WORD_STATS))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in words), np.int64, len(words))
        raw = s.to_pylist()
        for lo in range(0, len(raw), ROWS):
            hi = min(lo + ROWS, len(raw))
            out = np.zeros((hi - lo, FEATURES), np.float32)
            for i in range(lo, hi):
                text, c = raw[i], codes[begin[i] : begin[i + 1]]
                data = np.frombuffer(text.encode(), np.uint8)
                n, size, row = len(c), max(1, len(data)), out[i - lo]
                if n:
                    tf = np.bincount(bucket[c], minlength=BUCKETS)
                    row[:BUCKETS] = np.sqrt(tf / n)
                lines = text.split("\n")
                at = BUCKETS
                row[at : at + len(_CLASSES)] = np.bincount(data, minlength=256) @ _CLASS_OF / size
                at += len(_CLASSES)
                row[at : at + len(WORD_STATS)] = traits[c].mean(axis=0) if n else 0
                row[at] /= 10
                row[at + 1] = np.sqrt(max(0, row[at + 1] - 100 * row[at] ** 2)) / 10
                at += len(WORD_STATS)
                distinct = len(np.unique(c)) if n else 0
                pairs = len(np.unique(c[:-1].astype(np.int64) * len(words) + c[1:])) if n > 1 else 0
                length = np.array([len(x) for x in lines], np.float64)
                ended = sum(x[-1:] in (".", "!", "?", '"') for x in lines)
                row[at : at + 12] = (
                    distinct / max(1, n), pairs / max(1, n - 1), np.log1p(n) / 10, np.log1p(size) / 10, np.log1p(len(lines)) / 10, len(set(lines)) / len(lines),
                    ended / len(lines), np.log1p(length.mean()) / 10, np.log1p(length.max()) / 10, np.log1p(length.std()) / 10, (length == 0).mean(), size / 10 / max(1, n) if n else 0,
                )
                row[BUCKETS + STATS + min(SIZES - 1, int(np.log2(size)))] = 1
            yield out


@dataclass
class Machine:
    """The fitted model; ``center`` and ``scale`` standardise the statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, BUCKETS : BUCKETS + STATS] = np.clip((x[:, BUCKETS : BUCKETS + STATS] - self.center) / self.scale, -4, 4) / 4
        return x

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((s**2).sum(axis=1) - (x**2) @ (self.v**2).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.prepared(x)).astype(np.float64), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Adam on the mean logistic loss with classes weighted alike."""
    rng = np.random.default_rng(seed)
    stats = x[:, BUCKETS : BUCKETS + STATS]
    zero = np.zeros(STATS, np.float32)
    m = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, rank)).astype(np.float32), stats.mean(axis=0) if len(x) else zero, stats.std(axis=0) + 1e-3 if len(x) else zero + 1)
    if not len(x):
        m.v[:] = 0
        return m
    x = m.prepared(x)
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    params = [np.zeros(1, np.float32), m.w, m.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            r = order[i : i + batch]
            xb = x[r]
            s = xb @ m.v
            z = params[0][0] + xb @ m.w + 0.5 * ((s**2).sum(axis=1) - (xb**2) @ (m.v**2).sum(axis=1))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r]) * weight[r] / len(r)).astype(np.float32)
            grads = [np.array([g.sum()]), xb.T @ g + decay * m.w, xb.T @ (g[:, None] * s) - m.v * ((xb**2).T @ g)[:, None] + decay * m.v]
            step += 1
            for p, d, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.w0 = float(params[0][0])
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on the labelled rows that are not held out: features come from the executors, sparse, at most ``sample_rows`` rows."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y"))
    sample = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by sample_rows
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))  # an id that is repeated counts once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, value = [], []
            for x in features(b.column("text")):
                for row in x:
                    at.append(np.flatnonzero(row).astype(np.int32))
                    value.append(row[at[-1]])
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["doc_id", "y", "at", "value"])

    got = sorted(arrow_map(rows, run, "doc_id long, y int, at array<int>, value array<float>").collect())
    x = np.zeros((len(got), FEATURES), np.float32)
    for i, r in enumerate(got):
        x[i, r.at] = r.value
    return fit(x, np.array([r.y for r in got], np.float32))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and score (_score if there is such a column) of every row: a scan without shuffle."""
    names = [id_col, *keep]
    fields = [docs.schema[c].dataType.simpleString() for c in names]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            s = np.concatenate([np.zeros(0), *(m.score(x) for x in features(pc.fill_null(b.column(at), "")))])
            yield pa.record_batch([*b.columns[: len(names)], pa.array(s)], names=[*(f"c{i}" for i in range(len(names))), "score"])

    # A text that is kept as it is goes to Python once.
    at = names.index(text_col) if text_col in names and docs.schema[text_col].dataType.simpleString() == "string" else len(names)
    wanted = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)), *([text_of(text_col).alias("text")] if at == len(names) else []))
    scored = arrow_map(wanted, run, ", ".join(f"c{i} {t}" for i, t in enumerate(fields)) + ", score double")
    return scored.toDF(*names, "score" if "score" not in names else "_score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, learn(docs, read(spark, sf_dir, "labels", "doc_id", "quality")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
