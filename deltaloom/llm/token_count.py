"""Token counts by byte-pair merging with a heap and a linked list.

The counter never makes an id: a pre-token starts as its byte symbols, the adjacent pair of lowest rank is popped
from a heap again and again and merged in a doubly linked list, and the count is the initial symbols less the merges.

Defined cases: null or empty text has 0 tokens; a special string inside a text is one token; any length is counted
whole; repeated rows are counted row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read, text_of
from .units import Units


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges; ties in rank go to the leftmost pair. O(n log n) for n symbols."""
    n = len(symbols)
    after = [*range(1, n), -1] if n else []
    before = list(range(-1, n - 1))
    sym: list[str | None] = list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if sym[i] == a else -1
        if j < 0 or sym[j] != b:
            continue  # one side has been merged meanwhile
        merges += 1
        sym[i], sym[j] = a + b, None
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((a + b, sym[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, sym[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((sym[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, sym[h], a + b))
    return n - merges


_counters: dict[str, Callable[[pa.Array], np.ndarray]] = {}


def counter(path: str, pattern: str) -> Callable[[pa.Array], np.ndarray]:
    """Texts -> number of tokens under a byte-level BPE file of the tokenizers library."""
    if path not in _counters:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        symbol, split = byte_symbols(), regex.compile(pattern)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        known: dict[str, int] = {}

        def solve(units: list[str]) -> list[int]:
            if len(known) > 500_000:
                known.clear()
            out = []
            for unit in units:
                n = 0
                for word in split.findall(unit):
                    if (k := known.get(word)) is None:
                        k = merged_length([symbol[b] for b in word.encode("utf-8", "replace")], ranks)
                        if len(word) < 64:
                            known[word] = k
                    n += k
                out.append(n)
            return out

        units = Units(solve)

        def count(texts: pa.Array) -> np.ndarray:
            out = units.sums(texts)
            if cut:
                for i in np.flatnonzero(pc.match_substring_regex(texts, "|".join(map(regex.escape, special))).to_numpy(zero_copy_only=False)):
                    parts = cut.split(texts[i].as_py())
                    out[i] = len(parts) - 1 + units.sums(pa.array(parts)).sum()
            return out

        _counters[path] = count
    return _counters[path]


def count_tokens(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_bytes, n_tokens. A scan without shuffle; a worker's memo is bounded."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for b in batches:
            n = pa.array(count(b.column("text")))
            yield pa.record_batch([b.column("id"), b.column("n_bytes"), n], names=["id", "n_bytes", "n_tokens"])

    narrow = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    narrow = narrow.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = arrow_map(narrow, run, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    counts = count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), P.path("byte_bpe_50k.json"), P.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
