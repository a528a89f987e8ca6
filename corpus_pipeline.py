"""From documents to packed training sequences: quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``docs``. Null and empty texts, repeated rows, null ids, ties, very long texts, empty tables and further columns are
handled as the stages' operators define; columns that a stage does not need go through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import line_dedup, near_dedup, packing, quality
from deltaloom.llm.common import park, shared_path, text_of


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 go. The machine learns from the labels of the table's documents."""
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.learn(docs, labelled)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    scored = quality.score(docs, model, keep=rest)
    return scored.where(scored[scored.columns[-1]] >= 0.7).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay only where they occur first; n_chars follows the text."""
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1, keep_first=True))
    text = F.col("__dl_text")
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, out[c]).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 one stays: that of the smallest id (nulls last, then of
    the least text hash). Rows are told apart by id and text, so no other text of an id goes; of repeated rows one stays,
    but rows without an id and without words are linked with nothing and all stay."""
    found = park(near_dedup.near_duplicates(docs, percent=80), "found")
    row = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    first = found.where("component is not null").groupBy("component").agg(F.min(row).alias("first"))
    gone = found.join(first, "component").where(~row.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = lambda other: docs["doc_id"].cast("long").eqNullSafe(other["__id"]) & (F.xxhash64(text_of("text")) == other["__hash"])
    gone = park(gone.distinct(), "gone")
    left = docs.join(gone, same(gone), "left_anti")
    repeated = found.where("doc_id is not null or n_shingles > 0").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("n")).where("n > 1")
    again = park(repeated.select("__id", "__hash"), "again")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(again, same(again), "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(again, same(again), "left_anti").select(*docs.columns).unionByName(once)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    import public_tokenizers as P

    return packing.pack(docs, P.path("byte_bpe_50k.json"), end_id=0, window=1024, memo=150_000)  # workers still hold what earlier stages used


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("packing", pack_stage)]

#: Tokenisers and a fitted model are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
