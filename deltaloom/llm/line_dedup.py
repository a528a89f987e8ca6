"""Line dedup with DataFrame functions only.

A row's lines become key hashes in place. Every line goes as (hash, document, position) to range partitions of
(hash, document), sorted by position within them; because the range key ends in the document, a key that a third of all
lines share is spread over many partitions. The sorted stream gives the first line of each key in each document; these
are pre-aggregated in their partition to the key's first occurrence and number of documents before the small exchange
by hash. Keys found in enough documents go back to the lines they touch, and each row gets a compressed bitmap of the
lines it keeps; text is neither shuffled nor returned by the operator. All work on a row is linear in its lines.

A bitmap is hexadecimal: bit i of the line string, padded to whole bytes, then run-length coded as
``count`` x ``0|1`` runs joined by commas (an all-kept row is one run), see ``keep_bitmap``.

Defined cases: null or empty text is one empty line; lines whose key is shorter than ``min_chars`` are always kept;
repeated rows are one document if their id is equal (a null id is an id of its own); ties have no effect, as all lines
of a key fare alike; very long texts are handled whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, park, read, text_of, wide


def lines_of(text: Column) -> Column:
    """Pieces between line feeds; empty text is one empty line. Both flags keep trailing empty lines."""
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\v\f\r")))


def key_hash(key: Column) -> Column:
    """128 bits: two chained 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(0x5EED), key).alias("b"))


def keep_bitmap(bits: Column) -> Column:
    """A string of 0 and 1 by line, as runs: '110' -> '2x1,1x0'."""
    runs = F.regexp_extract_all(bits, F.lit("(0+|1+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.lit("x"), F.substring(r, 1, 1))), ",")


def bitmap_bits(runs: Column) -> Column:
    """The inverse of ``keep_bitmap``: an array of booleans by line."""
    return F.flatten(F.transform(F.split(runs, ","), lambda r: F.array_repeat(F.element_at(F.split(r, "x"), 2) == "1", F.element_at(F.split(r, "x"), 1).cast("int"))))


def hashed_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, text_hash (tells rows of one id apart) and keys: the hash of each line, null where the key is too short."""
    text = text_of(text_col)
    keys = F.transform(F.transform(lines_of(text), line_key), lambda k: F.when(F.char_length(k) >= min_chars, key_hash(k)))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), keys.alias("keys"))


def lines_with_keys(rows: DataFrame) -> DataFrame:
    """id, text_hash, pos (from 0), a, b: one row for each line that has a key."""
    lines = rows.select("id", "text_hash", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    return lines.select("id", "text_hash", "pos", "key.a", "key.b")


def line_stats(lines: DataFrame) -> DataFrame:
    """a, b, n_docs, first_id, first_pos over all lines, by the sorted stream described above."""
    ranged = lines.select("a", "b", "id", "pos").repartitionByRange(wide(lines.sparkSession), "a", "b", "id")
    order = Window.partitionBy("a", "b", "id").orderBy("pos")  # the ranges already cluster it
    firsts = ranged.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    first = F.min(F.struct(F.col("id").alias("first_id"), F.col("pos").alias("first_pos"))).alias("first")
    return firsts.groupBy("a", "b").agg(F.count("*").alias("n_docs"), first).select("a", "b", "n_docs", "first.first_id", "first.first_pos")


def keep_bitmaps(df: DataFrame, min_docs: int, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """Distinct (``id_col``, text_hash) with n_lines, n_dropped, keep. ``keep_first``: the first occurrence of a key stays."""
    rows = park(hashed_rows(df, id_col, text_col, min_chars), "lines")
    lines = lines_with_keys(rows)
    often = park(line_stats(lines).where(F.col("n_docs") >= min_docs), "keys")
    touched = lines.join(often.drop("n_docs"), ["a", "b"])
    if keep_first:
        touched = touched.where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))))
    gone = touched.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    base = rows.select("id", "text_hash", F.size("keys").cast("long").alias("n_lines")).dropDuplicates(["id", "text_hash"])
    out = base.join(gone, base["id"].eqNullSafe(gone["id"]) & (base["text_hash"] == gone["text_hash"]), "left").select(base["id"], base["text_hash"], "n_lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # Before each dropped line the kept ones since the last dropped one; after the last, the rest.
    before = lambda p, i: F.concat(F.repeat(F.lit("1"), p - 1 - F.coalesce(F.get("gone", i - 1), F.lit(-1))), F.lit("0"))
    rest = F.col("n_lines") - 1 - F.coalesce(F.get("gone", F.size("gone") - 1), F.lit(-1))
    bits = F.concat(F.array_join(F.transform("gone", before), ""), F.repeat(F.lit("1"), rest.cast("int")))
    return out.select(F.col("id").alias(id_col), "text_hash", "n_lines", F.size("gone").cast("long").alias("n_dropped"), keep_bitmap(bits).alias("keep"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with __dl_text (null text stays null), __dl_lines and __dl_gone; one exchange of the text."""
    maps = bitmaps.where("n_dropped > 0").select(F.col(id_col).alias("__dl_id"), F.col("text_hash").alias("__dl_hash"), F.col("n_dropped").alias("__dl_dropped"), F.col("keep").alias("__dl_keep"))
    joined = df.join(maps, df[id_col].eqNullSafe(F.col("__dl_id")) & (F.xxhash64(text_of(text_col)) == F.col("__dl_hash")), "left")
    lines = lines_of(text_of(text_col))
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("l"), bitmap_bits(F.col("__dl_keep")).alias("k")), lambda x: x["k"]), lambda x: x["l"]), "\n")
    return joined.select(*[df[c] for c in df.columns], F.when(F.col("__dl_keep").isNull(), df[text_col]).otherwise(kept).alias("__dl_text"), F.size(lines).cast("long").alias("__dl_lines"), F.coalesce("__dl_dropped", F.lit(0).cast("long")).alias("__dl_gone"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    kept = F.sha2(F.encode(F.coalesce("__dl_text", F.lit("")), "UTF-8"), 256)
    return out.select("doc_id", F.col("__dl_lines").alias("n_lines"), F.col("__dl_gone").alias("n_dropped"), kept.alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE f.key IS NOT NULL))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY doc_id
"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE_SQL = {"op5_line_dedup": SQL}
