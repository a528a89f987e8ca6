"""SimHash document fingerprints with DataFrame functions only.

Terms are pairs of neighbouring words (lower-cased ASCII; the last word stands alone), weighted by how often they
occur: every occurrence casts one vote. A term has 128 hash bits; a fingerprint bit is set if more than half of the
votes on it are set. Votes are summed four bits at a time in 16-bit lanes of a long, in chunks of at most 32,767
terms, so that no lane overflows, and the chunks' lanes are added afterwards. No term is dropped, whatever a text's
length.

``near_hits`` finds all fingerprints within a Hamming radius of stated queries by permuted block tables: the 128 bits
are cut into radius+1 blocks; two fingerprints within the radius agree on one block at least, so each block in turn
leads a table, which is joined on it and verified on all bits.

Defined cases: null and empty texts (and texts of white space) have the fingerprint of no votes, all zero; equal texts
have equal fingerprints; repeated rows are fingerprinted each; a null id orders last; rows that share an id follow each
other in the order of their texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, park, read, text_of, wide

LANES = 0x0001000100010001
CHUNK = 32_767
BITS = 128
#: Hamming radius of the query's search, and fingerprints of one block value that are compared in one expression.
RADIUS, GROUP = 3, 1024


def terms(text: Column) -> Column:
    """Array of structs (0: word, 1: next word or null) of a text."""
    words = F.filter(F.split(ascii_lower(text), f"{SPACE}+"), lambda w: w != "")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def votes(df: DataFrame, keys: list[str], texts: Column) -> DataFrame:
    """Fingerprints of an array of texts per row: ``keys``, tag (position of the text), hi, lo.

    ``keys`` must tell rows apart; if the input is already clustered by a subset of them, nothing is exchanged.
    """
    tagged = df.select(*keys, F.posexplode(texts).alias("tag", "_text"))
    exploded = tagged.select(*keys, "tag", F.posexplode_outer(terms(F.col("_text"))).alias("_i", "_t"))
    voice = F.col("_t").isNotNull()
    hashed = exploded.select(*keys, "tag", F.floor(F.coalesce("_i", F.lit(0)) / CHUNK).alias("_chunk"), voice.cast("long").alias("_n"), F.when(voice, F.xxhash64(F.col("_t.a"), F.col("_t.b"))).otherwise(0).alias("_h"), F.when(voice, F.xxhash64(F.lit(7), F.col("_t.a"), F.col("_t.b"))).otherwise(0).alias("_l"))
    sums = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(LANES)).alias(f"{h}{k}") for h in ("_h", "_l") for k in range(16)]
    lanes = hashed.groupBy(*keys, "tag", "_chunk").agg(F.sum("_n").alias("_n"), *sums)
    split = [F.sum(F.shiftrightunsigned(f"{h}{k}", 16 * j).bitwiseAND(0xFFFF)).alias(f"{h}{k + 16 * j}") for h in ("_h", "_l") for k in range(16) for j in range(4)]
    total = lanes.groupBy(*keys, "tag").agg(F.sum("_n").alias("_n"), *split)

    def word(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(64):
            value = (1 << i) - (1 << 64 if i == 63 else 0)
            out = out.bitwiseOR(F.when(2 * F.col(f"{h}{i}") > F.col("_n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return total.select(*keys, "tag", word("_h").alias("hi"), word("_l").alias("lo"))


def as_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def likeness(d: Column) -> Column:
    return 1 - d / F.lit(float(BITS))


def fingerprints(df: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """``key_col`` (unique), hi, lo."""
    return votes(df, [key_col], F.array(text_of(text_col))).drop("tag")


def blocks_of(prints: DataFrame, radius: int) -> DataFrame:
    """(table, x, y, hi, lo): each distinct fingerprint under each of its radius+1 blocks, the other bits masked away."""
    masks = block_masks(radius)
    tables = [F.struct(F.lit(i).alias("table"), F.col("hi").bitwiseAND(F.lit(hi)).alias("x"), F.col("lo").bitwiseAND(F.lit(lo)).alias("y")) for i, (hi, lo) in enumerate(masks)]
    return prints.select("hi", "lo").distinct().select("hi", "lo", F.explode(F.array(*tables)).alias("t")).select("t.*", "hi", "lo")


def block_masks(radius: int) -> list[tuple[int, int]]:
    """(mask of hi, mask of lo) of each of the radius+1 blocks, as signed longs."""
    cuts = [i * BITS // (radius + 1) for i in range(radius + 2)]

    def mask(lo: int, hi: int) -> int:
        m = sum(1 << i for i in range(max(lo, 0), min(hi, 64)))
        return m - (1 << 64) if m >> 63 else m

    return [(mask(a - 64, b - 64), mask(a, b)) for a, b in zip(cuts, cuts[1:])]


def near_hits(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(q_hi, q_lo, hits): other fingerprints of ``prints`` within ``radius`` bits of a query, in lists of bounded length.

    Only block values that a query has are looked at. The fingerprints under one value are dealt to groups of about
    GROUP, so a value that a third of all fingerprints share is many small groups; a query is compared with a group
    inside one expression, and nothing but its hits leaves it. A pair that agrees on several blocks counts in the first.
    """
    key = ["table", "x", "y"]
    asked = blocks_of(queries, radius).select(*key, F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"))
    there = blocks_of(prints, radius).join(asked.select(*key).distinct(), key, "left_semi")
    sized = there.join(there.groupBy(*key).agg(F.count("*").alias("n")), key)
    salt = F.pmod(F.xxhash64("hi", "lo"), F.ceil(F.col("n") / GROUP).cast("long"))
    groups = sized.groupBy(*key, salt.alias("salt")).agg(F.collect_list(F.struct("hi", "lo")).alias("members"))
    met = asked.join(groups, key)

    def hit(m: Column) -> Column:
        hi, lo = m["hi"].bitwiseXOR(F.col("q_hi")), m["lo"].bitwiseXOR(F.col("q_lo"))
        d = F.bit_count(hi) + F.bit_count(lo)
        later = F.lit(False)
        for i, (x, y) in enumerate(block_masks(radius)[:-1]):
            later = later | ((F.col("table") > i) & (hi.bitwiseAND(F.lit(x)) == 0) & (lo.bitwiseAND(F.lit(y)) == 0))
        return (d <= radius) & (d > 0) & ~later

    return met.select("q_hi", "q_lo", F.filter("members", hit).alias("hits")).where(F.size("hits") > 0)


def near_fingerprints(prints: DataFrame, radius: int, queries: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a_hi, a_lo) of ``queries`` and (b_hi, b_lo) of ``prints`` within ``radius`` bits, with distance.

    Equal fingerprints are one; membership is the caller's join on (hi, lo). Without ``queries`` each unordered pair
    of ``prints`` is given once; that output is as large as the links are many.
    """
    pairs = near_hits(prints, prints if queries is None else queries, radius).select(F.col("q_hi").alias("a_hi"), F.col("q_lo").alias("a_lo"), F.explode("hits").alias("b"))
    pairs = pairs.select("a_hi", "a_lo", F.col("b.hi").alias("b_hi"), F.col("b.lo").alias("b_lo"))
    if queries is None:
        pairs = pairs.where("a_hi < b_hi or (a_hi = b_hi and a_lo < b_lo)")
    return pairs.withColumn("distance", distance(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo")))


def near_counts(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(hi, lo, n_near) of the distinct fingerprints of ``queries`` that have another one within ``radius`` in ``prints``."""
    hits = near_hits(prints, queries, radius)
    return hits.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum(F.size("hits")).cast("long").alias("n_near"))


def range_limits(df: DataFrame, id_col: str, ranges: int) -> DataFrame:
    """One row, cuts: the largest id of each of about ``ranges`` ranges of the non-null ids, ascending. Only ids are exchanged."""
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null").repartitionByRange(ranges, "id")
    tops = ids.groupBy(F.spark_partition_id().alias("range")).agg(F.max("id").alias("top"))
    return tops.agg(F.sort_array(F.collect_list("top")).alias("cuts"))


def with_next(df: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """Rows in descending id as (bucket, rn, is_copy, id, text, next_text), the row after the last being the first.

    The text is exchanged once, by ranges of the id. A range ends with an id that is in the table, so the row that
    comes first in a range is known without looking for it; it is also dealt to the range before, which is how that
    range's last row sees it. The limits are one array, a scalar subquery's result, searched by halving: neither the
    driver's code nor the plan's expressions grow with the number of ranges.
    """
    cuts = range_limits(df, id_col, ranges).scalar()
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("cuts", cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, ranges).bit_length() + 1))])
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.col("cuts"), n + step - 1) < F.col("id"), n + step).otherwise(n))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), 0).otherwise(below))  # null ids follow the smallest
    rows = rows.withColumn("last", F.size("cuts") - 1).withColumn("head", (F.col("last") < 0) | F.coalesce(F.col("id") == F.get("cuts", F.col("bucket")), F.lit(False)))
    before = F.when(F.col("head"), F.when(F.col("bucket") < F.col("last"), F.col("bucket") + 1).otherwise(0))
    own = F.struct(F.col("bucket"), F.lit(False).alias("is_copy"))
    copy = F.struct(before.alias("bucket"), F.lit(True).alias("is_copy"))
    dealt = rows.select("id", "text", F.explode(F.filter(F.array(own, copy), lambda s: s["bucket"].isNotNull())).alias("d"))
    dealt = dealt.select("d.bucket", "d.is_copy", "id", "text").repartition(wide(df.sparkSession), "bucket")
    w = Window.partitionBy("bucket").orderBy("is_copy", F.col("id").desc_nulls_last(), "text")
    return dealt.select("bucket", "is_copy", "id", "text", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next_text"))


def edited(text: Column, next_text: Column, half: Column) -> Column:
    return F.concat(F.left(text, F.char_length(text) - half), F.left(next_text, half))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and n_near: for ids divisible by 100 the other distinct fingerprints within RADIUS bits, else null."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    ordered = with_next(docs, "doc_id", "text", 4 * wide(spark))
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = ordered.withColumn("edited", F.when(F.col("next_text").isNotNull(), edited(F.col("text"), F.col("next_text"), half)))
    facts = F.struct(F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    keyed = rows.select("bucket", "rn", "is_copy", "id", facts.alias("facts"), F.array("text", F.coalesce("edited", F.lit(""))).alias("texts"))
    tags = votes(keyed, ["bucket", "rn", "is_copy", "id", "facts"], F.col("texts"))
    own = lambda t, c: F.max(F.when(F.col("tag") == t, F.col(c)))
    prints = tags.groupBy("bucket", "rn", "is_copy", "id", "facts").agg(own(0, "hi").alias("hi"), own(0, "lo").alias("lo"), own(1, "hi").alias("e_hi"), own(1, "lo").alias("e_lo"))
    w = Window.partitionBy("bucket").orderBy("rn")
    c = F.col
    both = prints.select("*", F.lead("hi").over(w).alias("n_hi"), F.lead("lo").over(w).alias("n_lo")).where("not is_copy")
    both = park(both.select(c("id").alias("doc_id"), "facts.n_chars", "facts.edited_sha256", "hi", "lo", likeness(distance(c("hi"), c("lo"), c("e_hi"), c("e_lo"))).alias("near_edited"), likeness(distance(c("hi"), c("lo"), c("n_hi"), c("n_lo"))).alias("near_next"), as_text(c("e_hi"), c("e_lo")).alias("edited_fingerprint")), "fingerprints")
    asked = both.where("doc_id % 100 = 0")  # the stated queries of a search
    near = near_counts(both, asked, RADIUS).withColumnsRenamed({"hi": "q_hi", "lo": "q_lo"})
    found = asked.join(near, (c("hi") == c("q_hi")) & (c("lo") == c("q_lo")), "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    all_ = both.where("doc_id is null or doc_id % 100 <> 0").withColumn("n_near", F.lit(None).cast("long"))
    names = ("doc_id", "n_chars", "edited_sha256", as_text(c("hi"), c("lo")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "n_near")
    return found.select(*names).unionByName(all_.select(*names))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
