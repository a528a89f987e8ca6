"""Orphans, the mass-delete guard and drift between a target and its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(target: DataFrame, live: DataFrame, key: str = "doc_id", prefix: str = "") -> DataFrame:
    """Target ids with the prefix that the source no longer has."""
    return target.where(F.col(key).startswith(prefix)).join(live.where(F.col(key).isNotNull()), key, "left_anti")


def guard(target: DataFrame, live: DataFrame, key: str = "doc_id", share: float = 0.5) -> DataFrame:
    """One row: counts and whether deletion is allowed: not with an empty live set, nor for more than ``share``."""
    t = target.agg(F.count("*").alias("n_target"))
    g = orphans(target, live, key).agg(F.count("*").alias("n_orphans"))
    n = live.where(F.col(key).isNotNull()).agg(F.count("*").alias("n_live"))
    return t.join(g).join(n).withColumn("allowed", (F.col("n_live") > 0) & (F.col("n_orphans") <= share * F.col("n_target")))


def drift(data: DataFrame, versions: DataFrame, key: str = "key") -> DataFrame:
    """Counts of keys in both sets, or only in one."""
    both = data.select(key, F.lit(1).alias("d")).join(versions.select(key, F.lit(1).alias("v")), key, "full")
    return both.agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("v").isNull(), 1)).alias("data_only"), F.count(F.when(F.col("d").isNull(), 1)).alias("version_only"))


def view_drift(values: DataFrame, manifests: DataFrame, owners: DataFrame, staging: DataFrame) -> DataFrame:
    """One row of counts over a target of keyed views (K26). ``values``: key; ``manifests``: source, key (null: the
    manifest is incomplete), what each source id claims; ``owners``: key, source, who a key says it belongs to;
    ``staging``: key, what an unfinished write has left."""
    claims = manifests.where("key is not null").select("key", F.col("source").alias("claim"))
    own = owners.select("key", F.col("source").alias("owner"))
    have = values.select("key", F.lit(1).alias("value"))
    claimed = claims.join(have, "key", "left").join(own, "key", "left")
    one = claimed.agg(F.count(F.when(F.col("value").isNull(), 1)).alias("missing_values"), F.count(F.when(F.col("owner").isNull(), 1)).alias("missing_owners"), F.count(F.when(F.col("owner") != F.col("claim"), 1)).alias("owner_mismatches"))
    count = lambda df, name: df.agg(F.count("*").alias(name)).scalar().alias(name)
    return one.select("*", count(own.join(claims, "key", "left_anti"), "orphan_owners"), count(have.join(own, "key", "left_anti"), "unowned_values"), count(manifests.where("key is null").select("source").distinct(), "incomplete_manifests"), count(staging, "staging_keys"))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(col, type) lists: added, dropped, type_change."""
    j = old.select("col", F.col("type").alias("old_type")).join(new.select("col", F.col("type").alias("new_type")), "col", "full")
    kind = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "dropped").when(F.col("old_type") != F.col("new_type"), "type_change")
    return j.withColumn("kind", kind).where("kind is not null")
