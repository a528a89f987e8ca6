"""Routing, keyed views, bulk actions, outcome classes and rejects, as row-level plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import json_value, pointer_json


def bulk_actions(rows: DataFrame) -> DataFrame:
    """(op, index, doc_id, event_id, version, body) -> bulk action rows; a delete needs an id, an upsert falls back on
    its event's (K01); ``reject`` says why a row cannot be sent."""
    delete = F.col("op") == "delete"
    return rows.select(F.when(delete, "delete").otherwise("index").alias("action"), F.col("index").alias("_index"), F.when(delete, F.col("doc_id")).otherwise(F.coalesce("doc_id", "event_id")).alias("_id"), "version", F.when(~delete, F.col("body")).alias("body"), F.when(delete & F.col("doc_id").isNull(), "delete without id").alias("reject"))


def current_row(op: Column, new: Column, payload: Column) -> Column:
    """On update an object ``new`` is the document."""
    return F.when((op == "update") & new.isNotNull(), new).otherwise(payload)


def view_source(namespace: Column, relation: Column, source: tuple[str, str]) -> Column:
    """Whether a row is of a view's source table."""
    return (namespace == source[0]) & (relation == source[1])


def vector_distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance of two arrays of doubles by the metric of a vector index: cosine, euclidean, manhattan or dot."""
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    if metric == "cosine":
        return 1 - total(lambda x, y: x * y) / F.sqrt(norm(a) * norm(b))
    if metric == "euclidean":
        return F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return total(lambda x, y: F.abs(x - y))
    if metric == "dot":
        return -total(lambda x, y: x * y)
    raise ValueError(f"metric {metric!r}")


# Error types that pass by themselves, types of documents that never fit, and what the reason of an
# illegal argument says if it is a mapping conflict.
TRANSIENT = (
    "circuit_breaking_exception",
    "cluster_block_exception",
    "es_rejected_execution_exception",
    "master_not_discovered_exception",
    "node_not_connected_exception",
    "snapshot_in_progress_exception",
    "unavailable_shards_exception",
)
PERMANENT = ("document_parsing_exception", "mapper_parsing_exception", "strict_dynamic_mapping_exception")
CONFLICT = ("mapper", "cannot be changed", "different type")


def outcome(status: Column, kind: Column, action: Column, reason: Column | None = None) -> Column:
    """applied, transient, permanent or blocked (K04, K05). An illegal argument is permanent only as a mapping conflict."""
    transient = status.isin(408, 429) | (status >= 500) | kind.isin(*TRANSIENT)
    why = F.coalesce(F.lit(None).cast("string") if reason is None else reason, F.lit(""))
    conflict = (kind == "illegal_argument_exception") & reduce(Column.__or__, [F.contains(why, F.lit(x)) for x in CONFLICT])
    permanent = kind.isin(*PERMANENT) | conflict
    return F.when(status < 300, "applied").when(status == 409, "applied").when((action == "delete") & (status == 404), "applied").when(F.coalesce(transient, F.lit(False)), "transient").when(F.coalesce(permanent, F.lit(False)), "permanent").otherwise("blocked")


def backoff(attempt: int, initial: float = 0.1, factor: float = 2.0, most: float = 30.0) -> float:
    """Seconds before a retry."""
    return min(most, initial * factor**attempt)


def split_oversize(sizes: list[int], limit: int) -> tuple[list[list[int]], list[int]]:
    """Bisect a batch that is too large, left half first; a lone oversize item is permanent."""
    out, bad, todo = [], [], [list(range(len(sizes)))]
    while todo:
        part = todo.pop()
        if sum(sizes[i] for i in part) <= limit:
            out += [part] if part else []
        elif len(part) == 1:
            bad += part
        else:
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return out, bad


def view_filter(cond: dict, variant: str = "doc") -> Column:
    """all / any of {pointer, equals | not_equals | in | not_in | exists | not_exists}; a missing value passes not_equals
    and not_in (K18). JSON values are compared: 5 is not "5", true is a boolean, null is a value."""

    def one(c: dict) -> Column:
        value = pointer_json(variant, c["pointer"])
        among = lambda xs: reduce(Column.__or__, [value == json_value(x) for x in xs], F.lit(False))
        if "equals" in c:
            return F.coalesce(among([c["equals"]]), F.lit(False))
        if "not_equals" in c:
            return F.coalesce(~among([c["not_equals"]]), F.lit(True))
        if "in" in c:
            return F.coalesce(among(c["in"]), F.lit(False))
        if "not_in" in c:
            return F.coalesce(~among(c["not_in"]), F.lit(True))
        return value.isNotNull() if c.get("exists") else value.isNull()

    parts = [one(c) for c in cond.get("all", cond.get("any", []))]
    return reduce(Column.__and__ if "all" in cond else Column.__or__, parts) if parts else F.lit(True)


def view_moves(states: DataFrame, source: str, order: str, key: str) -> DataFrame:
    """Per source id one key a view: a changed or vanished key deletes the old one (K20). ``key`` is null where the
    filter fails or a pointer is unresolved."""
    w = Window.partitionBy(source).orderBy(order)
    before = F.col("_before")
    acts = F.array(F.when(before.isNotNull() & ~before.eqNullSafe(F.col(key)), F.struct(F.lit("delete").alias("action"), before.alias("view_key"))), F.when(F.col(key).isNotNull(), F.struct(F.lit("upsert").alias("action"), F.col(key).alias("view_key"))))
    return states.withColumn("_before", F.lag(key).over(w)).withColumn("_a", F.explode(F.array_compact(acts))).select(source, order, "_a.action", "_a.view_key")


def collisions(owned: DataFrame, key: str, source: str) -> DataFrame:
    """Keys claimed by several source ids."""
    return owned.groupBy(key).agg(F.countDistinct(source).alias("owners")).where("owners > 1")


def route(relation: Column, target: Column, fixed: str | None = None) -> Column:
    """Projection target, else output relation, else the fixed index; null is a reject."""
    return F.coalesce(target, relation, F.lit(fixed))


def reject_reason(doc_id: Column, body: Column, index: Column, most: int) -> Column:
    """Client-side rejects."""
    return F.when(index.isNull(), "missing target").when(doc_id.isNull(), "missing id").when(~F.coalesce(body.startswith("{"), F.lit(False)), "not an object").when(F.octet_length(body) > most, "oversize")


def view_digest(specs: list[dict]) -> str:
    """Order-independent digest of a view set."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(sorted(json.dumps(s, sort_keys=True) for s in specs)).encode()).hexdigest()


def expired(written: Column, ttl_s: int, now: Column) -> Column:
    return F.unix_timestamp(written) + ttl_s <= F.unix_timestamp(now)
