"""Subject patterns, fan-out, replay and retention of realtime events, as batch or streaming plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pattern_regex(pattern: str) -> str:
    """Literal segments, * for one segment, a final > for one or more."""
    parts = pattern.split(".")
    if any(p == "" or (p == ">" and i < len(parts) - 1) for i, p in enumerate(parts)):
        raise ValueError(f"bad pattern {pattern!r}")
    return r"\A" + r"\.".join("[^.]+" if p == "*" else ".+" if p == ">" else re.escape(p) for p in parts) + r"\z"


def regex_of(pattern: Column) -> Column:
    """The same for a column of valid patterns."""
    esc = F.regexp_replace(F.regexp_replace(pattern, r"[.]", r"\\."), r"[*]", "[^.]+")
    return F.concat(F.lit(r"\A"), F.regexp_replace(esc, ">$", ".+"), F.lit(r"\z"))


def anchored(tenant: Column, pattern: Column) -> Column:
    return F.concat(F.lit("rt.t."), tenant, F.lit("."), pattern)


def fan_out(events: DataFrame, subs: DataFrame) -> DataFrame:
    """events(event_id, tenant, subject), subs(connection, tenant, sub_id, pattern) -> one delivery an event and
    connection with its matched ids (T03).

    The tenant is an equi-join key, and so is the pattern's first literal segment after the tenant where it has one;
    only patterns that begin with a wildcard meet all events of their tenant. The regex runs within the key.
    """
    seg = F.get(F.split("subject", "[.]"), 3)
    keyed = subs.withColumn("_seg", F.get(F.split("pattern", "[.]"), 0)).withColumn("_re", regex_of(anchored(F.col("tenant"), F.col("pattern"))))
    e = events.select("event_id", "tenant", "subject", seg.alias("_seg"))
    wild = F.col("_seg").isin("*", ">")
    exact = e.join(keyed.where(~wild), ["tenant", "_seg"])
    any_ = e.drop("_seg").join(keyed.where(wild).drop("_seg"), "tenant")
    cols = ["event_id", "connection", "sub_id"]
    hits = exact.where(F.rlike(F.col("subject"), F.col("_re"))).select(*cols).unionByName(any_.where(F.rlike(F.col("subject"), F.col("_re"))).select(*cols))
    return hits.groupBy("event_id", "connection").agg(F.array_sort(F.collect_set("sub_id")).alias("sub_ids"))


def replay(events: DataFrame, after: int, cutoff: int, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(after, cutoff] from the store, then what follows the cutoff: no gap, no repetition."""
    return events.where((F.col(seq) > after) & (F.col(seq) <= cutoff)), events.where(F.col(seq) > cutoff)


def resume_state(after: Column, first: Column, last: Column, contiguous: bool = True) -> Column:
    """ahead, expired or ok (T06); ``contiguous``: a cursor one past the last is still ok."""
    return F.when(after > (last + 1 if contiguous else last), "ahead").when(after < (first - 1 if contiguous else first), "expired").otherwise("ok")


def retained(events: DataFrame, by: str, seq: str, most: int) -> DataFrame:
    """The last ``most`` events of each tenant."""
    w = Window.partitionBy(by).orderBy(F.col(seq).desc())
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def envelope_reject(e: dict[str, Column]) -> Column:
    """Why an envelope is refused, or null."""
    from ..functions.keys import valid_entity, valid_event, valid_tenant

    return F.when(F.coalesce(e["schema_version"] != 2, F.lit(True)), "version").when(~F.coalesce(valid_tenant(e["tenant"]), F.lit(False)), "tenant").when(~F.coalesce(valid_event(e["event"]), F.lit(False)), "event").when(~F.coalesce(valid_entity(e["entity_id"]), F.lit(False)), "entity_id")


def typed_response(fields: dict[str, str], data: str, typename: Column, seq: Column) -> list[Column]:
    """A subscription's result columns: each field by its source expression, the type's name and the cursor."""
    from ..functions.keys import source_expression

    return [*(source_expression(e, data, {}, {}).alias(f) for f, e in fields.items()), typename.alias("__typename"), F.concat(F.lit("js:"), seq.cast("string")).alias("cursor")]


def published(inputs: DataFrame, event_id: str, now: Column, version: int = 2) -> DataFrame:
    """Publish inputs as events: the schema's version, when it was received, an id where the input has none."""
    own = F.coalesce(F.col(event_id).cast("string"), F.expr("uuid()"))
    return inputs.select(*[c for c in inputs.columns if c not in ("schema_version", "received_at")], F.lit(version).alias("schema_version"), now.alias("received_at"), own.alias("id"))


def available(descriptors: DataFrame, tenant: str, tenants: str = "tenants") -> DataFrame:
    """Subject descriptors that a tenant may see: those of no tenant in particular and its own."""
    return descriptors.where((F.size(tenants) == 0) | F.array_contains(tenants, tenant))


CAPABILITIES = {"core": (False, False, False, "per-connection"), "stream": (True, True, True, "total"), "log": (True, True, False, "total")}  # replay, durable, ack, order (T15)


def parse_sdl(sdl: str) -> list[dict]:
    """Subscription fields: name, args, return type, subject; fields of types with their source, $data.NAME by default."""
    out = []
    types = {m[1]: dict(re.findall(r'(\w+)\s*:\s*[\w!\[\]]+(?:\s*@source\(from:\s*"([^"]*)"\))?', m[2])) for m in re.finditer(r"type\s+(\w+)\s*\{([^}]*)\}", sdl)}
    for body in re.findall(r"type\s+Subscription\s*\{(.*?)\n\}", sdl, re.S) or re.findall(r"type\s+Subscription\s*\{([^}]*\}?[^}]*)\}", sdl):
        for m in re.finditer(r'(\w+)\s*(?:\(([^)]*)\))?\s*:\s*(\w+)!?\s*(?:@subscribe\(subject:\s*"([^"]*)"\))?', body):
            if not m[4]:
                raise ValueError(f"subscription {m[1]} has no subject")
            fields = {f: s or f"$data.{f}" for f, s in types.get(m[3], {}).items()}
            out.append({"name": m[1], "args": dict(re.findall(r"(\w+)\s*:\s*(\w+)", m[2] or "")), "returns": m[3], "subject": m[4], "fields": fields})
    return out
