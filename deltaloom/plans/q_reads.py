"""Queries of the read tools and realtime subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import doc_id, realtime_subject
from ..operators import realtime as T
from ..operators import search as S
from .registry import query

c = F.col


def docs(t):
    return t.orders.select(doc_id("orders", c("o_orderkey")).alias("doc_id"), F.lit("orders").alias("target"), "o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")


@query("r02_get_entity", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def _(t):
    return S.get_entity(docs(t), 'orders:["42"]', ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("r03_search", r"SELECT doc_id FROM documents WHERE (regexp_matches(text, '(?i)\bthe\b') AND regexp_matches(text, '(?i)\bof\s+the\b') AND NOT lang = 'fr') OR regexp_matches(text, '(?i)\bapache\s+license\b') ORDER BY n_chars DESC, doc_id LIMIT 50")
def _(t):
    return S.search(t.documents, '(the AND "of the" AND NOT lang:fr) OR "apache license"', ["text"], "n_chars:desc", 50).select("doc_id")


@query("r04_top_k", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey DESC, 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) LIMIT 100")
def _(t):
    return S.search(docs(t), "o_orderstatus:O", [], "o_custkey:desc", 5000, 100).select("o_orderkey")


@query("r05_scan", "SELECT doc_id FROM (SELECT 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) AS doc_id FROM orders) WHERE doc_id LIKE 'orders:[\"1_2%' ORDER BY doc_id LIMIT 200")
def _(t):
    return S.scan(docs(t), 'orders:["1?2*', 200).select("doc_id")


@query("r07_key_scope", "SELECT event_type AS target, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def _(t):
    return S.scoped(t.events.withColumnRenamed("event_type", "target"), ["view", "click"]).groupBy("target").agg(F.count("*").alias("n"))


@query("r08_reverse_lookup", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (3, 5)")
def _(t):
    d = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey")).alias("items"))
    return S.containing(d, "items", t.supplier.where("s_suppkey in (3, 5)").select(c("s_suppkey").alias("l_suppkey")), ["l_suppkey"], "l_orderkey")


def published(t):
    tenant = F.concat(F.lit("t"), (c("user_id") % 4).cast("string"))
    return t.events.select("event_id", tenant.alias("tenant"), realtime_subject(tenant, c("event_type"), c("event_id").cast("string")).alias("subject"), "user_id")


SUBS = [(k, f"t{k % 4}", s, p) for k in range(12) for s, p in enumerate((["click.*"], ["*.17", "view.>"], [">"], ["purchase.1", "error.*", "nothing.>"])[k % 4 if k < 8 else k % 3])]
SUB_SQL = "(VALUES " + ", ".join(f"({k}, '{t}', {s}, '{p}')" for k, t, s, p in SUBS) + ") s(connection, tenant, sub_id, pattern)"


@query("t01_subject_match", "SELECT event_id FROM events WHERE event_type = 'view' AND event_id % 10 = 3")
def _(t):
    p = published(t)
    return p.where(c("subject").rlike(T.pattern_regex("rt.t.*.view.*")) & c("subject").rlike(r"3\z")).select("event_id")


@query("t02_anchoring", "SELECT event_id, 'rt.t.t' || user_id % 4 || '.view.>' AS p FROM events")
def _(t):
    return published(t).select("event_id", T.anchored(c("tenant"), F.lit("view.>")).alias("p"))


@query("t03_fan_out", rf"SELECT event_id, connection, string_agg(CAST(sub_id AS VARCHAR), ',' ORDER BY sub_id) AS subs FROM (SELECT DISTINCT event_id, connection, sub_id FROM events JOIN {SUB_SQL} ON tenant = 't' || user_id % 4 AND regexp_full_match(event_type || '.' || event_id, replace(replace(replace(pattern, '.', '[.]'), '*', '[^.]+'), '>', '.+'))) GROUP BY ALL")
def _(t):
    subs = t.spark.createDataFrame(SUBS, "connection int, tenant string, sub_id int, pattern string")
    return T.fan_out(published(t), subs).select("event_id", "connection", F.array_join(F.transform("sub_ids", lambda x: x.cast("string")), ",").alias("subs"))


@query("t04_filtered_stream", "SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id % 4 = 2")
def _(t):
    return published(t).where(c("subject").rlike(T.pattern_regex("rt.t.t2.purchase.>"))).select("event_id")


@query("t05_replay", "SELECT event_id, CASE WHEN event_id <= 900 THEN 'replay' ELSE 'live' END AS part FROM events WHERE event_id > 250")
def _(t):
    old, new = T.replay(t.events, 250, 900, "event_id")
    return old.select("event_id", F.lit("replay").alias("part")).unionByName(new.select("event_id", F.lit("live").alias("part")))


@query("t06_resume_window", "SELECT user_id, CASE WHEN 500 > hi + 1 THEN 'ahead' WHEN 500 < lo - 1 THEN 'expired' ELSE 'ok' END AS state FROM (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events WHERE event_id % 3 <> user_id % 3 GROUP BY 1)")
def _(t):
    w = t.events.where("event_id % 3 <> user_id % 3").groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return w.select("user_id", T.resume_state(F.lit(500), c("lo"), c("hi")).alias("state"))


@query("t07_typed_response", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS __typename, 'js:' || event_id AS cursor FROM events")
def _(t):
    cols = T.typed_response({"k": "$data.k"}, "props", c("event_type"), c("event_id"))
    return t.events.select("event_id", *cols)


@query("t09_envelope_validation", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'version' WHEN event_id % 3 = 0 THEN 'tenant' WHEN event_id % 2 = 0 THEN 'event' END AS reason FROM events")
def _(t):
    e = {"schema_version": F.when(c("event_id") % 5 != 0, 2), "tenant": F.when(c("event_id") % 3 == 0, "Bad Tenant").otherwise("acme"), "event": F.when(c("event_id") % 2 == 0, "a..b").otherwise("a.b"), "entity_id": c("event_id").cast("string")}
    return t.events.select("event_id", T.envelope_reject(e).alias("reason"))


@query("t10_publish", "SELECT event_id, 2 AS schema_version, ts AS received_at FROM events")
def _(t):
    return T.published(t.events, "event_id", c("ts")).select("event_id", "schema_version", "received_at")


@query("t11_available_subjects", "SELECT * FROM (VALUES ('order.*'), ('view.>')) s(subject)")
def _(t):
    all_ = t.spark.createDataFrame([("order.*", []), ("view.>", ["t1", "t2"]), ("admin.>", ["t9"])], "subject string, tenants array<string>")
    return T.available(all_, "t1").select("subject")


@query("t18_retention", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) <= 300")
def _(t):
    return T.retained(t.events.withColumn("tenant", c("user_id") % 4), "tenant", "event_id", 300).select("event_id")
