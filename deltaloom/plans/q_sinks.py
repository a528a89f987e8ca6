"""Queries of sinks, views, rejects and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import reconcile as R
from ..operators import sinks as S
from .registry import query

c = F.col


@query("k01_bulk_actions", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS action, CASE WHEN event_id % 4 <> 0 THEN 'u' || user_id WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS _id, CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'delete without id' END AS reject FROM events")
def _(t):
    rows = t.events.select("event_id", F.when(c("event_type") == "error", "delete").otherwise("update").alias("op"), F.lit("ix").alias("index"), F.when(c("event_id") % 4 != 0, F.concat(F.lit("u"), c("user_id").cast("string"))).alias("doc_id"), c("event_id").alias("version"), c("props").alias("body"))
    out = S.bulk_actions(rows.withColumn("event_id", c("event_id").cast("string")))
    return out.select(c("version").alias("event_id"), "action", "_id", "reject")


@query("k02_update_unwrap", "SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'new' ELSE 'payload' END AS r FROM events")
def _(t):
    op = F.when(c("event_type") == "view", "update").otherwise("insert")
    return t.events.select("event_id", S.current_row(op, F.when(c("event_id") % 2 == 0, "new"), F.lit("payload")).alias("r"))


STATUS = "CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 409 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 400 ELSE 401 END"


@query("k05_outcomes", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'applied' WHEN 1 THEN 'applied' WHEN 2 THEN CASE WHEN event_type = 'error' THEN 'applied' ELSE 'blocked' END WHEN 3 THEN 'transient' WHEN 4 THEN 'transient' WHEN 5 THEN 'permanent' ELSE 'blocked' END AS o FROM events")
def _(t):
    kind = F.when(c("event_id") % 8 == 5, "mapper_parsing_exception")
    return t.events.select("event_id", S.outcome(F.expr(STATUS), kind, F.when(c("event_type") == "error", "delete").otherwise("index")).alias("o"))


@query("k04_idempotent", f"SELECT count(*) AS n FROM (SELECT {STATUS} AS s, event_type FROM events) WHERE s IN (200, 409) OR (s = 404 AND event_type = 'error')")
def _(t):
    o = S.outcome(F.expr(STATUS), F.lit(None).cast("string"), F.when(c("event_type") == "error", "delete").otherwise("index"))
    return t.events.where(o == "applied").agg(F.count("*").alias("n"))


@query("k10_search_document", "SELECT 'orders:[\"' || o_orderkey || '\"]' AS _src_id, translate(rtrim(base64(encode('orders:[\"' || o_orderkey || '\"]')), '='), '+/', '-_') AS pk, o_orderstatus FROM orders")
def _(t):
    d = K.doc_id("orders", c("o_orderkey"))
    return t.orders.select(d.alias("_src_id"), K.search_key(d).alias("pk"), "o_orderstatus")


@query("k12_record_document", "SELECT c_custkey AS source_id, 'customer:[\"' || c_custkey || '\"]' AS _src_id, CAST(c_nationkey AS VARCHAR) AS _lx_c_nationkey FROM customer")
def _(t):
    return t.customer.select(c("c_custkey").alias("source_id"), K.doc_id("customer", c("c_custkey")).alias("_src_id"), K.lookup_values(F.array(F.struct("c_nationkey")), "c_nationkey")[0].alias(K.lookup_field("c_nationkey")))


@query("k16_ttl", "SELECT event_id FROM events WHERE epoch(ts)::BIGINT + 86400 > (SELECT max(epoch(date_trunc('second', ts))::BIGINT) FROM events)")
def _(t):
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(now)).where(~S.expired(c("ts"), 86400, c("now"))).select("event_id")  # one row


@query("k17_view_source", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    rows = t.orders.withColumn("namespace", F.lit("shop")).withColumn("relation", F.when(c("o_orderstatus") == "O", "orders").otherwise("other"))
    return rows.where(S.view_source(c("namespace"), c("relation"), ("shop", "orders"))).select("o_orderkey")


VIEW = {"all": [{"pointer": "/status", "in": ["O", "P"]}, {"pointer": "/none", "not_equals": "x"}, {"pointer": "/total", "exists": True}]}


def orders_variant(t):
    return t.orders.withColumn("doc", F.parse_json(F.to_json(F.struct(c("o_orderkey").alias("id"), c("o_custkey").alias("customer_id"), c("o_orderstatus").alias("status"), F.when(c("o_orderkey") % 3 != 0, c("o_custkey")).alias("total")))))


@query("k18_view_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 3 <> 0")
def _(t):
    return orders_variant(t).where(S.view_filter(VIEW)).select("o_orderkey")


@query("k19_view_value", "SELECT o_orderkey, 'customer:' || o_custkey || ':order:' || o_orderkey AS k, o_orderstatus AS status FROM orders")
def _(t):
    return orders_variant(t).select("o_orderkey", K.key_template("customer:${json:/customer_id}:order:${json:/id}", F.lit(""), "doc", {}).alias("k"), F.expr(K.pointer("doc", "/status")[0]).alias("status"))


MOVES = "WITH s AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_type || ':' || user_id END AS k FROM events), p AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM s) SELECT user_id, event_id, 'delete' AS action, b AS view_key FROM p WHERE b IS NOT NULL AND b IS DISTINCT FROM k UNION ALL SELECT user_id, event_id, 'upsert', k FROM p WHERE k IS NOT NULL"


@query("k20_view_moves", MOVES)
def _(t):
    e = t.events.withColumn("k", F.when(c("event_type") != "error", F.concat_ws(":", "event_type", c("user_id").cast("string"))))
    return S.view_moves(e, "user_id", "event_id", "k")


@query("k21_collisions", "SELECT c_nationkey, count(DISTINCT c_custkey) AS owners FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1")
def _(t):
    return S.collisions(t.customer, "c_nationkey", "c_custkey")


@query("k26_drift", "SELECT count(*) AS n_keys, count(*) FILTER (WHERE v IS NULL) AS data_only, count(*) FILTER (WHERE d IS NULL) AS version_only FROM (SELECT o_orderkey AS d FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey AS v FROM orders WHERE o_orderkey % 5 <> 0) b ON d = v")
def _(t):
    k = t.orders.select(c("o_orderkey").alias("key"))
    return R.drift(k.where("key % 7 <> 0"), k.where("key % 5 <> 0"))


REJECT = "CASE WHEN event_id % 7 = 0 THEN 'missing target' WHEN event_id % 5 = 0 THEN 'missing id' WHEN event_id % 3 = 0 THEN 'not an object' WHEN length(props) > 8 THEN 'oversize' END"


def rejects(t):
    body = F.when(c("event_id") % 3 == 0, "[1]").otherwise(c("props"))
    return t.events.select("event_id", S.reject_reason(F.when(c("event_id") % 5 != 0, "x"), body, F.when(c("event_id") % 7 != 0, "ix"), 8).alias("reason"))


query("k30_rejects", f"SELECT event_id, {REJECT} AS reason FROM events")(rejects)
query("k28_dead_letters", f"SELECT event_id, {REJECT} AS reason FROM events WHERE {REJECT} IS NOT NULL")(lambda t: rejects(t).where("reason is not null"))


@query("k29_routing", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'proj' WHEN event_id % 3 = 0 THEN event_type ELSE 'fixed' END AS ix FROM events")
def _(t):
    return t.events.select("event_id", S.route(F.when(c("event_id") % 3 == 0, c("event_type")), F.when(c("event_id") % 2 == 0, "proj"), "fixed").alias("ix"))


def target(t):
    return t.orders.where("o_orderkey % 11 <> 0").select(K.doc_id("orders", c("o_orderkey")).alias("doc_id"))


def live(t):
    return t.orders.where("o_orderkey % 4 <> 1").select(K.doc_id("orders", c("o_orderkey")).alias("doc_id"))


@query("c01_orphans", "SELECT 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) AS doc_id FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 = 1")
def _(t):
    return R.orphans(target(t), live(t), prefix="orders:")


@query("c02_mass_delete_guard", "SELECT count(*) FILTER (WHERE o_orderkey % 11 <> 0) AS n_target, count(*) FILTER (WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 = 1) AS n_orphans, count(*) FILTER (WHERE o_orderkey % 4 <> 1) AS n_live, true AS allowed FROM orders")
def _(t):
    return R.guard(target(t), live(t))


@query("c03_live_keys", "SELECT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_custkey % 10 <> 0")
def _(t):
    return t.orders.select(K.join_key(F.when(c("o_custkey") % 10 != 0, c("o_custkey"))).alias("k")).where("k is not null")


@query("k13_vector_distance", "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS d FROM embeddings")
def _(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id = 0").agg(F.first("v")).scalar()
    return e.withColumn("q", q).select("vec_id", F.round(S.vector_distance(c("v"), c("q")), 6).alias("d"))


@query("k13_other_metrics", "SELECT vec_id, round(list_distance(e, q), 6) AS euclidean, round(-list_inner_product(e, q), 6) AS dot FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)")
def _(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id = 0").agg(F.first("v")).scalar()
    return e.withColumn("q", q).select("vec_id", *[F.round(S.vector_distance(c("v"), c("q"), m), 6).alias(m) for m in ("euclidean", "dot")])


KINDS = ["circuit_breaking_exception", "cluster_block_exception", "es_rejected_execution_exception", "master_not_discovered_exception", "node_not_connected_exception", "snapshot_in_progress_exception", "unavailable_shards_exception", "document_parsing_exception", "mapper_parsing_exception", "strict_dynamic_mapping_exception", "illegal_argument_exception", "illegal_argument_exception", "illegal_argument_exception", "illegal_argument_exception", "process_cluster_event_timeout_exception", "index_not_found_exception"]


@query("k05_outcome_types", "SELECT event_id, CASE WHEN event_id % 16 < 7 THEN 'transient' WHEN event_id % 16 < 13 THEN 'permanent' ELSE 'blocked' END AS o FROM events")
def _(t):
    """Every type with its outcome; an illegal argument by its reason."""
    at = (c("event_id") % 16).cast("int")
    kind = F.get(F.array(*map(F.lit, KINDS)), at)
    reason = F.when(at == 10, "mapper [x] is taken").when(at == 11, "x cannot be changed").when(at == 12, "of a different type").when(at == 13, "unknown setting")
    return t.events.select("event_id", S.outcome(F.lit(400), kind, F.lit("index"), reason).alias("o"))


@query("k18_view_filter_values", "SELECT o_orderkey, o_orderkey % 4 = 1 AS a, o_orderkey % 4 <> 1 AS b, o_orderkey % 3 = 0 AS c, o_orderkey % 4 IN (1, 2) AS d, o_orderkey % 2 = 0 AS e FROM orders")
def _(t):
    """true is not "true", 5 is not "5", null is a value, digits name a member too."""
    k = c("o_orderkey")
    flag = F.when(k % 4 == 1, "true").when(k % 4 == 2, '"true"').when(k % 4 == 3, "1").otherwise("false")
    text = F.concat(F.lit('{"flag":'), flag, F.lit(',"n":'), F.when(k % 3 == 0, "null").otherwise('"5"'), F.when(k % 2 == 0, ',"0":5}').otherwise("}"))
    d = t.orders.select(k, F.parse_json(text).alias("doc"))
    one = lambda **cond: S.view_filter({"all": [cond]})
    return d.select("o_orderkey", one(pointer="/flag", equals=True).alias("a"), one(pointer="/flag", not_in=[True, 5]).alias("b"), (one(pointer="/n", equals=None) & one(pointer="/n", not_equals=5)).alias("c"), one(pointer="/flag", **{"in": [True, "true"]}).alias("d"), one(pointer="/0", equals=5).alias("e"))
