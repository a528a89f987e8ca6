"""Queries of sources, change-log folds, dispatch and ordering. events is the change log: key user_id, version event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import doc_id
from ..operators import changelog as L
from ..operators import compose as C
from ..operators.reconcile import schema_drift
from ..sources import changes as S
from .registry import query

c = F.col
OP = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END"


def log(t):
    return t.events.withColumn("op", F.expr(OP))


@query("s02_committed_transactions", "SELECT event_id FROM events WHERE event_id // 7 IN (SELECT event_id // 7 FROM events WHERE event_type = 'purchase')")
def _(t):
    e = t.events.withColumn("tx_id", F.expr("event_id div 7"))
    return L.committed(e, e.where("event_type = 'purchase'")).select("event_id")


@query("s04_keyset_page", "SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE (l_orderkey, l_linenumber) > (100, 3) ORDER BY ALL LIMIT 500")
def _(t):
    return S.keyset_page(t.lineitem.select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"], (100, 3), 500)


@query("s06_flat_projections", "SELECT 'customer' AS t, 'customer:' || to_json([CAST(c_custkey AS VARCHAR)]) AS doc_id FROM customer UNION ALL SELECT 'nation', 'nation:' || to_json([CAST(n_nationkey AS VARCHAR)]) FROM nation")
def _(t):
    specs = S.flat_specs({"nation": ("n_nationkey",), "customer": ("c_custkey",), "lineitem": ()})
    parts = [getattr(t, s["primary"]).select(F.lit(s["primary"]).alias("t"), doc_id(s["primary"], *map(c, s["key"])).alias("doc_id")) for s in specs]
    return parts[0].unionByName(parts[1])


@query("s08_event_payload", f"SELECT event_id, CASE {OP} WHEN 'insert' THEN n WHEN 'update' THEN '{{\"new\":' || n || ',\"old\":null}}' ELSE '{{\"old\":' || n || '}}' END AS payload FROM (SELECT *, '{{\"u\":' || user_id || '}}' AS n FROM events)")
def _(t):
    n = F.to_json(F.struct(c("user_id").alias("u")))
    return log(t).select("event_id", S.event_payload(c("op"), n, F.when(c("op") == "delete", n)).alias("payload"))


PARTIAL = "SELECT user_id, arg_max(event_type, event_id) AS a, arg_max_null(CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id END, event_id) FILTER (WHERE event_id % 3 = 0) AS b FROM events GROUP BY user_id"


def partial(t):
    """Column a is in every change, b in every third, where it may be set to null."""
    row = F.when(c("event_id") % 3 == 0, F.create_map(F.lit("a"), c("event_type"), F.lit("b"), F.when(c("event_id") % 6 != 0, c("event_id").cast("string")))).otherwise(F.create_map(F.lit("a"), c("event_type")))
    merged = L.merge_present(t.events.withColumn("row", row), ["user_id"], "event_id")
    return merged.select("user_id", F.try_element_at("row", F.lit("a")).alias("a"), F.try_element_at("row", F.lit("b")).cast("long").alias("b"))


for _name in ("s09_partial_update", "j14_related_merge"):
    query(_name, PARTIAL)(partial)


@query("j13_primary_merge", "SELECT 'event:' || to_json([CAST(user_id AS VARCHAR)]) AS doc_id, a, b, c_name FROM (" + PARTIAL + ") LEFT JOIN customer ON c_custkey = user_id")
def _(t):
    """The primary's partial updates are merged, then composed with what its merged key refers to."""
    join = C.Join("event", ("user_id",), (C.Relation("customer", "customer", (("user_id", "c_custkey"),), ("c_name",)),))
    docs = C.compose(join, {"event": partial(t), "customer": t.customer})
    return docs.select("doc_id", "a", "b", c("customer.c_name").alias("c_name"))


@query("j14_related_merge_compose", "SELECT 'customer:' || to_json([CAST(c_custkey AS VARCHAR)]) AS doc_id, coalesce(string_agg(user_id || '-' || a, ',' ORDER BY user_id), '') AS related FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS a, arg_max_null(CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 100 END, event_id) FILTER (WHERE event_id % 3 = 0) AS fk FROM events GROUP BY user_id) ON fk = c_custkey GROUP BY c_custkey")
def _(t):
    """Related rows are merged first; the foreign key, sent in every third change and there sometimes null, is the merged row's."""
    fk = F.when(c("event_id") % 6 != 0, (c("event_id") % 100).cast("string"))
    row = F.when(c("event_id") % 3 == 0, F.create_map(F.lit("a"), c("event_type"), F.lit("fk"), fk)).otherwise(F.create_map(F.lit("a"), c("event_type")))
    merged = L.merge_present(t.events.withColumn("row", row), ["user_id"], "event_id")
    related = merged.select("user_id", F.try_element_at("row", F.lit("a")).alias("a"), F.try_element_at("row", F.lit("fk")).alias("fk"))
    join = C.Join("customer", ("c_custkey",), (C.Relation("related", "related", (("c_custkey", "fk"),), ("user_id", "a"), many=True, sort_by="user_id"),))
    docs = C.compose(join, {"customer": t.customer, "related": related})
    return docs.select("doc_id", F.array_join(F.transform("related", lambda x: F.concat_ws("-", x["user_id"].cast("string"), x["a"])), ",").alias("related"))


@query("s10_key_relocation", "SELECT event_id, 'u:' || user_id AS doc_id, CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS action FROM events UNION ALL SELECT event_id, 'u:' || (user_id + 1000), 'delete' FROM events WHERE event_id % 10 = 0")
def _(t):
    new = F.concat(F.lit("u:"), c("user_id").cast("string"))
    e = log(t).withColumn("new_id", new).withColumn("old_id", F.when(c("event_id") % 10 == 0, F.concat(F.lit("u:"), (c("user_id") + 1000).cast("string"))))
    e = e.withColumn("op", F.when((c("event_id") % 10 == 0) & (c("op") != "delete"), "update").otherwise(c("op"))).where("event_id % 10 <> 0 or op <> 'delete'")
    gone = log(t).where("event_id % 10 = 0 and op = 'delete'").select("event_id", new.alias("doc_id"), F.lit("delete").alias("action"))
    old = log(t).where("event_id % 10 = 0 and op = 'delete'").select("event_id", F.concat(F.lit("u:"), (c("user_id") + 1000).cast("string")).alias("doc_id"), F.lit("delete").alias("action"))
    return L.key_moves(e, "new_id", "old_id").select("event_id", "doc_id", "action").unionByName(gone).unionByName(old)


@query("s11_reread_by_key", "SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'error'")
def _(t):
    e = log(t).withColumn("c_custkey", c("user_id"))
    return S.reread(e.select("event_id", "c_custkey", "op"), t.customer, ["c_custkey"]).select("event_id", "c_name")


@query("s12_keyset_first_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 256")
def _(t):
    return S.keyset_page(t.orders.select("o_orderkey"), ["o_orderkey"], None, 256)


@query("s15_change_stream_filter", "SELECT event_id FROM events WHERE event_type IN ('signup', 'view', 'error') AND (event_id % 4 <> 0 OR event_type = 'error')")
def _(t):
    full = F.when(c("event_id") % 4 != 0, c("props"))
    return S.change_stream(t.events, "event_type", ["signup", "view", "error"], full, ["error"]).select("event_id")


@query("s16_collection_scan", "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND source NOT LIKE 'system.%'")
def _(t):
    return S.collection_scan(t.documents, "doc_id", "source").select("doc_id")


@query("s17_id_relocation", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE CAST(event_id AS VARCHAR) END AS id, false AS has_old FROM events")
def _(t):
    i = c("event_id").cast("string")
    d = S.relocate_id(F.when(c("event_id") % 2 == 0, F.create_map(F.lit("_id"), i, F.lit("id"), F.lit("own"))).otherwise(F.create_map(F.lit("_id"), i)))
    return t.events.select("event_id", F.element_at(d, "id").alias("id"), F.map_contains_key(d, "_id").alias("has_old"))


@query("s23_debezium", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op, CAST(user_id AS VARCHAR) AS u, event_id AS ts_ms FROM events WHERE event_id % 4 < 3 AND event_id % 5 <> 0")
def _(t):
    code = F.element_at(F.array(F.lit("c"), F.lit("u"), F.lit("d"), F.lit("t")), (c("event_id") % 4 + 1).cast("int"))
    row = F.struct(c("user_id").alias("u"))
    body = F.to_json(F.struct(code.alias("op"), row.alias("after"), row.alias("before"), F.struct(c("event_id").alias("ts_ms")).alias("source")))
    v = F.when(c("event_id") % 5 == 0, None).when(c("event_id") % 2 == 0, F.concat(F.lit('{"payload":'), body, F.lit("}"))).otherwise(body)
    return S.debezium(t.events.withColumn("value", v)).select("event_id", "op", F.get_json_object("row", "$.u").alias("u"), "ts_ms")


@query("s24_raw_topic", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'insert' END AS op, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS key FROM events")
def _(t):
    op, key, _bad = S.raw_topic(F.when(c("event_id") % 3 == 0, c("event_id").cast("string")), F.when(c("event_id") % 5 != 0, c("props")), "k")
    return t.events.select("event_id", op.alias("op"), key.alias("key"))


@query("s25_key_components", "SELECT event_id, event_type || '|' || user_id AS k FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, CAST(event_id AS VARCHAR) FROM events WHERE event_id % 2 = 1")
def _(t):
    k = F.when(c("event_id") % 2 == 0, F.to_json(F.struct(c("user_id").alias("b"), c("event_type").alias("a")))).otherwise(c("event_id").cast("string"))
    return t.events.select("event_id", F.array_join(S.key_components(k), "|").alias("k"))


@query("s26_scope", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def _(t):
    return t.documents.where(S.in_scope(c("source"), ["src1", "src2"]) & S.in_scope(c("lang"), [])).select("doc_id")


@query("s27_schema_drift", "SELECT * FROM (VALUES ('a', 'dropped'), ('c', 'type_change'), ('d', 'added')) v(col, kind)")
def _(t):
    old, new = ([("a", "int"), ("b", "int"), ("c", "int")], [("b", "int"), ("c", "long"), ("d", "int")])
    return schema_drift(t.spark.createDataFrame(old, "col string, type string"), t.spark.createDataFrame(new, "col string, type string")).select("col", "kind")


@query("s28_snapshot_sentinel", "SELECT event_id FROM events WHERE event_id % 1000 <> 999")
def _(t):
    mark = F.when(c("event_id") % 1000 == 999, "snapshot-complete")
    return S.without_marks(t.events, mark, ["snapshot-complete"]).select("event_id")


@query("s05_resync_tables", "SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def _(t):
    return S.resync({"region": t.region, "nation": t.nation, "supplier": t.supplier}, ["region", "nation"])


@query("d01_batching", "SELECT batch, count(*) AS n, min(event_id) AS lo FROM (SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 200)::BIGINT AS batch, event_type FROM events) GROUP BY batch, event_type")
def _(t):
    return L.batches(t.events, "event_id", ["event_type"], 200).groupBy("event_type", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("lo")).select("batch", "n", "lo")


PREFIX = "WITH p AS (SELECT *, min(CASE WHEN value < 0 OR event_id % 700 = 699 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS ok FROM events) SELECT user_id % 8 AS part, max(event_id){} AS watermark FROM p WHERE ok = 1 GROUP BY 1"


def prefix(t, plus=0):
    e = t.events.withColumn("part", c("user_id") % 8).withColumn("ok", ~((c("value") < 0) | (c("event_id") % 700 == 699))).withColumn("w", c("event_id") + plus)
    return L.durable_prefix(e, "event_id", "ok", "w", ["part"])


query("d02_durable_prefix", PREFIX.format(""))(prefix)
query("d06_offset_prefix", PREFIX.format(" + 1"))(lambda t: prefix(t, 1))


@query("d03_batch_watermark", "SELECT event_id // 500 AS batch, max(CASE WHEN event_id % 3 = 0 THEN event_id * 10 ELSE event_id END) AS w FROM events GROUP BY 1")
def _(t):
    e = t.events.withColumn("batch", F.expr("event_id div 500"))
    return L.batch_watermark(e, "batch", F.when(c("event_id") % 3 == 0, c("event_id") * 10), c("event_id")).withColumnRenamed("watermark", "w")


@query("d04_barriers", "SELECT event_id FROM events WHERE event_type <> 'error'")
def _(t):
    return S.without_marks(t.events, c("event_type"), ["error"]).select("event_id")


@query("d07_safe_ack", "SELECT user_id, least(max(event_id), 5000) AS ack FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(L.safe_ack(F.max("event_id"), F.lit(5000)).alias("ack"))


@query("k03_lww_fold", f"SELECT user_id, event_id, {OP} AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 1009 DESC, event_id DESC) = 1")
def _(t):
    e = log(t).withColumn("version", c("event_id") * 7919 % 1009)
    return L.last_writer(e, ["user_id"], "version", "event_id").select("user_id", "event_id", "op")


@query("k15_versioned_delete", f"SELECT user_id, event_id FROM (SELECT *, {OP} AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE op <> 'delete'")
def _(t):
    return L.live(L.last_writer(log(t), ["user_id"], "event_id", "event_id")).select("user_id", "event_id")


@query("k14_stale_writes", "SELECT event_id, coalesce(v >= m, false) OR m IS NULL AS applied FROM (SELECT event_id, v, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN event_id * 31 % 997 END AS v FROM events))")
def _(t):
    e = t.events.withColumn("v", F.when(c("event_id") % 9 != 0, c("event_id") * 31 % 997))
    return L.stale_after_version(e, ["user_id"], "v", "event_id").select("event_id", "applied")


@query("k22_truncate", "SELECT event_id FROM events e WHERE event_id % 2500 <> 1200 AND event_id > coalesce((SELECT max(event_id) FROM events x WHERE x.event_id % 2500 = 1200 AND x.event_type = e.event_type), -1)")
def _(t):
    e = t.events.withColumn("op", F.when(c("event_id") % 2500 == 1200, "truncate").otherwise("update"))
    return L.after_truncate(e, "event_type", "event_id").select("event_id")


RUNS = "SELECT run::BIGINT AS run, count(*) AS n, min(event_id) AS lo FROM (SELECT event_id, lane, sum(new) OVER (PARTITION BY lane ORDER BY event_id) AS run FROM (SELECT event_id, user_id % 16 AS lane, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id % 16 ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY lane, run"


def lanes(t):
    return L.runs(t.events.withColumn("lane", c("user_id") % 16), "event_id", ["event_type"], ["lane"]).groupBy("lane", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("lo")).select("run", "n", "lo")


query("k09_runs", RUNS)(lanes)


@query("k11_lanes", "SELECT lane, run::BIGINT AS run, any_value(op) AS op, count(*) AS n FROM (SELECT lane, op, sum(new) OVER (PARTITION BY lane ORDER BY event_id) AS run FROM (SELECT event_id, op, user_id % 16 AS lane, CASE WHEN op IS NOT DISTINCT FROM lag(op) OVER (PARTITION BY user_id % 16 ORDER BY event_id) AND event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id % 16 ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM events))) GROUP BY lane, run")
def _(t):
    """A record keeps to its lane; within a lane a run has one table and one kind of write."""
    e = t.events.withColumn("lane", c("user_id") % 16).withColumn("op", F.when(c("event_id") % 4 == 0, "delete").otherwise("upsert"))
    return L.runs(e, "event_id", ["op", "event_type"], ["lane"]).groupBy("lane", "run").agg(F.first("op").alias("op"), F.count("*").alias("n"))


@query("s08_truncate_payload", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{\"cascade\":' || (event_id % 2 = 0) || ',\"restart_identity\":false}' ELSE '{\"u\":' || user_id || '}' END AS payload FROM events")
def _(t):
    op = F.when(c("event_id") % 9 == 0, "truncate").otherwise("insert")
    return t.events.select("event_id", S.event_payload(op, F.to_json(F.struct(c("user_id").alias("u"))), F.lit(None).cast("string"), c("event_id") % 2 == 0).alias("payload"))


@query("s22_kafka_rows", "SELECT event_id AS offset, CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op, CAST(user_id AS VARCHAR) AS k, CAST(user_id AS VARCHAR) AS u FROM events WHERE event_id % 4 < 3 AND event_id % 5 <> 0")
def _(t):
    """Kafka's columns, with tombstones and unknown operations among the messages: these are left out."""
    code = F.element_at(F.array(F.lit("c"), F.lit("u"), F.lit("d"), F.lit("t")), (c("event_id") % 4 + 1).cast("int"))
    row = F.struct(c("user_id").alias("u"))
    value = F.when(c("event_id") % 5 != 0, F.to_json(F.struct(F.struct(code.alias("op"), row.alias("after"), row.alias("before")).alias("payload"))))
    k = t.events.select(F.to_json(F.struct(c("user_id").alias("id"))).cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit("shop").alias("topic"), F.lit(0).alias("partition"), c("event_id").alias("offset"))
    return S.from_kafka(k).select("offset", "op", c("doc_key")[0].alias("k"), F.get_json_object("row", "$.u").alias("u"))


@query("s03_unknown_relations", "SELECT event_type AS relation, count(*) AS skipped FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def _(t):
    known = t.spark.createDataFrame([("click",), ("view",)], "relation string")
    return S.unknown_relations(t.events.withColumnRenamed("event_type", "relation"), known)[1]


@query("d05_precise_rejection", "SELECT count(*) = 40 AS ok, CASE WHEN count(*) <> 40 THEN 'count' END AS why FROM events WHERE event_id < 40")
def _(t):
    return L.precise_rejection(t.events.where("event_id < 40"), 40, 0, 5000, "event_id")


@query("d01_sized_batching", "WITH RECURSIVE e AS (SELECT event_type, event_id, length(props) AS b, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), w AS (SELECT event_type, i, 0::BIGINT AS batch, 1 AS n, b AS held FROM e WHERE i = 1 UNION ALL SELECT e.event_type, e.i, CASE WHEN w.n >= 50 OR w.held + e.b > 300 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.n >= 50 OR w.held + e.b > 300 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 50 OR w.held + e.b > 300 THEN e.b ELSE w.held + e.b END FROM w JOIN e ON e.event_type = w.event_type AND e.i = w.i + 1) SELECT event_type, batch, count(*) AS n FROM w GROUP BY ALL")
def _(t):
    e = t.events.select("event_type", "event_id", F.length("props").alias("b"))
    return L.sized_batches(e, "event_id", ["event_type"], 50, 300, "b").groupBy("event_type", "batch").agg(F.count("*").alias("n"))
