"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..sources.changes import bolt_bytes, bolt_duration, bson_document, current_row
from .registry import query

c = F.col


@query("f01_component_text", "SELECT o_orderkey, coalesce(CAST(nullif(o_custkey % 7, 0) AS VARCHAR), 'null') AS k, CAST(o_custkey % 2 = 0 AS VARCHAR) AS b FROM orders")
def _(t):
    return t.orders.select("o_orderkey", K.component_text(F.nullif(c("o_custkey") % 7, F.lit(0))).alias("k"), K.component_text(c("o_custkey") % 2 == 0).alias("b"))


@query("f02_doc_id", "SELECT 'lineitem:' || to_json([CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)]) AS doc_id, l_partkey FROM lineitem")
def _(t):
    return t.lineitem.select(K.doc_id("lineitem", c("l_orderkey"), c("l_linenumber")).alias("doc_id"), "l_partkey")


@query("f03_pk_key", "SELECT CAST(o_orderkey AS VARCHAR) AS one, CAST(to_json([CAST(o_orderkey AS VARCHAR), o_orderstatus]) AS VARCHAR) AS two FROM orders")
def _(t):
    return t.orders.select(K.pk_key(c("o_orderkey")).alias("one"), K.pk_key(c("o_orderkey"), c("o_orderstatus")).alias("two"))


@query("f04_key_of_doc_id", "SELECT CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus || ':x' AS b, true AS other_arity FROM orders")
def _(t):
    d = t.orders.select(K.doc_id("orders", c("o_orderkey"), F.concat("o_orderstatus", F.lit(":x"))).alias("d"))
    return d.select(K.key_of(c("d"), 2)[0].alias("a"), K.key_of(c("d"), 2)[1].alias("b"), K.key_of(c("d"), 3).isNull().alias("other_arity"))


@query("f05_join_key", "SELECT count(*) AS n FROM orders o JOIN (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer) c ON CAST(o.o_custkey AS VARCHAR) = c.k")
def _(t):
    return t.orders.join(t.customer.select(K.join_key(c("c_custkey")).alias("k")), K.join_key(c("o_custkey")) == c("k")).agg(F.count("*").alias("n"))


@query("f06_op_of_subject", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op FROM events")
def _(t):
    s = F.concat(F.lit("pg.shop.users."), F.when(c("event_type") == "error", "delete").otherwise("update"))
    return t.events.select("event_id", K.op_of(s).alias("op"))


@query("f07_source_table", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'h.r' WHEN 1 THEN 'shop.users' ELSE NULL END AS tab FROM events")
def _(t):
    h = F.when(c("event_id") % 3 == 0, "h")
    s = F.when(c("event_id") % 3 == 1, "pg.shop.users.update").otherwise("a.b")
    return t.events.select("event_id", K.source_table(s, h, F.when(h.isNotNull(), "r")).alias("tab"))


@query("f09_sanitize_segment", "SELECT page_id, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), ''), '_') AS seg FROM pages")
def _(t):
    return t.pages.select("page_id", K.sanitize_segment(c("url")).alias("seg"))


@query("f10_percent_encode", "SELECT doc_id, url_encode(substr(text, 1, 40)) AS enc FROM documents")
def _(t):
    return t.documents.select("doc_id", K.percent_encode(F.substring("text", 1, 40)).alias("enc"))


@query("f10_percent_encode_whole", "SELECT doc_id, url_encode(text) AS enc FROM documents")
def _(t):
    """Whole texts; f10_percent_encode has the first 40 characters, as its SQL says."""
    return t.documents.select("doc_id", K.percent_encode(c("text")).alias("enc"))


@query("f11_valid_subject", "SELECT page_id, regexp_full_match(replace(url, '/', '.'), '[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)*') AS ok, regexp_full_match('a.' || page_id, '[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)*') AS ok2 FROM pages")
def _(t):
    return t.pages.select("page_id", K.valid_subject(F.replace("url", F.lit("/"), F.lit("."))).alias("ok"), K.valid_subject(F.concat(F.lit("a."), c("page_id").cast("string"))).alias("ok2"))


@query("f12_valid_source_uri", "SELECT page_id, length(url) > 0 AND contains(url, '://') AS ok FROM pages")
def _(t):
    return t.pages.select("page_id", K.valid_source_uri(c("url")).alias("ok"))


@query("f13_text_mode", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k, CASE WHEN o_custkey % 2 = 0 THEN 't' ELSE 'f' END AS b, '[' || o_custkey || ',1]' AS a FROM orders")
def _(t):
    return t.orders.select("o_orderkey", K.text_mode(c("o_custkey"), "bigint").alias("k"), K.text_mode(c("o_custkey") % 2 == 0, "boolean").alias("b"), K.text_mode(F.array("o_custkey", F.lit(1)), "array<bigint>").alias("a"))


@query("f14_iso_to_space", r"SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})', '\1 \2') AS s FROM events")
def _(t):
    return t.events.select("event_id", K.iso_to_space(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("s"))


@query("f15_datetime_text", "SELECT event_id, CASE WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS s, strftime(ts, '%Y-%m-%d') AS d, lpad(CAST(24 * 2 + event_id % 24 AS VARCHAR), 2, '0') || ':05:09' AS tm FROM events")
def _(t):
    return t.events.select("event_id", K.datetime_text(c("ts")).alias("s"), K.datetime_text(F.date_trunc("day", "ts")).alias("d"), K.time_text(F.lit(2), (c("event_id") % 24).cast("int"), F.lit(5), F.lit(9)).alias("tm"))


@query("f18_value_compare", "SELECT o_custkey, string_agg(coalesce(CAST(nullif(o_orderkey % 5, 0) AS VARCHAR), 'null') , ',' ORDER BY nullif(o_orderkey % 5, 0) NULLS FIRST) AS s FROM orders GROUP BY o_custkey")
def _(t):
    x = F.nullif(c("o_orderkey") % 5, F.lit(0))
    arr = F.array_sort(F.collect_list(K.json_order(x)))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(arr, lambda e: K.component_text(e["x"])), ",").alias("s"))


@query("f20_index_name", "SELECT event_id, 'ev-' || strftime(ts, '%Y.%m') || '-' || lower(event_type) || '-u' || user_id AS ix FROM events")
def _(t):
    return t.events.select("event_id", K.index_name("ev-%Y.%m-${subject:1}-${header:u}", F.concat(F.lit("a."), F.upper("event_type")), c("ts"), {"u": F.concat(F.lit("U"), c("user_id").cast("string"))}).alias("ix"))


@query("f21_segment_codec", "SELECT page_id, url AS dec, replace(url_encode(url), '~', '%7E') AS enc FROM pages")
def _(t):
    return t.pages.select("page_id", K.segment_decode(K.segment_encode(c("url"))).alias("dec"), K.segment_encode(c("url")).alias("enc"))


@query("f22_data_key", "SELECT o_orderkey, 'p:{orders}:' || url_encode('orders:[\"' || o_orderkey || '\"]') AS k FROM orders")
def _(t):
    return t.orders.select("o_orderkey", K.data_key("p", F.lit("orders"), K.doc_id("orders", c("o_orderkey"))).alias("k"))


@query("f23_search_key", "SELECT doc_id, CASE WHEN length(e) > 511 THEN 'h-' || sha256(text) ELSE e END AS k FROM (SELECT doc_id, text, translate(rtrim(base64(encode(text)), '='), '+/', '-_') AS e FROM documents)")
def _(t):
    return t.documents.select("doc_id", K.search_key(c("text")).alias("k"))


@query("f24_index_segment", "SELECT page_id, replace(replace(replace(replace(url_encode(replace(url, '_', '~')), '.', '%2E'), '~', '%7E'), '%7E', '__'), '%', '_') AS seg FROM pages")
def _(t):
    return t.pages.select("page_id", K.index_segment(c("url")).alias("seg"))


@query("f25_record_id", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, 'plain' || o_orderkey AS b, 'orders:x' AS f FROM orders")
def _(t):
    return t.orders.select("o_orderkey", K.record_id(K.doc_id("orders", c("o_orderkey")))[0].alias("a"), K.record_id(F.concat(F.lit("t:plain"), c("o_orderkey").cast("string")))[0].alias("b"), K.record_id(F.lit("orders:x"), fixed=True)[0].alias("f"))


@query("f26_lookup_values", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS _lx_items_l_partkey FROM lineitem GROUP BY l_orderkey")
def _(t):
    items = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey")).alias("items"))
    return items.select("l_orderkey", F.array_join(K.lookup_values(c("items"), "l_partkey"), ",").alias(K.lookup_field("items.l_partkey")))


@query("f27_json_pointer", "SELECT event_id, CAST(json_extract(props, '/k') AS VARCHAR) AS v, json_exists(props, '$.k') AS has, json_exists(props, '$.none') AS has_none, event_id % 2 = 0 AS has_null FROM events")
def _(t):
    e = t.events.withColumn("v", F.parse_json("props")).withColumn("n", F.parse_json(F.when(c("event_id") % 2 == 0, '{"a/b":null}').otherwise("{}")))
    v, has = K.pointer("v", "/k")
    return e.select("event_id", F.expr(v).alias("v"), F.expr(has).alias("has"), F.expr(K.pointer("v", "/none")[1]).alias("has_none"), F.expr(K.pointer("n", "/a~1b")[1]).alias("has_null"))


@query("f28_key_template", "SELECT event_id, 'u:' || user_id || ':' || json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    e = t.events.withColumn("v", F.parse_json("props"))
    return e.select("event_id", K.key_template("u:${header:user}:${json:/k}", F.lit("x"), "v", {"user": c("user_id").cast("string")}).alias("k"))


@query("f30_source_expression", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.zz.b') AS m, event_type AS e, 'id-7' AS l FROM events")
def _(t):
    x = lambda s: K.source_expression(s, "props", {"event": c("event_type")}, {"x": "7"})
    return t.events.select("event_id", x("$data.k").alias("a"), x("$data.zz.b").alias("m"), x("$event.event").alias("e"), x("id-{args.x}").alias("l"))


@query("f31_identifiers", "SELECT page_id, regexp_full_match(url, '[a-z0-9_-]{1,64}') AS tenant, regexp_full_match('e.' || page_id, '[A-Za-z0-9_-]{1,64}([.][A-Za-z0-9_-]{1,64})*') AS event, regexp_full_match(CAST(page_id AS VARCHAR), '[A-Za-z0-9_-]{1,128}') AS entity FROM pages")
def _(t):
    return t.pages.select("page_id", K.valid_tenant(c("url")).alias("tenant"), K.valid_event(F.concat(F.lit("e."), c("page_id").cast("string"))).alias("event"), K.valid_entity(c("page_id").cast("string")).alias("entity"))


@query("f32_realtime_subject", "SELECT event_id, 'rt.t.t' || user_id % 4 || '.app.' || event_type || '.' || event_id AS subject, 't' || user_id % 4 AS tenant, 'app.' || event_type AS event, CAST(event_id AS VARCHAR) AS entity FROM events")
def _(t):
    s = K.realtime_subject(F.concat(F.lit("t"), (c("user_id") % 4).cast("string")), F.concat(F.lit("app."), c("event_type")), c("event_id").cast("string"))
    p = K.parse_subject(s)
    return t.events.select("event_id", s.alias("subject"), p["tenant"].alias("tenant"), p["event"].alias("event"), p["entity_id"].alias("entity"))


@query("f33_source_version", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN nullif(event_id, 0) WHEN event_id % 3 = 1 THEN event_id * 10 ELSE NULL END AS v FROM events")
def _(t):
    lsn = F.when(c("event_id") % 3 == 0, F.concat(F.lit("00"), c("event_id").cast("string")))
    tx = F.when(c("event_id") % 3 == 1, (c("event_id") * 10).cast("string")).when(c("event_id") % 3 == 2, "x1")
    return t.events.select("event_id", K.source_version(lsn, tx).cast("long").alias("v"))


@query("f34_cursor", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'js' WHEN 1 THEN 'rs' END AS kind, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 END::BIGINT AS ms, CASE WHEN event_id % 3 < 2 THEN event_id END AS seq FROM events")
def _(t):
    i = c("event_id").cast("string")
    cur = K.cursor(F.when(c("event_id") % 3 == 0, i).when(c("event_id") % 3 == 1, F.concat(F.lit("rs:5-"), i)).otherwise("kf:1"))
    return t.events.select("event_id", cur["kind"].alias("kind"), cur["ms"].alias("ms"), cur["seq"].alias("seq"))


@query("f35_glob", "SELECT page_id FROM pages WHERE url GLOB '*/p?1*' OR regexp_matches(url, '^http.*1.$')")
def _(t):
    return t.pages.where(c("url").rlike(K.glob_regex("*/p?1*")) | c("url").rlike(K.glob_regex("http*1?"))).select("page_id")


@query("f08_current_row", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'old' WHEN event_type = 'signup' THEN 'payload' ELSE 'new' END AS r FROM events")
def _(t):
    op = F.when(c("event_type") == "error", "delete").when(c("event_type") == "signup", "insert").otherwise("update")
    return t.events.select("event_id", current_row(op, F.lit("new"), F.lit("old"), F.lit("payload")).alias("r"))


@query("f08_current_row_kinds", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'payload' WHEN 1 THEN 'new' WHEN 2 THEN 'payload' WHEN 3 THEN 'old' END AS r FROM events")
def _(t):
    """An insert, an update with and without ``new``, a delete, a truncate."""
    op = F.element_at(F.array(*map(F.lit, ("insert", "update", "update", "delete", "truncate"))), (c("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", current_row(op, F.when(c("event_id") % 5 == 1, "new"), F.lit("old"), F.lit("payload")).alias("r"))


@query("f19_projection", "SELECT c_name, c_custkey FROM customer")
def _(t):
    have = t.customer
    return have.select(*K.project(have.columns, ["c_name", "no_such", "c_custkey"]))


@query("f16_bson_values", "SELECT event_id, '{\"id\":\"' || lpad(CAST(event_id AS VARCHAR), 24, '0') || '\",\"at\":\"' || strftime(epoch_ms(event_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '\",\"p\":\"1.50\",\"n\":[' || user_id || ',2],\"s\":{\"t\":' || event_id || ',\"i\":1},\"x\":\"y\"}' AS doc FROM events")
def _(t):
    i = c("event_id").cast("string")
    doc = F.concat(F.lit('{"id":{"$oid":"'), F.lpad(i, 24, "0"), F.lit('"},"at":{"$date":{"$numberLong":"'), i, F.lit('000000"}},"p":{"$numberDecimal":"1.50"},"n":[{"$numberLong":"'), c("user_id").cast("string"), F.lit('"},2],"s":{"$timestamp":{"t":'), i, F.lit(',"i":1}},"x":"y"}'))
    keys = lambda x: F.from_json(x, "struct<id:string,at:string,p:string,n:array<long>,s:struct<t:long,i:long>,x:string>")
    return t.events.select("event_id", F.to_json(keys(bson_document(doc))).alias("doc"))


@query("f17_bolt_values", "SELECT event_id, 'P' || (60 + event_id % 7) || 'DT' || (event_id % 90000 // 3600) || 'H' || (event_id % 90000 % 3600 // 60) || 'M' || (event_id % 60) || 'S' AS d, '[' || (event_id % 256) || ',255]' AS b FROM events")
def _(t):
    d = bolt_duration(F.lit(2), c("event_id") % 7, c("event_id") % 90000)
    raw = F.unhex(F.concat(F.lpad(F.hex(c("event_id") % 256), 2, "0"), F.lit("FF")))
    return t.events.select("event_id", d.alias("d"), F.to_json(bolt_bytes(raw)).alias("b"))
