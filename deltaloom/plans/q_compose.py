"""Queries of composition and incremental recomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import doc_id
from ..operators import changelog as L
from ..operators import compose as C
from ..operators.search import containing
from .registry import query

c = F.col
CUSTOMER = C.Relation("customer", "customer", (("o_custkey", "c_custkey"),), ("c_custkey", "c_name", "c_mktsegment"))
ITEMS = C.Relation("lineitem", "items", (("o_orderkey", "l_orderkey"),), ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), many=True, sort_by="l_linenumber", tie=("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
ORDERS = C.Join("orders", ("o_orderkey",), (CUSTOMER, ITEMS), ("o_orderkey", "o_custkey", "o_orderstatus"))
ITEM_SQL = "SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || '-' || l_partkey || '-' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS items FROM lineitem GROUP BY l_orderkey"
FULL_SQL = f"SELECT 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) AS doc_id, o_orderstatus, c_name AS customer_name, c_mktsegment AS segment, coalesce(n, 0)::INTEGER AS n_items, coalesce(items, '') AS items FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN ({ITEM_SQL}) ON l_orderkey = o_orderkey"


def flat(docs):
    item = lambda x: F.concat_ws("-", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))
    return docs.select("doc_id", "o_orderstatus", c("customer.c_name").alias("customer_name"), c("customer.c_mktsegment").alias("segment"), F.size("items").alias("n_items"), F.array_join(F.transform("items", item), ",").alias("items"))


def sides(t):
    return {"orders": t.orders, "customer": t.customer, "lineitem": t.lineitem}


@query("j01_primary_compose", FULL_SQL)
def _(t):
    return flat(C.compose(ORDERS, sides(t)))


@query("j02_embed_one", "SELECT c_custkey, first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def _(t):
    rel = C.Relation("orders", "o", (("c_custkey", "o_custkey"),), ("o_orderkey",))
    return C.compose(C.Join("customer", ("c_custkey",), (rel,)), {"customer": t.customer, "orders": t.orders}).select("c_custkey", c("o.o_orderkey").alias("first_order"))


@query("j03_embed_many", "SELECT o_orderkey, count(l_orderkey)::INTEGER AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(t):
    return C.compose(C.Join("orders", ("o_orderkey",), (ITEMS,)), sides(t)).select("o_orderkey", F.size("items").alias("n"))


@query("j04_embed_select", "SELECT o_orderkey, '{\"c_name\":\"' || c_name || '\"}' AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    rel = C.Relation("customer", "customer", (("o_custkey", "c_custkey"),), ("c_name", "no_such"))
    return C.compose(C.Join("orders", ("o_orderkey",), (rel,)), sides(t)).select("o_orderkey", F.to_json("customer").alias("customer"))


for _mode, _sql in (("first", "NULLS FIRST"), ("last", "NULLS LAST")):

    @query(f"j05_sort_by_nulls_{_mode}" if _mode == "first" else "j31_sql_order_nulls_last", f"SELECT n_nationkey, string_agg(coalesce(CAST(b AS VARCHAR), '-'), ',' ORDER BY b {_sql}, c_custkey) AS s FROM nation JOIN (SELECT *, nullif(c_custkey % 4, 0) AS b FROM customer) ON c_nationkey = n_nationkey GROUP BY n_nationkey")
    def _(t, mode=_mode):
        rows = t.customer.withColumn("b", F.nullif(c("c_custkey") % 4, F.lit(0)))
        rel = C.Relation("customer", "cs", (("n_nationkey", "c_nationkey"),), ("c_custkey", "b"), many=True, sort_by="b", tie=("c_custkey",), nulls=mode)
        docs = C.compose(C.Join("nation", ("n_nationkey",), (rel,)), {"nation": t.nation, "customer": rows}).where(F.size("cs") > 0)
        return docs.select("n_nationkey", F.array_join(F.transform("cs", lambda x: F.coalesce(x["b"].cast("string"), F.lit("-"))), ",").alias("s"))


@query("j06_on_missing", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN '{\"r_name\":\"' || r_name || '\"}' ELSE '{}' END AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def _(t):
    join = C.Join("nation", ("n_nationkey",), (C.Relation("region", "region", (("n_regionkey", "r_regionkey"),), ("r_name",), on_missing="empty_object"),), ("n_nationkey",))
    docs = C.documents_json(C.compose(join, {"nation": t.nation, "region": t.region.where("r_regionkey = 1")}), join)
    body = F.parse_json("doc")
    return docs.select(F.try_variant_get(body, "$.n_nationkey", "int").alias("n_nationkey"), F.to_json(F.try_variant_get(body, "$.region", "variant")).alias("region"))


@query("j07_composite_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a JOIN lineitem b USING (l_orderkey, l_linenumber) GROUP BY ALL")
def _(t):
    rel = C.Relation("lineitem", "xs", (("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")), ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), many=True)
    docs = C.compose(C.Join("keys", ("l_orderkey", "l_linenumber"), (rel,)), {"keys": t.lineitem.select("l_orderkey", "l_linenumber").distinct(), "lineitem": t.lineitem})
    return docs.select("l_orderkey", "l_linenumber", F.size("xs").cast("long").alias("n"))


@query("j08_text_equality", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    rows = t.customer.withColumn("c_custkey", c("c_custkey").cast("string"))
    return C.compose(C.Join("orders", ("o_orderkey",), (CUSTOMER,)), {"orders": t.orders, "customer": rows}).select("o_orderkey", c("customer.c_name").alias("c_name"))


for _mode, _op in (("sql", "="), ("memory", "IS NOT DISTINCT FROM")):

    @query(f"j09_null_keys_{_mode}", f"SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT nullif(n_nationkey, 0) AS k, count(*)::INTEGER AS n FROM nation GROUP BY 1) ON k {_op} nullif(o_custkey % 10, 0)" if _mode == "memory" else "SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT n_nationkey AS k, 1::INTEGER AS n FROM nation WHERE n_nationkey <> 0) ON k = nullif(o_custkey % 10, 0)")
    def _(t, mode=_mode):
        orders = t.orders.withColumn("fk", F.nullif(c("o_custkey") % 10, F.lit(0)))
        nation = t.nation.withColumn("k", F.nullif("n_nationkey", F.lit(0)))
        docs = C.compose(C.Join("orders", ("o_orderkey",), (C.Relation("nation", "x", (("fk", "k"),), ("n_name",), many=True, null_keys=mode),)), {"orders": orders, "nation": nation})
        return docs.select("o_orderkey", F.nullif(F.size("x"), F.lit(0)).alias("n"))


@query("j10_same_table_twice", "SELECT o_orderkey, b.c_name AS billing, s.c_name AS shipping FROM orders LEFT JOIN customer b ON b.c_custkey = o_custkey LEFT JOIN customer s ON s.c_custkey = (o_custkey * 7) % 1500")
def _(t):
    rows = t.orders.withColumn("ship", c("o_custkey") * 7 % 1500)
    rels = tuple(C.Relation("customer", name, ((k, "c_custkey"),), ("c_name",)) for name, k in (("billing", "o_custkey"), ("shipping", "ship")))
    return C.compose(C.Join("orders", ("o_orderkey",), rels), {"orders": rows, "customer": t.customer}).select("o_orderkey", c("billing.c_name").alias("billing"), c("shipping.c_name").alias("shipping"))


@query("j11_two_outputs", "SELECT 'a' AS target, 'nation:' || to_json([CAST(n_nationkey AS VARCHAR)]) AS doc_id FROM nation UNION ALL SELECT 'b', 'nation:' || to_json([CAST(n_nationkey AS VARCHAR)]) FROM nation")
def _(t):
    parts = [C.compose(C.Join("nation", ("n_nationkey",), (), (), name), {"nation": t.nation}).select("target", "doc_id") for name in "ab"]
    return parts[0].unionByName(parts[1])


@query("j12_join_on_other_column", "SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(t):
    names = t.nation.select(c("n_nationkey").alias("code"), "n_regionkey")
    rel = C.Relation("nation", "n", (("s_nationkey", "code"),), ("n_regionkey",))
    return C.compose(C.Join("supplier", ("s_suppkey",), (rel,)), {"supplier": t.supplier, "nation": names}).select("s_suppkey", c("n.n_regionkey").alias("n_regionkey"))


@query("j15_reverse_fan_out", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 1)")
def _(t):
    return C.affected(ORDERS, sides(t), {"customer": t.customer.where("c_custkey % 50 = 1")})


@query("j16_reparent", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 40 = 1 UNION SELECT c_custkey + 1 FROM customer WHERE c_custkey % 40 = 1)")
def _(t):
    old = t.customer.where("c_custkey % 40 = 1")
    return C.affected(ORDERS, sides(t), {"customer": old.unionByName(old.withColumn("c_custkey", c("c_custkey") + 1))})


@query("j17_delete_recovers_fk", "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_partkey % 97 = 3")
def _(t):
    deleted = t.lineitem.where("l_partkey % 97 = 3").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").drop("l_orderkey")
    prior = t.lineitem.join(deleted, deleted.columns, "left_semi")
    return C.affected(ORDERS, sides(t), {"lineitem": prior})


@query("j18_delete_tombstone", "SELECT 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) AS doc_id, 'delete' AS op FROM orders WHERE o_orderkey % 10 = 0")
def _(t):
    return C.tombstones(ORDERS, t.orders.where("o_orderkey % 10 = 0"))


@query("j19_primary_truncate", "SELECT 'nation:' || to_json([CAST(n_nationkey AS VARCHAR)]) AS doc_id FROM nation")
def _(t):
    return C.recompose(C.Join("nation", ("n_nationkey",)), {"nation": t.nation.limit(0)}, t.nation.select("n_nationkey"))[1]


@query("j20_related_truncate", "SELECT o_orderkey, 0::INTEGER AS n FROM orders")
def _(t):
    return C.compose(C.Join("orders", ("o_orderkey",), (ITEMS,)), {"orders": t.orders, "lineitem": t.lineitem.where("false")}).select("o_orderkey", F.size("items").alias("n"))


@query("j21_pass_through", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def _(t):
    return C.pass_through(t.events, ["click", "view"], "event_type").select("event_id")


@query("j23_batched_lookup", "SELECT k AS c_custkey, c_name FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 100 = 0) JOIN customer ON c_custkey = k")
def _(t):
    return C.fetch(CUSTOMER, t.customer, t.orders.where("o_orderkey % 100 = 0").select("o_custkey")).select("c_custkey", "c_name")


@query("j23_batched_lookup_all", "SELECT k AS c_custkey, c_name FROM (SELECT DISTINCT o_custkey AS k FROM orders) JOIN customer ON c_custkey = k")
def _(t):
    return C.fetch(CUSTOMER, t.customer, t.orders.select("o_custkey")).select("c_custkey", "c_name")


@query("j25_target_stamp", "SELECT 'orders-v2' AS target, count(*) AS n FROM orders")
def _(t):
    return C.compose(C.Join("orders", ("o_orderkey",), target="orders-v2"), sides(t)).groupBy("target").agg(F.count("*").alias("n"))


@query("j26_reemit_shape", "SELECT 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) AS doc_id, 'pg.shop.orders.update' AS subject, 'related' AS reason FROM orders WHERE o_custkey % 100 = 7")
def _(t):
    keys = C.affected(ORDERS, sides(t), {"customer": t.customer.where("c_custkey % 100 = 7")})
    return keys.select(doc_id("orders", c("o_orderkey")).alias("doc_id"), F.lit("pg.shop.orders.update").alias("subject"), F.lit("related").alias("reason"))


@query("j33_full_projection", "SELECT 'orders-v3' AS target, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, sum((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey))::BIGINT AS items FROM orders")
def _(t):
    """The bootstrap: every primary once, under the target's name, with all that it embeds."""
    docs = C.compose(C.Join("orders", ("o_orderkey",), (CUSTOMER, ITEMS), target="orders-v3"), sides(t))
    return docs.groupBy("target").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.sum(F.size("items")).cast("long").alias("items"))


@query("j32_json_document", "SELECT 'nation:' || to_json([CAST(n_nationkey AS VARCHAR)]) AS doc_id, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"suppliers\":[' || coalesce((SELECT string_agg('{\"s_suppkey\":' || s_suppkey || '}', ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') || ']}' AS doc FROM nation")
def _(t):
    rel = C.Relation("supplier", "suppliers", (("n_nationkey", "s_nationkey"),), ("s_suppkey",), many=True, sort_by="s_suppkey")
    return C.document_expression(C.Join("nation", ("n_nationkey",), (rel,), ("n_nationkey", "n_name")), {"nation": t.nation, "supplier": t.supplier})


@query("j40_truncate_rebuild", "SELECT 'nation:' || to_json([CAST(n_nationkey AS VARCHAR)]) AS doc_id, 'clear' AS op FROM nation UNION ALL SELECT 'nation:' || to_json([CAST(n_nationkey AS VARCHAR)]), 'upsert' FROM nation WHERE n_regionkey < 3")
def _(t):
    """The target is cleared of all that it had, then gets what the table has after its truncate."""
    join = C.Join("nation", ("n_nationkey",))
    cleared, docs = C.rebuild(join, C.compose(join, {"nation": t.nation}), {"nation": t.nation.where("n_regionkey < 3")})
    return cleared.unionByName(docs.select("doc_id", F.lit("upsert").alias("op")))


BACKFILL = "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey"


@query("j22_sync_on_miss", BACKFILL)
def _(t):
    """Half of the customers have been seen; the others are fetched."""
    seen = {"customer": sides(t)["customer"].where("c_custkey % 2 = 0")}
    return C.backfill(C.Join("orders", ("o_orderkey",), (CUSTOMER,)), sides(t), seen).select("o_orderkey", c("customer.c_name").alias("c_name"))


@query("j22_no_backfill", BACKFILL + " AND c_custkey % 2 = 0")
def _(t):
    seen = {"customer": sides(t)["customer"].where("c_custkey % 2 = 0")}
    return C.backfill(C.Join("orders", ("o_orderkey",), (CUSTOMER,)), sides(t), seen, "none").select("o_orderkey", c("customer.c_name").alias("c_name"))


@query("j34_affected_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey % 500 = 0 OR o_custkey % 300 = 1 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 800 = 5)")
def _(t):
    return C.affected(ORDERS, sides(t), {"orders": t.orders.where("o_orderkey % 500 = 0"), "customer": t.customer.where("c_custkey % 300 = 1"), "lineitem": t.lineitem.where("l_partkey % 800 = 5")})


@query("j35_reverse_lookup", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(t):
    join = C.Join("supplier", ("s_suppkey",), (C.Relation("nation", "n", (("s_nationkey", "n_nationkey"),)),))
    return C.affected(join, {"supplier": t.supplier, "nation": t.nation}, {"nation": t.nation.where("n_regionkey = 2")})


@query("j36_child_delete_lookup", "SELECT DISTINCT 'orders:' || to_json([CAST(l_orderkey AS VARCHAR)]) AS doc_id FROM lineitem WHERE l_partkey % 331 = 8")
def _(t):
    docs = C.compose(ORDERS, sides(t))
    return containing(docs, "items", t.lineitem.where("l_partkey % 331 = 8"), ["l_partkey"])


@query("j37_composite_child_lookup", "SELECT DISTINCT 'orders:' || to_json([CAST(a.l_orderkey AS VARCHAR)]) AS doc_id FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey % 700 = 1 AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)")
def _(t):
    return containing(C.compose(ORDERS, sides(t)), "items", t.lineitem.where("l_orderkey % 700 = 1"), ["l_partkey", "l_suppkey"])


@query("j38_recompose_keys", FULL_SQL + " WHERE o_orderkey % 20 = 3")
def _(t):
    return flat(C.recompose(ORDERS, sides(t), t.orders.where("o_orderkey % 20 = 3").select("o_orderkey"))[0])


@query("j39_tombstone_absent", "SELECT 'orders:' || to_json([CAST(-o_orderkey AS VARCHAR)]) AS doc_id FROM orders WHERE o_orderkey % 100 = 5")
def _(t):
    k = t.orders.where("o_orderkey % 100 = 5").select("o_orderkey")
    return C.recompose(ORDERS, sides(t), k.unionByName(k.select((-c("o_orderkey")).alias("o_orderkey"))))[1]


@query("j40_incremental_equals_full", FULL_SQL)
def _(t):
    """A base of older tables, then one delta: customers renamed, orders moved, items added; equals the full compose."""
    now = sides(t)
    old = {"orders": t.orders.where("o_orderkey % 13 <> 0").withColumn("o_custkey", F.when(c("o_orderkey") % 11 == 0, c("o_custkey") + 1).otherwise(c("o_custkey"))), "customer": t.customer.withColumn("c_name", F.when(c("c_custkey") % 17 == 0, "old").otherwise(c("c_name"))), "lineitem": t.lineitem.where("l_partkey % 19 <> 0")}
    changed = {"orders": t.orders.where("o_orderkey % 13 = 0 or o_orderkey % 11 = 0"), "customer": t.customer.where("c_custkey % 17 = 0"), "lineitem": t.lineitem.where("l_partkey % 19 = 0")}
    return flat(C.apply_changes(ORDERS, C.compose(ORDERS, old), now, C.affected(ORDERS, now, changed)))


@query("j41_key_change", "SELECT 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) AS doc_id, 'upsert' AS action FROM orders WHERE o_orderkey % 30 = 2 UNION ALL SELECT 'orders:' || to_json([CAST(o_orderkey + 1000000000 AS VARCHAR)]), 'delete' FROM orders WHERE o_orderkey % 30 = 2")
def _(t):
    moved = t.orders.where("o_orderkey % 30 = 2").select("o_orderkey", (c("o_orderkey") + 1000000000).alias("old"))
    keys = moved.select("o_orderkey").unionByName(moved.select(c("old").alias("o_orderkey")))
    docs, gone = C.recompose(ORDERS, sides(t), keys)
    return docs.select("doc_id", F.lit("upsert").alias("action")).unionByName(gone.withColumn("action", F.lit("delete")))


@query("j42_high_water", "SELECT 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) AS doc_id, (SELECT max(event_id) FROM events) AS lsn FROM orders WHERE o_orderkey % 50 = 0")
def _(t):
    return L.stamped(t.orders.where("o_orderkey % 50 = 0").select(doc_id("orders", c("o_orderkey")).alias("doc_id")), t.events, "event_id", "lsn")


@query("j42_high_water_all", "SELECT 'orders:' || to_json([CAST(o_orderkey AS VARCHAR)]) AS doc_id, (SELECT max(event_id) FROM events) AS lsn FROM orders")
def _(t):
    return L.stamped(t.orders.select(doc_id("orders", c("o_orderkey")).alias("doc_id")), t.events, "event_id", "lsn")


@query("j22_backfill", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 25 = 0")
def _(t):
    return C.compose(C.Join("orders", ("o_orderkey",), (CUSTOMER,)), sides(t), t.orders.where("o_orderkey % 25 = 0")).select("o_orderkey", c("customer.c_name").alias("c_name"))


@query("j22_backfill_all", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(t):
    return C.compose(C.Join("orders", ("o_orderkey",), (CUSTOMER,)), sides(t)).select("o_orderkey", c("customer.c_name").alias("c_name"))
