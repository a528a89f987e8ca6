"""Queries of graph projections. Edges: PLACED customer->order, LOCATED_IN supplier->nation, PART_OF nation->region, LIVES_IN customer->nation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import graph as G
from .registry import query

c = F.col


def edge(df, kind, a, pa, b, pb):
    src, dst = F.concat(F.lit(pa), c(a).cast("string")), F.concat(F.lit(pb), c(b).cast("string"))
    return df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), F.concat(F.lit(kind + "/"), src).alias("id"))


def edges(t) -> DataFrame:
    return reduce(DataFrame.unionByName, [edge(t.orders, "PLACED", "o_custkey", "c", "o_orderkey", "o").withColumn("id", F.concat(F.lit("PLACED/"), "dst")), edge(t.supplier, "LOCATED_IN", "s_suppkey", "s", "s_nationkey", "n"), edge(t.nation, "PART_OF", "n_nationkey", "n", "n_regionkey", "r"), edge(t.customer, "LIVES_IN", "c_custkey", "c", "c_nationkey", "n")])


EDGES = "(SELECT 'PLACED' AS type, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'LOCATED_IN', 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'PART_OF', 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'LIVES_IN', 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


def primaries(df, col, prefix):
    return df.select(F.concat(F.lit(prefix), c(col).cast("string")).alias("id"))


@query("g01_graph_projection", "SELECT 's' || s_suppkey AS p, string_agg('r' || n_regionkey, ',' ORDER BY n_regionkey) AS regions FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def _(t):
    paths = G.follow(primaries(t.supplier, "s_suppkey", "s"), edges(t), G.parse_path("(p)-[:LOCATED_IN]->(n)-[:PART_OF]->(r)"))
    return paths.groupBy("p").agg(F.array_join(F.array_sort(F.collect_set("n2")), ",").alias("regions"))


@query("g02_optional_path", "SELECT 'c' || c_custkey AS p, 'o' || o_orderkey AS n1 FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def _(t):
    return G.follow(primaries(t.customer, "c_custkey", "c"), edges(t), G.parse_path("(p)-[:PLACED]->(o)"))


@query("g03_within_hops", f"WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), w AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT e.b, depth + 1 FROM w JOIN e ON e.a = w.id WHERE depth < 2) SELECT id, min(depth)::INTEGER AS depth FROM w GROUP BY id")
def _(t):
    return G.within_hops(t.spark.createDataFrame([("r1",)], "id string"), edges(t), 2)


@query("g04_typed_fan_out", "SELECT 's' || s_suppkey AS p FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 3 OR n_nationkey = 4 OR s_suppkey = 7")
def _(t):
    changed = t.spark.createDataFrame([("r3",), ("LOCATED_IN/s7",), ("n4",)], "id string")
    return G.typed_fan_out(primaries(t.supplier, "s_suppkey", "s"), edges(t), G.parse_path("(p)-[:LOCATED_IN]->(n)-[:PART_OF]->(r)"), changed)


@query("g06_hot_endpoints", "SELECT 'LOCATED_IN' AS type, 'n' || s_nationkey AS id FROM supplier UNION SELECT 'PART_OF', 'r' || n_regionkey FROM nation UNION SELECT 'LIVES_IN', 'n' || c_nationkey FROM customer")
def _(t):
    return G.hot_endpoints(edges(t), 100)


@query("g07_hot_filter", "SELECT DISTINCT a AS anchor FROM (SELECT 'LOCATED_IN/s' || s_suppkey AS a FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)")
def _(t):
    e = edges(t)
    changed = e.where("type = 'LOCATED_IN'").join(t.supplier.where("s_suppkey % 10 = 0").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("src")), "src")
    return G.edge_anchors(changed, G.hot_endpoints(e, 100))


@query("g06_hot_paths", "SELECT 'LIVES_IN' AS type, 'dst' AS side, 'n' || c_nationkey AS id FROM customer UNION SELECT 'PLACED', 'src', 'c' || o_custkey FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderkey % 5)")
def _(t):
    """Few orders lead to few customers, which are far at src; PART_OF has both directions and is left out."""
    few = t.orders.groupBy((c("o_orderkey") % 5).alias("m")).agg(F.min("o_orderkey").alias("o_orderkey"))
    e = edges(t)
    a = G.hot_far_ends(primaries(few, "o_orderkey", "o"), e, [G.parse_path("(p)<-[:PLACED]-(c)")], 100)
    b = G.hot_far_ends(primaries(t.customer, "c_custkey", "c"), e, [G.parse_path("(p)-[:LIVES_IN]->(n)-[:PART_OF]->(r)"), G.parse_path("(p)-[:LIVES_IN]->(n)<-[:PART_OF]-(x)")], 100)
    return a.unionByName(b)


@query("g07_far_side", "SELECT DISTINCT a AS anchor FROM (SELECT 'PLACED/o' || o_orderkey AS a FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 50 = 0)")
def _(t):
    """The far end of an incoming hop is src; the near end stays though the same id is hot elsewhere."""
    e = edges(t).where("type = 'PLACED'")
    changed = e.join(t.orders.where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("dst")), "dst")
    hot = e.select("type", F.lit("src").alias("side"), F.col("src").alias("id")).unionByName(e.select(F.lit("OTHER").alias("type"), F.lit("dst").alias("side"), F.col("dst").alias("id"))).distinct()
    return G.edge_anchors(changed, hot)


@query("g08_recompose_by_id", "SELECT 's' || s_suppkey AS p, 'n' || s_nationkey AS n1 FROM supplier WHERE s_nationkey = 5")
def _(t):
    e = edges(t)
    hops = G.parse_path("(p)-[:LOCATED_IN]->(n)")
    all_ = primaries(t.supplier, "s_suppkey", "s")
    ids = G.typed_fan_out(all_, e, hops, t.spark.createDataFrame([("n5",)], "id string")).select(c("p").alias("id"))
    return G.follow(all_.join(ids, "id", "left_semi"), e, hops)


@query("g09_coalesced_poll", "SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0")
def _(t):
    return G.coalesced(t.events.where("event_id % 2 = 0"), "user_id", "event_id").select("user_id")


@query("g09_coalesced_poll_all", "SELECT DISTINCT user_id FROM events")
def _(t):
    return G.coalesced(t.events, "user_id", "event_id").select("user_id")


@query("g10_graph_tombstone", "SELECT 'supplier:s' || s_suppkey AS doc_id, 'delete' AS op FROM supplier WHERE s_suppkey % 9 = 0")
def _(t):
    return G.node_tombstones(primaries(t.supplier.where("s_suppkey % 9 = 0"), "s_suppkey", "s"), "supplier")


@query("g13_event_label", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'before' WHEN event_id % 3 = 1 THEN 'B' ELSE 'X' END AS label FROM events")
def _(t):
    top = F.when(c("event_id") % 3 == 0, F.array().cast("array<string>")).when(c("event_id") % 3 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("X")))
    return t.events.select("event_id", G.canonical_label(G.event_labels(top, F.array(F.lit("before"))), ["B", "C"]).alias("label"))


@query("s19_graph_bootstrap", f"SELECT 'node' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier) UNION ALL SELECT 'edge', count(*) FROM {EDGES}")
def _(t):
    nodes = t.customer.select(F.lit("node").alias("kind")).unionByName(t.supplier.select(F.lit("node").alias("kind")))
    return nodes.unionByName(edges(t).select(F.lit("edge").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("s20_canonical_label", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'P' ELSE 'Z' END AS label FROM orders")
def _(t):
    return t.orders.select("o_orderkey", G.canonical_label(F.array(F.lit("Z"), "o_orderstatus"), ["P", "Q"]).alias("label"))


@query("s21_label_table", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE lower(o_orderstatus) END AS tab FROM orders")
def _(t):
    return t.orders.select("o_orderkey", K.label_table(c("o_orderstatus"), {"P": "pending"}).alias("tab"))


@query("g14_fk_edges", "SELECT 'HAS/' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS src, CAST(nullif(o_custkey % 10, 0) AS VARCHAR) AS dst, CASE WHEN o_custkey % 10 = 0 THEN 'delete' ELSE 'upsert' END AS action FROM orders")
def _(t):
    e = G.fk_edges(t.orders.withColumn("fk", F.nullif(c("o_custkey") % 10, F.lit(0))), "o_orderkey", "fk", "HAS")
    return e.select(F.replace("id", F.lit(":"), F.lit("/")).alias("id"), "src", "dst", "action")
