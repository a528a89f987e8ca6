"""The engine's operators on literal cases, and every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import json
from urllib.parse import quote

import duckdb
import pytest
from pyspark.sql import functions as F

from deltaloom.functions import keys as K
from deltaloom.operators import changelog as L
from deltaloom.operators import compose as C
from deltaloom.operators import graph as G
from deltaloom.operators import realtime as T
from deltaloom.operators import search as S
from deltaloom.operators import sinks
from deltaloom.plans import registry
from deltaloom.sources import changes
from deltaloom.streaming import driver

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in got), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def shop(spark, orders, customers):
    return {"orders": spark.createDataFrame(orders, "id int, customer_id string, code string"), "customers": spark.createDataFrame(customers, "id int, name string, code string")}


JOIN = C.Join("orders", ("id",), (C.Relation("customers", "customer", (("customer_id", "id"),), ("name",)), C.Relation("customers", "coupons", (("code", "code"),), ("name",), many=True, sort_by="name")))


def test_compose_hand_cases(spark):
    t = shop(spark, [(1, "5", "x"), (2, "9", None), (3, None, "x")], [(5, "ann", "x"), (6, "bob", None), (7, None, "x")])
    got = {r.id: r for r in C.compose(JOIN, t).collect()}
    assert got[1].customer.name == "ann" and got[2].customer is None and got[3].customer is None
    assert [x.name for x in got[1].coupons] == [None, "ann"] and got[2].coupons == []
    assert got[1].doc_id == 'orders:["1"]'


def test_reparent_touches_old_and_new(spark):
    t = shop(spark, [(1, "5", "old"), (2, "5", "new"), (3, "5", "other")], [(5, "ann", "new")])
    changed = spark.createDataFrame([(5, "ann", "old"), (5, "ann", "new")], "id int, name string, code string")
    assert {r.id for r in C.affected(C.Join("orders", ("id",), JOIN.relations[1:]), t, {"customers": changed}).collect()} == {1, 2}


def test_delete_then_reinsert_is_no_tombstone(spark):
    t = shop(spark, [(1, "5", None)], [])
    docs, gone = C.recompose(JOIN, t, spark.createDataFrame([(1,), (2,)], "id int"))
    assert [r.id for r in docs.collect()] == [1] and [r.doc_id for r in gone.collect()] == ['orders:["2"]']


def test_spec_refuses_unknown_fields():
    ok = C.spec({"primary": "a", "key": ["id"], "relations": [{"table": "b", "embed_as": "b", "on": [["x", "y"]], "cardinality": "many"}]})
    assert ok.relations[0].many
    for bad in ({"primary": "a", "key": ["id"], "zz": 1}, {"primary": "a", "key": ["id"], "relations": [{"table": "b", "embed_as": "b", "on": [["x", "y"]], "zz": 1}]}):
        with pytest.raises(ValueError, match="unknown"):
            C.spec(bad)


def test_versions(spark):
    rows = spark.createDataFrame([("a", 9, "delete", 1), ("a", 8, "update", 2), ("b", 7, "update", 1), ("b", 7, "insert", 2)], "k string, v int, op string, n int")
    got = {r.k: (r.v, r.op) for r in L.last_writer(rows, ["k"], "v", "n").collect()}
    assert got == {"a": (9, "delete"), "b": (7, "insert")}
    assert {r.k for r in L.live(L.last_writer(rows, ["k"], "v", "n")).collect()} == {"b"}


def test_partial_update_keeps_absent_and_sets_null(spark):
    rows = spark.createDataFrame([("a", 1, {"x": "1", "y": "big"}), ("a", 2, {"x": "2"}), ("a", 3, {"x": None})], "k string, n int, row map<string,string>")
    assert L.merge_present(rows, ["k"], "n").first().row == {"x": None, "y": "big"}


def test_paths():
    assert G.parse_path("(p)-[:A|B]->(x:L)<-[:C]-(y)") == [(["A", "B"], "out"), (["C"], "in")]
    for bad in ("(x)-[:A]->(y)", "(p)-[:A*1..3]->(y)", "(p)", "(p)<-[:A]->(y)"):
        with pytest.raises(ValueError):
            G.parse_path(bad)


def test_query_strings():
    for bad in ("(a", "a)", "AND b", "NOT"):
        with pytest.raises(ValueError):
            S.compile_query(bad, ["text"])


def test_query_string_results(spark):
    docs = spark.createDataFrame([("1", "the quick fox", 5), ("2", "slow fox", 15), ("3", None, 25)], "doc_id string, text string, n int")
    ids = lambda q: [r.doc_id for r in S.search(docs, q, ["text"]).collect()]
    assert ids("fox AND NOT slow") == ["1"] and ids('"quick fox"') == ["1"] and ids("qui*") == ["1"] and ids("n:[10 TO *]") == ["2", "3"] and ids("slow quick") == ["1", "2"] and ids("") == ["1", "2", "3"]


def test_patterns_and_templates():
    with pytest.raises(ValueError):
        T.pattern_regex("a.>.b")
    assert K.expand("o.{args.id}.{open", {"id": "7"}) == "o.7.{open"
    with pytest.raises(KeyError):
        K.expand("{args.x}", {})
    assert K.parse_sort("a:desc") == ("a", True) and K.parse_sort("a") == ("a", False)
    with pytest.raises(ValueError):
        K.key_template("fixed", F, "v", {})
    sdl = 'type Order { id: ID! state: String @source(from: "$data.to") }\ntype Subscription {\n  order(orderId: ID): Order! @subscribe(subject: "order.{args.orderId}")\n}'
    assert T.parse_sdl(sdl) == [{"name": "order", "args": {"orderId": "ID"}, "returns": "Order", "subject": "order.{args.orderId}", "fields": {"id": "$data.id", "state": "$data.to"}}]


def test_writer_helpers():
    assert sinks.split_oversize([5, 5, 50, 5], 12) == ([[0, 1], [3]], [2])
    assert [sinks.backoff(i) for i in (0, 1, 20)] == [0.1, 0.2, 30.0]
    assert sinks.view_digest([{"a": 1}, {"b": 2}]) == sinks.view_digest([{"b": 2}, {"a": 1}])
    assert changes.ddl_tables("ALTER TABLE `shop`.`orders` ADD x int; drop table if exists t2") == ["shop.orders", "t2"]


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type")
    src, target, ck, dlq = (str(tmp_path / x) for x in ("src", "target", "ck", "dlq"))
    good = F.col("event_type") != "error"
    for part in range(3):
        events.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(src)
        q = driver.upsert_stream(driver.read_changes(spark, src, events.schema), target, ck, ["user_id"], "event_id", dlq, good)
        q.awaitTermination()
    got = {tuple(r) for r in driver.snapshot(spark, target, events.schema).collect()}
    assert got == {tuple(r) for r in L.last_writer(events.where(good).withColumn("n", F.lit(0)), ["user_id"], "event_id", "n").select("user_id", "event_id", "event_type").collect()}
    assert spark.read.json(f"{dlq}/batch=*").count() == events.where(~good).count()


def test_json_and_times(spark):
    r = spark.createDataFrame([(datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5, 600))], "a timestamp, b timestamp").select(K.datetime_text(F.col("a")), K.datetime_text(F.col("b"))).first()
    assert tuple(r) == ("2024-01-02", "2024-01-02T03:04:05.000600")
    j = C.Join("a", ("id",), (C.Relation("b", "b", (("id", "id"),), ("x",), on_missing="empty_object"), C.Relation("b", "c", (("id", "id"),), ("x",))))
    t = {"a": spark.createDataFrame([(1,)], "id int"), "b": spark.createDataFrame([], "id int, x int")}
    assert json.loads(C.documents_json(C.compose(j, t), j).first().doc) == {"id": 1, "b": {}, "c": None}


def test_percent_encode_takes_whole_texts(spark, tmp_path):
    texts = {1: "ab ~*-._é☃\n" * 5000, 2: "", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.enc for r in registry.QUERIES["f10_percent_encode_whole"](spark, str(tmp_path)).collect()}
    assert got == {d: t if t is None else quote(t, safe="-._~") for d, t in texts.items()}


def test_all_orders_and_events_take_part(spark, duck):
    n = lambda name: registry.QUERIES[name](spark, SF).count()
    orders = duck.execute("select count(*) from orders").fetchone()[0]
    assert n("j42_high_water_all") == n("j22_backfill_all") == orders
    assert n("j23_batched_lookup_all") == duck.execute("select count(*) from customer where c_custkey in (select o_custkey from orders)").fetchone()[0]
    assert n("g09_coalesced_poll_all") == duck.execute("select count(distinct user_id) from events").fetchone()[0]


def test_related_rows_join_by_their_merged_key(spark, tmp_path):
    spark.createDataFrame([(3,), (9,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    # user 1 moves from 3 to 9 and keeps it in a change without the key; user 2 sets it to null; user 3 never has one
    changes = [(3, 1, "x"), (9, 1, "y"), (10, 1, "z"), (103, 2, "x"), (303, 2, "x"), (306, 2, "y"), (4, 3, "x"), (603, 4, "w")]
    spark.createDataFrame(changes, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.doc_id: r.related for r in registry.QUERIES["j14_related_merge_compose"](spark, str(tmp_path)).collect()}
    assert got == {'customer:["3"]': "4-w", 'customer:["9"]': "1-z"}


SHOP = C.Join("orders", ("id",), (C.Relation("customers", "customer", (("customer_id", "id"),), ("id", "name")), C.Relation("items", "items", (("id", "order_id"),), ("sku", "n"), many=True, sort_by="sku", tie=("n",)), C.Relation("customers", "coupons", (("code", "code"),), ("name",), many=True, sort_by="name")))
SHOP_SCHEMAS = {"orders": "id int, customer_id int, code string", "customers": "id int, name string, code string", "items": "id int, order_id int, sku string, n int"}


def random_changes(r, n, version):
    out = []
    for i in range(n):
        table = r.choice(["orders", "orders", "customers", "items", "items"])
        k = r.randrange(12)
        row = {"orders": {"id": k, "customer_id": r.choice([None, *range(6)]), "code": r.choice([None, "a", "b"])}, "customers": {"id": k % 6, "name": r.choice(["ann", "bob", None]), "code": r.choice([None, "a", "b"])}, "items": {"id": k, "order_id": r.randrange(12), "sku": r.choice("xyz"), "n": r.randrange(3)}}[table]
        op = r.choice(["insert", "update", "update", "delete"]) if r.random() < 0.97 else "truncate"
        out.append((table, op, version + i, json.dumps({"id": row["id"]} if op == "delete" else row)))
    return out


def replayed(changes):
    state = {t: {} for t in SHOP_SCHEMAS}
    for table, op, _, row in sorted(changes, key=lambda c: c[2]):
        row = json.loads(row)
        if op == "truncate":
            state[table] = {}
        elif op == "delete":
            state[table].pop(row["id"], None)
        else:
            state[table][row["id"]] = row
    return state


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_composition_equals_the_batch_after_each_batch_and_a_restart(spark, tmp_path, seed):
    import random

    from deltaloom.streaming.incremental import Composer

    r = random.Random(seed)
    keys = {t: ["id"] for t in SHOP_SCHEMAS}
    schema = "table string, op string, version long, row string"
    src, target, log = str(tmp_path / "src"), {}, []

    def sink(out, n):
        for x in out.collect():
            target.pop(x.doc_id, None)
            if x.op == "upsert":
                target[x.doc_id] = json.loads(x.doc)

    for part in range(3):
        new = random_changes(r, 25, 100 * part)
        log += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(src)
        composer = Composer(spark, SHOP, SHOP_SCHEMAS, keys, str(tmp_path / "state"), buckets=4)  # a new one: a restart
        composer.run(driver.read_changes(spark, src, schema), str(tmp_path / "ck"), sink).awaitTermination()
        state = replayed(log)
        tables = {t: spark.createDataFrame([tuple(x.get(f.split()[0]) for f in SHOP_SCHEMAS[t].split(", ")) for x in state[t].values()], SHOP_SCHEMAS[t]) for t in SHOP_SCHEMAS}
        want = {x.doc_id: json.loads(x.doc) for x in C.documents_json(C.compose(SHOP, tables), SHOP).collect()}
        assert target == want
    again = dict(target)
    sink(composer.batch(spark.createDataFrame(new, schema), 2), 2)  # the last batch once more, as after a failure
    assert target == again


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    from deltaloom.streaming.store import Store

    store = Store(spark, str(tmp_path), 8)
    for n in range(4):
        rows = spark.createDataFrame([(n, n)] if n else [(k, -1) for k in range(40)], "k int, v int")
        m = store.manifest(n)
        where = store.touched(rows, "k")
        old = store.read(m, "t", "k int, v int", where).join(rows, "k", "left_anti")
        store.write(m, "t", old.select("k", "v").unionByName(rows), where, n, "k")
        store.commit(m, n)
        assert n == 0 or len(where) == 1 and sum(b == n for b in m["t"].values()) == 1
    assert {(x.k, x.v) for x in store.read(store.manifest(), "t", "k int, v int").collect()} == {(k, k if 0 < k < 4 else -1) for k in range(40)}
    assert store.versions() == [2, 3]


def test_point_look_ups_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/orders.parquet").withColumn("doc_id", K.doc_id("orders", F.col("o_orderkey")))
    one = S.get_entity(docs, 'orders:["42"]', ["o_orderkey"])
    assert "EqualTo(o_orderkey,42)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == S.get_entity(docs, 'orders:["42"]').count()
    for bad in ('orders:["042"]', 'orders:["x"]', "orders:[42]", "orders", 'orders:["1","2"]'):
        assert S.get_entity(docs, bad, ["o_orderkey"]).count() == 0


def test_unknown_fields_match_nothing(spark):
    docs = spark.createDataFrame([("1", "a fox")], "doc_id string, text string")
    assert S.search(docs, "colour:red", ["text"]).count() == 0 and S.search(docs, "colour:red OR fox", ["text"]).count() == 1


def test_bad_index_names_are_errors(spark):
    df = spark.createDataFrame([("_x",), ("ok",)], "u string").select(K.index_name("${header:u}", F.lit("a.b"), F.current_timestamp(), {"u": F.col("u")}).alias("ix"))
    with pytest.raises(Exception, match="bad index name"):
        df.collect()


def test_yaml_specs(tmp_path):
    (tmp_path / "t").write_text("shop-v2\n")
    text = f"version: 1\njoins:\n- primary: orders\n  key: [id]\n  target: file:{tmp_path}/t\n  name: env:WHO\n"
    got = C.load_spec(text, {"WHO": "me"})
    assert (got[0].target, got[0].name, got[0].key) == ("shop-v2", "me", ("id",))
    for bad in (text, text.replace("version: 1", "version: 2"), text + "other: 1\n"):
        with pytest.raises(ValueError):
            C.load_spec(bad, {} if bad == text else {"WHO": "me"})


def test_projection_texts():
    assert G.check_projection("MATCH (p) RETURN elementId(p) AS primaryEid, {a: 'SET x'} AS doc // DELETE") == []
    assert G.check_projection("MATCH (p) SET p.x = 1 RETURN p AS doc") == ["write keyword SET", "no column primaryEid"]
    assert G.hop_report(["(p)-[:A]->(x)-[:B]->(y)"], 1)["warning"] and not G.hop_report(["(p)-[:A]->(x)"], 1)["warning"]


def test_ddl_of_several_tables():
    assert changes.ddl_tables("DROP TABLE a, `s`.`b`; RENAME TABLE c TO d, e TO f; TRUNCATE TABLE g") == ["a", "s.b", "c", "d", "e", "f", "g"]


def test_table_schemas(spark):
    rows = [("t", "b", 2, "int", 1, None), ("t", "a", 1, "longtext", None, "json_valid(`a`)"), ("t", "c", 3, "json", 0, None), ("u", "x", 1, "int", None, None)]
    got = {r.table: (r.columns, r.key, r.json) for r in changes.table_schemas(spark.createDataFrame(rows, "table string, column string, ordinal int, type string, key_ordinal int, check string")).collect()}
    assert got == {"t": (["a", "b", "c"], ["c", "b"], ["a", "c"]), "u": (["x"], [], [])}


def test_precise_rejection(spark):
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "offset long")
    why = lambda d, n: L.precise_rejection(d, n, 0, 9).first().why
    assert (why(df(1, 2), 2), why(df(1, 2), 3), why(df(1, 1), 2), why(df(1, 12), 2)) == (None, "count", "repeated", "range")


def test_batches_by_age(spark):
    rows = spark.createDataFrame([(i, "a", 1, datetime.datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate((0, 3, 9, 10, 11, 30))], "n int, lane string, b int, at timestamp")
    assert [r.batch for r in L.sized_batches(rows, "n", ["lane"], 3, 100, "b", "at", 10).orderBy("n").collect()] == [0, 0, 0, 1, 1, 2]


def sized(rows, size, most, age=None):
    """The batches of one lane, by a plain loop; None is an unknown size."""
    out, k, n, held, first = [], 0, 0, 0, None
    for b, t in rows:
        if n and (n >= size or (None not in (held, b) and held + b > most) or (age is not None and t - first >= age)):
            k, n = k + 1, 0
        held, first = (b, t) if not n else (None if None in (held, b) else held + b, first)
        n += 1
        out.append(k)
    return out


def test_long_lanes_are_batched_in_one_pass(spark):
    """Lanes longer than an Arrow batch, with rows above the bound and unknown sizes; no lane is gathered in one value."""
    i = F.col("n")
    rows = spark.range(50_000).withColumnRenamed("id", "n").select("n", (i % 2).alias("lane"), F.when(i % 97 > 0, i * 7919 % 331).alias("b"), F.timestamp_seconds(i * i % 7 + i).alias("at"))
    for at, age in ((None, None), ("at", 40)):
        got = L.sized_batches(rows, "n", ["lane"], 50, 3000, "b", at, age)
        assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
        found = {r.n: r.batch for r in got.select("n", "batch").collect()}
        for lane in (0, 1):
            ns = range(lane, 50_000, 2)
            assert [found[n] for n in ns] == sized([(n * 7919 % 331 if n % 97 else None, n * n % 7 + n) for n in ns], 50, 3000, age)


def test_sized_batches_keep_every_row(spark):
    """A null lane is a lane, equal orders are rows of their own, a null order is the last; other columns pass."""
    rows = spark.createDataFrame([(None, 1, 5, "a"), (None, 2, 5, "b"), ("x", 1, 4, "c"), ("x", 1, 3, "d"), ("x", None, 1, "e"), ("x", 2, 9, "f")], "lane string, n int, b int, v string")
    got = L.sized_batches(rows, "n", ["lane"], 2, 100, "b")
    assert got.columns == ["lane", "n", "b", "v", "batch"]
    assert {r.v: r.batch for r in got.collect()} == {"a": 0, "b": 0, "d": 0, "c": 0, "f": 1, "e": 1}
    assert L.sized_batches(rows.where("n > 9"), "n", ["lane"], 2, 100, "b").collect() == []


def test_durable_prefix_of_one_stream(spark):
    rows = spark.createDataFrame([(3, True), (1, True), (2, True), (5, False), (4, True), (6, True)], "n int, ok boolean").withColumn("w", F.col("n") * 10)
    assert L.durable_prefix(rows, "n", "ok", "w").first().watermark == 40
    assert L.durable_prefix(rows.where("ok"), "n", "ok", "w").first().watermark == 60
    assert L.durable_prefix(rows.where("not ok"), "n", "ok", "w").first().watermark is None


def test_event_ids_sort_by_time(spark):
    rows = [(datetime.datetime(2024, 1, 1, 0, 0, 0, 1000 * i), i % 2) for i in range(1, 40)]
    got = [r[0] for r in spark.createDataFrame(rows, "at timestamp, k int").select(K.event_id(F.col("at"), F.col("k"))).collect()]
    assert got == sorted(got) and len(set(got)) == 39 and all(len(x) == 26 and set(x) <= set("0123456789ABCDEFGHJKMNPQRSTVWXYZ") for x in got)
    at = int(rows[0][0].replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert sum("0123456789ABCDEFGHJKMNPQRSTVWXYZ".index(c) * 32 ** (9 - i) for i, c in enumerate(got[0][:10])) == at


def test_logical_replication_rows(spark):
    lines = ['{"action":"B","xid":7}', '{"action":"I","xid":7,"lsn":"0/1","schema":"s","table":"t","columns":[{"name":"id","value":1},{"name":"a","value":null}]}', '{"action":"U","schema":"s","table":"t","columns":[{"name":"id","value":2}],"identity":[{"name":"id","value":1}]}', '{"action":"D","schema":"s","table":"t","identity":[{"name":"id","value":2}]}', '{"action":"T","schema":"s","table":"t"}', '{"action":"M"}']
    got = [(r.action, r.op, r.row, r.old, r.tx_id) for r in changes.wal2json(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("B", None, None, None, 7), ("I", "insert", '{"id":1,"a":null}', None, 7), ("U", "update", '{"id":2}', '{"id":1}', None), ("D", "delete", None, '{"id":2}', None), ("T", "truncate", None, None, None), ("M", None, None, None, None)]


def test_graph_changes(spark):
    lines = ['{"elementId":"n1","eventType":"n","operation":"u","state":{"before":{"labels":["A"],"properties":{"x":1}},"after":{"labels":["A","B"],"properties":{"x":2}}}}', '{"elementId":"e1","eventType":"r","operation":"d","type":"T","start":{"elementId":"n1"},"end":{"elementId":"n2"},"state":{"before":{"properties":{}}}}', '{"elementId":"n2","eventType":"n","operation":"zz"}']
    nodes, edges = changes.graph_cdc(spark.createDataFrame([(x,) for x in lines], "event string"))
    assert [(r.id, r.op, r.labels, r.properties) for r in nodes.collect()] == [("n1", "update", ["A", "B"], '{"x":2}')]
    assert [(r.id, r.op, r.type, r.src, r.dst) for r in edges.collect()] == [("e1", "delete", "T", "n1", "n2")]


def test_confirmed_position_and_counters(spark):
    barriers = spark.createDataFrame([(1, "a:10"), (5, "a:90"), (9, "b:4")], "seq int, position string")
    assert [L.confirmed_position(barriers, n).first().position for n in (0, 5, 8, 9)] == [None, "a:90", "a:90", "b:4"]
    from pyspark.sql import Observation

    seen = Observation("o")
    barriers.observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get == {"rows": 3} and driver.counted(barriers, "n", late="seq > 4").count() == 3


def test_view_drift(spark):
    from deltaloom.operators import reconcile

    values = spark.createDataFrame([("k1",), ("k2",), ("k5",)], "key string")
    manifests = spark.createDataFrame([("s1", "k1"), ("s1", "k3"), ("s2", "k2"), ("s3", None)], "source string, key string")
    owners = spark.createDataFrame([("k1", "s1"), ("k2", "s9"), ("k4", "s1")], "key string, source string")
    got = reconcile.view_drift(values, manifests, owners, values.limit(0)).first().asDict()
    assert got == {"missing_values": 1, "missing_owners": 1, "owner_mismatches": 1, "orphan_owners": 1, "unowned_values": 1, "incomplete_manifests": 1, "staging_keys": 0}


def test_ranges_of_time(spark):
    docs = spark.range(3).select(F.col("id").cast("string").alias("doc_id"), (F.current_timestamp() - F.expr("INTERVAL '1' HOUR") * F.col("id")).alias("at"))
    assert [r.doc_id for r in S.search(docs, "at:[now-90m TO *]", []).collect()] == ["0", "1"]
    assert [r.doc_id for r in S.search(docs, "at:[* TO now-1w]", []).collect()] == []


def test_bson_documents_of_any_depth(spark):
    doc = {"a": [{"b": {"c": [{"$oid": "0f"}, {"$date": {"$numberLong": "-1"}}, {"$numberDouble": "-1.5E3"}, {"$numberLong": "-007"}, {"$numberInt": "00"}, {"$date": {"$numberLong": "0000"}}]}}], "s": '{"$oid":"x"}', "{": {"$date": {"$numberLong": str(-(2**63))}}, "n": {"$numberDouble": "NaN"}, "t": {"$timestamp": {"t": 7, "i": 1}}, "r": {"$date": "2024-01-01T00:00:00Z"}, "x": {"$oid": "1", "y": 2}}
    want = {"a": [{"b": {"c": ["0f", "1969-12-31T23:59:59.999Z", -1500.0, -7, 0, "1970-01-01T00:00:00Z"]}}], "s": '{"$oid":"x"}', "{": {"$date": -(2**63)}, "n": None, "t": {"t": 7, "i": 1}, "r": "2024-01-01T00:00:00Z", "x": {"$oid": "1", "y": 2}}
    df = spark.createDataFrame([(json.dumps(doc),), (json.dumps(doc, separators=(",", ":")),)], "doc string").select(changes.bson_document(F.col("doc")).alias("x"))
    assert [json.loads(r.x) for r in df.collect()] == [want, want]
    assert spark.createDataFrame([(None,), ("",), ("not {json",)], "doc string").select(changes.bson_document(F.col("doc")).alias("x")).collect() == [(None,), ("",), ("not {json",)]


def test_bson_document_is_read_in_few_passes(spark):
    """The text is one operand of the expression; it was parsed again for each member and marker."""
    df = spark.createDataFrame([("{}",)], "doc string").where("length(doc) > 1").select(changes.bson_document(F.col("doc")).alias("x"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.split("Filter")[0].count("doc#") == 1 and "from_json" not in plan
