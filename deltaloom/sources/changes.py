"""Change envelopes of several kinds as one change log: op, key, row, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEBEZIUM_OPS = {"c": "insert", "r": "insert", "u": "update", "d": "delete"}


def event_payload(op: Column, new: Column, old: Column, cascade: Column | None = None, restart: Column | None = None) -> Column:
    """Insert is the bare row, update {new,old}, delete {old}, truncate {cascade,restart_identity} (S08); ``new`` and ``old`` are JSON text."""
    flag = lambda x: F.coalesce(F.lit(False) if x is None else x, F.lit(False)).cast("string")
    cut = F.concat(F.lit('{"cascade":'), flag(cascade), F.lit(',"restart_identity":'), flag(restart), F.lit("}"))
    return F.when(op == "truncate", cut).otherwise(_row_payload(op, new, old))


def current_row(op: Column, new: Column, old: Column, payload: Column) -> Column:
    """The row that an event speaks of: an insert's payload, an update's ``new`` or else its whole payload, a delete's
    ``old``, nothing for a truncate (F08)."""
    return F.when(op == "insert", payload).when(op == "update", F.coalesce(new, payload)).when(op == "delete", old)


def _row_payload(op: Column, new: Column, old: Column) -> Column:
    return F.when(op == "insert", new).when(op == "update", F.concat(F.lit('{"new":'), new, F.lit(',"old":'), F.coalesce(old, F.lit("null")), F.lit("}"))).when(op == "delete", F.concat(F.lit('{"old":'), F.coalesce(old, F.lit("null")), F.lit("}")))


def debezium(df: DataFrame, value: str = "value") -> DataFrame:
    """op, row, ts of an envelope with or without a schema wrapper; unknown ops and null values are skipped."""
    body = F.coalesce(F.get_json_object(value, "$.payload"), F.col(value))
    get = lambda p: F.get_json_object(body, p)
    op = F.create_map(*[F.lit(x) for kv in DEBEZIUM_OPS.items() for x in kv])[get("$.op")]
    out = df.withColumn("op", op).withColumn("row", F.when(F.col("op") == "delete", get("$.before")).otherwise(get("$.after"))).withColumn("ts_ms", get("$.source.ts_ms").cast("long"))
    return out.where(F.col(value).isNotNull() & F.col("op").isNotNull())


def raw_topic(key: Column, value: Column, key_field: str | None = None) -> tuple[Column, Column, Column]:
    """(op, key, reject): a null value deletes by key; without a key the named field serves, else it is an error."""
    k = F.coalesce(key, F.get_json_object(value, f"$.{key_field}")) if key_field else key
    return F.when(value.isNull(), "delete").otherwise("insert"), k, F.when(k.isNull(), "no key")


def key_components(key: Column) -> Column:
    """Object keys by sorted name, a scalar as one component."""
    names = F.array_sort(F.json_object_keys(key))
    return F.when(names.isNotNull(), F.transform(names, lambda n: F.element_at(F.from_json(key, "map<string,string>"), n))).otherwise(F.array(key))


def relocate_id(doc: Column) -> Column:
    """map<string,string>: _id moves to id unless there is one, and goes."""
    rest = F.map_filter(doc, lambda k, _: k != "_id")
    return F.when(F.map_contains_key(doc, "_id") & ~F.map_contains_key(doc, "id"), F.map_concat(rest, F.create_map(F.lit("id"), F.element_at(doc, "_id")))).otherwise(rest)


def in_scope(c: Column, allowed: list[str]) -> Column:
    """An empty list passes all."""
    return c.isin(allowed) if allowed else F.lit(True)


def keyset_page(df: DataFrame, keys: list[str], last: tuple | None, size: int) -> DataFrame:
    """The next page after ``last`` in key order; literals are compared, so the filter reaches the scan."""
    if last is not None:
        cond = F.lit(False)
        for i in range(len(keys)):
            part = F.col(keys[i]) > F.lit(last[i])
            for j in range(i):
                part = part & (F.col(keys[j]) == F.lit(last[j]))
            cond = cond | part
        df = df.where(cond)
    return df.orderBy(*keys).limit(size)


def reread(changes: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Upserts take the current row by key; a row that is gone is dropped."""
    return changes.where("op <> 'delete'").join(current, keys)


def flat_specs(tables: dict[str, tuple[str, ...]]) -> list[dict]:
    """One 1:1 projection for each table with a primary key; the others are skipped."""
    return [{"primary": t, "key": list(k)} for t, k in sorted(tables.items()) if k]


def resync(tables: dict[str, DataFrame], wanted: list[str]) -> DataFrame:
    """(t, n): rows that a resync of the wanted tables reads again; unknown tables are refused."""
    if unknown := sorted(set(wanted) - set(tables)):
        raise ValueError(f"unknown tables {unknown}")
    parts = [tables[t].agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t in wanted]
    return reduce(DataFrame.unionByName, parts)


def change_stream(df: DataFrame, op: str, known: list[str], full: Column, deletes: list[str]) -> DataFrame:
    """Events of known kinds that carry a whole document, and deletes, which need none."""
    return df.where(F.col(op).isin(*known) & (full.isNotNull() | F.col(op).isin(*deletes)))


def collection_scan(df: DataFrame, key: str, namespace: str) -> DataFrame:
    """Documents with a key, without the store's own collections."""
    return df.where(F.col(key).isNotNull() & ~F.col(namespace).startswith("system."))


def without_marks(df: DataFrame, mark: Column, kinds: list[str]) -> DataFrame:
    """Rows that are data, not marks of the given kinds: snapshot ends (S28), barriers."""
    return df.where(~F.coalesce(mark.isin(*kinds), F.lit(False)))


def from_kafka(df: DataFrame, mapping: str = "debezium", key_field: str | None = None) -> DataFrame:
    """Rows of Spark's Kafka columns (key, value, topic, partition, offset, timestamp) as a change log: topic, partition,
    offset, doc_key (key components), op, row. Messages that cannot be mapped are left out (S22)."""
    text = df.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    if mapping == "debezium":
        out = debezium(text)
        return out.select("topic", "partition", "offset", key_components(F.coalesce(F.get_json_object("key", "$.payload"), "key")).alias("doc_key"), "op", "row").where("doc_key[0] is not null")
    if mapping != "raw":
        raise ValueError(f"mapping {mapping!r}")
    op, key, bad = raw_topic(F.col("key"), F.col("value"), key_field)
    return text.withColumn("op", op).withColumn("_k", key).withColumn("_bad", bad).where("_bad is null").select("topic", "partition", "offset", key_components(F.col("_k")).alias("doc_key"), "op", F.col("value").alias("row"))


def bson_text(v: Column) -> Column:
    """Extended JSON of BSON, as JSON text, to plain JSON text: object ids are hex, dates RFC 3339 in UTC, decimals and
    longs text and numbers, timestamps {t,i}, at any depth; anything else stays, also what is not JSON (F16).

    A brace, a quote and ``$`` follow each other only where an object begins, as a quote within a string is escaped. So
    markers are replaced in the text: a few passes, whatever the depth, and no value is parsed again for each member."""
    marked = lambda names, value: rf'\{{\s*"\$(?:{names})"\s*:\s*{value}\s*\}}'
    v = F.regexp_replace(v, marked("numberLong|numberInt|numberDouble", r'"?(-?)0*(\d+(?:\.\d++)?(?:[eE][-+]?\d++)?)"?'), "$1$2")
    v = F.regexp_replace(v, marked("numberDouble", '"(?:NaN|-?Infinity)"'), "null")
    v = F.regexp_replace(v, marked("timestamp", r'(\{[^{}"]*"[ti]"[^{}"]*"[ti]"[^{}"]*\})'), "$1")
    moment = marked("date", r'"?(-?\d{1,19}+)"?')
    dated = lambda x: F.array_join(F.zip_with(F.split(x, moment), F.transform(F.regexp_extract_all(x, F.lit(moment), F.lit(1)), _moment), lambda a, d: F.concat(a, F.coalesce(d, F.lit("")))), "")
    v = F.transform(F.array(v), lambda x: F.when(x.contains('"$date"'), dated(x)).otherwise(x))[0]
    return F.regexp_replace(v, marked("oid|numberDecimal|date", r'("[^"\\]*+")'), "$1")


def _moment(ms: Column) -> Column:
    """Quoted RFC 3339 of milliseconds, whatever the session's time zone; what no date can hold stays marked."""
    n, day = ms.try_cast("long"), F.lit(86_400_000)
    of_day = F.pmod(n, day)
    two = lambda unit, size: F.lpad(F.pmod(F.floor(of_day / unit), F.lit(size)).cast("string"), 2, "0")
    millis = F.pmod(of_day, F.lit(1000))
    fraction = F.when(millis != 0, F.concat(F.lit("."), F.lpad(millis.cast("string"), 3, "0"))).otherwise("")
    date = F.date_from_unix_date((F.call_function("div", n, day) - F.when(n % day < 0, 1).otherwise(0)).try_cast("int")).cast("string")
    return F.coalesce(F.concat(F.lit('"'), date, F.lit("T"), two(3_600_000, 24), F.lit(":"), two(60_000, 60), F.lit(":"), two(1000, 60), fraction, F.lit('Z"')), F.concat(F.lit('{"$date":'), ms, F.lit("}")))


def bson_document(doc: Column) -> Column:
    """A document of extended JSON with every member in plain form, nested arrays and documents at any depth (F16)."""
    return bson_text(doc)


def bolt_duration(months: Column, days: Column, seconds: Column) -> Column:
    """P{d}DT{h}H{m}M{s}S, a month counting 30 days."""
    d = months * 30 + days
    part = lambda x: x.cast("long").cast("string")
    return F.concat(F.lit("P"), part(d), F.lit("DT"), part(F.floor(seconds / 3600)), F.lit("H"), part(F.floor(F.pmod(seconds, F.lit(3600)) / 60)), F.lit("M"), part(F.pmod(seconds, F.lit(60))), F.lit("S"))


def bolt_bytes(c: Column) -> Column:
    """Bytes as an array of numbers from 0 to 255."""
    hexed = F.hex(c)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def unknown_relations(changes: DataFrame, catalog: DataFrame, relation: str = "relation") -> tuple[DataFrame, DataFrame]:
    """(changes of known relations, one row for each unknown one with how many changes were skipped)."""
    known = catalog.select(relation).distinct()
    skipped = changes.join(known, relation, "left_anti").groupBy(relation).agg(F.count("*").alias("skipped"))
    return changes.join(known, relation, "left_semi"), skipped


def wal2json(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows of logical replication as wal2json's second format writes them: action, lsn, namespace, relation, op, row and
    old (JSON text of the columns' values; a column that was not sent is absent). Begin, commit and unknown actions have
    no op; begin and commit keep their transaction's number (S01, S02)."""
    get = lambda p: F.get_json_object(value, p)
    cells = "array<struct<name:string,value:variant>>"

    def image(path: str) -> Column:
        items = F.from_json(get(path), cells)
        pairs = F.transform(items, lambda x: F.concat(F.to_json(F.array(x["name"])).substr(F.lit(2), F.length(F.to_json(F.array(x["name"]))) - 2), F.lit(":"), F.coalesce(F.to_json(x["value"]), F.lit("null"))))
        return F.when(items.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))

    action = get("$.action")
    op = F.create_map(*map(F.lit, ("I", "insert", "U", "update", "D", "delete", "T", "truncate")))[action]
    return df.select("*", action.alias("action"), get("$.lsn").alias("lsn"), get("$.xid").cast("long").alias("tx_id"), get("$.schema").alias("namespace"), get("$.table").alias("relation"), op.alias("op"), image("$.columns").alias("row"), image("$.identity").alias("old"))


def graph_cdc(df: DataFrame, value: str = "event") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of polled graph changes, JSON with eventType n or r, operation c, u or d, state.before and .after:
    nodes (id, op, labels, properties), edges (id, op, type, src, dst, properties); a delete has the state before (S18)."""
    get = lambda p: F.get_json_object(value, p)
    op = F.create_map(*map(F.lit, ("c", "insert", "u", "update", "d", "delete")))[get("$.operation")]
    at = lambda p: F.coalesce(get(f"$.state.after.{p}"), get(f"$.state.before.{p}"))
    base = df.withColumn("op", op).where(F.col("op").isNotNull())
    nodes = base.where(get("$.eventType") == "n").select(*df.columns, get("$.elementId").alias("id"), "op", F.from_json(at("labels"), "array<string>").alias("labels"), at("properties").alias("properties"))
    edges = base.where(get("$.eventType") == "r").select(*df.columns, get("$.elementId").alias("id"), "op", get("$.type").alias("type"), get("$.start.elementId").alias("src"), get("$.end.elementId").alias("dst"), at("properties").alias("properties"))
    return nodes, edges


def table_schemas(columns: DataFrame) -> DataFrame:
    """(table, columns in ordinal order, primary key in key order, JSON columns) of a catalog's rows (table, column,
    ordinal, type, key_ordinal, check): a column is JSON by its type or by a json_valid() check (S30)."""
    names = lambda keep, by: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(by).alias("o"), F.col("column").alias("c"))))), lambda x: x["c"])
    checked = F.regexp_extract(F.lower(F.coalesce("check", F.lit(""))), r"json_valid\(`?(\w+)`?\)", 1) == F.lower("column")
    return columns.groupBy("table").agg(names(F.lit(True), "ordinal").alias("columns"), names(F.col("key_ordinal").isNotNull(), "key_ordinal").alias("key"), names((F.lower("type") == "json") | checked, "ordinal").alias("json"))


def ddl_tables(sql: str) -> list[str]:
    """Tables that DDL statements touch; DROP and RENAME may name several, RENAME its new names too."""
    import re

    out, name = [], r"[`\w.]+"
    for verb, rest in re.findall(r"\b(ALTER|DROP|CREATE|RENAME|TRUNCATE)\s+(?:TEMPORARY\s+)?TABLES?\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([^;]*)", sql, re.I):
        if verb.upper() == "RENAME":
            found = [x for pair in re.findall(rf"({name})\s+TO\s+({name})", rest, re.I) for x in pair]
        elif verb.upper() == "DROP":
            found = re.findall(rf"(?:\A|,)\s*({name})", rest)
        else:
            found = re.findall(rf"\A\s*({name})", rest)
        out += [x.replace("`", "") for x in found]
    return out
