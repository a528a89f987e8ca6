"""Declarative denormalisation: one document per primary row, related rows embedded.

Related tables are projected and pre-aggregated by their join key before the join (J02-J05), so a relation costs one
aggregation and one left join, whatever its cardinality; Catalyst chooses broadcast or sort-merge by size.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import doc_id


@dataclass(frozen=True)
class Relation:
    table: str
    embed_as: str
    on: tuple[tuple[str, str], ...]  # (primary column, related column)
    select: tuple[str, ...] = ()
    many: bool = False
    sort_by: str | None = None
    tie: tuple[str, ...] = ()  # further sort columns, for a total order
    nulls: str = "first"  # first: in-memory order; last: SQL order
    null_keys: str = "sql"  # sql: null never matches; memory: null matches null
    on_missing: str = "null"  # null | empty_object | drop_primary (behaves as null)

    def __post_init__(self):
        if self.on_missing not in ("null", "empty_object", "drop_primary"):
            raise ValueError(f"on_missing {self.on_missing!r}")
        if not self.on:
            raise ValueError(f"relation {self.embed_as} has no key")


@dataclass(frozen=True)
class Join:
    primary: str
    key: tuple[str, ...]
    relations: tuple[Relation, ...] = ()
    select: tuple[str, ...] = ()
    target: str | None = None
    name: str = field(default="")


def spec(d: dict) -> Join:
    """A Join from a parsed YAML mapping; unknown fields are refused."""
    known = {"name", "primary", "key", "select", "target", "relations"}
    if extra := set(d) - known:
        raise ValueError(f"unknown fields {sorted(extra)}")
    rels = []
    for r in d.get("relations", []):
        if extra := set(r) - {"table", "embed_as", "on", "select", "cardinality", "sort_by", "tie", "nulls", "null_keys", "on_missing"}:
            raise ValueError(f"unknown fields {sorted(extra)}")
        rels.append(Relation(r["table"], r["embed_as"], tuple(map(tuple, r["on"])), tuple(r.get("select", ())), r.get("cardinality", "one") == "many", r.get("sort_by"), tuple(r.get("tie", ())), r.get("nulls", "first"), r.get("null_keys", "sql"), r.get("on_missing", "null")))
    return Join(d["primary"], tuple(d["key"]), tuple(rels), tuple(d.get("select", ())), d.get("target"), d.get("name", ""))


def embed(rel: Relation, related: DataFrame) -> DataFrame:
    """The related side reduced to one row a key: _k0.. and the embed column."""
    cols = [c for c in (rel.select or related.columns) if c in related.columns]  # listed keys that exist, in list order
    keys = [related[r].cast("string").alias(f"_k{i}") for i, (_, r) in enumerate(rel.on)]
    names = [f"_k{i}" for i in range(len(rel.on))]
    order = ([rel.sort_by] if rel.sort_by in cols else []) + [t for t in rel.tie if t in related.columns] or cols
    # One struct holds what is sorted by and the rest, each column once; a struct's nulls come first by themselves.
    ranked = [x for i, c in enumerate(order) for x in ([related[c].isNull().alias(f"n{i}")] if rel.nulls == "last" else []) + [related[c].alias(f"v{i}")]]
    place = {c: f"v{order.index(c)}" if c in order else f"r{i}" for i, c in enumerate(cols)}
    rows = related.select(*keys, F.struct(*ranked, *[related[c].alias(place[c]) for c in cols if c not in order]).alias("_r"))
    as_row = lambda x: F.struct(*[x[place[c]].alias(c) for c in cols])
    if rel.null_keys == "sql":
        rows = rows.where(reduce(Column.__and__, [F.col(n).isNotNull() for n in names]))
    if rel.many:
        got = F.transform(F.sort_array(F.collect_list("_r")), as_row)
    else:
        got = F.min("_r")  # several matches: the smallest in the declared order
    out = rows.groupBy(*names).agg(got.alias(rel.embed_as))
    return out if rel.many else out.withColumn(rel.embed_as, as_row(F.col(rel.embed_as)))


def compose(join: Join, tables: dict[str, DataFrame], keys: DataFrame | None = None) -> DataFrame:
    """Documents: doc_id, target, the selected primary columns, one column a relation. ``keys`` restricts the primaries."""
    primary = tables[join.primary]
    if keys is not None:
        primary = primary.join(keys.select(*join.key).distinct(), list(join.key), "left_semi")
    base = primary.select(doc_id(join.primary, *[F.col(k) for k in join.key]).alias("doc_id"), F.lit(join.target or join.primary).alias("target"), *[c for c in (join.select or primary.columns) if c in primary.columns], *[F.col(p).cast("string").alias(f"_p{j}_{i}") for j, r in enumerate(join.relations) for i, (p, _) in enumerate(r.on)])
    for j, rel in enumerate(join.relations):
        side = embed(rel, tables[rel.table]).withColumnsRenamed({f"_k{i}": f"_s{j}_{i}" for i in range(len(rel.on))})
        pairs = [(base[f"_p{j}_{i}"], side[f"_s{j}_{i}"]) for i in range(len(rel.on))]
        base = base.join(side, reduce(Column.__and__, [a.eqNullSafe(b) if rel.null_keys == "memory" else a == b for a, b in pairs]), "left")
        if rel.many:
            base = base.withColumn(rel.embed_as, F.coalesce(rel.embed_as, F.array().cast(side.schema[rel.embed_as].dataType)))
        base = base.drop(*[f"_p{j}_{i}" for i in range(len(rel.on))], *[f"_s{j}_{i}" for i in range(len(rel.on))])
    return base


def document_expression(join: Join, tables: dict[str, DataFrame]) -> DataFrame:
    """doc_id and doc, the JSON object of the primary's columns and its relations (J31, J32): arrays are sorted after
    they are gathered, a missing one-relation is null, a missing many-relation an empty array."""
    docs = compose(join, tables)
    body = [c for c in docs.columns if c not in ("doc_id", "target")]
    return docs.select("doc_id", F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("doc"))


def documents_json(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, target, doc: the JSON body, with ``{}`` for a missing one-relation that asks for it."""
    body = [c for c in docs.columns if c not in ("doc_id", "target")]
    empty = {r.embed_as for r in join.relations if not r.many and r.on_missing == "empty_object"}
    whole = F.to_json(F.struct(*[c for c in body if c not in empty]), {"ignoreNullFields": "false"})
    for c in sorted(empty):
        part = F.concat(F.lit(f',"{c}":'), F.coalesce(F.to_json(F.col(c), {"ignoreNullFields": "false"}), F.lit("{}")))
        whole = F.concat(F.regexp_replace(whole, r"\}$", ""), part, F.lit("}"))
    return docs.select("doc_id", "target", whole.alias("doc"))


def affected(join: Join, tables: dict[str, DataFrame], changed: dict[str, DataFrame]) -> DataFrame:
    """Primary keys to recompose: changed primaries, and primaries that reference a changed row's old or new key.

    ``changed[table]`` has the columns of the table; old and new images are both rows in it (J15, J16, J34, J35).
    """
    primary = tables[join.primary]
    parts = []
    if join.primary in changed:
        parts.append(changed[join.primary].select(*join.key))
    for rel in join.relations:
        if rel.table in changed:
            hit = changed[rel.table].select(*[F.col(r).cast("string").alias(f"_c{i}") for i, (_, r) in enumerate(rel.on)]).distinct()
            cond = reduce(Column.__and__, [primary[p].cast("string") == hit[f"_c{i}"] for i, (p, _) in enumerate(rel.on)])
            parts.append(primary.join(hit, cond, "left_semi").select(*join.key))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else primary.select(*join.key).limit(0)


def tombstones(join: Join, deleted: DataFrame) -> DataFrame:
    """(doc_id, op) of deleted primaries."""
    return deleted.select(doc_id(join.primary, *[F.col(k) for k in join.key]).alias("doc_id"), F.lit("delete").alias("op"))


def pass_through(events: DataFrame, tables: list[str], table: str) -> DataFrame:
    """Events of tables that no join has."""
    return events.where(~F.coalesce(F.col(table).isin(*tables), F.lit(False)))


def fetch(rel: Relation, related: DataFrame, keys: DataFrame) -> DataFrame:
    """Related rows of a list of keys, by text, with the selected columns and the key's (J23, J24). ``keys``: one column
    for each of the relation's related columns, in that order."""
    names = [r for _, r in rel.on]
    cols = list(dict.fromkeys([*[c for c in (rel.select or related.columns) if c in related.columns], *names]))
    wanted = keys.toDF(*[f"_w{i}" for i in range(len(names))]).select(*[F.col(f"_w{i}").cast("string").alias(f"_w{i}") for i in range(len(names))]).dropna().distinct()
    cond = reduce(Column.__and__, [related[n].cast("string") == wanted[f"_w{i}"] for i, n in enumerate(names)])
    return related.join(wanted, cond, "left_semi").select(*cols)


def backfill(join: Join, tables: dict[str, DataFrame], seen: dict[str, DataFrame], mode: str = "sync_on_miss") -> DataFrame:
    """Documents when only part of the related rows has been seen (J22): ``none`` composes from the seen rows alone;
    ``sync_on_miss`` fetches, for keys without a seen row, what the source table has."""
    if mode not in ("none", "sync_on_miss"):
        raise ValueError(f"backfill {mode!r}")
    state = dict(tables) | seen
    if mode == "sync_on_miss":
        for rel in join.relations:
            have = seen.get(rel.table)
            if have is None:
                continue
            keys = tables[join.primary].select(*[F.col(p).cast("string").alias(r) for p, r in rel.on]).dropna().distinct()
            names = [r for _, r in rel.on]
            known = have.select(*[F.col(r).cast("string").alias(r) for r in names]).distinct()
            full = Relation(rel.table, rel.embed_as, rel.on)
            state[rel.table] = state[rel.table].unionByName(fetch(full, tables[rel.table], keys.join(known, names, "left_anti").select(*names)).select(*have.columns))
    return compose(join, state)


def load_spec(text: str, env: dict[str, str] | None = None, read=None) -> list[Join]:
    """Joins from YAML: version 1, a list ``joins``. Values ``env:NAME`` and ``file:PATH`` are replaced by what they name;
    anything else is literal, and unknown fields are refused (C08)."""
    import os

    import yaml

    env = os.environ if env is None else env

    def open_text(path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read().strip()

    def resolved(x):
        if isinstance(x, dict):
            return {k: resolved(v) for k, v in x.items()}
        if isinstance(x, list):
            return [resolved(v) for v in x]
        if isinstance(x, str) and x.startswith("env:"):
            if x[4:] not in env:
                raise ValueError(f"{x}: no such variable")
            return env[x[4:]]
        if isinstance(x, str) and x.startswith("file:"):
            return (read or open_text)(x[5:])
        return x

    d = yaml.safe_load(text)
    if not isinstance(d, dict) or d.get("version") != 1:
        raise ValueError("version 1 is expected")
    if extra := set(d) - {"version", "joins"}:
        raise ValueError(f"unknown fields {sorted(extra)}")
    return [spec(resolved(j)) for j in d.get("joins", [])]


def recompose(join: Join, tables: dict[str, DataFrame], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of the keys that exist, doc ids of those that do not): source truth beats arrival order."""
    docs = compose(join, tables, keys)
    gone = keys.join(tables[join.primary].select(*join.key), list(join.key), "left_anti")
    return docs, gone.select(doc_id(join.primary, *[F.col(k) for k in join.key]).alias("doc_id")).distinct()


def rebuild(join: Join, old_docs: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """After a truncate of the primary: (the target's documents, all of them cleared; the full projection of what the
    table now has) (J40). The caller overwrites the target with the second."""
    return old_docs.select("doc_id", F.lit("clear").alias("op")), compose(join, tables)


def apply_changes(join: Join, old_docs: DataFrame, tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """The document table after a batch: untouched documents, recomposed ones, without tombstones."""
    docs, gone = recompose(join, tables, keys)
    touched = docs.select("doc_id").unionByName(gone)
    return old_docs.join(touched, "doc_id", "left_anti").unionByName(docs)
