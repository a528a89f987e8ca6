"""Read queries over materialised documents: point lookup, query strings, sort and limit, glob scans, key scoping.

Query strings: terms, "phrases", field:value, wildcards, [a TO b] ranges, AND OR NOT, parentheses; adjacent clauses are
OR. Relevance ranking is not offered; results are ordered by a field and the document id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import glob_regex, parse_sort

TOKEN = re.compile(r'\s*(\(|\)|AND\b|OR\b|NOT\b|[A-Za-z_][\w.]*:\[[^\]]*\]|[A-Za-z_][\w.]*:"[^"]*"|"[^"]*"|[^\s()]+)')


def bound(value: str) -> Column:
    """A range's end: a literal, or a time such as now, now-15m, now+1d."""
    units = {"s": "SECONDS", "m": "MINUTES", "h": "HOURS", "d": "DAYS", "w": "WEEKS"}
    if not (m := re.fullmatch(r"now(?:([+-])(\d+)([smhdw]))?", value)):
        return F.lit(value)
    return F.current_timestamp() if not m[1] else F.current_timestamp() + F.expr(f"INTERVAL '{m[1]}{m[2]}' {units[m[3]][:-1]}" if m[3] != "w" else f"INTERVAL '{m[1]}{int(m[2]) * 7}' DAY")


def clause(token: str, text: list[str], columns: list[str] | None = None) -> Column:
    """A field that the documents do not have matches nothing."""
    fields, value = text, token
    if m := re.match(r'([A-Za-z_][\w.]*):(.+)', token, re.S):
        fields, value = [m[1]], m[2]
        if columns is not None and m[1].split(".")[0] not in columns:
            return F.lit(False)
    if m := re.match(r"\[(\S+) TO (\S+)\]", value):
        c = F.col(fields[0])
        lo = F.lit(True) if m[1] == "*" else c >= bound(m[1])
        return F.coalesce(lo & (F.lit(True) if m[2] == "*" else c <= bound(m[2])), F.lit(False))
    phrase = value.strip('"')
    body = r"\s+".join("".join(r"\w*" if ch == "*" else r"\w" if ch == "?" else re.escape(ch) for ch in w) for w in phrase.split())
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.col(f).cast("string").rlike(rf"(?i)(?<!\w){body}(?!\w)"), F.lit(False))
    return out


def compile_query(q: str, text: list[str], columns: list[str] | None = None) -> Column:
    tokens, at = TOKEN.findall(q), 0

    def any_() -> Column:
        nonlocal at
        out = all_()
        while at < len(tokens) and tokens[at] != ")":
            at += tokens[at] == "OR"
            out = out | all_()
        return out

    def all_() -> Column:
        nonlocal at
        out = one()
        while at < len(tokens) and tokens[at] == "AND":
            at += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("query ends early")
        t = tokens[at]
        at += 1
        if t == "NOT":
            return ~one()
        if t == "(":
            out = any_()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("missing )")
            at += 1
            return out
        if t in ("AND", "OR", ")"):
            raise ValueError(f"unexpected {t}")
        return clause(t, text, columns)

    if not tokens:
        return F.lit(True)
    out = any_()
    if at < len(tokens):
        raise ValueError("unbalanced )")
    return out


def search(docs: DataFrame, q: str, text: list[str], sort: str | None = None, limit: int = 10, most: int = 100, id_col: str = "doc_id") -> DataFrame:
    """limit is clamped to 1..most; ties by document id (R03, R04). Plans as TakeOrderedAndProject."""
    field, down = parse_sort(sort) if sort else (id_col, False)
    return docs.where(compile_query(q, text, docs.columns)).orderBy(F.col(field).desc() if down else F.col(field).asc(), id_col).limit(max(1, min(limit, most)))


def key_filter(docs: DataFrame, doc_id: str, keys: list[str]) -> Column:
    """The key columns of an id as typed literals, so that a look-up reaches the scan; an id of another form matches nothing."""
    import json

    try:
        parts = json.loads(doc_id.partition(":")[2])
    except ValueError:
        parts = None
    if not isinstance(parts, list) or len(parts) != len(keys) or not all(isinstance(p, str) for p in parts):
        return F.lit(False)
    out = F.lit(True)
    for k, p in zip(keys, parts):
        kind = docs.schema[k].dataType.typeName()
        if kind in ("long", "integer", "short", "byte"):
            if not re.fullmatch(r"0|-?[1-9][0-9]{0,18}", p):
                return F.lit(False)
            out = out & (F.col(k) == F.lit(int(p)))
        elif kind == "string":
            out = out & (F.col(k) == F.lit(p))
        else:
            out = out & (F.col(k).cast("string") == F.lit(p))
    return out


def get_entity(docs: DataFrame, doc_id: str, keys: list[str] | None = None) -> DataFrame:
    """With ``keys``, the columns that the id is made of, no other row group is read than the key may be in."""
    return docs.where(F.col("doc_id") == doc_id) if keys is None else docs.where(key_filter(docs, doc_id, keys) & (F.col("doc_id") == doc_id))


def scan(docs: DataFrame, glob: str, limit: int, most: int = 1000) -> DataFrame:
    """The glob's literal beginning is a prefix filter, which a stored doc_id column takes to the scan."""
    literal = re.match(r"[^*?]*", glob)[0]
    docs = docs.where(F.col("doc_id").startswith(literal)) if literal else docs
    return docs.where(F.col("doc_id").rlike(glob_regex(glob))).orderBy("doc_id").limit(max(1, min(limit, most)))


def scoped(docs: DataFrame, allowed: list[str], target: str = "target") -> DataFrame:
    return docs.where(F.col(target).isin(allowed))


def targets(joins) -> list[tuple[str, str]]:
    """(name, shape) of each target."""
    return [(j.target or j.primary, ",".join([*j.key, *(f"{r.embed_as}{'[]' if r.many else ''}" for r in j.relations)])) for j in joins]


def containing(docs: DataFrame, items: str, wanted: DataFrame, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """Ids of documents whose embedded array holds one of the wanted tuples, exactly."""
    flat = docs.select(id_col, F.explode(items).alias("_i")).select(id_col, *[F.col(f"_i.{f}").alias(f) for f in fields])
    return flat.join(wanted.select(*fields).distinct(), fields, "left_semi").select(id_col).distinct()
