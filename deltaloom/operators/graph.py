"""Typed graph projections and fan-out over node and edge tables: edges(type, src, dst)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOP = re.compile(r"(<-|-)\[:([A-Za-z_|]+)\](->|-)\(([A-Za-z_]*)(?::([A-Za-z_]+))?\)")


def parse_path(pattern: str) -> list[tuple[list[str], str]]:
    """(p)-[:A|B]->(x)<-[:C]-(y): hops as (types, out | in | any). Anything else is unsupported."""
    head = re.match(r"\(p(?::[A-Za-z_]+)?\)", pattern)
    if not head:
        raise ValueError("a path is anchored at (p)")
    hops, at = [], head.end()
    while at < len(pattern):
        m = HOP.match(pattern, at)
        if not m or (m[1] == "<-" and m[3] == "->"):
            raise ValueError(f"unsupported pattern at {pattern[at:]!r}")
        hops.append((m[2].split("|"), "in" if m[1] == "<-" else "out" if m[3] == "->" else "any"))
        at = m.end()
    if not hops:
        raise ValueError("a path has at least one hop")
    return hops


def hop_edges(edges: DataFrame, types: list[str], way: str) -> DataFrame:
    """(near, far, edge) of one hop seen from the primary's side."""
    some = edges.where(F.col("type").isin(types))
    out = some.select(F.col("src").alias("near"), F.col("dst").alias("far"), F.col("id").alias("edge"))
    back = some.select(F.col("dst").alias("near"), F.col("src").alias("far"), F.col("id").alias("edge"))
    return {"out": out, "in": back}.get(way) if way != "any" else out.unionByName(back)


def follow(primaries: DataFrame, edges: DataFrame, hops: list, optional: bool = True) -> DataFrame:
    """(p, n1, n2, ...) along typed hops; optional hops keep primaries without a match."""
    out = primaries.select(F.col("id").alias("p"), F.col("id").alias("n0"))
    for i, (types, way) in enumerate(hops):
        e = hop_edges(edges, types, way).select(F.col("near").alias(f"n{i}"), F.col("far").alias(f"n{i + 1}")).distinct()
        out = out.join(e, f"n{i}", "left" if optional else "inner")
    return out.select("p", *[f"n{i + 1}" for i in range(len(hops))])


def typed_fan_out(primaries: DataFrame, edges: DataFrame, hops: list, changed: DataFrame) -> DataFrame:
    """Primaries whose path touches a changed node or edge: the union of reverse walks from each depth."""
    parts = [primaries.join(changed, "id", "left_semi").select(F.col("id").alias("p"))]
    for depth in range(len(hops)):
        e = hop_edges(edges, *hops[depth])
        at = e.join(changed.select(F.col("id").alias("far")), "far", "left_semi").select("near").unionByName(e.join(changed.select(F.col("id").alias("edge")), "edge", "left_semi").select("near")).distinct()
        for types, way in reversed(hops[:depth]):
            at = hop_edges(edges, types, way).join(at.select(F.col("near").alias("far")), "far", "left_semi").select("near").distinct()
        parts.append(at.select(F.col("near").alias("p")))
    found = reduce(DataFrame.unionByName, parts).distinct()
    return found.join(primaries.select(F.col("id").alias("p")), "p", "left_semi")


def within_hops(starts: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(id, depth): nodes within n undirected hops, each once at its smallest depth. A frontier join for each hop."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    seen = starts.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, n + 1):
        step = frontier.select(F.col("id").alias("a")).join(both, "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = step.select("id", F.lit(d).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen


def hot_endpoints(edges: DataFrame, most: int = 100) -> DataFrame:
    """Far ends (dst) of the edge types that have few of them."""
    few = edges.groupBy("type").agg(F.countDistinct("dst").alias("n")).where(F.col("n") <= most).select("type")
    return edges.join(few, "type", "left_semi").select("type", F.col("dst").alias("id")).distinct()


def hot_far_ends(primaries: DataFrame, edges: DataFrame, paths: list[list], most: int = 100) -> DataFrame:
    """(type, side, id) of far ends to be left out: a prefix of a path that reaches at most ``most`` distinct nodes from
    all primaries makes these hot for its last hop's types. The far side of an outgoing hop is dst, of an incoming one
    src; a type with both, or of an undirected hop, is never filtered (G06)."""
    sides: dict[str, set] = {}
    for hops in paths:
        for types, way in hops:
            for t in types:
                sides.setdefault(t, set()).update({"out": {"dst"}, "in": {"src"}, "any": {"dst", "src"}}[way])
    clear = {t: next(iter(s)) for t, s in sides.items() if len(s) == 1}
    parts = []
    for hops in paths:
        at = primaries.select(F.col("id").alias("near")).distinct()
        for types, way in hops:
            step = at.join(hop_edges(edges, types, way).select("near", "far", "edge"), "near")
            far = step.select(F.col("far").alias("near")).distinct()
            few = far.limit(most + 1).agg(F.count("*").alias("n")).where(F.col("n") <= most)
            for t in types:
                if t in clear:
                    own = at.join(hop_edges(edges, [t], way), "near").select(F.lit(t).alias("type"), F.lit(clear[t]).alias("side"), F.col("far").alias("id")).distinct()
                    parts.append(own.join(F.broadcast(few.select("n"))).drop("n"))  # at most one row
            at = far
    return reduce(DataFrame.unionByName, parts).distinct() if parts else edges.select("type", F.lit("dst").alias("side"), F.col("dst").alias("id")).limit(0)


def edge_anchors(changed: DataFrame, hot: DataFrame) -> DataFrame:
    """Ids that a changed edge touches: the edge, its near end, and its far end unless that is hot (G07). ``hot`` has
    (type, id) and, where not all far ends are dst, side."""
    if "side" not in hot.columns:
        hot = hot.withColumn("side", F.lit("dst"))
    end = lambda side: F.struct(F.lit(side).alias("side"), F.col(side).alias("anchor"))
    ends = changed.select("type", F.explode(F.array(end("src"), end("dst"))).alias("e")).select("type", "e.*")
    kept = ends.join(hot.select("type", "side", F.col("id").alias("anchor")), ["type", "side", "anchor"], "left_anti")
    return kept.select("anchor").unionByName(changed.select(F.col("id").alias("anchor"))).distinct()


def hop_report(patterns: list[str], configured: int) -> dict:
    """The hops that a projection's longest path takes against the configured ones."""
    need = max((len(parse_path(p)) for p in patterns), default=0)
    return {"needed": need, "configured": configured, "warning": f"paths take {need} hops, {configured} are configured" if need > configured else None}


WRITES = ("CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "FOREACH", "LOAD")


def check_projection(text: str) -> list[str]:
    """Why a projection's text is refused: write keywords outside strings and comments, missing result columns."""
    bare = re.sub(r"'(?:[^'\\\\]|\\\\.)*'|\"(?:[^\"\\\\]|\\\\.)*\"|`[^`]*`|//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    found = [f"write keyword {w}" for w in WRITES if re.search(rf"(?<![\w.:]){w}(?!\w)", bare, re.I)]
    return found + [f"no column {c}" for c in ("primaryEid", "doc") if not re.search(rf"\bAS\s+{c}\b", bare)]


def coalesced(polls: DataFrame, key: str, order: str) -> DataFrame:
    """Polls of one id become one, the last; a hash aggregate with map-side combine."""
    return polls.groupBy(key).agg(F.max(order).alias(order))


def node_tombstones(deleted: DataFrame, table: str) -> DataFrame:
    """(doc_id, op) of deleted primary nodes."""
    return deleted.select(F.concat(F.lit(table + ":"), "id").alias("doc_id"), F.lit("delete").alias("op"))


def event_labels(after, before):
    """A node event's labels: those after it, or those before where there are none after."""
    return F.when(F.size(after) > 0, after).otherwise(before)


def fk_edges(rows: DataFrame, key: str, fk: str, kind: str, reversed_: bool = False) -> DataFrame:
    """An edge a row by its foreign key; a null key deletes the edge; ``reversed_`` swaps the ends."""
    a, b = (fk, key) if reversed_ else (key, fk)
    return rows.select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), F.when(F.col(fk).isNull(), "delete").otherwise("upsert").alias("action"))


def canonical_label(labels, priority: list[str]):
    """The first label of the priority list that the node has, else its first."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, priority)), lambda x: F.array_contains(labels, x)), 0), F.get(labels, 0))
