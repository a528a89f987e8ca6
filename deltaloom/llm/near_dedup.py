"""Near-duplicate documents by SetSketch registers, verified on whole shingle sets.

1. Each text becomes its set of distinct 5-word shingles and a SetSketch of it (one scan). Texts with equal sets form a
   class, the node of all that follows; doc ids come back at the end.
2. ``bands`` groups of ``band_rows`` registers are the candidate keys. In each bucket every member is paired with the
   smallest only, so a bucket of n gives n-1 pairs: the star of that hub.
3. Star pairs are compared by the joint likelihood estimate, for which only registers move. Those it does not rule out
   are confirmed on the full sets, which gives their exact distance (1 - similarity); this joins most groups of near
   copies at linear cost.
4. Two members of a star need not both be like its hub. Distances obey the triangle inequality, so members whose
   distances from the hub differ by more than the threshold allows cannot be linked; members that step 3 has joined
   need no comparison. What is left, the members outside the hub's component against the star's members in reach, is
   compared in pairs of blocks of bounded rows and bytes: registers first, and only for members that have a survivor
   there is the text fetched and the link confirmed. A task returns a spanning forest of its links, at most as many as
   it has members.

No cap on buckets, partners or candidates. A pair at the threshold shares no bucket with probability
below 1e-5, from which the band length follows (8 at 0.85); the estimate rules out only what lies 5 standard errors
below the threshold. Step 4 compares all pairs of a star whose members are alike but not linked; that cost is inherent
to confirming them, it is spread over blocks, and no pair leaves a task unless it is a link of the forest.

Defined cases: null and empty texts have the empty set and are linked with nothing; repeated rows (same id) share one
result; each text of an id that has several is linked for itself; a null id takes part but is never a component's id
unless nothing else is in it; a text of under five words is one shingle; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, park, read, text_of, wide
from .components import components
from .shingles import SetSketch, shingle_sets

REGISTERS, MISS = 320, 1e-5
#: Members of a block, and shingles of all of them; pairs whose registers are compared at once; most distance bins.
BLOCK, BLOCK_SHINGLES, PAIRS, BINS = 512, 1_000_000, 4096, 20
#: Standard errors by which an estimate may be off.
ERRORS = 5


def band_rows_for(percent: int, registers: int = REGISTERS, miss: float = MISS) -> int:
    """The longest bands with which a pair at the threshold shares no bucket with probability ``miss`` at most."""
    return max(r for r in range(1, 33) if (1 - (percent / 100) ** r) ** (registers // r) <= miss or r == 1)


def sketched(df: DataFrame, id_col: str, text_col: str, registers: int = REGISTERS, width: int = 5) -> DataFrame:
    """id, text_hash, n_shingles, set_key (128-bit hash of the set; null if empty), registers (little-endian 16 bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(registers)
        for b in batches:
            n, keys, regs = [], [], []
            for s in shingle_sets(b.column("text"), width):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(sketch.registers(s).astype("<u2").tobytes() if len(s) else None)
            yield pa.record_batch([b.column("id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["id", "text_hash", "n_shingles", "set_key", "registers"])

    return arrow_map(keyed_texts(df, id_col, text_col), run, "id long, text_hash long, n_shingles long, set_key binary, registers binary")


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, text_hash: id and hash tell rows apart that are not repeats of each other."""
    text = text_of(text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def band_keys(classes: DataFrame, band_rows: int) -> DataFrame:
    """(node, bucket): one row for each band of a class; the bucket's hash includes the band's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = b.column("registers").to_pylist()
            if not regs:
                continue
            step = 2 * band_rows
            bands = len(regs[0]) // step
            keys = [xxhash.xxh3_64_intdigest(r[j * step : (j + 1) * step], j) for r in regs for j in range(bands)]
            node = np.repeat(b.column("node").to_numpy(), bands)
            yield pa.record_batch([pa.array(node), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["node", "bucket"])

    return arrow_map(classes.select("node", "registers"), run, "node long, bucket long")


def numbered(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes`` with node: the class's smallest id; for null ids, and for an id's further texts, a number that is no id.

    Also whether every node is an id.
    """
    odd = park(classes.groupBy("id").agg(F.count("*").alias("n"), F.min("set_key").alias("owner")).where("n > 1 or id is null").select("id", "owner"), "odd")
    if odd.isEmpty():
        return classes.withColumn("node", F.col("id")), True
    low, high = classes.agg(F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    if high < 1 << 62:
        free = F.lit(high + 1) + F.monotonically_increasing_id()
    elif low > -(1 << 62):
        free = F.lit(low - 1) - F.monotonically_increasing_id()
    else:
        raise ValueError("ids span the whole range of long: numbers must be free at one end for null or repeated ids")
    joined = classes.join(odd.where("id is not null"), "id", "left")
    own = F.col("id").isNotNull() & F.coalesce(F.col("owner") == F.col("set_key"), F.lit(True))
    return park(joined.select(*classes.columns, F.when(own, F.col("id")).otherwise(free).alias("node")), "nodes"), False


def matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<u2") for r in column.to_pylist()])


def floor_of(percent: int, registers: int) -> float:
    """The estimate below which a pair is ruled out."""
    tau = percent / 100
    return tau - ERRORS * (tau * (1 - tau) / registers) ** 0.5


def star_estimates(pairs: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """(hub, node, estimate) of rows (hub, chunk, side, node, n_shingles, registers); side 0 is the hub, side 1 its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, hub, size = SetSketch(registers), None, 0
        for b in batches:
            if not len(b):
                continue
            regs, side = matrix(b.column("registers")), b.column("side").to_numpy()
            n, hubs, nodes = (b.column(c).to_numpy() for c in ("n_shingles", "hub", "node"))
            out = np.zeros(len(b))
            cuts = [*np.flatnonzero(side == 0).tolist(), len(b)]
            for lo, hi in zip([0, *cuts], cuts):
                if lo < hi and side[lo] == 0:
                    hub, size, lo = regs[lo], n[lo], lo + 1
                for i in range(lo, hi, PAIRS):
                    j = min(i + PAIRS, hi)
                    out[i:j] = sketch.jaccard(np.broadcast_to(hub, (j - i, registers)), regs[i:j], np.full(j - i, size), n[i:j])
            own = np.flatnonzero(side == 1)
            yield pa.record_batch([pa.array(hubs[own]), pa.array(nodes[own]), pa.array(out[own])], names=["hub", "node", "estimate"])

    spread = pairs.repartition(wide(pairs.sparkSession), "hub", "chunk").sortWithinPartitions("hub", "chunk", "side", "node")
    return arrow_map(spread.select("hub", "node", "side", "n_shingles", "registers"), run, "hub long, node long, estimate double")


def star_distances(pairs: DataFrame, width: int = 5) -> DataFrame:
    """(hub, node, shared, either) of rows (hub, chunk, side, node, text): sizes of intersection and union. Memory: a batch and the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for b in batches:
            out = ([], [], [], [])
            for h, node, side, s in zip(*(b.column(c).to_pylist() for c in ("hub", "node", "side")), shingle_sets(b.column("text"), width)):
                if side == 0:
                    hub = s
                    continue
                at = np.minimum(np.searchsorted(hub, s), len(hub) - 1)
                both = int((hub[at] == s).sum())
                for column, value in zip(out, (h, node, both, len(hub) + len(s) - both)):
                    column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["hub", "node", "shared", "either"])

    spread = pairs.repartition(wide(pairs.sparkSession), "hub", "chunk").sortWithinPartitions("hub", "chunk", "side", "node")
    return arrow_map(spread.select("hub", "node", "side", "text"), run, "hub long, node long, shared long, either long")


def by_star(pairs: DataFrame) -> DataFrame:
    """(hub, chunk, side, node): partners in chunks of about BLOCK, each with its hub."""
    many = F.ceil(F.col("n") / BLOCK).cast("long")
    sizes = park(pairs.groupBy("hub").agg(F.count("*").alias("n")), "star-sizes")  # a table of its own, so that a large hub's join can be split
    partners = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), many).alias("chunk"), "node")
    hubs = partners.select("hub", "chunk").distinct().select("hub", "chunk", F.lit(0).alias("side"), F.col("hub").alias("node"))
    return hubs.unionByName(partners.select("hub", "chunk", F.lit(1).alias("side"), "node"))


def tasks_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tables of equal ``task`` of batches that are sorted by it."""
    pend, last = [], None
    for b in rows:
        if not len(b):
            continue
        key = b.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            if pend and key[lo] != last:
                yield pa.Table.from_batches(pend)
                pend = []
            pend.append(b.slice(lo, hi - lo))
            last = key[lo]
    if pend:
        yield pa.Table.from_batches(pend)


def alike(left: np.ndarray, right: np.ndarray, joined: np.ndarray, size: np.ndarray, regs: np.ndarray, percent: int, sketch: SetSketch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``left`` and ``right`` (all of ``left`` if there is no right) that are not joined and not ruled out."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, 64 * PAIRS // max(1, len(right) or len(left)))
    for i in range(0, len(left), step):
        rows = left[i : i + step]
        other = right if len(right) else left
        a, b = (x.ravel() for x in np.meshgrid(rows, other, indexing="ij"))
        keep = (joined[a] != joined[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        if not len(right):
            keep &= a < b
        a, b = a[keep], b[keep]
        for j in range(0, len(a), PAIRS):
            x, y = a[j : j + PAIRS], b[j : j + PAIRS]
            # The share of equal registers is an estimate too, and a cheap one.
            some = (regs[x] == regs[y]).sum(axis=1) >= floor_of(percent, sketch.size) * sketch.size
            x, y = x[some], y[some]
            ok = sketch.jaccard(regs[x], regs[y], size[x], size[y]) >= floor_of(percent, sketch.size)
            found_a.append(x[ok])
            found_b.append(y[ok])
    return np.concatenate(found_a), np.concatenate(found_b)


def survivors(tasks: DataFrame, percent: int, registers: int = REGISTERS) -> DataFrame:
    """Rows (task, side, node) of rows (task, side, node, joined, n_shingles, registers) that have a pair not ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(registers)
        for t in tasks_of(batches):
            side, joined, size = (t.column(c).to_numpy() for c in ("side", "joined", "n_shingles"))
            a, b = alike(np.flatnonzero(side == 0), np.flatnonzero(side == 1), joined, size, matrix(t.column("registers")), percent, sketch)
            some = np.unique(np.concatenate([a, b]))
            yield pa.record_batch([pa.array(t.column(c).to_numpy()[some]) for c in ("task", "side", "node")], names=["task", "side", "node"])

    spread = tasks.repartition(wide(tasks.sparkSession), "task").sortWithinPartitions("task", "side", "node")
    return arrow_map(spread.select("task", "side", "node", "joined", "n_shingles", "registers"), run, "task long, side int, node long")


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of positions ``a``, ``b``; many pairs at once by an incidence matrix."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rank = np.where(times > 1, np.cumsum(times > 1) - 1, -1)  # only shingles of two members at least
    column = rank[column]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(rank.max(initial=-1)) + 1, 4096):
        here = (column >= lo) & (column < lo + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[here], column[here] - lo] = 1
        total += m @ m.T
    return total[a, b].astype(np.int64)


def forest(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the pairs of positions ``a``, ``b``, confirmed on the full sets."""
    size = np.array([len(s) for s in sets], np.int64)
    both = intersections(sets, a, b)
    linked = 100 * both >= percent * (size[a] + size[b] - both)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in zip(a[linked].tolist(), b[linked].tolist()):
        if (p := root(i)) != (q := root(j)):
            parent[p] = q
            out.append((i, j))
    return out


def confirmed(tasks: DataFrame, percent: int, registers: int = REGISTERS, width: int = 5) -> DataFrame:
    """Links (u, v) of rows (task, side, node, joined, registers, text); the pairs are those of ``survivors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(registers)
        for t in tasks_of(batches):
            sets = list(shingle_sets(t.column("text").combine_chunks(), width))
            side, joined, node = (t.column(c).to_numpy() for c in ("side", "joined", "node"))
            size = np.array([len(s) for s in sets], np.int64)
            a, b = alike(np.flatnonzero(side == 0), np.flatnonzero(side == 1), joined, size, matrix(t.column("registers")), percent, sketch)
            found = forest(sets, a, b, percent)
            yield pa.record_batch([pa.array([int(node[i]) for i, _ in found], pa.int64()), pa.array([int(node[j]) for _, j in found], pa.int64())], names=["u", "v"])

    spread = tasks.repartition(wide(tasks.sparkSession), "task").sortWithinPartitions("task", "side", "node")
    return arrow_map(spread.select("task", "side", "node", "joined", "registers", "text"), run, "u long, v long")


def open_blocks(stars: DataFrame, joined: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(task, side, node, joined): the block pairs of step 4. ``stars``: (hub, node, low, high), bounds of the distance."""
    hubs = stars.select("hub").distinct().select("hub", F.col("hub").alias("node"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    component = joined.select("node", F.col("component").alias("joined"))
    own = lambda c: F.coalesce("joined", c).alias("joined")
    all_ = stars.unionByName(hubs).join(component, "node", "left").select("hub", "node", "low", "high", own("node")).join(sizes, "node")
    main = hubs.select("hub", "node").join(component, "node", "left").select("hub", F.coalesce("joined", "node").alias("main"))
    members = park(all_.join(main, "hub").withColumn("out", F.col("joined") != F.col("main")), "star-members")
    open_ = members.where("out").select("hub").distinct()
    members = members.join(open_, "hub", "left_semi")
    # A star of one block's size is one block; a larger one has bins of the distance, as many as it has blocks.
    blocks_of = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    bins = park(members.groupBy("hub").agg(F.least(blocks_of, F.lit(BINS)).alias("bins")), "bins")
    members = members.join(bins, "hub").withColumn("bin", F.floor(F.col("low") * F.col("bins")).cast("int"))
    members = members.withColumn("out", F.col("out") | (F.col("bins") == 1)).withColumn("bin", F.when(F.col("bins") > 1, F.col("bin")).otherwise(0))
    # Blocks of bounded rows and shingles.
    key = ["hub", "bins", "out", "bin"]
    total = members.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    placed = park(members.join(total, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select(*key, "part", "node", "joined", "high"), "blocks")
    blocks = placed.groupBy(*key, "part").agg(F.max("high").alias("high"))
    # Outside members against all: the block of the smaller bin (then the lesser part) is the first.
    one = blocks.where("out").select("hub", "bins", *(F.col(c).alias(f"a_{c}") for c in ("out", "bin", "part", "high")))
    two = blocks.select("hub", "bins", *(F.col(c).alias(f"b_{c}") for c in ("out", "bin", "part", "high")))
    reach = 1 - percent / 100 + 1e-9
    pairs = one.join(two, ["hub", "bins"]).where("not b_out or a_bin < b_bin or (a_bin = b_bin and a_part <= b_part)")
    pairs = pairs.where((F.col("b_bin") / F.col("bins") <= F.col("a_high") + reach) & (F.col("a_bin") / F.col("bins") <= F.col("b_high") + reach))
    pairs = park(pairs.withColumn("task", F.monotonically_increasing_id()), "block-pairs")
    same = F.col("b_out") & (F.col("a_bin") == F.col("b_bin")) & (F.col("a_part") == F.col("b_part"))
    side = lambda c, n: pairs.where(~same | F.lit(n == 0)).select("task", F.lit(n).alias("side"), "hub", "bins", *(F.col(f"{c}_{x}").alias(x) for x in ("out", "bin", "part")))
    return side("a", 0).unionByName(side("b", 1)).join(placed, [*key, "part"]).select("task", "side", "node", "joined")


def near_duplicates(df: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: ``id_col``, n_shingles, component_id, kept, text_hash, component. Links: 100 * intersection >= percent * union.

    ``component`` is one number for each group (null for a text without words); it is ``component_id`` unless ids are
    null or repeated.
    """
    all_ = park(sketched(df, id_col, text_col), "sketches")
    some = all_.where("n_shingles > 0")
    first = F.min(F.struct("id", "text_hash")).alias("row")
    classes, plain = numbered(park(some.groupBy("set_key").agg(F.min("id").alias("id"), first, F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes"))
    buckets = band_keys(classes, band_rows_for(percent))
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("bucket", "hub")
    stars = park(buckets.join(hubs, "bucket").where("node <> hub").select("hub", "node").distinct(), "stars")
    members = members_of(df, all_, classes, stars.select("node").unionByName(stars.select(F.col("hub").alias("node"))), id_col, text_col)
    sketches, texts = members.select("node", "n_shingles", "registers"), members.select("node", "text")

    estimates = park(star_estimates(by_star(stars).join(sketches, "node")), "estimates")
    likely = estimates.where(F.col("estimate") >= floor_of(percent, REGISTERS)).select("hub", "node")
    distances = park(star_distances(by_star(likely).join(texts, "node")), "distances")
    links = distances.where(F.col("shared") * 100 >= F.col("either") * percent).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    joined = components(links)

    exact, about, error = 1 - F.col("shared") / F.col("either"), 1 - F.col("estimate"), ERRORS * (0.25 / REGISTERS) ** 0.5
    low, high = F.coalesce(exact, F.greatest(about - error, F.lit(0.0))), F.coalesce(exact, F.least(about + error, F.lit(1.0)))
    bounded = estimates.join(distances, ["hub", "node"], "left").select("hub", "node", low.alias("low"), high.alias("high"))
    blocks = park(open_blocks(bounded, joined, members.select("node", "n_shingles"), percent), "block-rows")
    left = park(survivors(blocks.join(sketches, "node"), percent), "survivors")
    rows = blocks.join(left, ["task", "side", "node"], "left_semi").join(members.select("node", "registers", "text"), "node")
    final = components(links.unionByName(park(confirmed(rows, percent), "links")))

    label = named(classes, classes.select("node", "set_key").join(final, "node", "left").select("node", "set_key", F.coalesce("component", "node").alias("component")), plain)
    with_set = some.select("id", "text_hash", "n_shingles", "set_key").join(label, "set_key").select("id", "text_hash", "n_shingles", "component_id", "component")
    without = all_.where("n_shingles = 0").select("id", "text_hash", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    out = with_set.unionByName(without)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "component")


def named(classes: DataFrame, grouped: DataFrame, plain: bool) -> DataFrame:
    """(set_key, component, component_id) of rows (node, set_key, component): the smallest id in each component.

    That is the component's number, but for components in which some class has a number that is no id.
    """
    if plain:
        return grouped.select("set_key", "component", F.col("component").alias("component_id"))
    grouped = park(grouped, "grouped")
    odd = classes.where("id is null or node <> id").select("node").join(grouped, "node").select("component").distinct()
    smallest = park(grouped.join(odd, "component", "left_semi").join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("smallest"), F.lit(True).alias("odd")), "smallest")
    joined = grouped.join(smallest, "component", "left")
    return joined.select("set_key", "component", F.when(F.col("odd"), F.col("smallest")).otherwise(F.col("component")).alias("component_id"))


def members_of(df: DataFrame, rows: DataFrame, classes: DataFrame, nodes: DataFrame, id_col: str, text_col: str, registers: int = REGISTERS, width: int = 5) -> DataFrame:
    """(node, n_shingles, registers, text): the classes in ``nodes``, with one text each; the only exchange of the table's texts.

    Registers are made again from the few texts that are left, which moves less than looking them up among all classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(registers)
        for b in batches:
            sets = list(shingle_sets(b.column("text"), width))
            regs = [sketch.registers(s).astype("<u2").tobytes() for s in sets]
            yield pa.record_batch([b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(regs, pa.binary()), b.column("text")], names=["node", "n_shingles", "registers", "text"])

    wanted = classes.select("node", "row.id", "row.text_hash").join(nodes.distinct(), "node", "left_semi")
    texts = keyed_texts(df, id_col, text_col)
    same = texts["id"].eqNullSafe(wanted["id"]) & (texts["text_hash"] == wanted["text_hash"])
    out = texts.join(wanted, same).select("node", "text")
    if not rows.groupBy("id", "text_hash").count().where("count > 1").isEmpty():  # repeated rows
        out = out.dropDuplicates(["node"])
    return park(arrow_map(out, run, "node long, n_shingles long, registers binary, text string"), "members")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: Exact: all pairs that share a shingle, over the whole table.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLE_SQL = {"op6_near_dedup": SQL}
