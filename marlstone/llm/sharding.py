"""K-d tree sharding with DataFrame operations only.

Nodes are split at the distributed weighted median (weights are bytes) along
their widest metadata dimension until each leaf is one shard.  Every level of
the tree reads the points once and makes a histogram of the bytes of each node
along each dimension, of 2**16 bins at most.  From it come a node's weight, its
widest dimension and the bin in which its median lies.  Where that bin weighs
more than ``FINE`` of a leaf, its rows are read again by the next 16 bits of
their sort key, until the cut is as fine; no node's rows meet in one task, and
the driver sees one row per node and dimension.

A row's sort key is its coordinate, a hash of its text and a hash of its id.
Equal texts share all coordinates (those of the smallest doc_id among them), so
copies stay in one shard; only a group that weighs over a leaf is cut, by the
hash of doc_id.  The cut goes to the nearer end of the last bin or group.

Defined results: null or empty texts have size 1; null metadata have the
coordinate 0; fully identical rows share a shard and get slots of their own; an
empty table gives an empty result.  Only named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty
from .ranking import expanded, numbered_runs, piece_bits

SHARDS = 16
DIGIT = 16
#: Bits of a coordinate, of the text hash and of the id hash in a sort key.
BITS = {"c": 16, "t": 48, "h": 32}
TOTAL_BITS = sum(BITS.values())
#: A group of equal texts is cut only where it weighs more than this part of a leaf: where no leaf holds it.
WHOLE = 1.0
#: A cut may miss a median by half this part of a leaf.
FINE = 0.0005
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")


@dataclass
class Node:
    """A node of the tree; ``leaves`` shards from ``first`` on lie below it."""

    name: int
    first: int
    leaves: int
    split: tuple[str, int] | None = None
    low: Node | None = None
    high: Node | None = None


# Expressions over the tree are SQL text: as columns, each comparison would be a
# call to the JVM, and there are hundreds in a level.


def _digit(dim: str, start: int) -> str:
    """Bits ``start .. start + DIGIT`` of the sort key along a dimension, counted from its top."""
    for column, width in ((dim, BITS["c"]), ("t", BITS["t"]), ("h", BITS["h"])):
        if start < width:
            return f"(shiftright({column}, {width - start - DIGIT}) & {(1 << DIGIT) - 1})"
        start -= width
    raise ValueError("beyond the key")


def _parts(key: int) -> tuple[int, int, int]:
    h, t = BITS["h"], BITS["t"]
    return key >> (h + t), (key >> h) & ((1 << t) - 1), key & ((1 << h) - 1)


def _begins(dim: str, key: int, bits: int) -> str:
    """Whether the first ``bits`` bits of a row's sort key are those of ``key``."""
    tests = []
    for column, width, part in zip((dim, "t", "h"), BITS.values(), _parts(key), strict=True):
        if bits > 0:
            off = max(0, width - bits)
            tests.append(f"shiftright({column}, {off}) = {part >> off}L")
        bits -= width
    return " AND ".join(tests)


def _below(dim: str, key: int) -> str:
    """Whether a row's sort key is under ``key``."""
    c, t, h = _parts(key)
    return f"({dim} < {c}L OR ({dim} = {c}L AND (t < {t}L OR (t = {t}L AND h < {h}L))))"


def _placed(node: Node, leaf) -> str:
    if node.split is None:
        return str(leaf(node))
    return f"IF({_below(*node.split)}, {_placed(node.low, leaf)}, {_placed(node.high, leaf)})"


def _place(node: Node, leaf) -> Column:
    """What ``leaf`` gives the leaf under ``node`` that a row falls into."""
    return F.expr(_placed(node, leaf))


def coordinates(docs: DataFrame) -> DataFrame:
    """(doc_id, size, crc, t, h, dimensions), equal texts with equal dimensions."""
    text = text_or_empty("text")
    low = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS["h"])
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.xxhash64(text).alias("__text"),
        low.alias("h"),
        F.struct("doc_id", "source", "lang").alias("__meta"),
    )
    staged_rows = staged(rows, "kd-rows")
    # written, so that the join below stands on plain scans and can split hot texts
    groups = staged(staged_rows.groupBy("__text", "size").agg(F.min("__meta").alias("__of")), "kd-groups")
    span = groups.agg(F.min("__of.doc_id").alias("a"), F.max("__of.doc_id").alias("b")).first()
    least, width = span.a or 0, (span.b or 0) - (span.a or 0) + 1  # Python's integers have no bound
    full = float(1 << BITS["c"])
    name = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(c), 64 - BITS["c"])).cast("long")
    groups = groups.select(
        F.col("__text").alias("__text2"),
        F.col("size").alias("__size2"),
        F.floor(F.least(F.log2("size") / 40, F.lit(1.0)) * (full - 1)).cast("long").alias("d_size"),
        name("__of.source").alias("d_source"),
        name("__of.lang").alias("d_lang"),
        # doubles, as the difference of two ids may be no long
        F.coalesce(F.floor((F.col("__of.doc_id").cast("double") - F.lit(float(least))) / F.lit(float(width)) * (full - 1)), F.lit(0)).cast("long").alias("d_id"),
    )
    return staged_rows.join(groups, (F.col("__text") == F.col("__text2")) & (F.col("size") == F.col("__size2"))).select(
        "doc_id", "size", "crc", F.shiftrightunsigned("__text", 64 - BITS["t"]).alias("t"), "h", *DIMENSIONS
    )


def _nearer(low: int, step: int, before: float, weight: float, goal: float) -> int:
    """The end of the bin low .. low + step at which the part below is nearer its goal."""
    return low if goal - before < before + weight - goal and before > 0 else low + step


def _weighed() -> list[Column]:
    """The bytes of a bin, and whether it holds several texts."""
    return [F.sum("size").alias("w"), (F.min("t") < F.max("t")).alias("several")]


def _crossings(bins: DataFrame, goals: dict[int, tuple[int, float]]) -> list:
    """For each node its bin along a dimension in which the bytes below reach the goal.

    ``goals`` has the dimension and the goal of each node; ``bins`` has node, dim,
    digit and w, 2**DIGIT bins for a node and dimension at most.
    """
    asked = " OR ".join(f"(node = {n} AND dim = {dim})" for n, (dim, _) in goals.items())
    goal = "CASE node " + " ".join(f"WHEN {n} THEN {g!r}D" for n, (_, g) in goals.items()) + " END"
    upto = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    found = bins.filter(asked).withColumn("upto", F.sum("w").over(upto)).filter(F.col("upto") >= F.expr(goal))
    return found.groupBy("node").agg(F.min_by(F.struct("digit", "w", "upto", "several"), "digit").alias("x")).select("node", "x.*").collect()


def _level(rows: DataFrame, place: Column, full: dict[str, int]) -> tuple[DataFrame, dict[int, dict]]:
    """Histograms of the nodes along all dimensions, and what they say of each node."""
    along = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("digit")) for i, d in enumerate(DIMENSIONS)]))
    bins = rows.select(place.alias("node"), "size", "t", along.alias("x")).filter("node >= 0")
    bins = staged(bins.groupBy("node", "x.dim", "x.digit").agg(*_weighed()), "kd-bins")
    found: dict[int, dict] = {}
    for r in bins.groupBy("node", "dim").agg(F.sum("w").alias("w"), F.min("digit").alias("lo"), F.max("digit").alias("hi")).collect():
        found.setdefault(r.node, {"w": r.w, "span": {}})["span"][DIMENSIONS[r.dim]] = r.hi - r.lo
    if not full:
        full.update({d: max(1, n) for d, n in found[0]["span"].items()} if 0 in found else {})
    for node in found.values():
        node["dim"] = max(DIMENSIONS, key=lambda d: node["span"][d] / full[d])
    return bins, found


def _medians(rows: DataFrame, place: Column, bins: DataFrame, dims: dict[int, str], goals: dict[int, float], leaf: float) -> dict[int, int]:
    """For each node the key at which its rows below weigh about its goal."""
    keys: dict[int, int] = {}
    prefix, passed, open_nodes = dict.fromkeys(dims, 0), dict.fromkeys(dims, 0.0), set(dims)
    for start in range(0, TOTAL_BITS, DIGIT):
        if not open_nodes:
            break
        rest = TOTAL_BITS - start
        step = 1 << (rest - DIGIT)
        if start:
            nodes = sorted(open_nodes)
            inside = " OR ".join(f"(node = {n} AND {_begins(dims[n], prefix[n], start)})" for n in nodes)
            digit = "CASE node " + " ".join(f"WHEN {n} THEN {_digit(dims[n], start)}" for n in nodes) + " END"
            bins = rows.withColumn("node", place).filter(inside).groupBy("node", F.expr(digit).alias("digit")).agg(*_weighed())
            bins = bins.withColumn("dim", F.lit(0))
        wanted = {n: (0 if start else DIMENSIONS.index(dims[n]), float(goals[n] - passed[n])) for n in sorted(open_nodes)}
        crossing = _crossings(bins, wanted)
        for row in crossing:
            n = row.node
            low, before = prefix[n] + row.digit * step, passed[n] + row.upto - row.w
            # a bin of one text is as fine as can be, unless no leaf holds it
            group = not row.several and row.w <= WHOLE * leaf
            if group or rest == DIGIT or row.w <= FINE * leaf:
                keys[n] = _nearer(low, step, before, row.w, goals[n])
                open_nodes.discard(n)
            else:
                prefix[n], passed[n] = low, before
        for n in open_nodes - {r.node for r in crossing}:
            keys[n] = prefix[n] + (1 << rest)
        open_nodes &= {r.node for r in crossing}
    return keys


def build_tree(rows: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> Node:
    """The tree over ``rows``; with ``target_bytes`` it has as many leaves as needed."""
    root, front, full, leaf = Node(0, 0, shards or 1), [], {}, 0.0
    front.append(root)
    while front:
        open_names = {n.name for n in front}
        place = _place(root, lambda n, names=open_names: n.name if n.name in names else -1)
        bins, stats = _level(rows, place, full)
        if not leaf:
            total = stats[0]["w"] if 0 in stats else 0
            root.leaves = shards if target_bytes is None else max(1, -(-total // target_bytes))
            leaf = total / max(root.leaves, 1)
            if not total or root.leaves == 1:
                break
        dims = {n.name: stats[n.name]["dim"] for n in front if n.name in stats}
        goals = {n.name: stats[n.name]["w"] * (n.leaves - n.leaves // 2) / n.leaves for n in front if n.name in stats}
        keys = _medians(rows, place, bins, dims, goals, leaf)
        after = []
        for n in front:
            if n.name not in keys:
                continue
            half = n.leaves - n.leaves // 2
            n.split = dims[n.name], keys[n.name]
            n.low = Node(2 * n.name + 1, n.first, half)
            n.high = Node(2 * n.name + 2, n.first + half, n.leaves - half)
            after += [x for x in (n.low, n.high) if x.leaves > 1]
        front = after
    return root


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, crc, shard, slot) of every row of ``docs``."""
    rows = staged(coordinates(docs), "kd-points")
    tree = build_tree(rows, shards, target_bytes)
    bits = piece_bits(rows.count())
    piece = F.shiftright("h", BITS["h"] - bits) if bits else F.lit(0).cast("long")
    placed = rows.select("doc_id", "size", "crc", _place(tree, lambda n: n.first).alias("shard"), piece.alias("__piece"))
    runs = numbered_runs(placed, "shard", "__piece", ["doc_id", "size", "crc"])
    return expanded(runs, "slot").drop("__piece")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
