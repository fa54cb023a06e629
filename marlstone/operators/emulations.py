"""Operators that Spark's public API lacks, composed from built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, value: Sequence[str]) -> DataFrame:
    """For each left row the values of the last right row at or before it.

    Both sides are stacked and the last right row is carried forward in one
    window, so the plan is one shuffle by key and a sort, never a range join.
    ``on`` must be unique per key on the right.
    """
    carried = F.struct(*[F.col(v) for v in value])
    stacked = left.select(F.struct(*left.columns).alias("__row"), by, on, F.lit(1).alias("__side"), F.lit(None).cast(_type(right, value)).alias("__value"))
    events = right.select(F.lit(None).cast(_type(left, left.columns)).alias("__row"), by, on, F.lit(0).alias("__side"), carried.alias("__value"))
    before = Window.partitionBy(by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = stacked.unionByName(events).withColumn("__last", F.last("__value", ignorenulls=True).over(before))
    return joined.filter("__side = 1").select("__row.*", *[F.col(f"__last.{v}").alias(f"last_{v}") for v in value])


def _type(df: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: float) -> DataFrame:
    """Pairs with ``abs(a - b) <= width``: an equi-join on cells of that width.

    The right side is put into its own and both neighbouring cells, so the pairs
    of one cell meet in one task and no nested loop is planned.
    """
    cell = F.floor(F.col(a) / width).cast("long")
    near = F.explode(F.array(*[F.floor(F.col(b) / width).cast("long") + d for d in (-1, 0, 1)]))
    joined = left.withColumn("__cell", cell).join(right.withColumn("__cell", near), "__cell")
    return joined.filter(F.abs(F.col(a) - F.col(b)) <= width).drop("__cell")


#: Rows of a left and of a right piece in ``block_join``, and pairs that a task makes.
LEFT_PIECE, RIGHT_PIECE, TASK_PAIRS = 8192, 512, 8_000_000


def block_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Inner join on a key with few values, so that pairs far outnumber the rows.

    A plain join sends each value to one task and sizes its tasks by the bytes
    shuffled, not by the pairs.  Here each value's rows are dealt by a hash of
    their id into pieces of about ``LEFT_PIECE`` and ``RIGHT_PIECE`` rows; each
    left piece meets each right one, kept as an array, under a key of its own.
    For one pair the shuffles move 1/512 + 1/8192 rows, and the number of tasks
    follows the pairs, which are counted first.  Ids that repeat only make a
    piece larger; they are not returned.  The sizes of the pieces are broadcast,
    one row for each value of the key.
    """
    counts = [df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "__n"), (right, "__m"))]
    both = counts[0].join(counts[1], key)
    pairs = both.agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0
    tasks = min(int(pairs // TASK_PAIRS) + 1, 100_000)
    pieces = F.broadcast(both.select(key, F.ceil(F.col("__n") / LEFT_PIECE).alias("__lefts"), F.ceil(F.col("__m") / RIGHT_PIECE).alias("__rights")))
    number = lambda column, of: F.pmod(F.xxhash64(column), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    rows = left.join(pieces, key).select(*[c for c in left.columns if c != left_id], number(left_id, "__lefts").alias("__l"), each("__rights").alias("__r"))
    kept = F.struct(*[c for c in right.columns if c not in (key, right_id)])
    arrays = right.join(pieces, key).groupBy(key, "__lefts", number(right_id, "__rights").alias("__r")).agg(F.collect_list(kept).alias("__kept"))
    arrays = arrays.select(key, "__r", "__kept", each("__lefts").alias("__l"))
    on = [key, "__l", "__r"]
    # a merge join also puts a piece's rows next to each other, which files compress
    joined = rows.repartition(tasks, *on).join(arrays.repartition(tasks, *on).hint("merge"), on)
    return joined.select(*[c for c in left.columns if c != left_id], F.inline("__kept"))


def qualify(df: DataFrame, condition: Column | str) -> DataFrame:
    """QUALIFY: filter on window expressions without keeping them."""
    test = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumn("__qualify", test).filter("__qualify").drop("__qualify")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Deterministic dropDuplicates: the first row of each key in a total order."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark prunes to k rows before the shuffle."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= k)


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Number the sessions of each key: a gap over ``gap`` starts a new one."""
    order = Window.partitionBy(key).orderBy(ts)
    fresh = F.coalesce((F.col(ts) - F.lag(ts).over(order)) > F.expr(f"INTERVAL {gap}"), F.lit(True))
    return df.withColumn("__new", fresh.cast("int")).withColumn("session", F.sum("__new").over(order)).drop("__new")


def exact_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of each group, as percentile() gives them.

    Equal values are counted with map-side sums, values fall into bins of a
    rising function (4,096 to each doubling), and only the bins in which a wanted
    rank lies are sorted.  So no task holds a group.  Nulls do not count.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__bin", F.floor(F.signum("__v") * F.log2(F.abs("__v") + 1) * 4096))
    bins = counts.groupBy("__g", "__bin").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy("__g").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("*", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base"), F.sum("__m").over(Window.partitionBy("__g")).alias("__all"))
    # the ranks, from 0, between which each share lies
    wanted = F.explode(F.array(*[F.lit(s) for s in sorted(set(shares.values()))]))
    ranks = bins.select("*", wanted.alias("__share")).withColumn("__at", (F.col("__all") - 1) * F.col("__share"))
    ranks = ranks.select("*", F.explode(F.array(F.floor("__at"), F.ceil("__at"))).alias("__rank")).distinct()
    ranks = ranks.filter("__rank >= __base AND __rank < __base + __m").select("__g", "__bin", "__base", "__share", "__at", "__rank")
    narrow = counts.join(ranks.select("__g", "__bin", "__base").distinct(), ["__g", "__bin"])
    inside = Window.partitionBy("__g", "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("__first", F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    hit = placed.drop("__base").join(ranks, ["__g", "__bin"]).filter("__rank >= __first AND __rank < __first + __n")
    low, high, part = F.min("__v"), F.max("__v"), F.first("__at") - F.floor(F.first("__at"))
    points = hit.groupBy("__g", "__share").agg(((1 - part) * low + part * high).alias("__p"))
    chosen = [F.max(F.when(F.col("__share") == s, F.col("__p"))).alias(name) for name, s in shares.items()]
    return points.groupBy(F.col("__g").alias(group)).agg(*chosen)
