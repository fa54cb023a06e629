"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies.  The
expected copies are prefix-summed within the source, one random offset is
added, and a document is emitted once per integer boundary that its interval
crosses.  Documents are summed in order of their size class, so what a source
takes stays within about one document of its target.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; sources of size 0 get target 0 and take nothing; identical rows
are copies that are sampled one by one; an empty table gives an empty result.
Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, staged, table
from .ranking import expanded, numbered_runs, piece_bits

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20_251


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """A non-null key that orders like the source by code point, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """Targets of the sources by water-filling: (__g, source_size, n, target).

    ``sizes`` has one row per source (__g, source_size, n).  A source's target
    is ``min(level * weight, cap * source_size)`` with the level at which the
    targets sum to ``share`` of all sizes, which is where resharing the excess
    ends.  The windows run over the list of sources, not over documents.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy("__g")
    everything = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = sizes.select(
        "*",
        F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).alias("w"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
        (F.col("source_size") * F.lit(float(cap))).alias("most"),
    ).withColumn("turn", F.col("most") / F.col("w"))
    by_turn = Window.orderBy("turn", "__g")
    level = (F.col("budget") - F.coalesce(F.sum("most").over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "w"
    ).over(by_turn.rowsBetween(0, Window.unboundedFollowing))
    found = listed.withColumn("level", level)
    first = F.first(F.when(F.col("level") <= F.col("turn"), F.col("level")), ignorenulls=True)
    final = found.withColumn(
        "level", first.over(by_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    return final.select(
        "__g",
        "source_size",
        "n",
        F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"),
    )


def systematic_copies(docs: DataFrame, id_col: str, source_col: str, size: Column, seed: int = SEED) -> DataFrame:
    """Runs of identical (id, source, size) with their numbers and rates.

    Columns: __id, __g, __size, __start, __m, source_size, target, rate, shift.
    """
    light = staged(
        docs.select(F.col(id_col).alias("__id"), source_key(source_col).alias("__g"), size.alias("__size")),
        "mix-sizes",
    )
    sizes = light.groupBy("__g").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    wanted = targets(sizes)
    bits = piece_bits(light.count())
    spread = F.shiftrightunsigned(F.xxhash64("__id", F.lit(seed)), 64 - bits) if bits else F.lit(0).cast("long")
    # four size classes to each doubling, then hash pieces inside a class
    keyed = light.withColumn(
        "__piece", F.floor(F.log2(F.col("__size") + 1) * 4).cast("long") * F.lit(1 << bits) + spread
    )
    runs = numbered_runs(keyed, "__g", "__piece", ["__size", "__id"])
    return runs.join(wanted, "__g").select(
        "__id",
        "__g",
        "__size",
        "__start",
        "__m",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        (F.shiftrightunsigned(F.xxhash64("__g", F.lit(seed)), 12) / F.lit(float(1 << 52))).alias("shift"),
    )


def copies_of(number: Column) -> Column:
    """Integers crossed by the interval of the document with this number."""
    crossed = F.floor(F.col("shift") + F.col("rate") * (number + 1)) - F.floor(F.col("shift") + F.col("rate") * number)
    return F.least(crossed, F.ceil("rate")).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    runs = systematic_copies(table(spark, sf_dir, "documents"), "doc_id", "source", word_count("text"))
    rows = expanded(runs, "__i").withColumn("copies", copies_of(F.col("__i")))
    return rows.select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * F.col("copies")).alias("taken"),
        "copies",
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix emits, each as often as it is taken.

    Rows that share id, source and size take their numbers in order of hashes
    of the text and of all columns, so every one of them is sampled by itself
    and reruns agree.
    """
    runs = systematic_copies(docs, "doc_id", "source", word_count("text")).select(
        source_key("__id").alias("__k2"), F.col("__g").alias("__g2"), F.col("__size").alias("__size2"), "__start", "rate", "shift"
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("__row"),
        source_key("doc_id").alias("__k"),
        source_key("source").alias("__g"),
        word_count("text").alias("__size"),
    )
    # the join has the window's keys, so the texts are shuffled and sorted once
    same = Window.partitionBy("__k", "__g", "__size").orderBy(F.xxhash64("__row.text"), F.xxhash64("__row"))
    joined = rows.withColumn("__at", F.row_number().over(same) - 1).join(
        runs, (F.col("__k") == F.col("__k2")) & (F.col("__g") == F.col("__g2")) & (F.col("__size") == F.col("__size2"))
    )
    number = F.col("__start") + F.col("__at")
    return (
        joined.withColumn("__n", copies_of(number))
        .filter("__n > 0")
        .select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
        .select("__row.*")
    )
