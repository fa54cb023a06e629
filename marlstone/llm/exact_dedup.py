"""Exact deduplication with an extendible-hash index on shared files.

1. Tasks scan the rows and write index entries to the shared folder: one per
   distinct normalised text and memory-bounded chunk, with the rows it stands
   for.  That combines copies before any shuffle.
2. A directory over the top bits of the 64-bit key is doubled until no bucket
   is over its page size.  The page grows with the input, to an eighth of what
   2**MAX_DEPTH equal buckets would hold at least, so that the directory stays
   within 2**MAX_DEPTH slots; owners stream, so a page needs no memory.
3. Entries whose key no other entry has (proven by a Bloom filter of the keys
   that several have, 8 MB at most) are chains of their own; their texts are not
   shuffled.
4. Owner tasks process buckets, which are key ranges, as sorted streams: entries
   of one key form chains by comparing the bytes of their texts, so keys that
   collide stay apart.  They do so in two rounds.  First every bucket is dealt
   into ``SLICES`` owners and each hands on one leader for each of its chains;
   then the leaders of a bucket meet in one owner.  So a hot text, of which each
   chunk has an entry, neither lands in one task nor gathers in memory: links to
   leaders are written as they are found.
5. The resolved entries are written as the index and joined to the rows by
   entry number.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``.  Of equal
texts the row with the most code points stays, then the smallest doc_id (null
last), then the first entry; exactly one row of a group stays, also when rows
are repeated.  Null counts as empty; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bloom
from .common import as_bytes, prepare, slices, staged, table

SPACES = b" \t\n\x0b\x0c\r"
MAX_DEPTH = 16
PAGE_BYTES = 256 << 10
SLICES = 64
CHUNK_BYTES = 24 << 20

ENTRY = T.StructType(
    [
        T.StructField("e_entry", T.LongType()),
        T.StructField("e_key", T.LongType()),
        T.StructField("e_sha", T.StringType()),
        T.StructField("e_bytes", T.LongType()),
        T.StructField("e_chars", T.LongType()),
        T.StructField("e_best", T.LongType()),
        T.StructField("e_at", T.IntegerType()),
        T.StructField("e_ids", T.ArrayType(T.LongType())),
    ]
)

def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def key_of(text: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >= 1 << 63 else h


def code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def _rank(chars: int, doc_id: int | None) -> tuple:
    """Sorts the row that stays first."""
    return -chars, doc_id is None, doc_id or 0


def entry_writer(schema: T.StructType, text: str, id_col: str, key=key_of):
    """A mapInArrow function from rows to entries with their best row."""
    out = to_arrow_schema(T.StructType(ENTRY.fields + schema.fields))

    def combine(batches: list[pa.RecordBatch], first: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows.column(id_col).to_pylist()
        found: dict[bytes, list] = {}
        position = 0
        for batch in batches:
            for raw in as_bytes(batch.column(batch.schema.get_field_index(text))):
                rank = _rank(code_points(raw), ids[position])
                norm = normalised(raw)
                have = found.get(norm)
                if have is None:
                    found[norm] = [rank, position, [position]]
                else:
                    have[2].append(position)
                    if rank < have[0]:
                        have[0], have[1] = rank, position
                position += 1
        best = rows.take(pa.array([v[1] for v in found.values()], pa.int64()))
        columns = {
            "e_entry": range(first, first + len(found)),
            "e_key": [key(n) for n in found],
            "e_sha": [hashlib.sha256(n).hexdigest() for n in found],
            "e_bytes": [len(n) for n in found],
            "e_chars": [-v[0][0] for v in found.values()],
            "e_best": [ids[v[1]] for v in found.values()],
            "e_at": [v[2].index(v[1]) for v in found.values()],
            "e_ids": [[ids[p] for p in v[2]] for v in found.values()],
        }
        arrays = [pa.array(columns[f.name], type=f.type) for f in out if f.name in columns]
        arrays += [best.column(f.name).combine_chunks().cast(f.type) for f in out if f.name not in columns]
        return pa.RecordBatch.from_arrays(arrays, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 40
        for batch in slices(batches, text):
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                made = combine(held, number)
                number += made.num_rows
                held, size = [], 0
                yield from slices(iter([made]), text)
        if held:
            yield from slices(iter([combine(held, number)]), text)

    return run, T.StructType(ENTRY.fields + schema.fields)


class Directory:
    """Extendible hashing over the top bits of keys, from counts by prefix.

    ``weights[p]`` is the weight of the keys whose top MAX_DEPTH bits are p.
    A bucket over ``page`` splits by its next bit; when its local depth is the
    directory's depth the directory doubles first.
    """

    def __init__(self, weights: dict[int, int], page: int = PAGE_BYTES, max_depth: int = MAX_DEPTH):
        self.depth = 0
        self.slots = [0]
        self.buckets: list[tuple[int, int]] = [(0, 0)]  # (local depth, prefix)
        waiting = [(0, sorted(weights.items()))]
        while waiting:
            bucket, content = waiting.pop()
            local, prefix = self.buckets[bucket]
            if local == max_depth or sum(w for _, w in content) <= page:
                continue
            if local == self.depth:
                self.slots = [b for b in self.slots for _ in (0, 1)]
                self.depth += 1
            new, bit = len(self.buckets), max_depth - local - 1
            self.buckets[bucket] = (local + 1, prefix * 2)
            self.buckets.append((local + 1, prefix * 2 + 1))
            span = 1 << (self.depth - local - 1)
            at = (prefix * 2 + 1) * span
            self.slots[at : at + span] = [new] * span
            waiting.append((bucket, [x for x in content if not x[0] >> bit & 1]))
            waiting.append((new, [x for x in content if x[0] >> bit & 1]))


CHAIN = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("e_key", T.LongType()),
        T.StructField("link", T.LongType()),
        T.StructField("leader", T.LongType()),
        T.StructField("chain", T.IntegerType()),
        T.StructField("keep_entry", T.LongType()),
        T.StructField("e_chars", T.LongType()),
        T.StructField("e_best", T.LongType()),
        T.StructField("e_count", T.LongType()),
        T.StructField("text", T.BinaryType()),
    ]
)


def owner(texts_out: bool):
    """A mapInArrow function over entries sorted by (bucket, key, entry).

    It writes a row for each entry, with its ``link`` and the ``leader`` of its
    chain, as soon as it is read, and a row for each chain, without a link, when
    its key ends.  Only the chains of the key at hand are held.
    """
    out = to_arrow_schema(CHAIN)

    def ended(bucket: int, key: int, chains: list) -> list[tuple]:
        return [
            (bucket, key, None, leader, number, keep, -rank[0], keep_id, size, norm if texts_out else None)
            for number, (norm, rank, keep, keep_id, size, leader) in enumerate(chains)
        ]

    def pack(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chains, rows, size = None, [], [], 0
        for batch in slices(batches, "text"):
            texts = as_bytes(batch.column("text"))
            light = batch.select(["bucket", "e_key", "e_entry", "keep_entry", "e_chars", "e_best", "e_count"]).to_pydict()
            for i, raw in enumerate(texts):
                at = (light["bucket"][i], light["e_key"][i])
                if at != current:
                    if current is not None:
                        rows += ended(*current, chains)
                        size += sum(len(c[0]) for c in chains)
                    current, chains = at, []
                    if len(rows) >= 20_000 or size > CHUNK_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
                entry, keep, best = light["e_entry"][i], light["keep_entry"][i], light["e_best"][i]
                norm, rank = normalised(raw), (*_rank(light["e_chars"][i], best), keep)
                number = next((k for k, c in enumerate(chains) if c[0] == norm), None)  # bytes, not hashes
                if number is None:
                    number = len(chains)
                    chains.append([norm, rank, keep, best, light["e_count"][i], entry])
                else:
                    chain = chains[number]
                    chain[4] += light["e_count"][i]
                    if rank < chain[1]:
                        chain[1:4] = rank, keep, best
                rows.append((*at, entry, chains[number][5], number, None, None, None, None, None))
                if len(rows) >= 100_000:
                    yield pack(rows)
                    rows, size = [], 0
        if current is not None:
            yield pack(rows + ended(*current, chains))

    return run


def _chained(placed: DataFrame, deal: list[str], texts_out: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """Links of entries to leaders, and the chains that they form."""
    met = placed.repartition(*deal).sortWithinPartitions(*deal, "e_key", "e_entry")
    rows = staged(met.mapInArrow(owner(texts_out), CHAIN), name)
    return rows.filter("link IS NOT NULL"), rows.filter("link IS NULL")


def _shared_keys(entries: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys that several entries have."""
    shared = staged(entries.groupBy("e_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("e_key"), "dedup-shared")
    return bloom.build(shared.select(F.xxhash64("e_key").alias("h")), bloom.log2_bits(shared.count()))


def _keyed(rows: DataFrame, column: str, bits: np.ndarray, inside: bool) -> DataFrame:
    """The rows whose long column may be in the filter, or those where it is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = bloom.test(bits, batch.column("h").to_numpy())
                yield batch.remove_column(batch.schema.get_field_index("h")).filter(pa.array(found == inside))

    return rows.select("*", F.xxhash64(column).alias("h")).mapInArrow(run, rows.schema)


def build_index(
    docs: DataFrame, text: str, id_col: str, page: int = PAGE_BYTES, key=key_of, slices_: int = SLICES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, directory, resolved entries), all written to the shared folder."""
    spark = prepare(docs.sparkSession)
    write, schema = entry_writer(docs.schema, text, id_col, key)
    entries = staged(docs.mapInArrow(write, schema), "dedup-entries")
    prefix = F.shiftrightunsigned("e_key", 64 - MAX_DEPTH).cast("int")
    weights = entries.groupBy(prefix.alias("p")).agg(F.sum(F.col("e_bytes") + 64).alias("w")).collect()
    tree = Directory({r.p: r.w for r in weights}, max(page, sum(r.w for r in weights) >> (MAX_DEPTH - 3)))
    directory = staged(
        spark.createDataFrame(list(enumerate(tree.slots)), "slot int, bucket int").coalesce(1), "dedup-directory"
    )
    slot = F.shiftrightunsigned("e_key", 64 - tree.depth).cast("int") if tree.depth else F.lit(0)
    bits = _shared_keys(entries)
    light = entries.select("e_key", "e_entry", "e_chars", "e_best", F.size("e_ids").cast("long").alias("e_count"), F.col(text).cast("binary").alias("text"))
    placed = lambda rows: rows.select("*", slot.alias("slot")).join(F.broadcast(directory), "slot").drop("slot")  # noqa: E731 -- at most 2**MAX_DEPTH slots
    alone = placed(_keyed(light.drop("text"), "e_key", bits, False)).select(
        F.col("bucket").alias("x_bucket"), F.col("e_key").alias("x_key"), F.lit(0).alias("x_chain"), F.col("e_entry").alias("x_entry"),
        F.col("e_entry").alias("x_keep_entry"), F.col("e_best").alias("x_keep_id"), F.col("e_count").alias("x_size"),
    )
    shared = placed(_keyed(light, "e_key", bits, True)).withColumn("keep_entry", F.col("e_entry")).withColumn("slice", F.pmod(F.shiftright("e_entry", 40), F.lit(slices_)))
    links, chains = _chained(shared, ["bucket", "slice"], True, "dedup-slices")
    leaders, resolved = _chained(
        chains.select("bucket", "e_key", F.col("leader").alias("e_entry"), "keep_entry", "e_chars", "e_best", "e_count", "text"),
        ["bucket"], False, "dedup-chains",
    )
    ends = leaders.select(F.col("link").alias("first"), F.col("leader").alias("last")).join(
        resolved.select(F.col("leader").alias("last"), "chain", "keep_entry", "e_best", "e_count"), "last"
    )
    together = links.select("bucket", "e_key", "link", F.col("leader").alias("first")).join(staged(ends, "dedup-ends"), "first").select(
        F.col("bucket").alias("x_bucket"), F.col("e_key").alias("x_key"), F.col("chain").alias("x_chain"), F.col("link").alias("x_entry"),
        F.col("keep_entry").alias("x_keep_entry"), F.col("e_best").alias("x_keep_id"), F.col("e_count").alias("x_size"),
    )
    return entries, directory, staged(alone.union(together), "dedup-index")


def grouped(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per input row: e_id, keep_id, group_size, kept, e_sha."""
    joined = entries.select("e_entry", "e_sha", "e_at", "e_ids").join(resolved, F.col("e_entry") == F.col("x_entry"))
    return joined.select("*", F.posexplode("e_ids").alias("e_pos", "e_id")).select(
        "e_id",
        F.col("x_keep_id").alias("keep_id"),
        F.col("x_size").alias("group_size"),
        ((F.col("e_entry") == F.col("x_keep_entry")) & (F.col("e_pos") == F.col("e_at"))).alias("kept"),
        "e_sha",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, id_col = f"c{docs.columns.index('text')}", f"c{docs.columns.index('doc_id')}"
    entries, _, resolved = build_index(renamed, text, id_col)
    # texts are shuffled only where a Bloom filter (8 MB at most) says that they may go
    gone = staged(resolved.filter("x_entry <> x_keep_entry").select("x_entry"), "dedup-gone")
    bits = bloom.build(gone.select(F.xxhash64("x_entry").alias("h")), bloom.log2_bits(gone.count()))
    rows = entries.select("e_entry", *[f"c{i}" for i in range(len(docs.columns))])
    left = _keyed(rows, "e_entry", bits, True).join(gone, F.col("e_entry") == F.col("x_entry"), "left_anti")
    kept = _keyed(rows, "e_entry", bits, False).union(left)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entries, _, resolved = build_index(docs, "text", "doc_id")
    return grouped(entries, resolved).select(
        F.col("e_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("e_sha").alias("text_sha256")
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
