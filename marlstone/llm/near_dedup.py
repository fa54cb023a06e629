"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of distinct 5-word shingles; two are linked when
``100 * |A & B| >= 75 * |A | B|``.  The steps:

1. A scan gives every document its set size, a digest of the set and 128 MinHash
   lanes.  Documents with equal sets collapse into one node.
2. Nodes that share a band of four lanes are candidates (32 bands: a pair at the
   threshold is missed with probability (1 - 0.75**4)**32 = 5e-6).
3. Owner tasks stream the buckets and compare candidates lane batch by lane
   batch; a pair is dropped once the posterior probability of reaching the
   threshold falls below ``MISS``.  The first pass emits for each member its best
   partner among the members before it, and those pairs are verified on their
   full shingle sets and united.
4. The second pass makes the result whole: in every bucket that still holds
   several components, each member outside the largest one is compared with all
   members of other components, and pairs that stay alive are verified on their
   full sets in the same task.  Only links are emitted, at most one for each two
   components of a bucket, never all pairs of a group.

No task holds more than a bucket of ``BUCKET`` members or ``BUCKET_SHINGLES``
shingles, however hot a band is.  The first pass, which is linear, deals larger
buckets into pieces, anew in each band, so that groups of copies still grow
together.  The second pass compares, in a larger bucket, blocks of strays with
blocks of members, each pair of blocks in a task of its own.  Only where the
strays alone would fill several blocks, so that blocks would be many, the
bucket is first cut by size of the sets (which is exact) and by the other bands
(a pair at the threshold that shares no other is missed with probability 8e-5,
within ``MISS``); what is left goes by blocks.  A member of a hot bucket is thus
sent at most 62 times for that, once, and never again by the bands it was cut by.

Defined results: null, empty and all-space texts have size 0 and are linked
with nothing; with one to four words the whole sequence is the one shingle;
rows that repeat a doc_id share its component; a null doc_id never names a
component unless its component has no other.  An empty table gives an empty
result.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import as_bytes, prepare, record_batch, slices, staged, table
from .components import components

WIDTH = 5
LANES = 128
ROWS = 4
BANDS = LANES // ROWS
STEP = 32
THRESHOLD = 0.75
MISS = 1e-4
BUCKET, BUCKET_SHINGLES = 1024, 8 << 20
HELD_BYTES = 64 << 20
LAGS = 64
CACHE = 200_000

FEATURES = "doc_id long, th long, n long, digest binary, sig array<long>"
_MIX = tuple(np.uint64(xxhash.xxh64_intdigest(b"shingle", i) | 1) for i in range(WIDTH + 1))
_LANE = np.array([xxhash.xxh64_intdigest(b"lane", i) & 0xFFFFFFFF | 1 for i in range(LANES)], dtype=np.uint32)


class _Words(dict):
    """Hashes of words; emptied when full, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    tokens = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    if len(tokens) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 1)], dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - WIDTH + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH):
        out += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _MIX[k]
    out ^= out >> np.uint64(32)
    out *= _MIX[WIDTH]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def lanes(hashes: np.ndarray) -> np.ndarray:
    """MinHash of each lane, folded to 16 bits."""
    least = None
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        x = (part >> np.uint64(32)).astype(np.uint32)[:, None] * _LANE[None, :]
        x ^= x >> np.uint32(15)
        x += part.astype(np.uint32)[:, None]
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        m = x.min(axis=0)
        least = m if least is None else np.minimum(least, m)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.list_(pa.int64()))]
    )
    for batch in slices(batches, "text"):
        sizes, digests, sigs = [], [], []
        for text in as_bytes(batch.column("text")):
            s = shingles(text, words)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sigs.append(lanes(s).view(np.int64) if len(s) else np.empty(0, np.int64))
        yield record_batch(
            {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n": sizes, "digest": digests, "sig": sigs}, schema
        )


def least_agreement(miss: float = MISS) -> list[int]:
    """Fewest agreeing lanes, per batch of STEP lanes, that keep a pair alive.

    With a uniform prior the similarity given m of n agreeing lanes is
    Beta(m+1, n-m+1), and P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(STEP, LANES + 1, STEP):
        total, m = 0.0, -1
        while True:
            m += 1
            total += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


def _survivors(sig: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, bounds: list[int]):
    """Of the pairs (i, j) those that stay alive, and their agreeing lanes."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    alive = small * 100 >= large * 75
    i, j = i[alive], j[alive]
    agree = np.zeros(len(i), dtype=np.int32)
    for step, bound in enumerate(bounds):
        if not len(i):
            break
        part = slice(step * STEP, (step + 1) * STEP)
        agree = agree + (sig[i, part] == sig[j, part]).sum(axis=1, dtype=np.int32)
        alive = agree >= bound
        i, j, agree = i[alive], j[alive], agree[alive]
    return i, j, agree


def _runs(bucket: np.ndarray) -> np.ndarray:
    """Numbers of the buckets, which lie one after another."""
    return np.cumsum(np.concatenate([[True], bucket[1:] != bucket[:-1]])) - 1


def _best_partners(rows: dict, bounds: list[int]) -> dict:
    """For each member its best partner among the LAGS members before it."""
    run, total = _runs(rows["bucket"]), len(rows["nid"])
    best = np.full(total, -1, dtype=np.int32)
    partner = np.zeros(total, dtype=np.int64)
    at = np.arange(total)
    for lag in range(1, LAGS + 1):
        at = at[at + lag < total]
        at = at[run[at + lag] == run[at]]
        for chunk in np.array_split(at, max(1, len(at) >> 14)):
            i, j, agree = _survivors(rows["sig"], rows["n"], chunk, chunk + lag, bounds)
            better = agree > best[j]
            best[j[better]], partner[j[better]] = agree[better], i[better]
    has = np.nonzero(best >= 0)[0]
    a, b = rows["nid"][partner[has]], rows["nid"][has]
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return {"a": both[:, 0], "b": both[:, 1]}


def _crossing(rows: dict, lo: int, hi: int, comp: np.ndarray, bounds: list[int]):
    """For each stray of the bucket lo..hi its live partners in other components.

    Strays are the members outside the bucket's largest component, so the work
    is strays times members.  A pair is only met in the first band it shares.
    ``comp`` may change between the steps: united members are not met again.
    """
    values, counts = np.unique(comp[lo:hi], return_counts=True)
    major = values[counts.argmax()]
    sig, first_band = rows["sig"], rows["sig"].view(np.int64)
    band = int(rows["bucket"][lo]["x"])
    every = np.arange(lo, hi)
    for i in every[comp[lo:hi] != major]:
        other = every[(comp[lo:hi] != comp[i]) & ((every > i) | (comp[lo:hi] == major))]
        for j in np.array_split(other, max(1, len(other) >> 14)):
            if band < BANDS and len(j):
                j = j[(first_band[j] == first_band[i]).argmax(axis=1) == band]
            _, j, agree = _survivors(sig, rows["n"], np.full(len(j), i), j, bounds)
            if len(j):
                yield i, j[np.argsort(-agree, kind="stable")], major


def _open_members(rows: dict, bounds: list[int]) -> dict:
    """The members that have a live partner in another component."""
    cuts = np.concatenate([np.nonzero(np.diff(_runs(rows["bucket"]), prepend=-1))[0], [len(rows["nid"])]])
    needed = np.zeros(len(rows["nid"]), dtype=bool)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        for i, j, _ in _crossing(rows, lo, hi, rows["comp"], bounds):
            needed[i] = True
            needed[j] = True
    return {"band": rows["bucket"]["x"][needed], "key": rows["bucket"]["y"][needed], "nid": rows["nid"][needed]}


def _linked(rows: dict, bounds: list[int]) -> dict:
    """Links between components, verified on the full sets."""
    cuts = np.concatenate([np.nonzero(np.diff(_runs(rows["bucket"]), prepend=-1))[0], [len(rows["nid"])]])
    comp, sets, sizes = rows["comp"].copy(), rows["sets"], rows["n"]
    a, b = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        for i, js, major in _crossing(rows, lo, hi, comp, bounds):
            mine = np.frombuffer(sets[i], np.uint64)
            for j in js:
                if comp[j] == comp[i]:
                    continue
                theirs = np.frombuffer(sets[j], np.uint64)
                at = np.searchsorted(mine, theirs)
                at[at == len(mine)] = 0
                both = int(np.count_nonzero(mine[at] == theirs))
                if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
                    a.append(rows["nid"][i])
                    b.append(rows["nid"][j])
                    # the label of the largest component must stay
                    old, new = (comp[i], comp[j]) if comp[j] == major else (comp[j], comp[i])
                    united = comp[lo:hi]
                    united[united == old] = new
    return {"a": a, "b": b}


def _owner(work, schema: pa.Schema):
    """A mapInArrow function that hands whole buckets to ``work``.

    Its input is sorted by bucket; a bucket that may go on in the next batch is
    held back.
    """

    def emit(parts: list[dict]) -> pa.RecordBatch:
        rows = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        return record_batch(work(rows), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        count = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("sig").flatten().to_numpy()
            both = np.stack([batch.column("band").to_numpy(), batch.column("key").to_numpy()], axis=1)
            part = {
                "bucket": np.ascontiguousarray(both).view([("x", np.int64), ("y", np.int64)])[:, 0],
                "sig": flat.view(np.uint16).reshape(batch.num_rows, LANES),
                **{c: batch.column(c).to_numpy() for c in ("nid", "n", "comp")},
            }
            if "sets" in batch.schema.names:
                part["sets"] = np.array([*as_bytes(batch.column("sets")), None], dtype=object)[:-1]
            last = part["bucket"][-1]
            going_on = held and part["bucket"][0] == held[-1]["bucket"][-1] == last
            cut = batch.num_rows if going_on else int(np.argmax(part["bucket"] == last))
            if cut < batch.num_rows:
                ended = held + ([{k: v[:cut] for k, v in part.items()}] if cut else [])
                if ended and (count + cut >= 4096 or size > HELD_BYTES or len(ended) > 8):
                    yield emit(ended)
                    held, count, size = [], 0, 0
                    part = {k: v[cut:] for k, v in part.items()}
            held.append(part)
            count += len(part["nid"])
            size += batch.nbytes
        if held:
            yield emit(held)

    return run


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MEMBER = pa.schema([("band", pa.int64()), ("key", pa.int64()), ("nid", pa.int64())])


def band_members(nodes: DataFrame) -> DataFrame:
    """(band, key, nid, n, members, weight) of nodes in buckets with company."""
    rows = nodes.select("nid", "n", F.posexplode("sig").alias("band", "key")).withColumn("band", F.col("band").cast("long"))
    counts = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).filter("members > 1")
    return staged(rows.join(counts, ["band", "key"]), "members")


def _blocks(members: str, weight: str, limit: int) -> Column:
    """Blocks into which a bucket is dealt: within the limits of a task."""
    return F.ceil(F.greatest(F.col(members) / limit, F.col(weight) / BUCKET_SHINGLES)).cast("long")


def in_pieces(members: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(band, key, nid): buckets over the limits dealt into pieces, anew in each band."""
    piece = F.pmod(F.xxhash64("nid", "band"), _blocks("members", "weight", limit))
    return members.select("band", F.when(_blocks("members", "weight", limit) > 1, F.xxhash64("key", piece)).otherwise(F.col("key")).alias("key"), "nid")


def _mixed(label: DataFrame, limit: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets with several components: those a task can hold, and the others.

    The others carry the largest component, the strays outside it and the
    numbers of blocks.
    """
    sums = label.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    size = F.struct("c", "w", "comp")
    sums = sums.groupBy("band", "key").agg(F.sum("c").alias("m"), F.sum("w").alias("mw"), F.max(size).alias("top"))
    sums = sums.filter("m > top.c").select(
        "band", "key", F.col("top.comp").alias("major"), "m", "mw", (F.col("m") - F.col("top.c")).alias("s"), (F.col("mw") - F.col("top.w")).alias("sw")
    )
    sums = staged(sums.select("band", "key", "major", _blocks("m", "mw", limit).alias("blocks"), _blocks("s", "sw", limit).alias("stray_blocks")), name)
    rows = ["band", "key", "nid", "n", "comp"]
    small = label.join(sums.filter("blocks = 1"), ["band", "key"], "left_semi").select(*rows)
    return small, label.join(sums.filter("blocks > 1"), ["band", "key"]).select(*rows, "major", "blocks", "stray_blocks")


def _in_blocks(hot: DataFrame) -> DataFrame:
    """Each block of strays with each block of members, as buckets of their own."""
    block, stray = F.pmod(F.xxhash64("nid"), "blocks"), F.pmod(F.xxhash64("nid", F.lit(1)), "stray_blocks")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    member = hot.select("*", block.alias("x"), F.explode(upto("stray_blocks")).alias("y"))
    strays = hot.filter("comp <> major").select("*", F.explode(upto("blocks")).alias("x"), stray.alias("y"))
    units = member.union(strays.select(*member.columns))
    key = F.xxhash64("band", "key", "x", "y")
    return units.select(F.lit(2 * BANDS).cast("long").alias("band"), key.alias("key"), "nid", "n", "comp").distinct()


def _cut(hot: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hot buckets cut by size of the sets and by the bands other than their own."""
    size = F.floor(F.ln("n") / math.log(1 / THRESHOLD + 0.01)).cast("long")
    rows = hot.join(nodes.select("nid", "sig"), "nid").select(
        "band", "key", "nid", "n", "comp", F.posexplode("sig").alias("other", "value"), F.array(size, size - 1).alias("sizes")
    )
    rows = rows.filter("other <> band").select("*", F.explode("sizes").alias("size"))
    key = F.xxhash64("band", "key", "other", "value", "size")
    return rows.select(F.lit(BANDS).cast("long").alias("band"), key.alias("key"), "nid", "n", "comp")


def crossing_buckets(label: DataFrame, nodes: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(band, key, nid, n, comp) of buckets that a task can hold, where components meet.

    ``label`` has the same columns, with buckets of any size.
    """
    found, hot = _mixed(label, limit, "mixed")
    hot = staged(hot, "hot")
    if hot.limit(1).count():
        found = found.union(_in_blocks(hot.filter("stray_blocks = 1")))
        many = hot.filter("stray_blocks > 1")
        if many.limit(1).count():
            fine, still = _mixed(staged(_cut(many, nodes), "cut"), limit, "mixed-again")
            found = found.union(fine).union(_in_blocks(staged(still, "still-hot")))
    return staged(found, "crossing")


def _in_buckets(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (band, key, nid, comp and more) with their signatures, by bucket."""
    rows = members.join(nodes.select("nid", "n", "sig"), "nid").repartition("band", "key")
    return rows.sortWithinPartitions("band", "key", "nid")


def _sets_of(bits: np.ndarray):
    """A mapInArrow function: digests and shingles of documents in the filter."""
    schema = pa.schema([("digest", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            if not whole.num_rows:
                continue
            hit = bloom.test(bits, whole.column("h").to_numpy())
            chosen = whole.filter(pa.array(hit))
            for batch in slices(iter([chosen]), "text", 4 << 20):
                sets = [shingles(t, words).tobytes() for t in as_bytes(batch.column("text"))]
                yield record_batch({"digest": [xxhash.xxh3_128_digest(s) for s in sets], "shingles": sets}, schema)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(as_bytes(batch.column("sa")), as_bytes(batch.column("sb")), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingle_sets(docs: DataFrame, nodes: DataFrame, nids: DataFrame) -> DataFrame:
    """(nid, shingles) of some nodes.

    Only documents that pass a Bloom filter of the ids asked for (8 MB at most)
    are shingled again, so their texts are never shuffled.
    """
    wanted = staged(nids.select("nid").distinct().join(nodes.select("nid", "digest", "rep"), "nid"), "wanted")
    bits = bloom.build(wanted.select(F.xxhash64("rep").alias("h")), bloom.log2_bits(wanted.count()))
    asked = docs.select("text", F.xxhash64("doc_id").alias("h"))
    sets = asked.mapInArrow(_sets_of(bits), "digest binary, shingles binary")
    sets = wanted.select("nid", "digest").join(sets, "digest").groupBy("nid").agg(F.first("shingles").alias("shingles"))
    return staged(sets, "sets")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that hold on full shingle sets."""
    sets = _shingle_sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("nid")))
    left = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")


def clusters(docs: DataFrame, limit: int = BUCKET, miss: float = MISS) -> DataFrame:
    """(doc_id, th, n, component_id) of every row; th is a hash of the text."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = staged(docs.withColumn("th", F.xxhash64("text")).mapInArrow(_features, FEATURES), "features")
    nodes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = staged(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    bounds = least_agreement(miss)
    members = band_members(nodes)

    grouped = _in_buckets(in_pieces(members, limit).withColumn("comp", F.col("nid")), nodes)
    first = grouped.mapInArrow(_owner(lambda rows: _best_partners(rows, bounds), PAIR), "a long, b long").distinct()
    edges = staged(_verified(docs, nodes, staged(first, "pairs")), "edges")
    roots = components(edges)

    label = members.join(roots, F.col("nid") == F.col("node"), "left").select(
        "band", "key", "nid", "n", F.coalesce("root", "nid").alias("comp")
    )
    label = crossing_buckets(staged(label, "labelled"), nodes, limit).drop("n")
    grouped = _in_buckets(label, nodes)
    opened = grouped.mapInArrow(_owner(lambda rows: _open_members(rows, bounds), MEMBER), "band long, key long, nid long")
    opened = staged(opened, "open")
    sets = _shingle_sets(docs, nodes, opened).withColumnRenamed("shingles", "sets")
    grouped = _in_buckets(opened.join(label, ["band", "key", "nid"]).join(sets, "nid"), nodes)
    more = staged(grouped.mapInArrow(_owner(lambda rows: _linked(rows, bounds), PAIR), "a long, b long"), "edges")
    roots = components(edges.union(more))

    nodes = nodes.join(roots, F.col("nid") == F.col("node"), "left").select(
        "digest", "rep", F.coalesce("root", "nid").alias("comp")
    )
    # written, so that the join below stands on plain scans and can split hot components
    nodes = staged(nodes, "node-roots")
    named = staged(nodes.groupBy("comp").agg(F.min("rep").alias("component")), "components")
    named = nodes.join(named, "comp").select(F.col("digest").alias("d2"), "component")
    return rows.join(named, (F.col("n") > 0) & (F.col("digest") == F.col("d2")), "left").select(
        "doc_id", "th", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component."""
    found = staged(clusters(docs), "near-clusters")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th")
    )
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
