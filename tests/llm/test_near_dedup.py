import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm import near_dedup as N
from marlstone.llm.components import components


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    return out


def expected(rows):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            same_row_id = d is not None and d == e and a == b
            if a and b and (same_row_id or 100 * len(a & b) >= 75 * len(a | b)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, a) in enumerate(sets):
        if a and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(str((d, len(a), least.get(find(i)) if a else d)) for i, (d, a) in enumerate(sets))


def near_copies(n, seed, spread):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(spread)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((10_000 * seed + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("limit", [N.BUCKET, 8])
def test_against_all_pairs(spark, docs_of, odd_texts, limit):
    rows = odd_texts + near_copies(90, 1, 8) + near_copies(60, 2, 3) + [(5, "One two three"), (77, "ONE two\tthree")]
    got = N.clusters(docs_of(rows), limit).collect()
    assert sorted(str((r.doc_id, r.n, r.component_id)) for r in got) == expected(rows)


def strangers(n, shared, seed=5):
    """Documents that share a passage of ``shared`` words and nothing else."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(shared)]
    return [(50_000 + i, " ".join(common + [f"s{rng.randrange(10**8)}" for _ in range(60 + i % 90)])) for i in range(n)]


def test_hot_bands_of_strangers_against_all_pairs(spark, docs_of):
    """Many strays in one bucket: cut by size and other bands, then by blocks."""
    rows = strangers(150, 60) + near_copies(40, 6, 12) + [(d + 500, t + " tail") for d, t in strangers(150, 60)[::7]]
    got = N.clusters(docs_of(rows), 6).collect()
    assert sorted(str((r.doc_id, r.n, r.component_id)) for r in got) == expected(rows)


@pytest.mark.parametrize("bands", [1, 8])
def test_hot_buckets_are_bounded_and_rows_do_not_multiply(spark, bands):
    """20,000 distinct nodes in one bucket for each of some bands."""
    sig = F.transform(F.sequence(F.lit(0), F.lit(N.BANDS - 1)), lambda b: F.when(b < bands, b.cast("long")).otherwise(F.xxhash64("id", b)))
    nodes = N.staged(spark.range(20_000).select(F.col("id").alias("nid"), F.lit(100).cast("long").alias("n"), sig.alias("sig")), "nodes")
    members = N.band_members(nodes)
    assert members.count() == 20_000 * bands
    first = N.in_pieces(members).groupBy("band", "key").count().agg(F.max("count"), F.sum("count")).first()
    assert first[0] <= 2 * N.BUCKET and first[1] == 20_000 * bands
    label = lambda strays: members.select("band", "key", "nid", "n", F.when(F.col("nid") < strays, F.col("nid")).otherwise(F.lit(-1)).cast("long").alias("comp"))
    size = lambda rows: rows.groupBy("band", "key").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    few = N.crossing_buckets(label(300), nodes)
    largest, total = size(few)
    assert largest <= 3 * N.BUCKET and total <= bands * (20_000 + 300 * 20)
    if bands == 1:
        many = N.crossing_buckets(label(20_000), nodes)
        assert size(many) == (0, 0)  # they share no other band


def test_blocks_meet_every_stray_with_every_member(spark):
    rows = spark.range(500).selectExpr("0L AS band", "7L AS key", "id AS nid", "10L AS n", "IF(id % 50 = 0, id, -1L) AS comp")
    small, hot = N._mixed(rows, 40, "mixed")
    assert small.count() == 0
    units = {}
    for r in N._in_blocks(hot).collect():
        units.setdefault(r.key, set()).add(r.nid)
    assert max(map(len, units.values())) < 100
    for stray in range(0, 500, 50):
        assert set().union(*(u for u in units.values() if stray in u)) == set(range(500))


def test_recall_against_a_shingle_index(spark):
    """Every link of a driver's table, found by an index of all shingles."""
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sets, holders, links = sets_of(rows), {}, 0
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        shared = Counter(j for s in a for j in holders.get(s, ()))
        for j, both in shared.items():
            if 100 * both >= 75 * (len(a) + len(sets[j][1]) - both):
                links += 1
                parent[find(i)] = find(j)
        for s in a:
            holders.setdefault(s, []).append(i)
    least = {}
    for i, (d, a) in enumerate(sets):
        if a:
            least[find(i)] = min(d, least.get(find(i), d))
    want = {d: least[find(i)] if a else d for i, (d, a) in enumerate(sets)}
    got = {r.doc_id: r.component_id for r in N.query(spark, folder).collect()}
    assert links > 50 and got == want


def test_rows_that_stay(spark, docs_of):
    rows = near_copies(50, 3, 2) + [(1, "alone in the world with these words"), (2, None), (3, None)]
    out = N.deduplicated(docs_of(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    comps = {r.doc_id: r.component_id for r in N.clusters(docs_of(rows)).collect()}
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, c in comps.items() if d == c)
    assert N.clusters(docs_of([])).collect() == []


def test_sequential_bounds_keep_true_pairs():
    import numpy as np

    rng, bounds, lost = np.random.default_rng(2), N.least_agreement(), 0
    for _ in range(4000):
        agree = np.cumsum(rng.random(N.LANES) < 0.75)
        lost += any(agree[(k + 1) * N.STEP - 1] < b for k, b in enumerate(bounds))
    assert lost <= 12


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 220)] + [(5, i) for i in range(6, 40)] + [(1, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(101, 221)} | {i: 5 for i in range(6, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
