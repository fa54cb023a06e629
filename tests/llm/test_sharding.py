import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import sharding as S


def test_law_of_bytes(spark, sf):
    rows = S.query(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, slots, shard_of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shard_of[docs[r.doc_id]].add(r.shard)
    assert len(rows) == len(docs) and set(total) == set(range(16))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    largest = max(r.size for r in rows)
    assert max(total.values()) - min(total.values()) <= 2 * largest


def test_balance_with_a_hot_group_and_many_small(spark, docs_of):
    rows = [(i, "hot text " * 5 if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(3000)]
    got = S.kd_shards(docs_of(rows)).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    sizes = [r.b for r in got]
    assert len(sizes) == 16 and max(sizes) <= 1.1 * min(sizes)


def test_odd_rows_and_target_bytes(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts).withColumn("shard", F.lit(9)).withColumn("t", F.lit("x"))
    got = S.kd_shards(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in odd_texts)
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    assert S.kd_shards(docs_of([])).collect() == []
    many = S.kd_shards(docs_of([(i, "y" * 99) for i in range(640)]), target_bytes=6400).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(many) == 10 and all(r.b <= 6500 for r in many)


def brute_tree(points, leaf, full, first, leaves):
    """Shards of points (key by dimension, t, h, size) by sorting every node whole."""
    if leaves == 1:
        return {p["i"]: first for p in points}
    dim = max(S.DIMENSIONS, key=lambda d: (max(p[d] for p in points) - min(p[d] for p in points)) / full[d])
    half = leaves - leaves // 2
    goal = sum(p["size"] for p in points) * half / leaves
    groups = defaultdict(list)
    for p in points:
        groups[p[dim], p["t"]].append(p)
    below, weight = [], 0
    for key in sorted(groups):
        group, w = groups[key], sum(p["size"] for p in groups[key])
        if weight + w < goal:
            below += group
            weight += w
            continue
        if w > S.WHOLE * leaf:  # no leaf holds it: cut by the hash of the id
            ids = defaultdict(list)
            for p in group:
                ids[p["h"]].append(p)
            for h in sorted(ids):
                w = sum(p["size"] for p in ids[h])
                if weight + w < goal:
                    below += ids[h]
                    weight += w
                    continue
                group = ids[h]
                break
        if not (goal - weight < weight + w - goal and weight > 0):
            below += group
        break
    low = {p["i"] for p in below}
    above = [p for p in points if p["i"] not in low]
    return brute_tree(below, leaf, full, first, half) | brute_tree(above, leaf, full, first + half, leaves - half)


def test_tree_equals_sorting_every_node(spark, docs_of):
    for hot in (0, 3):  # without and with a text that weighs a third of all
        rows = [(i * 37 % 5000, "hot text " * 30 if hot and i % hot == 0 else f"text {i % 700} " * (1 + i % 23), f"src{i % 3}") for i in range(1500)]
        points = S.staged(S.coordinates(docs_of(rows)), "kd-points")
        tree = S.build_tree(points, 16)
        got = points.select("doc_id", "size", "t", "h", *S.DIMENSIONS, S._place(tree, lambda n: n.first).alias("shard")).collect()
        listed = [{"i": i, **r.asDict()} for i, r in enumerate(got)]
        full = {d: max(1, max(p[d] for p in listed) - min(p[d] for p in listed)) for d in S.DIMENSIONS}
        want = brute_tree(listed, sum(p["size"] for p in listed) / 16, full, 0, 16)
        assert [r.shard for r in got] == [want[i] for i in range(len(got))]


def test_extreme_ids(spark, docs_of):
    rows = [(i, f"text {i}") for i in (-(1 << 63), (1 << 63) - 1, 0, -1, 1)] + [(None, "text"), (None, None)]
    got = S.kd_shards(docs_of(rows), 4).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert {r.shard for r in got} <= set(range(4)) and len({(r.shard, r.slot) for r in got}) == len(rows)


def test_native(spark, sf, monkeypatch):
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_: pytest.fail("rows of Python would come as an RDD"))
    text = S.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_copies_that_a_leaf_can_hold_stay_together(spark, docs_of):
    texts = [f"{k:03d} " + "z" * 95 for k in range(40)]
    got = S.kd_shards(docs_of([(i, texts[i % 40]) for i in range(400)]), shards=8).collect()  # a group is a fifth of a leaf
    shards = defaultdict(set)
    for r in got:
        shards[r.doc_id % 40].add(r.shard)
    assert {len(x) for x in shards.values()} == {1}
