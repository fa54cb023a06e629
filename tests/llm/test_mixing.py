import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes):
    """Targets by resharing, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    rest, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


def mixed(docs):
    runs = mixing.systematic_copies(docs, "doc_id", "source", mixing.word_count("text"))
    rows = mixing.expanded(runs, "__i").withColumn("copies", mixing.copies_of(F.col("__i")))
    return rows.select("__id", "__g", "__size", "source_size", "target", "copies").collect()


def test_targets_and_copies(spark, docs_of):
    sources = ["b", "a", None, "ç", "Z", ""]
    data = [(i, "w " * (i * 7 % 90), sources[i * i % 6 if i % 3 else 0]) for i in range(600)]
    sizes = defaultdict(int)
    for _, text, source in data:
        sizes[source] += words(text)
    want, taken, biggest = water(sizes), defaultdict(int), defaultdict(int)
    rows = mixed(docs_of(data))
    assert sorted(r["__id"] for r in rows) == list(range(600))
    for r in rows:
        source = None if r["__g"] == "1" else r["__g"][1:]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["copies"] <= 2
        taken[source] += r["copies"] * r["__size"]
        biggest[source] = max(biggest[source], r["__size"])
    for source, target in want.items():
        assert abs(taken[source] - target) <= 2 * biggest[source]
    assert sorted(map(str, mixed(docs_of(data, 7)))) == sorted(map(str, rows))


def test_odd_rows(spark, docs_of, odd_texts):
    rows = mixed(docs_of(odd_texts))
    assert sorted(str(r["__id"]) for r in rows) == sorted(str(d) for d, *_ in odd_texts)
    assert sorted(r["__size"] for r in rows) == sorted(words(t) for _, t in odd_texts)
    assert mixed(docs_of([])) == [] and mixed(docs_of([(1, None)]))[0]["target"] == 0


def test_mixed_rows_repeat_as_taken(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts).withColumn("rate", F.lit(1)).withColumn("target", F.lit("x"))
    copies = sum(r["copies"] for r in mixed(docs))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == copies


def test_each_row_is_taken_as_often_as_numbered(spark, docs_of):
    ids, sources = [None, 1, 1, 2, 3], ["a", None, "b"]
    docs = docs_of([(ids[i % 5], f"w{i % 4} " * (i % 7), sources[i % 3]) for i in range(300)])
    want, found = defaultdict(int), defaultdict(int)
    for r in mixed(docs):
        want[r["__id"], r["__g"], r["__size"]] += r["copies"]
    for r in mixing.mixed(docs).collect():
        found["" if r["doc_id"] is None else r["doc_id"], r["source"], words(r["text"])] += 1
    named = {("" if k[0] is None else k[0], None if k[1] == "1" else k[1][1:], k[2]): n for k, n in want.items() if n}
    assert found == named and any(k[0] == "" for k in found)
    again = mixing.mixed(docs_of([(ids[i % 5], f"w{i % 4} " * (i % 7), sources[i % 3]) for i in range(300)], 7))
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mixed(docs).collect()))
