"""The llm queries on the smallest tables, and the pipeline."""

import ast
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from test_mixing import water, words
from test_near_dedup import expected as near_expected

import corpus_pipeline
from marlstone.llm import packing, registry
from marlstone.sources.tables import NAMES


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in NAMES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, sf), con.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.project(", ".join(columns)).fetchall()))


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on its own input, redone in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns

    def after(k):
        nonlocal docs
        name, stage = corpus_pipeline.STAGES[k]
        docs = corpus_pipeline.staged(stage(spark, docs, sf), "stage")
        assert k == 4 or docs.columns == columns, name
        return docs.collect()

    before = docs.collect()
    toxic = {r.doc_id for r in registry.QUERIES["op8_subword_toxicity"](spark, sf).filter("predicted = 1").collect()}
    kept = after(0)
    assert {r.doc_id for r in kept} == {r.doc_id for r in before} - toxic

    best = {}
    for r in kept:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[norm] = min(best.get(norm, r), r, key=lambda x: (-len(x.text or ""), x.doc_id))
    kept = after(1)
    assert {r.doc_id for r in kept} == {r.doc_id for r in best.values()}

    components = [ast.literal_eval(row) for row in near_expected([(r.doc_id, r.text) for r in kept])]
    kept = after(2)
    assert {r.doc_id for r in kept} == {d for d, _, c in components if d == c}

    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept:
        sizes[r.source] += words(r.text)
        biggest[r.source] = max(biggest[r.source], words(r.text))
    mixed, texts = after(3), {r.doc_id: r for r in kept}
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 2 and all(texts[r.doc_id] == r for r in mixed)
    for r in mixed:
        taken[r.source] += words(r.text)
    for source, target in water(sizes).items():
        assert abs(taken[source] - target) <= 2 * biggest[source]

    encoder = packing.Encoder(packing.tokenizer_path())
    length = {d: len(encoder.encode([(texts[d].text or "").encode()])[0]) for d in copies}
    got = defaultdict(int)
    for r in after(4):
        assert r.doc_tokens == length[r.doc_id]
        got[r.doc_id] += r.length
    assert got == {d: n * length[d] for d, n in copies.items()}


def test_pipeline_runs_as_a_query(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
