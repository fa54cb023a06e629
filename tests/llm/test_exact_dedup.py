import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from marlstone.llm import exact_dedup as D


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(map(str, out))


def run(docs, **options):
    entries, _, resolved = D.build_index(docs.select("doc_id", "text"), "text", "doc_id", **options)
    return D.grouped(entries, resolved).collect()


def test_against_brute_force(spark, docs_of, odd_texts):
    rows = odd_texts + [(1000 + i, ["a b", "ab", "a  b\n", "é", " é", "ab "][i % 6]) for i in range(200)]
    got = run(docs_of(rows, 5))
    assert sorted(str((r.e_id, r.keep_id, r.group_size, r.e_sha)) for r in got) == expected(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.e_sha for r in got}) and all(r.e_id == r.keep_id for r in kept)


def test_colliding_keys_are_told_apart_by_bytes(spark, docs_of):
    rows = [(i, f"text {i % 7}") for i in range(100)]
    got = run(docs_of(rows), key=lambda text: len(text) % 2)
    assert sorted(str((r.e_id, r.keep_id, r.group_size, r.e_sha)) for r in got) == expected(rows)


def test_a_hot_text_is_shared_among_owners(spark, docs_of, monkeypatch):
    """Every task has entries of one text; no owner's memory grows with them."""
    monkeypatch.setattr(D, "CHUNK_BYTES", 1)  # an entry for each batch
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i % 50}") for i in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for slices_ in (1, 3):
            got = run(docs_of(rows, 6), slices_=slices_)
            assert sorted(str((r.e_id, r.keep_id, r.group_size, r.e_sha)) for r in got) == expected(rows)
            assert sum(r.kept for r in got) == len({r.e_sha for r in got})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")


def test_an_owner_writes_links_as_it_reads():
    import pyarrow as pa

    def entries():
        for k in range(40):
            n = 5_000
            at = range(k * n, (k + 1) * n)
            yield pa.RecordBatch.from_pydict(
                {"text": [b"same"] * n, "bucket": [0] * n, "e_key": [1] * n, "e_entry": list(at), "keep_entry": list(at), "e_chars": [4] * n, "e_best": list(at), "e_count": [1] * n}
            )

    sizes = [b.num_rows for b in D.owner(True)(entries())]
    assert len(sizes) > 1 and max(sizes) <= 100_001 and sum(sizes) == 200_001


def test_directory_doubles_until_pages_fit():
    weights = {p: 10 for p in range(0, 1 << 16, 64)} | {77: 5000}
    tree = D.Directory(weights, page=200)
    assert len(tree.slots) == 1 << tree.depth
    load = defaultdict(int)
    for p, w in weights.items():
        load[tree.slots[p >> (16 - tree.depth)]] += w
    for bucket, (local, prefix) in enumerate(tree.buckets):
        at = [s for s, b in enumerate(tree.slots) if b == bucket]
        assert at == list(range(prefix << (tree.depth - local), (prefix + 1) << (tree.depth - local)))
        assert load[bucket] <= 200 or local == 16
    assert D.Directory({}).slots == [0]


def test_rows_that_stay(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts).withColumn("e_key", F.lit("clash")).withColumn("x_entry", F.lit(1))
    out = D.deduplicated(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert len(texts) == len({re.sub(r"\s", "", t or "") for _, t in odd_texts})
    assert run(docs_of([])) == []
