import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import toxicity as X

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    bad = ["vilefoe", "grubling", "sneerwort"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "ne", "ti", "ro", "lu", "sem"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        toxic = i % 4 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "er", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_misspellings_and_long_texts(spark, docs_of):
    rows, labels = corpus()
    extra = [(9001, "ba ne ti " * 20 + "vilefooe " + "ro lu " * 9 + "grublings sneerworts"), (9002, "ba ne ti ro " * 8000 + "grubbling vilefoes " + "sneerwortz " + "lu sem " * 5000), (9003, "ba ne ti ro lu " * 9000), (9004, None), (9005, " ")]
    got = {r.doc_id: r for r in X.scored(docs_of(rows + extra), spark.createDataFrame(labels, LABELS)).collect()}
    held = [got[i] for i, _, _ in labels if got[i].held_out]
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) >= 0.95
    assert [got[i].predicted for i in range(9001, 9006)] == [1, 1, 0, 0, 0]
    assert got[9004].score == got[9005].score == 0 and all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark, docs_of):
    rows, labels = corpus(200)
    table = spark.createDataFrame(labels, LABELS)
    flipped = table.withColumn("toxic", F.when(X.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, X.scored(docs_of(rows), t).collect())) for t in (table, flipped))
    assert a == b


def test_clean_and_odd_labels(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts).withColumn("score", F.lit(2))
    none = spark.createDataFrame([(None, 1, 1), (4, None, None)], LABELS)
    out = X.clean(docs, none)
    assert out.columns == docs.columns and out.count() == len(odd_texts)
    assert X.scored(docs_of([]), none).collect() == []


def test_long_labelled_texts_give_windows(spark, docs_of):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % X.FOLDS][:40]
    docs = docs_of([(i, ("vile " if k % 2 else "mild ") * 4000) for k, i in enumerate(ids)])
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], LABELS)
    texts, toxic = X.labelled_sample(docs, labels)
    assert len(texts) == 40 and sorted(toxic) == [0] * 20 + [1] * 20
    assert {len(t) for t in texts} == {X.LONGEST}
    assert X._equal_bound([10, 50, 90], 100) == 45
    model = X.train(texts, toxic)
    assert model.score([b"vile vile vile"])[0] > 0.5 > model.score([b"mild mild mild"])[0]


def slow_score(table, bias, text):
    """The forward pass one n-gram at a time."""
    words = {}
    for word in text.lower().split():
        padded, found = b" " + word + b" ", []
        for size in X.SIZES:
            for k in range(len(padded) - size + 1):
                h = padded[k] * 0x9E3779B1 & 0xFFFFFFFF
                for c in padded[k + 1 : k + size]:
                    h = ((h ^ (h >> 15)) * 0x01000193 + c) & 0xFFFFFFFF
                found.append(float(table[(h * 0x85EBCA6B & 0xFFFFFFFF) >> 16]))
        words[word] = sum(found) / len(found)
    if not words:
        return 0.0
    best = sorted(words.values())[-X.STRONGEST :]
    return 1 / (1 + np.exp(-(sum(best) / len(best) + bias)))


def test_scores_equal_a_slow_forward_pass():
    rng = np.random.default_rng(3)
    model = X.Model(rng.normal(0, 2, X.BUCKETS).astype(np.float32), -0.3)
    words = ["a", "Be", "sea", "vilefoe", "\u00e9t\u00e9", "x" * 40, "vilefoe!"]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (0, 1, 2, 5, 30, 400)] + [b" \t\n", b" ".join(b"w%d" % i for i in range(300))]
    assert model.score(texts) == pytest.approx([slow_score(model.table, model.bias, t) for t in texts], abs=1e-5)


def test_training_takes_the_smallest_text_of_a_repeated_id(spark, docs_of):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % X.FOLDS][:8]
    rows = [(i, text) for i in ids for text in ("zz", "ab", "much longer text", None if i == ids[0] else "cd")]
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], LABELS)
    for parts in (1, 4):
        texts, _ = X.labelled_sample(docs_of(rows, parts), labels)
        assert sorted(texts) == [b""] + [b"ab"] * 7


def test_held_out_labels_of_a_driver_table(spark):
    """Both above 0.85 with some 350 toxic examples, a twentieth of which have no toxic word."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = X.query(spark, folder).filter("held_out").join(labels, "doc_id").groupBy("predicted", "toxic").count().collect()
    n = {(r.predicted, r.toxic): r["count"] for r in rows}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((0, 1), 0)) and n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
