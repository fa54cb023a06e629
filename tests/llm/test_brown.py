import math
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import brown as B


def test_base_score_and_counts(spark, docs_of, odd_texts, monkeypatch):
    monkeypatch.setattr(B, "HEAD", 12)  # most words take the joined way
    got = B.scored(docs_of(odd_texts)).collect()
    tokens = [(d, (t or "").encode().lower().split() + [B.END]) for d, t in odd_texts]
    train = [w for d, w in tokens if d is not None and zlib.crc32(str(d).encode()) % 10]
    count = Counter(x for w in train for x in w)
    total, kinds = sum(count.values()), len(count)
    base = math.log10(total + 0.1 * (kinds + 1))
    want = sorted((str(d), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10(count[x] + 0.1) - base for x in w), 4)) for d, w in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    assert B.scored(docs_of([])).collect() == []


def test_model_beats_base_on_held_out_text(spark, sf):
    rows = [r for r in B.query(spark, sf).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    n3 = rng.integers(0, 5, (B.ALL, B.ALL, B.ALL)).astype(float)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + B.ADD) / (n1 + B.ADD).sum()
    p2 = (n2 + B.PRIOR * p1) / (n2.sum(axis=1, keepdims=True) + B.PRIOR)
    p3 = (n3 + B.PRIOR * p2[None]) / (n3.sum(axis=2, keepdims=True) + B.PRIOR)
    assert p3.sum(axis=2) == pytest.approx(np.ones((B.ALL, B.ALL)))


def test_exchange_finds_alternating_classes():
    m = 24
    group = np.arange(m) % 2
    bigrams = np.where(group[:, None] != group[None, :], 50.0, 1.0)
    of = B.exchange(bigrams[np.ix_(np.argsort(-bigrams.sum(1)), np.arange(m))], classes=2)
    assert len({(g, c) for g, c in zip(group, of, strict=True)}) == 2


def test_rare_words_of_one_spelling_get_classes_of_their_own(spark, docs_of, monkeypatch):
    monkeypatch.setattr(B, "HEAD", 4)  # red, dog, up and sky; the other two share a spelling unit
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    assert B.shape_unit(b"abc1yz") == B.shape_unit(b"abc2yz")
    train, apart = [i for i in range(200) if not held(i)][:80], [i for i in range(200) if held(i)][:2]
    rows = [(i, "red abc1yz red dog red dog red" if k % 2 else "up abc2yz up sky up sky up") for k, i in enumerate(train)]
    rows += [(apart[0], "red abc1yz red"), (apart[1], "red abc2yz red")]
    got = {r.doc_id: r for r in B.scored(docs_of(rows)).collect()}
    met, strange = (got[i] for i in apart)
    assert met.base_score == pytest.approx(strange.base_score)
    assert met.score > strange.score + 0.1


def slow_scores(rows, classes):
    """The scores of all texts from their classes, by dictionaries."""
    tokens = [(d, (t or "").encode().lower().split() + [B.END]) for d, t in rows]
    in_training = [d is not None and zlib.crc32(str(d).encode()) % 10 > 0 for d, _ in tokens]
    count, n3, class_of = Counter(), Counter(), {}
    for (_, words), c, train in zip(tokens, classes, in_training, strict=True):
        assert len(words) == len(c)
        past = [B.END_CLASS, B.END_CLASS, *c]
        for i, (word, k) in enumerate(zip(words, c, strict=True)):
            if train:
                count[word] += 1
                n3[past[i], past[i + 1], k] += 1
                assert class_of.setdefault(word, k) == k
    size, kinds, n2, n1, after3, after2 = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    for word, n in count.items():
        size[class_of[word]] += n
        kinds[class_of[word]] += 1
    for (a, b, c), n in n3.items():
        n2[b, c] += n
        n1[c] += n
        after3[a, b] += n
        after2[b] += n
    total = sum(count.values())

    def follow(a, b, c):
        p1 = (n1[c] + B.ADD) / (total + B.ADD * B.ALL)
        p2 = (n2[b, c] + B.PRIOR * p1) / (after2[b] + B.PRIOR)
        return (n3[a, b, c] + B.PRIOR * p2) / (after3[a, b] + B.PRIOR)

    def probability(a, b, c, n):
        emission = (n + B.ADD) / (size[c] + B.ADD * (kinds[c] + 1))
        return (1 - B.MIX) * follow(a, b, c) * emission + B.MIX * (n + B.ADD) / (total + B.ADD * (len(count) + B.ALL))

    scores = []
    for (_, words), c in zip(tokens, classes, strict=True):
        past = [B.END_CLASS, B.END_CLASS, *c]
        scores.append(sum(math.log10(probability(past[i], past[i + 1], k, count[w])) for i, (w, k) in enumerate(zip(words, c, strict=True))))
    seen = lambda a, b: sum(probability(a, b, class_of[w], n) for w, n in count.items()) + sum(probability(a, b, c, 0) for c in range(B.ALL))
    return scores, seen


def test_scores_equal_slow_sums_and_probabilities_sum_to_one(spark, docs_of, monkeypatch):
    """Through the operator: the head, the tail joined by word, and unseen words."""
    monkeypatch.setattr(B, "HEAD", 30)
    monkeypatch.setattr(B, "DENSE", 3)
    rng = np.random.default_rng(8)
    line = "-" * 80  # too long for the head, and frequent
    words = np.array([f"w{i}" for i in range(120)] + [line] * 30)
    rows = [(i, " ".join(words[rng.integers(0, len(words), rng.integers(0, 60))])) for i in range(300)] + [(1000, None), (1010, "unseen things"), (None, "w1 w2")]
    texts, model, total = B.fitted(docs_of(rows))
    by_row = {}
    for r in texts.collect():
        by_row.setdefault(r.doc_id, []).append(list(r.classes))
    classes = [by_row[d][0] for d, _ in rows]
    want, seen = slow_scores(rows, classes)
    got = {r.doc_id: r.score for r in B.scored(docs_of(rows)).collect()}
    assert [got[d] for d, _ in rows] == pytest.approx(want, rel=1e-9)
    for a, b in ((B.END_CLASS, B.END_CLASS), (0, 1), (classes[0][0], classes[0][1])):
        assert seen(a, b) == pytest.approx(1, abs=1e-9)
    assert model.follow.sum(axis=2) == pytest.approx(np.ones((B.ALL, B.ALL)))
    assert total.v == len({w for (d, t) in rows if d is not None and zlib.crc32(str(d).encode()) % 10 for w in (t or "").split()}) + 1


def test_dense_counts_equal_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    key, beside = rng.integers(0, 5, 400), rng.integers(0, B.ALL + 20, (400, 2)).astype(np.uint8)
    found, pairs, none = B._grouped(key, beside)
    monkeypatch.setattr(B, "DENSE", 2)
    again, empty, sums = B._grouped(key, beside)
    assert (found == again).all() and none == [None] * 5 and empty == [None] * 5
    for p, s in zip(pairs, sums, strict=True):
        p, s = np.frombuffer(p, dtype=np.uint8).reshape(-1, 2), np.frombuffer(s, dtype=np.int64)
        assert s[-1] == len(p) and (s[:-1] == B._counted(p, np.zeros(len(p), dtype=np.int64), 1)[0]).all()
