import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marlstone.llm import packing as K

LETTERS = "abcXYZ éÉÀßöÖñçÿ×÷ªºµ .,;:!?'\"-_()[]{}<|>&*#%$@~`^\\/+=\n\t\x0b\x0c\r\x1c\x85\xa0 Σσςİıſ０１2³45́̈e中文字🙂"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(K.tokenizer_path())


def test_encoder_equals_tokenizer(tokenizer):
    rng, encoder = random.Random(3), K.Encoder(K.tokenizer_path())
    for _ in range(4000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(30))) + rng.choice(["", "", "<|endoftext|>", "'s", "'re"])
        want = tokenizer.encode(text, add_special_tokens=False).ids + [K.CLOSE]
        assert (encoder.encode([text.encode()])[0] & (K.END - 1)).tolist() == want


def test_sentences_and_lines_are_marked():
    text = b'One two. Three "four?" five;\n\n six seven\neight... (nine!) ten.%%% e\n'
    (marked,) = K.Encoder(K.tokenizer_path()).encode([text])
    ends = np.nonzero(marked & np.uint32(K.END))[0] + 1
    words, upto = K.Encoder(K.tokenizer_path()), {}
    for stop in (b"two.", b'four?"', b"five;", b"seven", b"eight...", b"(nine!)", b"ten.%%%", b"e\n"):
        upto[stop] = len(words.encode([text[: text.index(stop) + len(stop)]])[0]) - 1
    assert ends.tolist() == sorted(upto.values())
    assert not marked[-1] & np.uint32(K.END) and K.Encoder(K.tokenizer_path()).encode([b"", b"\n \n"])[1].tolist() == [K.CLOSE]


def test_cache_turns_over(tokenizer, monkeypatch):
    monkeypatch.setattr(K, "WORDS", 5)
    encoder = K.Encoder(K.tokenizer_path())
    text = " ".join(f"word{i % 13} thing" for i in range(200))
    assert (encoder.encode([text.encode()])[0] & (K.END - 1)).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [K.CLOSE]
    assert len(encoder.words) <= 6


def brute(at, cost, length, powers):
    best = {0: 0}
    for b, c in zip(at, cost, strict=True):
        best[b] = c + min(f + (K.SHORT if b - a in powers else length - (b - a)) for a, f in best.items() if 0 < b - a <= length)
    return best[at[-1]]


def price(cuts, at, cost, length, powers):
    paid, steps = dict(zip(at, cost, strict=True)), np.diff([0, *cuts])
    assert steps.max() <= length and steps.min() > 0
    return sum(K.SHORT if s in powers else length - s for s in steps) + sum(paid[c] for c in cuts)


def test_dynamic_program_is_optimal_over_segments():
    """Cuts settled in between are those of the optimum of the whole stream."""
    rng, early = random.Random(5), 0
    for k in range(300):
        gaps = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 200))]
        at, cost = np.cumsum(gaps).tolist(), [rng.choice([0, 2, 10]) for _ in gaps]
        powers = (16, 8) if k % 3 else ()
        plan, cuts = K.Cuts(32, powers), []
        for i in range(0, len(at), 7):
            plan.extend(at[i : i + 7], cost[i : i + 7])
            if k % 2:
                cuts += plan.settle()
        early += len(cuts)
        cuts += plan.path(plan.first + len(plan.at) - 1)
        assert price(cuts, at, cost, 32, powers) == brute(at, cost, 32, powers)
    assert early > 1000


def test_regular_sentences_are_settled_within_bounds():
    """Paths that never meet: memory stays bounded and a window is lost at most."""
    packer, n = K.Packer(0, 32, 100, 400), 5000
    packer.cuts = K.Cuts(32, ())
    for i in range(n):
        packer.add(i, np.array([5, 6, 7, K.CLOSE], dtype=np.uint32))
        assert packer.size - packer.done <= 700
    packer.finish()
    used = defaultdict(int)
    for r in packer.rows:
        used[r[5]] += r[2]
    assert sum(used.values()) == 4 * n and sum(32 - x for x in used.values()) <= 32 * (4 * n // 400 + 1)


def test_closing_windows():
    assert K.closing([2040]) == [2040] and K.closing([100, 1024]) == [1024]
    assert K.closing([16, 1040]) == [16, 1040] and K.closing([1]) == [1]
    assert K.closing([24, 700, 1300]) == [1300] and K.closing([2000, 2500]) in ([2000, 2500], [500, 2500])


def test_cuts_fall_at_sentences_and_documents_only(spark, tokenizer):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    encoder, texts = K.Encoder(K.tokenizer_path()), {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    inside = 0
    for r in K.query(spark, folder).collect():
        if r.start:
            marked = encoder.encode([texts[r.doc_id]])[0]
            if not marked[r.start - 1] & np.uint32(K.END):
                inside += 1
                ends = np.append(0, np.nonzero(marked & np.uint32(K.END))[0] + 1)
                low = ends[ends <= r.start].max()
                high = min([*ends[ends > r.start], len(marked)])
                assert high - low > K.LENGTH, (r.doc_id, r.start, low, high)


def test_pieces_cover_every_token(spark, docs_of, odd_texts, tokenizer):
    rows = odd_texts + [(900, "x" * 9000), (901, "é" * 3000 + ". " + "ab" * 4000)]
    got = K.packed(docs_of(rows), K.tokenizer_path()).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append(r)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= K.LENGTH
    left = defaultdict(list)
    for doc_id, text in rows:
        left[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [K.CLOSE])
    for doc_id, all_ids in left.items():
        tokens = sum(r.length for (d, _), rs in documents.items() if d == doc_id for r in rs)
        assert tokens == sum(map(len, all_ids))
    for doc_id in (6, 7, 900, 901):
        (ids,) = left[doc_id]
        end = 0
        for r in sorted(documents[doc_id, len(ids)], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.start == end and zlib.crc32(part.tobytes()) == r.ids_crc32
            end += r.length
        assert end == len(ids)
    assert K.packed(docs_of([]), K.tokenizer_path()).count() == 0


def test_little_padding(spark, sf):
    got = K.query(spark, sf).groupBy("sequence_id").sum("length").collect()
    sizes = [r[1] for r in got]
    padding = sum(0 if n & (n - 1) == 0 else K.LENGTH - n for n in sizes)
    assert padding <= 0.02 * sum(sizes)
