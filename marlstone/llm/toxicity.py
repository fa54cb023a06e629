"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the mean of the embeddings of its hashed character n-grams, so a
misspelling that was never seen shares most of its vector with the word it
bends.  A document is the mean of the ``STRONGEST`` distinct words that speak
most for the toxic class, and a linear softmax turns it into two classes: of
all words, as a plain mean would have it, the few toxic ones of a long text
would not count, and of one, as a maximum, any chance likeness would.  Embeddings and softmax are trained jointly
in numpy on the driver, from a sample of labelled documents: at most
``PER_CLASS`` of each class in order of a hash of doc_id, those of at most
``LONGEST`` bytes before longer ones.  A longer text gives a window of
``LONGEST`` bytes, whose place a hash of doc_id picks, and where the sample of a
class would pass half of ``SAMPLE_BYTES``, all its texts are cut to equal
bounds instead of dropping any.  Training begins with the mean of whole
documents, which tells which words are strong, and goes on with the strongest,
which are chosen anew every ``REFRESH`` steps.
Of rows that repeat a doc_id the smallest text counts.

All of the model that scoring needs is one number for each n-gram bucket
(256 KB), which goes to every task whatever the input's size.

Defined results: null, empty and all-space texts score 0; a document without a
label is scored like any other; a document with several labels counts as toxic
if one says so; null labels are ignored; without labels of both classes every
score is the prior.  Only doc_id and text are read, besides doc_id and toxic of
the labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, prepare, record_batch, slices, table

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 16
DIM = 8
STRONGEST = 3
PER_CLASS = 1500
LONGEST, SAMPLE_BYTES = 8 << 10, 8 << 20
WARM, ROUNDS, REFRESH, RATE, DECAY = 20, 150, 5, 0.05, 1e-5
#: Weight of the toxic class in training.
TOXIC_SHARE = 0.3
FOLDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def held_out(doc_id: str, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % folds == 0


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as lower-case bytes between spaces, and where each begins."""
    joined = b" " + b" ".join(texts) + b" " * (max(SIZES) + 1)
    raw = np.frombuffer(joined.lower(), dtype=np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return raw, begins


def _grams(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: whether one starts at a position, and its bucket.

    A gram may begin and end with the space around its word, not hold one inside.
    """
    space = _SPACE[raw]
    chars = np.where(space, np.uint8(32), raw).astype(np.uint32)
    n = len(raw) - max(SIZES)
    h = chars[:n] * np.uint32(0x9E3779B1)
    inside = np.ones(n, dtype=bool)
    for k in range(1, max(SIZES)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x01000193) + chars[k : k + n]
        if k + 1 in SIZES:
            ok = inside if k == 1 else inside & ~space[k - 1 : k - 1 + n]
            yield ok, ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)
        if k > 1:
            inside = inside & ~space[k - 1 : k - 1 + n]


@dataclass
class Model:
    """Score of each n-gram bucket (its embedding times the softmax) and bias."""

    table: np.ndarray
    bias: float

    def word_scores(self, texts: list[bytes]) -> list[np.ndarray]:
        """Scores of the words of each text."""
        if not texts:
            return []
        raw, begins = _stream(texts)
        n = len(raw) - max(SIZES)
        value, count = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
        for ok, bucket in _grams(raw):
            value += np.where(ok, self.table[bucket], np.float32(0))
            count += ok
        starts = np.nonzero(_SPACE[raw[:n]])[0]
        total, number = np.add.reduceat(value, starts), np.add.reduceat(count, starts)
        filled = number > 0
        score = total[filled] / number[filled]
        cuts = np.searchsorted(starts[filled], begins)
        return [score[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

    def logit(self, words: np.ndarray) -> float:
        return float(words[strongest(words)].mean()) + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, words in enumerate(self.word_scores(texts)):
            if len(words):
                out[i] = 1 / (1 + np.exp(-np.clip(self.logit(words), -30, 30)))
        return out


def strongest(words: np.ndarray) -> np.ndarray:
    """Where the strongest distinct words are; equal words have equal scores."""
    if len(words) > 64:  # the best few need no full sort
        near = np.argpartition(words, -64)[-64:]
        _, first = np.unique(words[near], return_index=True)
        if len(first) >= STRONGEST:
            return near[first[-STRONGEST:]]
    _, first = np.unique(words, return_index=True)
    return first[-STRONGEST:]


class _Bags:
    """N-gram buckets of the distinct words of the training texts.

    ``docs`` has the distinct words of each text and how often each occurs.  The
    arrays of each n-gram size are kept apart and worked on in chunks, so that
    no temporary is as large as the sample.
    """

    CHUNK = 1 << 20

    def __init__(self, texts: list[bytes]):
        index: dict[bytes, int] = {}
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            found = Counter(text.lower().split())
            ids = np.array([index.setdefault(w, len(index)) for w in found], dtype=np.int64)
            self.docs.append((ids, np.array(list(found.values()), dtype=np.float64)))
        raw, _ = _stream([b" ".join(index)])
        n = len(raw) - max(SIZES)
        word_at = (np.cumsum(_SPACE[raw[:n]]) - 1).astype(np.int32)
        number = np.zeros(len(index), dtype=np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        for ok, bucket in _grams(raw):
            self.parts.append((word_at[ok], bucket[ok]))
            number += np.bincount(self.parts[-1][0], minlength=len(index))[: len(index)]
        self.count = number.astype(np.float64)  # a word of one letter has a gram with its spaces

    def chosen(self, doc: int, scores: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The words of a text that count and their shares: the strongest, or all."""
        ids, often = self.docs[doc]
        if scores is None:
            return ids, often / often.sum()
        best = min(STRONGEST, len(ids))
        return ids[np.argpartition(scores[ids], len(ids) - best)[-best:]], np.full(best, 1 / best)

    def only(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The n-grams of some words."""
        wanted = np.zeros(len(self.count), dtype=bool)
        wanted[words] = True
        kept = [wanted[word] for word, _ in self.parts]
        return [(word[k], bucket[k]) for (word, bucket), k in zip(self.parts, kept, strict=True)]

    def _chunks(self, parts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for word, bucket in parts:
            for at in range(0, len(word), self.CHUNK):
                yield word[at : at + self.CHUNK], bucket[at : at + self.CHUNK]

    def scores(self, gram: np.ndarray, parts=None) -> np.ndarray:
        """Means of the n-grams of each word, of ``only`` some of them if given."""
        total = np.zeros(len(self.count))
        for word, bucket in self._chunks(self.parts if parts is None else parts):  # words rise within a chunk
            sums = np.bincount(word - word[0], gram[bucket])
            total[word[0] : word[0] + len(sums)] += sums
        return total / self.count

    def weights(self, per_word: np.ndarray, parts=None) -> np.ndarray:
        """Sum over buckets of the weights given to words."""
        each, total = per_word / self.count, np.zeros(BUCKETS)
        for word, bucket in self._chunks(self.parts if parts is None else parts):
            total += np.bincount(bucket, each[word], minlength=BUCKETS)
        return total


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> Model:
    """Train embeddings and softmax jointly with Adam on the whole sample."""
    keep = [i for i, t in enumerate(texts) if t.strip()]
    texts, label = [texts[i] for i in keep], toxic[keep].astype(np.float64)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(BUCKETS, dtype=np.float32), -4.0)
    bags = _Bags(texts)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    weight = np.where(label == 1, TOXIC_SHARE / label.mean(), (1 - TOXIC_SHARE) / (1 - label.mean())) / len(label)
    for step in range(1, WARM + ROUNDS + 1):
        embed, soft, bias = params
        away = soft[:, 1] - soft[:, 0]
        if step == 1 or (step > WARM and (step - WARM) % REFRESH == 1):
            words = bags.scores(embed @ away)
            chosen = [bags.chosen(d, words if step > WARM else None) for d in range(len(texts))]
            ids, share = (np.concatenate(x) for x in zip(*chosen, strict=True))
            text_of = np.repeat(np.arange(len(texts)), [len(x) for x, _ in chosen])
            parts = bags.only(ids) if step > WARM else None
        words = bags.scores(embed @ away, parts)
        logit = np.bincount(text_of, words[ids] * share, minlength=len(texts))
        p = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -30, 30)))
        error = (p - label) * weight
        coef = bags.weights(np.bincount(ids, share * error[text_of], minlength=len(words)), parts)
        pull = coef @ embed
        grads = [
            np.outer(coef, away) + DECAY * embed * (coef != 0)[:, None],
            np.stack([-pull, pull], axis=1) + DECAY * soft,
            np.array([-error.sum(), error.sum()]),
        ]
        for p_, g, m in zip(params, grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p_ -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    embed, soft, bias = params
    return Model((embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of a bounded sample outside the held-out fold."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # two orders by hash, so that a short text is never left out for a long one
    sizes = docs.groupBy("doc_id").agg(F.min(size).alias("size")).join(known, "doc_id")
    keys = [F.col("size") > LONGEST, order, F.col("doc_id")]
    picked = [sizes.filter(F.col("toxic") == c).orderBy(*keys).limit(per_class).select("doc_id", "toxic") for c in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # 2 * per_class rows at most
    start = F.when(size > LONGEST, F.pmod(F.xxhash64("doc_id", F.lit(1)), size - LONGEST + 1)).otherwise(F.lit(0)).cast("int")
    window = F.substring(text, start + 1, F.lit(LONGEST))
    rows = (
        docs.join(sample, "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct(size.alias("size"), window.alias("text"))).alias("least"), F.first("toxic").alias("toxic"))
        .select("doc_id", F.col("least.text").alias("text"), "toxic")
        .orderBy(order, "doc_id")
        .toArrow()
    )
    texts, toxic = as_bytes(rows.column("text").combine_chunks()), np.array(rows.column("toxic").to_pylist(), dtype=np.int64)
    for c in (0, 1):
        of = [i for i in range(len(texts)) if toxic[i] == c]
        bound = _equal_bound([len(texts[i]) for i in of], SAMPLE_BYTES // 2)
        for i in of:
            texts[i] = texts[i][:bound]
    return texts, toxic


def _equal_bound(lengths: list[int], room: int) -> int:
    """The largest bound under which texts cut to it fit in ``room``."""
    for left, n in zip(range(len(lengths), 0, -1), sorted(lengths), strict=True):
        if n * left > room:
            return room // left
        room -= n
    return LONGEST


def _scorer(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            score = model.score(as_bytes(batch.column("text")))
            yield record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score}, schema)

    return run


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    rows = rows.mapInArrow(_scorer(fitted(docs, labels)), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    prepare(docs.sparkSession)
    model = fitted(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_text, 1 << 20):
            yield batch.filter(pa.array(model.score(as_bytes(batch.column(at))) < 0.5))

    batch_text = docs.columns[at]
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
