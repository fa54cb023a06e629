"""Brown class-based n-grams: exchange clustering and smoothed scoring.

The UNITS most frequent words are units of their own; for the first sweeps all
others share one of SHAPES units by their spelling.  Units are put into classes
by exchange: first the CORE most frequent ones, moved one by one to the class
that raises the likelihood of the class bigrams most, then all units at once
from the classes of their neighbours in the whole corpus, SWEEPS times.  In the
last sweep every other word of the training documents gets a class of its own,
from its own neighbours in a distributed table; the spelling unit counts as
SHAPE_PRIOR occurrences, and speaks alone only for words never seen in training.
A text scores by class trigrams, smoothed towards bigrams and unigrams, times
the emission of each word from its class, smoothed with one unseen word a class,
mixed with the word's unigram (weight MIX), which the bare method does not have.

Counts cover all training documents.  Word counts stay distributed: only the
HEAD most frequent words (at most WORD_BYTES long) go to every task, which is a
fixed bound; the occurrences of all other words are joined with their counts
and classes.
What the driver holds is bounded by CORE, UNITS, SHAPES and CLASSES.

Defined results: null and empty texts are the one end token; a null doc_id is
held out; rows that repeat a doc_id are scored one by one; without training
documents the base probability of each token is 1.  Only doc_id and text are
read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, prepare, record_batch, slices, staged, table
from .toxicity import held_out

FOLDS = 10
HEAD, WORD_BYTES = 1 << 18, 64
UNITS, SHAPES = 20_000, 4096
CORE, CLASSES = 1024, 48
EXCHANGES, SWEEPS = 8, 2
#: Occurrences that the spelling unit of a word counts for in the word's class.
SHAPE_PRIOR = 0.5
ADD = 0.1
PRIOR = 20.0
#: Weight of the unigram in the mixture.
MIX = 0.15
#: Tokens whose neighbours a task combines before it sends them on.
FLUSH = 1 << 21
#: Occurrences of a word in as many tokens beyond which only their counts are sent.
DENSE = 400
#: Set in a class byte where the word is outside the head; classes are below it.
TAIL_BIT = 64
#: The end of a text; no word holds a space.
END = b" "
END_UNIT = UNITS + SHAPES
END_CLASS = CLASSES
ALL = CLASSES + 1


def shape_unit(word: bytes) -> int:
    """The unit of a word outside the most frequent: how it begins and ends."""
    return UNITS + zlib.crc32(word[:3] + b" " + word[-2:]) % SHAPES


# ---- counts --------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    found: Counter[bytes] = Counter()

    def full() -> pa.RecordBatch:
        made = record_batch({"word": list(found.keys()), "n": list(found.values())}, schema)
        found.clear()
        return made

    for batch in slices(batches, "text"):
        texts = as_bytes(batch.column("text"))
        for text in texts:
            found.update(text.lower().split())
        found[END] += len(texts)
        if len(found) > 400_000:
            yield full()
    if found:
        yield full()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents; the end of a text is a word."""
    rows = docs.filter(~held_out("doc_id", FOLDS)).select("text").mapInArrow(_count, "word binary, n long")
    return staged(rows.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


@dataclass
class Lexicon:
    """The most frequent words: unit and log10 of the smoothed count of each."""

    index: dict[bytes, int]
    unit: np.ndarray
    log_n: np.ndarray


def lexicon(counts: DataFrame) -> Lexicon:
    """At most HEAD of the most frequent words.

    Where to cut is read from a histogram of counts (16 steps to each doubling,
    each dealt into 64 by hash), so tasks send neither candidates nor words that
    are not taken, however many there are.
    """
    rows = counts.filter(F.octet_length("word") <= WORD_BYTES).filter(F.col("word") != F.lit(END))
    step = F.floor(F.log2("n") * 16) * 64 + F.xxhash64("word").bitwiseAND(F.lit(63))
    rows = rows.withColumn("step", step.cast("long"))
    room, cut = HEAD, None
    for r in sorted(rows.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room -= r.n
        if room < 0:
            break
        cut = r.step
    top = rows.filter(F.col("step") >= cut if cut is not None else F.lit(False)).select("word", "n").toArrow()
    words, n = as_bytes(top.column("word").combine_chunks()), top.column("n").to_numpy().astype(np.float64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words = [words[i] for i in order]
    unit = np.array([i if i < UNITS else shape_unit(w) for i, w in enumerate(words)], dtype=np.int16)
    return Lexicon({w: i for i, w in enumerate(words)}, unit, np.log10(n[order] + ADD) if len(order) else n)


def unit_totals(counts: DataFrame, words: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every unit."""
    index, unit = words.index, words.unit
    schema = pa.schema([("unit", pa.int32()), ("n", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(END_UNIT + 1, np.int64), np.zeros(END_UNIT + 1, np.int64)
        for batch in batches:
            at = [_unit_of(w, index, unit) for w in as_bytes(batch.column("word"))]
            n = batch.column("n").to_numpy()
            np.add.at(tokens, at, n)
            np.add.at(kinds, at, 1)
        used = np.nonzero(kinds)[0]
        yield record_batch({"unit": used, "n": tokens[used], "words": kinds[used]}, schema)

    got = counts.mapInArrow(run, "unit int, n long, words long").groupBy("unit").agg(F.sum("n"), F.sum("words")).toArrow()
    tokens, kinds = np.zeros(END_UNIT + 1), np.zeros(END_UNIT + 1)
    tokens[got.column(0).to_numpy()] = got.column(1).to_numpy()
    kinds[got.column(0).to_numpy()] = got.column(2).to_numpy()
    return tokens, kinds


def _unit_of(word: bytes, index: dict[bytes, int], unit: np.ndarray) -> int:
    at = index.get(word)
    return END_UNIT if word == END else int(unit[at]) if at is not None else shape_unit(word)


# ---- documents as codes ----------------------------------------------------

#: ``tail`` has the distinct words of a text outside the head, ``spots`` which of
#: them each of their occurrences is.
ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, log_n double, codes binary, tail array<binary>, spots binary"


def units_of(words: Lexicon) -> np.ndarray:
    """The unit of every code: words of the head, spelling units, the end."""
    return np.concatenate([words.unit, np.arange(UNITS, END_UNIT + 1)]).astype(np.int16)


def encoded(docs: DataFrame, words: Lexicon, log_end: float) -> DataFrame:
    """Each document as codes, with what its frequent words add up to."""
    index, log_n, heads = words.index, words.log_n, len(words.index)
    schema = pa.schema(
        [
            ("uid", pa.int64()),
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("n_tokens", pa.int64()),
            ("known", pa.int64()),
            ("log_n", pa.float64()),
            ("codes", pa.binary()),
            ("tail", pa.list_(pa.binary())),
            ("spots", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out: dict[str, list] = {k: [] for k in ("n_tokens", "known", "log_n", "codes", "tail", "spots")}
            for text in as_bytes(batch.column("text")):
                tokens = text.lower().split()
                at = np.fromiter(map(index.get, tokens, repeat(-1)), dtype=np.int32, count=len(tokens))
                rare = np.nonzero(at < 0)[0]
                number: dict[bytes, int] = {}
                spots = np.fromiter((number.setdefault(tokens[i], len(number)) for i in rare.tolist()), dtype=np.int32, count=len(rare))
                codes = np.append(at, np.int32(heads + SHAPES))
                if number:
                    codes[rare] = np.array([heads - UNITS + shape_unit(w) for w in number], dtype=np.int32)[spots]
                known = len(tokens) - len(rare)
                out["n_tokens"].append(len(tokens) + 1)
                out["known"].append(known + 1 if log_end > np.log10(ADD) else known)
                out["log_n"].append((float(log_n[at[at >= 0]].sum()) if known else 0.0) + log_end)
                out["codes"].append(codes.tobytes())
                out["tail"].append(list(number))
                out["spots"].append(spots.tobytes())
            yield record_batch({c: batch.column(c) for c in ("uid", "doc_id", "held_out")} | out, schema)

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", held_out("doc_id", FOLDS).alias("held_out"), "text"
    )
    return staged(rows.mapInArrow(run, ENCODED), "brown-units")


def _streams(batches: Iterator[pa.RecordBatch], unit_of: np.ndarray) -> Iterator[np.ndarray]:
    """Unit numbers of the documents of each batch, one after another.

    Texts end with the end unit, which is also what the next one follows.
    """
    for batch in batches:
        if batch.num_rows:
            data = b"".join(as_bytes(batch.column("codes")))
            yield np.concatenate([[END_UNIT], unit_of[np.frombuffer(data, dtype=np.int32)]]).astype(np.int32)


def _class_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Classes of the documents of each batch, one after another."""
    for batch in batches:
        if batch.num_rows:
            data = b"".join(as_bytes(batch.column("classes")))
            yield np.concatenate([[END_CLASS], np.frombuffer(data, dtype=np.uint8)]).astype(np.int32)


def _summed(rows: DataFrame, streams, work, size: int) -> np.ndarray:
    """Sum over all tasks of the count vectors that ``work`` makes of streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for stream in streams(batches):
            total += work(stream)
        used = np.nonzero(total)[0]
        for part in np.array_split(used, max(1, len(used) >> 16)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["k", "n"])

    got = rows.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


# ---- classes ---------------------------------------------------------------


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = EXCHANGES) -> np.ndarray:
    """Classes of the core units by exchange on their bigram counts.

    The criterion is the sum of n log n over class bigrams less that over their
    margins; units move one by one, most frequent first, until none does.
    """
    m = len(bigrams)
    of = np.arange(m) % classes
    member = np.zeros((m, classes))
    member[np.arange(m), of] = 1
    left, right = bigrams.T @ member, bigrams @ member  # [unit, class] before, after
    pairs = member.T @ right
    xlogx = lambda v: v * np.log(np.maximum(v, 1e-300))
    ids = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            own = of[w]
            self_ = bigrams[w, w]
            l_, r_ = left[w].copy(), right[w].copy()
            if not l_.any() and not r_.any():
                continue
            l_[own] -= self_
            r_[own] -= self_
            pairs[:, own] -= l_
            pairs[own, :] -= r_
            pairs[own, own] -= self_
            # the gain of adding w to each class, over its row and its column
            new_cols, new_rows = pairs + l_[:, None], pairs + r_[None, :]
            cols = xlogx(new_cols).sum(0) - xlogx(pairs).sum(0)
            rows = xlogx(new_rows).sum(1) - xlogx(pairs).sum(1)
            diag = pairs[ids, ids]
            both = xlogx(diag + l_ + r_ + self_) - xlogx(diag + l_) - xlogx(diag + r_) + xlogx(diag)
            before, after = pairs.sum(0), pairs.sum(1)
            margin = xlogx(before + l_.sum() + self_) - xlogx(before) + xlogx(after + r_.sum() + self_) - xlogx(after)
            best = int(np.argmax(cols + rows + both - margin))
            pairs[:, best] += l_
            pairs[best, :] += r_
            pairs[best, best] += self_
            if best != own:
                moved += 1
                of[w] = best
                left[:, own] -= bigrams[w, :]
                left[:, best] += bigrams[w, :]
                right[:, own] -= bigrams[:, w]
                right[:, best] += bigrams[:, w]
        if not moved:
            break
    return of


def _neighbours(rows: DataFrame, unit_of: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts [unit, class] of the classes before and after every unit."""
    units = END_UNIT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, units * ALL), dtype=np.int32)
        for s in _streams(batches, unit_of):
            c = of[s]
            known = c[:-1] >= 0
            total[0] += np.bincount((s[1:] * ALL + c[:-1])[known], minlength=units * ALL).astype(np.int32)
            known = c[1:] >= 0
            total[1] += np.bincount((s[:-1] * ALL + c[1:])[known], minlength=units * ALL).astype(np.int32)
        both = np.concatenate(list(total.reshape(2, units, ALL)), axis=1)
        used = np.nonzero(both.any(axis=1))[0]
        for part in np.array_split(used, max(1, len(used) >> 10)):
            values = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * (2 * ALL), both[part].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), values], names=["unit", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("v").flatten().to_numpy().reshape(-1, 2 * ALL)
            for u, v in zip(batch.column("unit").to_pylist(), values, strict=True):
                if u in total:
                    total[u] += v
                else:
                    total[u] = v.astype(np.int64)
        if total:
            flat = np.concatenate(list(total.values()))
            values = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * (2 * ALL), flat)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), values], names=["unit", "v"])

    summed = rows.select("codes").mapInArrow(run, "unit int, v array<int>").repartition("unit").mapInArrow(add, "unit int, v array<long>")
    got = summed.toArrow()
    out = np.zeros((units, 2 * ALL))
    if got.num_rows:
        out[got.column("unit").to_numpy()] = got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, 2 * ALL)
    return out[:, :ALL], out[:, ALL:]


@dataclass
class Sweep:
    """What one sweep gives a unit or word for its neighbours' classes.

    ``of`` has the classes of units before the sweep; the gain of a class is
    the counts of the classes before and after times ``weight``, less
    ``margin`` for each occurrence.
    """

    of: np.ndarray
    weight: np.ndarray
    margin: np.ndarray

    def gain(self, beside: np.ndarray, n: np.ndarray) -> np.ndarray:
        gain = beside @ self.weight - n[:, None] * self.margin[None, :]
        gain[:, END_CLASS] = -np.inf
        return gain


def _sweep(right: np.ndarray, tokens: np.ndarray, of: np.ndarray) -> Sweep:
    """Units move to their likeliest class, the others staying as they are."""
    known = of >= 0
    pairs = np.zeros((ALL, ALL))
    np.add.at(pairs, of[known], right[known])
    follow = np.log((pairs + ADD) / (pairs + ADD).sum(axis=1, keepdims=True))
    size = np.bincount(of[known], tokens[known], minlength=ALL)
    return Sweep(of, np.concatenate([follow, follow.T]), np.log(size + 1))


def classes(rows: DataFrame, unit_of: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, Sweep, np.ndarray]:
    """The class of every unit, the last sweep, and its gains a token of spelling units."""
    core_of = np.full(END_UNIT + 1, -1, dtype=np.int32)
    core_of[:CORE] = np.arange(CORE)

    def core_pairs(s: np.ndarray) -> np.ndarray:
        a, b = core_of[s[:-1]], core_of[s[1:]]
        both = (a >= 0) & (b >= 0)
        return np.bincount(a[both] * CORE + b[both], minlength=CORE * CORE)

    of = np.full(END_UNIT + 1, -1, dtype=np.int32)
    pairs = _summed(rows.select("codes"), lambda batches: _streams(batches, unit_of), core_pairs, CORE * CORE)
    of[:CORE] = exchange(pairs.reshape(CORE, CORE))
    of[END_UNIT] = END_CLASS
    for _ in range(SWEEPS):
        left, right = _neighbours(rows, unit_of, of)
        sweep = _sweep(right, tokens, of)
        gain = sweep.gain(np.concatenate([left, right], axis=1), tokens)
        of = gain.argmax(axis=1).astype(np.int32)
        of[END_UNIT] = END_CLASS
    return of, sweep, gain[UNITS:END_UNIT] / np.maximum(tokens[UNITS:END_UNIT], 1)[:, None]


# ---- classes of all other words --------------------------------------------


def _grouped(key: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, list[bytes | None], list[bytes | None]]:
    """The distinct keys, and for each what stands beside its occurrences.

    That is the class pairs, two bytes each, or for a key with more than
    ``DENSE`` occurrences their counts, so that no key takes more than a few
    hundred bytes however often it occurs.
    """
    order = np.argsort(key, kind="stable")
    found, first = np.unique(key[order], return_index=True)
    beside, ends = beside[order], np.append(first, len(key))[1:]
    pairs, sums = [], []
    for a, b in zip(first.tolist(), ends.tolist(), strict=True):
        many = b - a > DENSE
        pairs.append(None if many else beside[a:b].tobytes())
        sums.append(np.append(_counted(beside[a:b], np.zeros(b - a, dtype=np.int64), 1)[0], b - a).tobytes() if many else None)
    return found, pairs, sums


def _counted(beside: np.ndarray, of_pair: np.ndarray, keys: int) -> np.ndarray:
    """Counts [key, class before and class after] of class pairs; a class may be unknown."""
    total, beside = np.zeros(keys * 2 * ALL, dtype=np.int64), beside.astype(np.int64)
    for side in (0, 1):
        known = beside[:, side] < ALL
        total += np.bincount((of_pair * 2 * ALL + side * ALL + beside[:, side])[known], minlength=len(total))
    return total.reshape(-1, 2 * ALL)


def word_classes(rows: DataFrame, unit_of: np.ndarray, sweep: Sweep, spelled: np.ndarray) -> DataFrame:
    """(code, word, cls, n) of all words that are no units; word is null in the head.

    A task sends one row a word and FLUSH tokens; rows of a word meet in order,
    so adding them up holds one word at a time besides a batch.
    """
    of, heads = sweep.of, len(unit_of) - SHAPES - 1
    schema = pa.schema([("code", pa.int32()), ("word", pa.binary()), ("beside", pa.binary()), ("sums", pa.binary())])
    result = pa.schema([("code", pa.int32()), ("word", pa.binary()), ("cls", pa.int32()), ("n", pa.int64())])

    def send(codes: list[np.ndarray], tails: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        code = np.concatenate([[heads + SHAPES], *codes])
        c = of[unit_of[code]].astype(np.uint8)  # 255 where a unit has no class yet
        at = np.nonzero((code >= UNITS) & (code < heads))[0]
        found, beside, sums = _grouped(code[at], np.stack([c[at - 1], c[at + 1]], axis=1))
        yield record_batch({"code": found, "word": pa.nulls(len(found), pa.binary()), "beside": beside, "sums": sums}, schema)
        at = np.nonzero((code >= heads) & (code < heads + SHAPES))[0]
        words = pa.concat_arrays(tails).dictionary_encode()
        found, beside, sums = _grouped(words.indices.to_numpy(), np.stack([c[at - 1], c[at + 1]], axis=1))
        code_of = np.zeros(len(found), dtype=np.int32)
        code_of[words.indices.to_numpy()] = code[at]
        yield record_batch({"code": code_of, "word": words.dictionary, "beside": beside, "sums": sums}, schema)

    def occurrences(batch: pa.RecordBatch) -> pa.Array:
        """The words of all spots, one after another."""
        tail = batch.column("tail")
        begins = tail.offsets.to_numpy()[:-1].astype(np.int64) - tail.offsets[0].as_py()
        spots = [np.frombuffer(x, dtype=np.int32) + a for x, a in zip(as_bytes(batch.column("spots")), begins, strict=True)]
        return tail.flatten().take(pa.array(np.concatenate(spots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tails, size = [], [], 0
        for batch in batches:
            if batch.num_rows:
                codes.append(np.frombuffer(b"".join(as_bytes(batch.column("codes"))), dtype=np.int32))
                tails.append(occurrences(batch))
                size += len(codes[-1])
            if size > FLUSH:
                yield from send(codes, tails)
                codes, tails, size = [], [], 0
        if codes:
            yield from send(codes, tails)

    def chosen(code: np.ndarray, words: list, total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        gain = sweep.gain(total, n) + SHAPE_PRIOR * spelled[unit_of[code] - UNITS]
        return record_batch({"code": code, "word": words, "cls": gain.argmax(axis=1), "n": n}, result)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # code, word, counts and occurrences of the word that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            code, words = batch.column("code").to_numpy(), batch.column("word").to_pylist()
            new = np.array([True] + [a != b for a, b in zip(words, words[1:], strict=False)])
            new[1:] |= code[1:] != code[:-1]
            first, ids = np.nonzero(new)[0], np.cumsum(new) - 1
            data = as_bytes(batch.column("beside"))
            beside = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, 2)
            of_pair = np.repeat(ids, [len(x) // 2 for x in data])
            n = np.bincount(of_pair, minlength=len(first))
            total = _counted(beside, of_pair, len(first)).astype(np.float64)
            for i, dense in zip(ids, batch.column("sums").to_pylist(), strict=True):
                if dense is not None:
                    dense = np.frombuffer(dense, dtype=np.int64)
                    total[i] += dense[:-1]
                    n[i] += dense[-1]
            code, words = code[first], [words[i] for i in first]
            if held is not None:
                if held[0] == code[0] and held[1] == words[0]:
                    total[0] += held[2]
                    n[0] += held[3]
                else:
                    yield chosen(np.array([held[0]]), [held[1]], held[2][None], np.array([held[3]]))
            held = code[-1], words[-1], total[-1], n[-1]
            if len(first) > 1:
                yield chosen(code[:-1], words[:-1], total[:-1], n[:-1])
        if held is not None:
            yield chosen(np.array([held[0]]), [held[1]], held[2][None], np.array([held[3]]))

    sent = rows.select("codes", "tail", "spots").mapInArrow(run, "code int, word binary, beside binary, sums binary")
    met = sent.repartition("code", "word").sortWithinPartitions("code", "word")
    return staged(met.mapInArrow(add, "code int, word binary, cls int, n long"), "brown-words")


CLASSED = "doc_id long, held_out boolean, n_tokens long, known long, log_n double, classes binary"


def classed(rows: DataFrame, words: DataFrame, class_of: np.ndarray, heads: int) -> DataFrame:
    """Each document as classes, with what all its words add up to."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("log_n", pa.float64()), ("classes", pa.binary())])
    byte_of = class_of.astype(np.uint8)
    byte_of[heads : heads + SHAPES] |= TAIL_BIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"known": [], "log_n": [], "classes": []}
            columns = (batch.column(c).to_pylist() for c in ("known", "log_n", "own"))
            for x, raw, known, log_n, own in zip(as_bytes(batch.column("codes")), as_bytes(batch.column("spots")), *columns, strict=True):
                c, spots = byte_of[np.frombuffer(x, dtype=np.int32)], np.frombuffer(raw, dtype=np.int32)
                if len(spots):
                    at = np.nonzero(c & TAIL_BIT)[0]
                    c &= TAIL_BIT - 1
                    count = np.zeros(spots.max() + 1)
                    if own:
                        i, cls, n = (np.array([w[k] for w in own]) for k in ("i", "cls", "n"))
                        count[i] = n
                        found = np.full(len(count), -1, dtype=np.int64)
                        found[i] = cls
                        mine = found[spots]
                        c[at[mine >= 0]] = mine[mine >= 0]
                        known += int((count[spots] > 0).sum())
                    log_n += float(np.log10(count[spots] + ADD).sum())
                out["known"].append(known)
                out["log_n"].append(log_n)
                out["classes"].append(c.tobytes())
            yield record_batch({c: batch.column(c) for c in ("doc_id", "held_out", "n_tokens")} | out, schema)

    tails = words.filter("word IS NOT NULL").select("word", "cls", "n")
    # one row for each distinct rare word of a text; a text's own words are collected
    rare = rows.select("uid", F.posexplode("tail").alias("i", "word")).join(tails, "word").groupBy("uid").agg(
        F.collect_list(F.struct("i", "cls", "n")).alias("own")
    )
    joined = rows.select("uid", "doc_id", "held_out", "n_tokens", "known", "log_n", "codes", "spots").join(rare, "uid", "left").drop("uid")
    return staged(joined.mapInArrow(run, CLASSED), "brown-classes")


# ---- the model -------------------------------------------------------------


@dataclass
class Model:
    """Transitions [c2, c1, c], sums of emission, of unigrams.

    The probability of a word is a mixture of that of its class times its
    emission and of its unigram.  Both have the word's smoothed count as their
    numerator, so a text is scored from classes and the counts are added apart.
    """

    follow: np.ndarray
    emit: np.ndarray
    unigram: float

    def score(self, c: np.ndarray) -> float:
        """log10 probability of a text of classes, without the counts of its words."""
        past = np.concatenate([[END_CLASS, END_CLASS], c])
        by_class = self.follow[past[:-2], past[1:-1], c] / self.emit[c]
        return float(np.log10((1 - MIX) * by_class + MIX / self.unigram).sum())


def model_of(rows: DataFrame, size: np.ndarray, words: np.ndarray) -> Model:
    """The model of documents as classes; ``size`` and ``words`` are tokens and words of each class."""

    def triples(c: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[END_CLASS], c[:-1]])
        # a text that begins has two ends before it
        before = np.where(c == END_CLASS, END_CLASS, ends)
        return np.bincount((before[:-1] * ALL + c[:-1]) * ALL + c[1:], minlength=ALL**3)

    n3 = _summed(rows.select("classes"), _class_streams, triples, ALL**3).reshape(ALL, ALL, ALL)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + ADD) / (n1 + ADD).sum()
    p2 = (n2 + PRIOR * p1) / (n2.sum(axis=1, keepdims=True) + PRIOR)
    p3 = (n3 + PRIOR * p2[None]) / (n3.sum(axis=2, keepdims=True) + PRIOR)
    # one unseen word for each class, so that all probabilities sum to one
    return Model(p3, size + ADD * (words + 1), size.sum() + ADD * (words.sum() + ALL))


def fitted(docs: DataFrame) -> tuple[DataFrame, Model, Row]:
    """All documents as classes, the model, and the tokens n and words v it learned from."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    counts = word_counts(docs)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = lexicon(counts)
    tokens, kinds = unit_totals(counts, words)
    rows, unit_of = encoded(docs, words, float(np.log10(tokens[END_UNIT] + ADD))), units_of(words)
    training = rows.filter("NOT held_out")
    of, sweep, spelled = classes(training, unit_of, tokens)
    others = word_classes(training, unit_of, sweep, spelled)
    class_of = of[unit_of]
    in_head = others.filter("word IS NULL").select("code", "cls").toArrow()  # HEAD rows at most
    class_of[in_head.column("code").to_numpy()] = in_head.column("cls").to_numpy()
    own = np.r_[:UNITS, END_UNIT]
    size, number = (np.bincount(of[own], x[own], minlength=ALL) for x in (tokens, kinds))
    for r in others.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        size[r.cls] += r.n
        number[r.cls] += r.words
    texts = classed(rows, others, class_of, len(words.index))
    return texts, model_of(texts.filter("NOT held_out"), size, number), total


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts, model, total = fitted(docs)
    base = float(np.log10(total.n + ADD * (total.v + 1)))
    schema = pa.schema([("class_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(np.frombuffer(x, dtype=np.uint8)) for x in as_bytes(batch.column("classes"))]
            others = [f for f in batch.schema if f.name != "classes"]
            yield record_batch({f.name: batch.column(f.name) for f in others} | {"class_score": score}, pa.schema([*others, *schema]))

    return texts.mapInArrow(run, CLASSED.replace("classes binary", "class_score double")).select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("log_n") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("log_n") + F.col("class_score")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
