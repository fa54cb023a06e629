"""Packing documents into sequences by order-preserving dynamic programming.

The token stream of a partition, document after document, is cut into windows
of at most ``LENGTH`` tokens.  A cut may fall at the end of a document (free) or
at the end of a sentence or line (``SENTENCE``); only inside sentences that no window
can hold also every ``HARD_EVERY`` tokens (``HARD``).  With b(j) the stream
position of cut j, the best cost up to it is

    f(j) = penalty(j) + min of f(i) + LENGTH - (b(j) - b(i))  where b(j) - b(i) <= LENGTH
                              f(i) + SHORT                    where b(j) - b(i) is one of POWERS

as sequences of a power of two are not padded.  Padding is linear in the window,
so f(i) + b(i) does not depend on j and the first minimum, over the sliding
range of i, is the head of a monotone queue: each cut enters and leaves it once.
The second is one look for each power.  The queue lives as long as the
partition.  Whenever ``SEGMENT`` tokens have gathered, the windows that the best
paths of all cuts within reach have in common are written out, as no later cut
can change them.  Where paths still differ after ``PENDING`` tokens, the
cheapest one is followed: that bounds the memory and costs one window's padding
in as many tokens at most.

The last window of a partition is cut alike, at any power of two.
Sequence numbers hold the task's partition and a count, so no shuffle is needed.

Defined results: null and empty texts are the one closing token; repeated rows
are packed one by one; ties go to the later cut; an empty table gives no piece.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, prepare, slices, table

LENGTH = 2048
CLOSE = 1
SENTENCE, HARD, HARD_EVERY = 2, 10, 24
POWERS, SHORT = (1024, 512, 256, 128), 4
SEGMENT, PENDING = 1 << 18, 1 << 21
WORDS = 600_000
TOKENIZER = "word_bpe_49k.json"
#: The top bit of a cached id says that a sentence ends with its word.
END = 1 << 31
#: A sentence ends with a word whose closing marks hold one of STOPS.
STOPS = set(".!?\u2026\u3002")
MARKS = string.punctuation + "\u2026\u3002\u201c\u201d\u2018\u2019\xab\xbb"

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)
SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for the bytes of a Latin-1 letter.

    Printable Latin-1 bytes stand for themselves, all others for the letters
    from U+0100 on in order of the byte.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in own}
    letter |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Words(dict):
    """Ids of words as little-endian bytes, in a bounded cache.

    Words of Latin-1 letters, with ASCII marks at their end at most, go straight
    to the tokenizer's BPE model; all others go through the whole tokenizer.  When
    the cache is full the words of the older half are dropped.
    """

    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.plain = self.PLAIN.fullmatch
        self.old: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.packed(word)
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
            self.stems.clear()
        self[word] = value
        return value

    def packed(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = self.plain(text)
        if not plain:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if ids and STOPS & set(text[len(text.rstrip(MARKS)) :]):
                ids[-1] |= END
            return pack(ids)
        stem, mark = plain.groups()
        value = self.stems.get(stem)
        if value is None:
            # the same letters in another case have the same ids
            small = stem.lower()
            value = self.stems[stem] = pack([t.id for t in self.model(small.translate(self.letters))])
        if mark:
            end = self.marks.get(mark)
            if end is None:
                ids = [t.id for t in self.model(mark)]
                ids[-1] |= END * bool(STOPS & set(mark))
                end = pack(ids)
                if len(self.marks) < 10_000:
                    self.marks[mark] = end
            value += end
        return value


def pack(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class Encoder:
    """Token ids of whole texts.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its space-separated words, one after another.
    """

    def __init__(self, path: str):
        self.words = Words(path)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids with marks where sentences and lines end; each text gets the closing token."""
        get, close, out = self.words.__getitem__, CLOSE.to_bytes(4, "little"), []
        for text in texts:
            lines = [b"".join(map(get, line.split())) for line in text.split(b"\n")]
            ids = np.frombuffer(b"".join([*lines, close]), dtype="<u4")
            if len(lines) > 1:
                ends = np.cumsum([len(x) for x in lines if x]) // 4 - 1
                ids = ids.copy()
                ids[ends.astype(np.int64)] |= np.uint32(END)
            out.append(ids)
        return out


def cut_points(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a document may be cut, and their penalties."""
    n = len(marked)
    ends = np.nonzero(marked & np.uint32(END))[0] + 1
    at = np.append(ends[ends < n], n)
    cost = np.append(np.full(len(at) - 1, SENTENCE), 0)
    gaps = np.diff(at, prepend=0)
    long = gaps > LENGTH
    if long.any():
        hard = np.concatenate([np.arange(b - g + HARD_EVERY, b, HARD_EVERY) for b, g in zip(at[long], gaps[long], strict=True)])
        at = np.concatenate([at, hard])
        cost = np.concatenate([cost, np.full(len(hard), HARD)])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


class Cuts:
    """The dynamic program over the cuts of a stream that goes on.

    Cuts before ``first`` are settled; cut ``first`` is the root of all paths.
    """

    def __init__(self, length: int = LENGTH, powers: tuple[int, ...] = POWERS):
        self.length, self.powers = length, powers
        self._root(0, 0)

    def _root(self, number: int, position: int) -> None:
        self.first, self.at, self.cost, self.before, self.best = number, [position], [0], [number], [0]
        self.number = {position: number}
        self.queue = deque([(position, number, position)])  # (f + b, number, position), the first rising

    def extend(self, at: list[int], cost: list[int]) -> None:
        """Gaps between cuts are at most ``length``."""
        queue, before, best, length, powers = self.queue, self.before, self.best, self.length, self.powers
        popleft, pop, append, number_of, first = queue.popleft, queue.pop, queue.append, self.number.get, self.first
        number = first + len(self.at)
        self.at += at
        self.cost += cost
        for b, c in zip(at, cost, strict=True):
            low = b - length
            while queue[0][2] < low:
                popleft()
            key, i, _ = queue[0]
            f = key + length - b
            for power in powers:
                other = number_of(b - power)
                if other is not None and best[other - first] + SHORT < f:
                    i, f = other, best[other - first] + SHORT
            f += c
            before.append(i)
            best.append(f)
            self.number[b] = number
            key = f + b
            while queue and queue[-1][0] >= key:
                pop()
            append((key, number, b))
            number += 1

    def common(self) -> int:
        """The last cut that the best paths of all cuts within reach have in common."""
        reach = bisect_left(self.at, self.at[-1] - max(self.powers, default=0))
        live = {number for _, number, _ in self.queue}.union(range(self.first + reach, self.first + len(self.at)))
        heap = [-number for number in live]
        heapify(heap)
        while len(heap) > 1:
            number = -heap[0]
            live.discard(number)
            parent = self.before[number - self.first]
            if parent in live:
                heappop(heap)
            else:
                live.add(parent)
                heapreplace(heap, -parent)
        return -heap[0]

    def path(self, last: int) -> list[int]:
        """Positions of the cuts on the best path to ``last`` from the root."""
        out = []
        while last > self.first:
            out.append(self.at[last - self.first])
            last = self.before[last - self.first]
        return out[::-1]

    def settle(self, force: bool = False) -> list[int]:
        """Positions of the cuts that nothing can change any more."""
        root = self.common()
        if force and root == self.first:
            cheapest = min(range(bisect_left(self.at, self.at[-1] - self.length), len(self.at)), key=self.best.__getitem__)
            root = self.before[cheapest]
            cuts, skip = self.path(root), root - self.first
            tail = self.at[skip + 1 :], self.cost[skip + 1 :]
            self._root(root, self.at[skip])
            self.extend(*tail)
            return cuts
        cuts, skip = self.path(root), root - self.first
        for position in self.at[:skip]:
            del self.number[position]
        self.first, self.at, self.cost = root, self.at[skip:], self.cost[skip:]
        self.before, self.best = self.before[skip:], self.best[skip:]
        return cuts

    def rest(self) -> list[int]:
        """Positions of all cuts to the end of the stream, and the last window."""
        cuts = self.path(self.first + len(self.at) - 1)
        # windows at the end are too short to be worth a queue
        start = next((c for c in reversed(cuts) if c <= self.at[-1] - self.length), self.at[0])
        after = [b - start for b in self.at if b > start]
        return [c for c in cuts if c <= start] + [start + x for x in closing(after, self.length)]


def closing(ends: list[int], length: int = LENGTH) -> list[int]:
    """Cuts of the last windows, which may have any power of two as their length."""
    best = {0: (0, 0)}
    for b in ends:
        best[b] = min(
            (f + (SHORT * (b - a < length) if b - a & (b - a - 1) == 0 else length - (b - a)) + SENTENCE * bool(a), a)
            for a, (f, _) in best.items()
            if b - a <= length
        )
    cuts, b = [], ends[-1]
    while b:
        cuts.append(b)
        b = best[b][1]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; pieces come out as columns."""

    def __init__(self, first_sequence: int, length: int = LENGTH, segment: int = SEGMENT, pending: int = PENDING):
        self.sequence, self.segment, self.pending = first_sequence, segment, pending
        self.docs: deque = deque()  # (doc_id, ids, tokens before the stream's start)
        self.cuts = Cuts(length)
        self.size = self.done = 0
        self.next = segment
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, marked: np.ndarray) -> None:
        at, cost = cut_points(marked)
        self.docs.append((doc_id, marked & np.uint32(END - 1), 0))
        self.cuts.extend((at + self.size).tolist(), cost.tolist())
        self.size += len(marked)
        if self.size >= self.next:
            self._write(self.cuts.settle(self.size - self.done > self.pending))
            self.next = self.size + self.segment

    def finish(self) -> None:
        if self.size > self.done:
            self._write(self.cuts.rest())

    def _write(self, cuts: list[int]) -> None:
        for cut in cuts:
            self._emit(cut - self.done)
            self.done = cut

    def _emit(self, tokens: int) -> None:
        offset = 0
        while offset < tokens:
            doc_id, ids, start = self.docs[0]
            take = min(tokens - offset, len(ids) - start)
            part = ids[start : start + take]
            self.rows.append((doc_id, start, take, zlib.crc32(part.tobytes()), len(ids), self.sequence, offset))
            offset += take
            if start + take == len(ids):
                self.docs.popleft()
            else:
                self.docs[0] = (doc_id, ids, start + take)
        self.sequence += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(SCHEMA)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SCHEMA)


_ENCODERS: dict[str, Encoder] = {}  # a Python worker serves many tasks


def encoder(path_: str) -> Encoder:
    if path_ not in _ENCODERS:
        _ENCODERS[path_] = Encoder(path_)
    return _ENCODERS[path_]


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents (columns in ``PIECES``)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId() << 33, length)
        for batch in slices(batches, "text", 1 << 20):
            ids = batch.column("doc_id").to_pylist()
            for doc_id, marked in zip(ids, tokens.encode(as_bytes(batch.column("text"))), strict=True):
                packer.add(doc_id, marked)
            if len(packer.rows) > 5000:
                yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
