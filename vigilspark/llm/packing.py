"""Packing documents into training windows by minimum bin slack.

Each task tokenises its documents, cuts the part beyond whole windows off as full windows, and keeps the remainders as
pending lengths. A window is filled from the pending lengths by a subset-sum dynamic programme over bits: bit s of the
set says that some multiset of pending lengths sums to s. The reachable sum closest to the capacity wins, and walking
the recorded sets backwards gives how many pieces of each length it takes. Slack that is left is closed by cutting one
more document. Memory is bounded by `lookahead` windows of pending tokens and the longest document.

Defined cases: a null or empty text is the closing id alone; equal rows are packed as rows of their own; an empty table
gives no pieces; other columns are ignored. The last window of a task holds fewer ids than the capacity: with
`tail="powers"` it is dealt into sequences whose lengths are powers of two, which need no padding; `tail="pad"` keeps it
whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import common

CAPACITY = 4096
END_ID = 2
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Words kept per task between batches; beyond it the table starts anew.
CACHE_WORDS = 1 << 20
#: Special tokens start so. They are matched before lower-casing, so a batch that holds one keeps its case.
SPECIAL = b"<|"


class WordTokenizer:
    """Ids of whole texts from ids of their white-space words.

    The tokenizer drops white space, its pieces never cross it, and it lower-cases letters, so the ids of a text are
    those of its words in turn and each distinct word is encoded once. Known words sit in an open-addressing table of
    numpy arrays, keyed by a 64-bit hash and checked by length, so that a batch is looked up in a few array passes.
    """

    def __init__(self, path: str, capacity: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        self.mask = np.int64((1 << (2 * capacity - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        n = int(self.mask) + 1
        self.keys = np.zeros(n, dtype=np.uint64)
        self.size = np.zeros(n, dtype=np.int32)  # bytes of the word; 0: free
        self.start = np.zeros(n, dtype=np.int32)
        self.count = np.zeros(n, dtype=np.int32)
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.used = self.known = 0

    def _find(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word, and which of them are free (unknown words)."""
        slots = (hashes >> np.uint64(20)).astype(np.int64) & self.mask
        todo = np.arange(len(slots))
        while len(todo):
            at = slots[todo]
            wrong = (self.size[at] != 0) & ((self.keys[at] != hashes[todo]) | (self.size[at] != sizes[todo]))
            todo = todo[wrong]
            slots[todo] = (slots[todo] + 1) & self.mask
        return slots, self.size[slots] == 0

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        _, first = np.unique(hashes, return_index=True)
        words = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(counts.sum()))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(flat), len(self.flat)), dtype=np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        begins = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.known += len(ids)
        keys, sizes = hashes[first], (ends[first] - starts[first]).astype(np.int32)
        slots = (keys >> np.uint64(20)).astype(np.int64) & self.mask
        todo = np.arange(len(keys))
        while len(todo):  # of several words at one free slot one gets it, the others step on
            at = slots[todo]
            empty = todo[self.size[at] == 0]
            self.start[slots[empty]] = empty
            won = empty[self.start[slots[empty]] == empty]
            self.keys[slots[won]], self.size[slots[won]], self.count[slots[won]] = keys[won], sizes[won], counts[won]
            lost = np.ones(len(keys), dtype=bool)
            lost[won] = False
            self.start[slots[won]] = begins[won]
            todo = todo[lost[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask

    def encode_rows(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        if SPECIAL not in data[int(offs[0]) : int(offs[-1])].tobytes():
            data, offs = common.lower_ascii(data[int(offs[0]) : int(offs[-1])]), offs - offs[0]
        starts, ends, rows = common.word_spans(data, offs)
        hashes, sizes = common.word_hashes(data, starts, ends), (ends - starts).astype(np.int32)
        slots, free = self._find(hashes, sizes)
        if free.any():
            new = np.flatnonzero(free)
            if self.known + len(new) > self.capacity and (distinct := len(np.unique(hashes[new]))) + self.known > self.capacity:
                if self.known:
                    self.clear()
                    return self.encode_rows(data, offs)
                if distinct > self.capacity:
                    return self._halves(data, offs)
            self._learn(data, starts[new], ends[new], hashes[new])
            slots, _ = self._find(hashes, sizes)
        counts = self.count[slots].astype(np.int64)
        shift = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.start[slots] - shift[:-1], counts) + np.arange(int(shift[-1]))]
        at = shift[rows]
        return [ids[at[i] : at[i + 1]] for i in range(len(rows) - 1)]

    def _halves(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        if len(offs) == 2:
            return [self.encode(data[int(offs[0]) : int(offs[1])].tobytes(), int(offs[1] - offs[0]) // 2)]
        mid = len(offs) // 2
        return self.encode_rows(data, offs[: mid + 1]) + self.encode_rows(data, offs[mid:])

    def encode(self, text: bytes, stretch: int = common.CHUNK_BYTES) -> np.ndarray:
        """The ids of one text; a long one is taken in stretches that end at white space."""
        parts, at = [np.zeros(0, dtype=np.uint32)], 0
        while at < len(text):
            to = at + stretch
            to = min((i for i in (text.find(c, to) for c in (b" ", b"\n", b"\t", b"\r")) if i >= 0), default=len(text)) if to < len(text) else len(text)
            piece = np.frombuffer(text[at:to], dtype=np.uint8)
            parts += self.encode_rows(piece, np.array([0, len(piece)], dtype=np.int64))
            at = to
        return np.concatenate(parts)


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One table for all tasks of a Python worker."""
    return WordTokenizer(path)


def closest_multiset(lengths: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The reachable sum nearest below or at `capacity`, and how many of each length make it up.

    `lengths` counts the pending pieces of each length. Counts enter as 1, 2, 4, ... copies, so a length with many
    pieces costs a logarithm of steps.
    """
    full = (1 << (capacity + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for n in sorted(lengths, reverse=True):
        left, k = min(lengths[n], capacity // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, reach))
            reach = (reach | (reach << (n * k))) & full
            left -= k
            k *= 2
        if reach >> capacity:
            break
    best = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] = taken.get(n, 0) + k
            at -= n * k
    return best, taken


class Packer:
    """Fills windows from pending pieces (document, start, ids, tokens of the document)."""

    def __init__(self, first_id: int, capacity: int, lookahead: int, tail: str) -> None:
        self.next_id, self.capacity, self.lookahead, self.tail = first_id, capacity, lookahead * capacity, tail
        self.pending: dict[int, list[tuple[int, int, np.ndarray, int]]] = {}
        self.waiting = 0
        self.rows: list[tuple[int, ...]] = []

    def _put(self, pieces: list[tuple[int, int, np.ndarray, int]]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def _hold(self, piece: tuple[int, int, np.ndarray, int]) -> None:
        self.pending.setdefault(len(piece[2]), []).append(piece)
        self.waiting += len(piece[2])

    def _take(self, n: int) -> tuple[int, int, np.ndarray, int]:
        held = self.pending[n]
        piece = held.pop()
        if not held:
            del self.pending[n]
        self.waiting -= n
        return piece

    def add(self, doc: int, ids: np.ndarray) -> None:
        c, total = self.capacity, len(ids)
        whole = total - total % c
        for at in range(0, whole, c):
            self._put([(doc, at, ids[at : at + c], total)])
        if whole < total:
            self._hold((doc, whole, ids[whole:].copy() if whole else ids, total))
        if self.waiting >= 2 * self.lookahead:
            while self.waiting >= self.lookahead:
                self.fill()

    def fill(self) -> None:
        best, taken = closest_multiset({n: len(v) for n, v in self.pending.items()}, self.capacity)
        pieces = [self._take(n) for n, k in taken.items() for _ in range(k)]
        if best < self.capacity and self.pending:
            doc, start, ids, total = self._take(max(self.pending))
            gap = self.capacity - best
            pieces.append((doc, start, ids[:gap], total))
            self._hold((doc, start + gap, ids[gap:].copy(), total))
        self._put(pieces)

    def finish(self) -> None:
        while self.waiting >= self.capacity:
            self.fill()
        left = [self._take(n) for n in sorted(self.pending, reverse=True) for _ in range(len(self.pending[n]))]
        if not left:
            return
        if self.tail == "pad":
            self._put(left)
            return
        rest = sum(len(p[2]) for p in left)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            pieces, need = [], size
            while need:
                doc, start, ids, total = left.pop(0)
                pieces.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    left.insert(0, (doc, start + need, ids[need:], total))
                need -= min(need, len(ids))
            self._put(pieces)


def _batch(rows: list[tuple[int, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, lookahead: int = 32, tail: str = "powers") -> DataFrame:
    """Packs `docs` (doc_id, text) and returns one row per piece: see PIECES.

    A sequence id is the task's partition times 2**33 plus its number there, so a rerun of a lost task gives the same
    rows.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 33, capacity, lookahead, tail)
        words = word_tokenizer(tokenizer_path)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            data, offs, _ = common.text_buffers(batch.column(1))
            docs_ = batch.column(0).to_pylist()
            for i, j in common.row_chunks(offs):
                long = offs[j] - offs[i] > common.CHUNK_BYTES
                found = [words.encode(data[offs[i] : offs[j]].tobytes())] if long else words.encode_rows(data, offs[i : j + 1])
                for doc, ids in zip(docs_[i:j], found, strict=True):
                    packer.add(doc, np.concatenate([ids, end]).astype("<u4", copy=False))
                if len(packer.rows) >= 20_000:
                    yield _batch(packer.rows, names)
                    packer.rows = []
        packer.finish()
        if packer.rows:
            yield _batch(packer.rows, names)

    return common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.released(run), PIECES)
