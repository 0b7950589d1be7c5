"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

Texts of up to `LONG` bytes are encoded in their task, each distinct word once. A longer text is cut into stretches at
white space; a run without white space that is longer than a stretch is normalised, split as the tokenizer splits, and
what is then still long, the unsplit text, is cut into leaves anywhere. Stretches and leaves are dealt over all tasks and
encoded in parallel. Leaves are joined in a tree, `FANIN` neighbours by each level: at a join a window of the last
tokens of the left side and the first ones of the right side is encoded anew and grows on either side until its first
token is the left side's and its last token is the right side's there. Then all neighbouring tokens are pairs of a true
encoding, so that no merge crosses them and the whole is exactly the encoding of the whole text. Finally the parts of each
text are read in order and hashed as they come.

Decoding joins the tokens' strings as the tokenizer does, which has no decoder: with one blank between.

Defined cases: null and empty texts have no tokens; a repeated row or id is a row of its own; an empty table gives no
rows; a text may be of any length, its parts are never held together by one task; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import common, packing

#: Bytes of a text beyond which it is dealt over several tasks.
LONG = 1 << 16
#: Bytes of a stretch, and characters of a leaf of unsplit text.
LEAF = 1 << 14
#: Neighbouring leaves that one task joins by each level.
FANIN = 16
#: Tokens of each side in the first window of a join.
WINDOW = 4

DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
# A part of a long text: its row, its number in it, its leaf, how it is to be encoded, and its text or its ids.
_PARTS = "row bigint, doc_id bigint, number bigint, leaf bigint, kind int, data binary"
STRETCH, PIECES, SPECIAL, INNER, LAST = range(5)
_SPACE = re.compile(rb"[ \t-\r]")


class Codec:
    """The tokenizer of a file, and the same merges without what precedes them: with and without the mark of a word's end."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.words = packing.WordTokenizer(path)
        self.whole = self.words.tokenizer
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.mark = config["model"]["end_of_word_suffix"] or ""
        plain = config | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None}
        self.last = Tokenizer.from_str(json.dumps(plain))
        self.inner = Tokenizer.from_str(json.dumps(plain | {"model": config["model"] | {"end_of_word_suffix": None}}))
        size = max([*config["model"]["vocab"].values(), *self.special.values()]) + 1
        strings = [(self.whole.id_to_token(i) or "") for i in range(size)]
        self.strings = strings
        raw = [s.encode() + b" " for s in strings]
        self.size = np.array(list(map(len, raw)), dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.one_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def decoded(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, a blank after each."""
        size = self.size[ids]
        shift = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[ids] - shift, size) + np.arange(int(size.sum()))].tobytes()

    def pieces(self, run: str) -> Iterator[tuple[str, bool]]:
        """What the tokenizer makes of a run before merging: its pieces in order, and whether each is a special token."""
        at = 0
        for m in self.one_special.finditer(run) if self.one_special else ():
            yield from self._plain(run[at : m.start()])
            yield m[0], True
            at = m.end()
        yield from self._plain(run[at:])

    def _plain(self, text: str) -> Iterator[tuple[str, bool]]:
        if text:
            for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text)):
                yield piece, False

    def encode(self, kind: int, data: bytes) -> np.ndarray:
        if kind == STRETCH:
            return self.words.encode(data)
        text = data.decode()
        if kind == SPECIAL:
            return np.array([self.special[text]], dtype=np.uint32)
        if kind == PIECES:
            return np.array([i for e in self.last.encode_batch_fast(text.split(" "), add_special_tokens=False) for i in e.ids], dtype=np.uint32)
        return np.array((self.last if kind == LAST else self.inner).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _window(self, ids: np.ndarray, last: bool) -> np.ndarray:
        text = "".join(self.strings[i] for i in ids.tolist())
        return self.encode(LAST, text.removesuffix(self.mark).encode()) if last else self.encode(INNER, text.encode())

    def joined(self, left: np.ndarray, right: np.ndarray, last: bool, width: int = WINDOW) -> np.ndarray:
        """The tokens of two neighbouring texts as one; `last`: the right one ends its word."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        i = j = width
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            made = self._window(np.concatenate([left[len(left) - i :], right[:j]]), last and j == len(right))
            same_left = i == len(left) or made[0] == left[len(left) - i]
            same_right = j == len(right) or made[-1] == right[j - 1]
            if same_left and same_right:
                return np.concatenate([left[: len(left) - i], made, right[j:]])
            i, j = i if same_left else 2 * i, j if same_right else 2 * j

    def tree(self, leaves: list[np.ndarray], last: bool) -> np.ndarray:
        """All leaves as one, halves first."""
        if len(leaves) == 1:
            return leaves[0]
        mid = len(leaves) // 2
        return self.joined(self.tree(leaves[:mid], False), self.tree(leaves[mid:], last), last)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for all tasks of a Python worker."""
    return Codec(path)


class _Digest:
    """Hashes of the ids and of the decoded text, part by part."""

    def __init__(self, using: Codec) -> None:
        self.codec, self.n, self.held = using, 0, b""
        self.ids, self.text = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        self.n += len(ids)
        self.ids.update(ids.astype("<u4", copy=False).tobytes())
        for at in range(0, len(ids), common.CHUNK_BYTES):
            text = self.codec.decoded(ids[at : at + common.CHUNK_BYTES])
            self.text.update(self.held)
            self.text.update(memoryview(text)[:-1])
            self.held = b" "

    def row(self, doc_id: int | None) -> tuple:
        return doc_id, self.n, self.ids.hexdigest(), self.text.hexdigest()


_NAMES = [c.split()[0] for c in DIGESTS.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def short_digests(docs: DataFrame, path: str) -> DataFrame:
    """Digests of texts that are encoded in one piece each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = codec(path)
        for batch in batches:
            data, offs, _ = common.text_buffers(batch.column(1))
            doc_ids, out = batch.column(0).to_pylist(), []
            for i, j in common.row_chunks(offs):
                for doc_id, ids in zip(doc_ids[i:j], using.words.encode_rows(data, offs[i : j + 1]), strict=True):
                    digest = _Digest(using)
                    digest.add(ids)
                    out.append(digest.row(doc_id))
            if out:
                yield _rows(out)

    return docs.mapInArrow(common.released(run), DIGESTS)


def cut(text: bytes, using: Codec, leaf: int = LEAF) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, leaf, kind, data) of a long text; leaves of one number are one piece of unsplit text."""
    number, at = 0, 0
    while at < len(text):
        space = _SPACE.search(text, min(len(text), at + leaf))
        end = space.start() if space else len(text)
        if end - at <= 2 * leaf:
            yield number, 0, STRETCH, text[at:end]
            number, at = number + 1, end
            continue
        # the last white space of the stretch parts ordinary words from the run that is too long
        gaps = [m.end() for m in _SPACE.finditer(text, at, at + leaf)]
        if gaps:
            yield number, 0, STRETCH, text[at : gaps[-1]]
            number, at = number + 1, gaps[-1]
        short: list[str] = []
        size = 0
        for piece, special in using.pieces(text[at:end].decode()):
            alone = special or len(piece) > 2 * leaf
            if short and (alone or size + len(piece) > leaf):
                yield number, 0, PIECES, " ".join(short).encode()
                number, short, size = number + 1, [], 0
            if special:
                yield number, 0, SPECIAL, piece.encode()
            elif alone:
                for k, begin in enumerate(range(0, len(piece), leaf)):
                    yield number, k, LAST if begin + leaf >= len(piece) else INNER, piece[begin : begin + leaf].encode()
            else:
                short.append(piece)
                size += len(piece)
                continue
            number += 1
        if short:
            yield number, 0, PIECES, " ".join(short).encode()
            number += 1
        at = end


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PARTS.split(", ")])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c[at].as_py() for c in batch.columns)


def _cut_rows(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = codec(path)
        for batch in batches:
            for at in range(batch.num_rows):
                row, doc_id = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                held: list[tuple] = []
                size = 0
                for part in cut(batch.column(2)[at].as_buffer().to_pybytes(), using, leaf):
                    held.append((row, doc_id, *part))
                    size += len(part[3])
                    if size > common.CHUNK_BYTES:
                        yield _part_batch(held)
                        held, size = [], 0
                if held:
                    yield _part_batch(held)

    return common.released(run)


def _encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = codec(path)
        for batch in batches:
            rows = [(row, doc_id, number, leaf, kind, using.encode(kind, data).astype("<u4", copy=False).tobytes()) for row, doc_id, number, leaf, kind, data in _parts([batch])]
            if rows:
                yield _part_batch(rows)

    return common.released(run)


def _join_leaves(path: str, fanin: int):
    """Neighbouring leaves, in order, become one leaf of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = codec(path)
        key, held, kind = None, [], INNER

        def done() -> pa.RecordBatch:
            whole = using.tree(held, kind == LAST)
            return _part_batch([(*key, kind, whole.astype("<u4", copy=False).tobytes())])

        for row, doc_id, number, leaf, k, data in _parts(batches):
            now = (row, doc_id, number, leaf // fanin)
            if key is not None and now != key:
                yield done()
                held = []
            key, kind = now, k
            held.append(np.frombuffer(data, dtype="<u4"))
        if held:
            yield done()

    return common.released(run)


def _digest_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = codec(path)
        now, doc, digest = None, None, None
        for row, doc_id, _, _, _, data in _parts(batches):
            if row != now:
                if digest is not None:
                    yield _rows([digest.row(doc)])
                now, doc, digest = row, doc_id, _Digest(using)
            digest.add(np.frombuffer(data, dtype="<u4"))
        if digest is not None:
            yield _rows([digest.row(doc)])

    return common.released(run)


def long_digests(docs: DataFrame, path: str, leaf: int = LEAF, fanin: int = FANIN) -> DataFrame:
    """Digests of texts whose parts are encoded by many tasks and joined in a tree."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = rows.mapInArrow(_cut_rows(path, leaf), _PARTS).repartition("row", "number", "leaf")
    parts = common.stored(parts.mapInArrow(_encode_parts(path), _PARTS), "bpe-parts")
    unsplit = parts.filter(F.col("kind").isin(INNER, LAST))
    leaves = (unsplit.agg(F.max("leaf")).first()[0] or 0) + 1
    while leaves > 1:
        dealt = unsplit.repartition("row", "number", F.floor(F.col("leaf") / fanin)).sortWithinPartitions("row", "number", "leaf")
        unsplit = common.stored(dealt.mapInArrow(_join_leaves(path, fanin), _PARTS), "bpe-leaves")
        leaves = -(-leaves // fanin)
    whole = parts.filter(~F.col("kind").isin(INNER, LAST)).unionByName(unsplit)
    return whole.repartition(common.partitions(spark), "row").sortWithinPartitions("row", "number").mapInArrow(_digest_parts(path), DIGESTS)


def token_digests(docs: DataFrame, path: str, long: int = LONG, leaf: int = LEAF, fanin: int = FANIN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of `docs` (doc_id, text)."""
    rows = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    return short_digests(rows.filter(~is_long), path).unionByName(long_digests(rows.filter(is_long), path, leaf, fanin))
