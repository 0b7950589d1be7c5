"""Vector code compression: integer codebooks for each part of a vector, fitted over all rows, and the codes of all rows.

Vectors become whole numbers and are cut into parts. Each part has a codebook of at most `ENTRIES` entries, which starts
with the smallest ids. A round sends the codebooks to all tasks; Arrow batches get every distance by norm expansion
(x.x - 2 x.c + c.c) from exact matrix products of whole numbers and take the first nearest entry; each task adds up the
rows of its entries, and one grouped shuffle merges these sums by entry and position. What comes to the driver is a
codebook, whose size doesn't depend on the number of rows. Products are 64-bit where the largest component allows it and
Python's whole numbers beyond.

Defined cases: a vector that is null or holds a null or non-finite component is dropped; vectors of different lengths
have codebooks of their own (all of them together are bounded by `MOST_BYTES`); lengths that don't divide evenly are cut
as evenly as possible; an empty vector has code 0 and error 0; a null id is no start of a codebook before all others;
rows of equal id are told apart by their components; repeated rows count as rows of their own; an error beyond a long
stays at the largest long; components of 2**62 or more after scaling raise OverflowError; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import common

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Codebooks of all lengths together; more raise ValueError, as they are sent to every task.
MOST_BYTES = 256 << 20
#: Distances held at once by a task.
CELLS = 1 << 20
_LONGEST = (1 << 63) - 1

#: For each length of a vector, the entries (entry x component of the part) of each part.
Codebooks = dict[int, list[np.ndarray]]


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the vectors that take part, in doubles."""
    rows = common.pick(vectors, "vec_id", "label", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & ~bad)


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) exactly: 64-bit, or Python's whole numbers where doubles have no fractions any more."""
    scaled = np.floor(values * float(scale)) if scale & (scale - 1) == 0 else None
    if scaled is not None and (not scaled.size or np.abs(scaled).max() < 2.0**53):
        return scaled.astype(np.int64)
    exact = [(n := x.as_integer_ratio())[0] * scale // n[1] for x in values.ravel().tolist()]
    if max(map(abs, exact)) >= 1 << 62:
        raise OverflowError("a component of 2**62 or more after scaling")
    return np.array(exact, dtype=object).reshape(values.shape)


def cuts(width: int, parts: int = PARTS) -> list[int]:
    return [i * width // parts for i in range(parts + 1)]


def _safe(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are where no distance leaves 64 bits, else as Python's whole numbers."""
    if rows.dtype != object and entries.dtype != object:
        most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
        if 4 * rows.shape[1] * most * most < 1 << 62:
            return rows, entries
    return rows.astype(object), entries.astype(object)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance."""
    index, least = [], []
    rows, entries = _safe(rows, entries)
    norms = (entries * entries).sum(axis=1)
    for at in range(0, len(rows), each := max(1, CELLS // max(1, len(entries)))):
        x = rows[at : at + each]
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + norms
        index.append(np.argmin(far, axis=1))
        least.append(far[np.arange(len(x)), index[-1]])
    return np.concatenate(index), np.concatenate(least)


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
    """Width, ids, labels and whole numbers of the rows of each batch, by width."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        widths = np.diff(np.asarray(vectors.offsets))
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            rows = vectors.take(pa.array(at))
            yield width, ids.take(pa.array(at)), labels.take(pa.array(at)), whole_numbers(np.asarray(rows.flatten(), dtype=np.float64).reshape(len(at), width))


def starts(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, scale: int = SCALE) -> Codebooks:
    """The codebooks of the rows with the smallest ids of each length."""
    widths = [r[0] for r in rows.select(F.size("embedding").alias("w")).groupBy("w").count().orderBy("w").limit(MOST_BYTES // (8 * entries) + 1).collect()]
    if 8 * entries * sum(w + 1 for w in widths) > MOST_BYTES:
        raise ValueError(f"codebooks of {len(widths)} lengths exceed {MOST_BYTES} bytes")
    out = {}
    for w in widths:
        first = rows.filter(F.size("embedding") == w).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
        whole = whole_numbers(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), w), scale)
        out[w] = [whole[:, a:b] for a, b in zip(cuts(w, parts)[:-1], cuts(w, parts)[1:], strict=True)]
    return out


_SUMS = "width int, part int, entry int, pos int, total decimal(38,0), n bigint"


def _summed(books: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for width, _, _, rows in _by_width(batches):
            for part, entries in enumerate(books.value[width]):
                piece = rows[:, cuts(width, len(books.value[width]))[part] :][:, : entries.shape[1]]
                index, _ = nearest(piece, entries)
                total, n = sums.setdefault((width, part), (np.zeros(entries.shape, dtype=object), np.zeros(len(entries), dtype=np.int64)))
                added = np.zeros(entries.shape, dtype=object if piece.dtype == object or np.abs(piece).max(initial=0) > 1 << 40 else np.int64)
                np.add.at(added, index, piece)
                total += added.astype(object)
                n += np.bincount(index, minlength=len(entries))
        for (width, part), (total, n) in sums.items():
            used = np.flatnonzero(n)
            w = total.shape[1]
            if not w:
                continue
            columns = [np.full(len(used) * w, width), np.full(len(used) * w, part), np.repeat(used, w), np.tile(np.arange(w), len(used))]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns], pa.array(total[used].ravel().tolist(), pa.decimal128(38, 0)), pa.array(np.repeat(n[used], w), pa.int64())], names=["width", "part", "entry", "pos", "total", "n"])

    return run


def fitted(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """The codebooks after all rounds; an entry that no row is nearest to stays."""
    context = rows.sparkSession.sparkContext
    books = starts(rows, entries, parts, scale)
    for _ in range(rounds):
        sent = context.broadcast(books)
        merged = rows.mapInArrow(_summed(sent), _SUMS).groupBy("width", "part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        fresh = {w: [b.astype(object) for b in held] for w, held in books.items()}
        for r in merged.collect():  # at most `entries` times the length
            fresh[r["width"]][r["part"]][r["entry"], r["pos"]] = int(r["total"]) // r["n"]
        books = {w: [b.astype(np.int64) for b in held] for w, held in fresh.items()}
        sent.unpersist()
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of each row."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    digests = {w: codebooks_digest(b) for w, b in books.items()}
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, ids, labels, whole in _by_width(batches):
            held, at = sent.value[width], cuts(width, len(sent.value[width]))
            error, code = np.zeros(len(whole), dtype=object), np.full(len(whole), "", dtype=object)
            for part, entries in enumerate(held):
                index, far = nearest(whole[:, at[part] : at[part + 1]], entries)
                error += far.astype(object)
                code += hexes[index].astype(object)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code.tolist(), pa.string()), pa.array([min(e, _LONGEST) for e in error.tolist()], pa.int64()), pa.array([digests[width]] * len(whole), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint, codebooks_sha256 string")


def compress(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of `vectors` (vec_id, label, embedding).

    The coded rows are written before they are added up by label, so that they are made once and a table of few labels
    is broadcast by its written size.
    """
    if not 0 < entries <= ENTRIES:
        raise ValueError("a code has two hexadecimal digits for each part")
    rows = kept(vectors).withColumn("vec_id", F.col("vec_id").cast("long"))
    coded = common.stored(encoded(rows, fitted(rows, entries, parts, rounds, scale)), "codes")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = common.stored(sums, "label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["__label"])).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
