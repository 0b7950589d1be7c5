"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Candidates form blocks of at most `BLOCK` vectors. A block's index holds posting segments: for each dimension and each
of at most `LEVELS` quantised values the vectors that have it. What quantising drops is bounded by the step. The impact
of a segment on a query is the query's weight times the quantised value, counted from the least impact of its dimension,
so that accumulators only grow. The queries of a block are searched together: segments are processed by descending
impact (the greatest on any of the queries) into one accumulator per vector and query. After each of `ROUNDS` groups of
segments a query's k-th best lower bound is compared with every vector's upper bound (what it has, what the segments
left can add, what quantising dropped). A query stops only when at most `ENOUGH` vectors are still possible, or at the
end. All possible members are then rescored exactly on whole vectors.

Candidate blocks form groups of at most `GROUP` blocks. A group stays in its task: each of its blocks is shuffled once,
and the query blocks, a small share of the rows, travel to every group. A task merges what its blocks return to the k
best of each query, and a window keeps the k best of all groups.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no part; vectors of different
lengths never meet; ties go to the smaller id; rows with the query's own id are no candidates; repeated rows of another
id count as rows of their own; fewer candidates than k give all; an empty table gives no rows; other columns are ignored.
Components of any finite size take part: scores are exact whole numbers, and beyond 2**63 - 1 in size they stay there;
a component beyond 2**61 after scaling counts as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import common

BLOCK = 4096
QUERIES = 256
LEVELS = 128
ROUNDS = 4
ENOUGH = 200
#: Impacts (of a segment on a query) held at once, in two arrays of 8 bytes each.
CELLS = 1 << 22
#: Candidate blocks that one task holds, and bytes of their components.
GROUP = 16
GROUP_BYTES = 64 << 20
MOST = 1 << 61
_LONG = (1 << 63) - 1

_BLOCKS = "block bigint, width int, ids array<bigint>, cells array<bigint>"
_HITS = "query_id bigint, vec_id bigint, score bigint"


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale)))))


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def row(width: int) -> pa.RecordBatch:
            nonlocal number
            ids, cells = held.pop(width)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(cells)], pa.list_(pa.int64()))], names=["block", "width", "ids", "cells"])

        for batch in batches:
            for vec_id, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.asarray(cells.values, dtype=np.int64)
                ids, rows = held.setdefault(len(values), ([], []))
                ids.append(vec_id)
                rows.append(values)
                if len(ids) == size:
                    yield row(len(values))
        for width in sorted(held):
            yield row(width)

    return run


class Index:
    """Posting segments of one block, by dimension and quantised value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        low = self.vectors.min(axis=0)
        self.step = max(1, -(-(int((self.vectors - low).max()) + 1) // LEVELS))
        levels = ((self.vectors - low) // self.step).T  # dimension x vector
        self.postings = np.argsort(levels, axis=1, kind="stable")
        held = np.take_along_axis(levels, self.postings, axis=1)
        starts = np.concatenate([np.ones((len(held), 1), dtype=bool), held[:, 1:] != held[:, :-1]], axis=1)
        self.dimension, self.start = np.nonzero(starts)  # one for each segment, by dimension and ascending value
        self.value = held[self.dimension, self.start] * self.step
        self.first = np.flatnonzero(np.concatenate([[True], self.dimension[1:] != self.dimension[:-1]]))
        # what quantising dropped, from the middle of its range: 0 where each value has a level of its own
        self.dropped = np.sqrt(((((self.vectors - low) % self.step) - (self.step - 1) / 2) ** 2).sum(axis=1))
        last = np.append(self.dimension[1:] != self.dimension[:-1], True)
        self.stop = np.where(last, len(ids), np.append(self.start[1:], 0))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and exact scores of the k best (all, if fewer), ties to smaller ids."""
        q = queries.astype(np.float64)
        impact = q.T[self.dimension] * self.value[:, None]  # segment x query
        impact -= np.minimum.reduceat(impact, self.first, axis=0)[np.searchsorted(self.first, np.arange(len(impact)), side="right") - 1]
        length = np.sqrt((q**2).sum(axis=1))
        order = np.argsort(-impact.max(axis=1), kind="stable")
        score = np.zeros((len(self.ids), len(q)))
        for j, own in enumerate(query_ids.tolist()):
            score[self.ids == own, j] = -np.inf
        left = impact.copy()
        # roundings of all additions to a score
        least = np.maximum.reduceat(np.abs(impact), self.first, axis=0).sum(axis=0) * (len(self.first) + 8) * 2.0**-51 + 1e-6
        open_ = np.arange(len(q))
        out: list[tuple[np.ndarray, np.ndarray]] = [(self.ids[:0], self.ids[:0])] * len(q)
        for part in np.array_split(order, min(ROUNDS, len(order))):
            for s in part.tolist():
                score[self.postings[self.dimension[s], self.start[s] : self.stop[s]]] += impact[s]
            left[part] = 0
            rest = np.maximum.reduceat(left, self.first, axis=0).sum(axis=0)
            final = part[-1] == order[-1]
            slack = np.outer(self.dropped, length) * (1 + 1e-9) + least  # no dropped part weighs more, nor do roundings
            kth = np.partition(score - slack, len(score) - k, axis=0)[len(score) - k] if len(score) > k else np.full(len(open_), -np.inf)
            possible = (score + slack + rest >= kth) & (score > -np.inf)
            done = possible.sum(axis=0) <= ENOUGH
            for j in np.flatnonzero(done | final).tolist():
                out[open_[j]] = self._exact(np.flatnonzero(possible[:, j]), queries[open_[j]], k)
            if final or done.all():
                break
            if done.any():
                score, impact, left, length, least, open_ = score[:, ~done], impact[:, ~done], left[:, ~done], length[~done], least[~done], open_[~done]
        return out

    def _exact(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        held, query = self.vectors[rows], query.astype(np.int64)
        if not len(rows) or int(np.abs(held).max()) * int(np.abs(query).max()) * len(query) < _LONG:
            exact = held @ query
        else:  # beyond 64 bits
            exact = np.array([max(-_LONG, min(_LONG, x)) for x in (held.astype(object) @ query.astype(object)).tolist()], dtype=np.int64)
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][best], exact[best]


def merged(found: list[list[tuple[np.ndarray, np.ndarray]]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best of what several blocks return."""
    out = []
    for parts in zip(*found, strict=True):
        ids, scores = (np.concatenate(c) for c in zip(*parts, strict=True))
        best = np.lexsort((ids, -scores))[:k]
        out.append((ids[best], scores[best]))
    return out


_DEALT = "grp int, kind int, width int, ids array<bigint>, cells array<bigint>"


def _searched(k: int):
    """The rows of a group come with its candidate blocks first, then all query blocks of its width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                group, kind, width = (batch.column(c)[r].as_py() for c in range(3))
                ids, cells = (np.array(batch.column(c)[r].values) for c in (3, 4))
                if group != now:
                    now, held = group, []
                if kind == 0:
                    held.append(Index(ids, cells.reshape(-1, width)))
                    continue
                queries = cells.reshape(-1, width)
                for i in range(0, len(ids), each := max(1, CELLS // max(len(x.start) for x in held))):
                    out = merged([index.search(ids[i : i + each], queries[i : i + each], k) for index in held], k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + each], [len(x) for x, _ in out])), pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([s for _, s in out]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row that `is_query` picks."""
    rows = common.pick(vectors, "vec_id", "embedding").filter("vec_id is not null")
    rows = rows.withColumn("cells", whole_numbers(F.col("embedding"), scale)).filter("cells is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "cells")
    candidates = common.stored(rows.mapInArrow(_blocks(BLOCK), _BLOCKS), "blocks")
    queries = common.stored(rows.filter(is_query).mapInArrow(_blocks(QUERIES), _BLOCKS), "queries")
    spark = vectors.sparkSession
    number = F.row_number().over(Window.orderBy("width", "block"))  # of blocks, by their names alone
    names = candidates.select("block", "width").withColumn("number", number)
    shape = names.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
    # as many groups as tasks can run at once, at the least; as large as fits
    fits = max(1, GROUP_BYTES // (8 * BLOCK * (shape["width"] or 1)))
    size = max(1, min(GROUP, fits, -(-shape["n"] // (4 * spark.sparkContext.defaultParallelism))))
    within = F.floor((F.row_number().over(Window.partitionBy("width").orderBy("number")) - 1) / size)
    groups = names.withColumn("grp", (F.dense_rank().over(Window.orderBy("width", within)) - 1).cast("int")).select("block", "width", "grp")
    groups = common.stored(groups, "groups")
    placed = candidates.join(groups, ["block", "width"]).select("grp", F.lit(0).alias("kind"), "width", "ids", "cells")
    asked = queries.join(groups.select("width", "grp").distinct(), "width").select("grp", F.lit(1).alias("kind"), "width", "ids", "cells")
    last = groups.agg(F.max("grp")).first()[0]
    dealt = placed.unionByName(asked).repartitionById((last or 0) + 1, "grp").sortWithinPartitions("grp", "kind")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return dealt.mapInArrow(_searched(k), _HITS).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
