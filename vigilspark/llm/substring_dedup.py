"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is `WINDOW` consecutive words of one document. Its fingerprint is the smallest hash of the `GRAM`-word runs in
it, so equal windows have equal fingerprints and neighbours mostly share one. The index holds, for each fingerprint, the
first document that has it, in immutable runs in a shared folder. A run is bucketed and sorted by fingerprint, so a new
batch of documents (in doc_id order), written as a run of its own, is merge-joined with the others without a shuffle or a
sort of them. When there are more than `FANOUT` runs they are compacted into one, which later batches read instead.
Fingerprints met before are then verified: the whole windows that they stand for, in all documents that have them, are
compared by their window hash, and a word goes if such a window also starts in a document with a smaller doc_id.

An index in a folder of its own outlives the job: opened again, it takes further batches of greater ids, and each batch is
cleaned as if all documents so far had come at once. It keeps the texts and, for fingerprints that several documents have,
all of these, since a window of a later document may repeat that of any.

Window hashes travel in arrays, one row per map batch and target part; the number of parts grows with the fingerprints,
that of tasks is bounded, and a task holds one part at a time. Within a map batch only the smallest document with a window
asks for it, the others are known to repeat it.

Defined cases: a null text has no words; windows never cross documents; repeats inside one document stay; a row without
doc_id takes no part; rows that repeat a doc_id count as the same document; an empty table gives no rows; other columns
are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import common

WINDOW = 50
GRAM = 8
#: Batches that one call makes of its documents: the last of them reads a compacted run.
BATCHES = 4
FANOUT = 2
#: Fingerprints of all documents for each part of the window index; a fingerprint stands for about 21 windows.
PART_PRINTS = 100_000
#: Parts beyond this number share tasks, and runs have no more buckets.
MOST_TASKS = 8192

_U = np.uint64
_CLEAN = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[:n], h[width - done : width - done + n])


def _windows(data: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the fingerprint of the window at each word (where one fits), and the rows' offsets in words."""
    starts, ends, rows = common.word_spans(data, offs)
    words = common.word_hashes(data, starts, ends)
    return words, _lowest(common.window_hashes(words, gram), window - gram + 1), rows


def _owners(rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one row, and their rows."""
    counts = np.maximum(np.diff(rows) - window + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows[:-1][owner] + within, owner


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = common.text_buffers(batch.column(1))
            ids = np.asarray(batch.column(0))
            for i, j in common.row_chunks(offs, 4 * common.CHUNK_BYTES):
                _, prints, rows = _windows(data, offs[i : j + 1], window, gram)
                at, owner = _owners(rows, window)
                p = prints[at]
                new = np.ones(len(p), dtype=bool)
                new[1:] = (p[1:] != p[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(p[new])), pa.array(ids[i:j][owner[new]])], names=["print", "doc_id"])

    return run


_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Index:
    """Documents by fingerprint, in runs that are never changed; a manifest names those that count.

    `folder` lasts as long as its owner wants; without one the index is of use to one call. `last` is the greatest id so far.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.fanout, self.lasting = spark, fanout, folder is not None
        self.folder = (folder or f"{common.shared_dir(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
        self.version, self.buckets, self.last = 0, 0, None
        self.paths: dict[str, list[str]] = {"run": [], "member": [], "text": []}
        self.tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> Index:
        """The index that an earlier job left in the folder."""
        self = cls(spark, folder, fanout)
        rows = spark.read.schema("version int, kind string, path string, buckets int, last bigint").parquet(f"{self.folder}/manifest/*").collect()
        self.version = max(r["version"] for r in rows)
        for r in sorted((r for r in rows if r["version"] == self.version), key=lambda r: r["path"] or ""):
            self.buckets, self.last = r["buckets"], r["last"]
            if r["kind"]:
                self.paths[r["kind"]].append(r["path"])
        return self

    @property
    def runs(self) -> list[str]:
        return list(self.paths["run"])

    def save(self) -> None:
        """Makes what was added so far the state that `open` finds; until then it finds the one before."""
        self.version += 1
        rows = [(self.version, kind, path, self.buckets, self.last) for kind, paths in self.paths.items() for path in paths] or [(self.version, None, None, self.buckets, self.last)]
        self.spark.createDataFrame(rows, "version int, kind string, path string, buckets int, last bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{self.version:08d}")

    def close(self) -> None:
        """Takes the runs' names out of the catalog; files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()

    def _new(self, kind: str, number: int = 0) -> str:
        return f"{self.folder}/{kind}-{self.version:08d}-{number:04d}-{uuid.uuid4().hex}"

    def _put_run(self, rows: DataFrame) -> str:
        """Rows (print, first) as a run with one sorted file for each bucket."""
        path = self._new("run", len(self.paths["run"]))
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "print").write.bucketBy(self.buckets, "print").sortBy("print").option("path", path).saveAsTable(name)
        self.tables[path] = name
        return path

    def _run(self, path: str) -> DataFrame:
        if path not in self.tables:
            self.tables[path] = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[path]} (print BIGINT, first BIGINT) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(self.tables[path])

    def _rows(self, kind: str, schema: str) -> DataFrame:
        paths = self.paths[kind]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def members(self) -> DataFrame:
        """(print, doc_id): documents after the first one of a fingerprint."""
        return self._rows("member", "print bigint, doc_id bigint")

    def texts(self) -> DataFrame:
        return self._rows("text", "doc_id bigint, text string")

    def firsts(self, own: str) -> DataFrame:
        """(print, first) of a run's fingerprints: the first document of all runs."""
        first = self._run(own)
        for path in self.paths["run"]:
            past = self._run(path).withColumnRenamed("first", "past").hint("merge")
            first = first.join(past, "print", "left").select("print", F.least("first", F.coalesce("past", "first")).alias("first"))
        return first

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-joins a batch (print, doc_id) with the runs, adds it as a run, and returns its repeated fingerprints.

        Returned: (print, doc_id, first), one for each document of the batch with a fingerprint that an earlier
        document has.
        """
        self.buckets = self.buckets or min(common.partitions(self.spark), MOST_TASKS)
        batch = common.stored(batch.distinct(), "batch")
        own = self._put_run(batch.groupBy("print").agg(F.min("doc_id").alias("first")))
        with self._ordered():
            first = common.stored(self.firsts(own), "first")
        repeated = batch.join(first, "print").filter("first < doc_id")
        path = self._new("member", len(self.paths["member"]))
        repeated.select("print", "doc_id", "first").write.parquet(path)
        self.paths["member"].append(path)
        self.paths["run"].append(own)
        if len(self.paths["run"]) > self.fanout:
            self.compact()
        return self.spark.read.schema("print bigint, doc_id bigint, first bigint").parquet(path)

    @contextmanager
    def _ordered(self) -> Iterator[None]:
        """Within, Spark takes the order of a bucket's one file as given and doesn't sort it again."""
        before = self.spark.conf.get(_ORDERED, "false")
        self.spark.conf.set(_ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_ORDERED, before)

    def compact(self) -> None:
        """Merges the runs into one. Here alone they are read as plain files: grouped, their union is shuffled once."""
        merged = self.spark.read.schema("print bigint, first bigint").parquet(*self.paths["run"])
        self.paths["run"] = [self._put_run(merged.groupBy("print").agg(F.min("first").alias("first")))]


_BLOB = "part int, known boolean, docs array<bigint>, counts array<int>, hashes array<bigint>, starts array<int>"


def _live(prints: np.ndarray, at: np.ndarray, owner: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """Which windows have a fingerprint that their row's list names."""
    live = np.zeros(len(at), dtype=bool)
    edges = np.searchsorted(owner, np.arange(len(wanted) + 1))
    for k, w in enumerate(wanted):
        if len(w) and edges[k + 1] > edges[k]:
            live[edges[k] : edges[k + 1]] = np.isin(prints[at[edges[k] : edges[k + 1]]], w)
    return live


def _listed(col: pa.Array, kind: type) -> list[np.ndarray]:
    """Each row's list; a null one is empty."""
    flat = np.asarray(col.flatten()).view(kind) if len(col) else np.zeros(0, kind)
    sizes = np.array([0 if v is None else v for v in pa.compute.list_value_length(col).to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    return [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(values), kind))


def _lowest_doc(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window the smallest document here that has it."""
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    low = np.empty_like(docs)
    low[order] = np.repeat(np.minimum.reduceat(docs[order], first), np.diff(np.append(first, len(order))))
    return low


def _routed(target: np.ndarray, docs: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each target its documents, their numbers of windows, and the windows' values in that order."""
    order = np.lexsort((docs, target))
    target, docs, values = target[order], docs[order], [v[order] for v in values]
    for t in np.unique(target).tolist():
        s, e = np.searchsorted(target, [t, t + 1])
        who, n = np.unique(docs[s:e], return_counts=True)
        yield t, who, n.astype(np.int32), [v[s:e] for v in values]


def _dealt(parts: int, window: int, gram: int):
    """The live windows, dealt by hash. Those that a smaller document of the same chunk has are known to go.

    So a passage that very many documents share is asked for once a chunk, not once a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            data, offs, _ = common.text_buffers(batch.column(1))
            wanted = _listed(batch.column(2), _U)
            for i, j in common.row_chunks(offs, 4 * common.CHUNK_BYTES):
                words, prints, rows = _windows(data, offs[i : j + 1], window, gram)
                at, owner = _owners(rows, window)
                live = _live(prints, at, owner, wanted[i:j])
                at, owner = at[live], owner[live]
                if not len(at):
                    continue
                hashes, docs, starts = common.window_hashes(words, window)[at], ids[i:j][owner], (at - rows[owner]).astype(np.int32)
                gone = docs > _lowest_doc(hashes, docs)
                ask = ~gone
                asked = [(p, False, *x) for p, *x in _routed((hashes[ask] >> _U(33)) % _U(parts), docs[ask], common.signed(hashes[ask]), starts[ask])]
                known = [(p, True, who, n, [np.zeros(0, np.int64), v[0]]) for p, who, n, v in _routed(_route(docs[gone], parts), docs[gone], starts[gone])]
                part, kinds, who, n, values = zip(*asked, *known, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(kinds), _lists(list(who), pa.int64()), _lists(list(n), pa.int32()), _lists([v[0] for v in values], pa.int64()), _lists([v[1] for v in values], pa.int32())],
                    names=[c.split()[0] for c in _BLOB.split(", ")],
                )

    return run


_FOUND = "route int, docs array<bigint>, counts array<int>, starts array<int>"
_GONE = "doc_id bigint, gone array<int>"


def _route(docs: np.ndarray, routes: int) -> np.ndarray:
    return common.mix(docs.view(_U)) % _U(routes)


def _first_only(routes: int):
    """Of each part's windows, where those start that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        names = [c.split()[0] for c in _FOUND.split(", ")]

        def settled() -> Iterator[pa.RecordBatch]:
            docs, hashes, starts = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            gone = docs > _lowest_doc(hashes, docs)
            found = list(_routed(_route(docs[gone], routes), docs[gone], starts[gone]))
            if found:
                which, who, n, values = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), _lists(list(who), pa.int64()), _lists(list(n), pa.int32()), _lists([v[0] for v in values], pa.int32())], names=names)

        for batch in batches:
            known = np.asarray(batch.column(1).to_pylist(), dtype=bool)
            passed = batch.filter(pa.array(known))
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column(c) for c in (0, 2, 3, 5)], names=names)
            for r in np.flatnonzero(~known).tolist():
                part = batch.column(0)[r].as_py()
                if held and part != now:
                    yield from settled()
                now = part
                docs, counts, hashes, starts = (np.asarray(batch.column(c)[r].values) for c in (2, 3, 4, 5))
                held.append([np.repeat(docs, counts), hashes.copy(), starts.copy()])
        if held:
            yield from settled()

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: where its repeated windows start. Rows come sorted by route."""
    now, held = None, []

    def settled() -> pa.RecordBatch:
        docs, starts = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(docs, kind="stable")
        ids, n = np.unique(docs, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), _lists(np.split(starts[order], np.cumsum(n)[:-1]), pa.int32())], names=["doc_id", "gone"])

    for batch in batches:
        for r in range(batch.num_rows):
            route = batch.column(0)[r].as_py()
            if held and route != now:
                yield settled()
            now = route
            docs, counts, starts = (np.asarray(batch.column(c)[r].values) for c in (1, 2, 3))
            held.append([np.repeat(docs, counts), starts.copy()])
    if held:
        yield settled()


def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = common.text_buffers(batch.column(1))
            gone = _listed(batch.column(2), np.int32)
            for i, j in common.row_chunks(offs, 4 * common.CHUNK_BYTES):
                out = []
                for k in range(i, j):
                    words = data[offs[k] : offs[k + 1]].tobytes().split()
                    total = len(words)
                    if len(gone[k]):
                        cover = np.zeros(total + 1, dtype=np.int64)
                        begin = gone[k][gone[k] <= total - window]
                        np.add.at(cover, begin, 1)
                        np.add.at(cover, begin + window, -1)
                        words = list(compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))
                    out.append((total, total - len(words), b" ".join(words).decode("utf-8", "replace")))
                n, r, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(t, pa.string())], names=[c.split()[0] for c in _CLEAN.split(", ")])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): see the module's text.

    With an index, `docs` are a further batch: their ids must be greater than those it holds (ValueError if not). They
    are cleaned against all documents so far, and the index is saved with them.
    """
    spark = docs.sparkSession
    texts = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    index = index or Index(spark)
    past, history = index.members(), index.texts()
    prints = common.stored(texts.mapInArrow(common.released(_fingerprints(window, gram)), "print bigint, doc_id bigint"), "prints")
    cuts, n_prints = prints.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5], 1000), F.count("*")).first()
    low_id, high_id = texts.agg(F.min("doc_id"), F.max("doc_id")).first() if index.lasting else (None, None)
    if index.last is not None and low_id is not None and low_id <= index.last:
        raise ValueError(f"the index holds ids up to {index.last}; a further batch can't begin at {low_id}")
    parts = common.partitions(spark, n_prints, PART_PRINTS)
    index.buckets = index.buckets or min(parts, MOST_TASKS)
    edges = [None, *(sorted(set(cuts or [])) if batches > 1 else []), None]
    found = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = prints
        if low is not None:
            batch = batch.filter(F.col("doc_id") > low)
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= high)
        got = index.add(batch)
        found = got if found is None else found.unionByName(got)
    index.close()
    if index.lasting:
        path = index._new("text", len(index.paths["text"]))
        texts.write.parquet(path)
        index.paths["text"].append(path)
        index.last = max((x for x in (index.last, high_id) if x is not None), default=None)
        index.save()
    live = found.select("doc_id", "print").union(found.select("first", "print").distinct())
    if history is not None and index.lasting:
        live = live.union(past.join(found.select("print").distinct(), "print", "left_semi").select("doc_id", "print")).distinct()
    live = common.stored(live.groupBy("doc_id").agg(F.collect_set("print").alias("prints")), "live")
    every = texts.unionByName(history) if index.lasting else texts
    tasks = min(parts, max(MOST_TASKS, common.partitions(spark)))
    blobs = every.join(live, "doc_id").select("doc_id", "text", "prints").mapInArrow(common.released(_dealt(parts, window, gram)), _BLOB)
    found = blobs.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(common.released(_first_only(parts)), _FOUND)
    gone = found.repartition(tasks, "route").sortWithinPartitions("route").mapInArrow(common.released(_by_document), _GONE)
    return texts.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(common.released(_cleaned(window)), _CLEAN)
