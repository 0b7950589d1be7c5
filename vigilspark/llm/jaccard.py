"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

The sets are the distinct word shingles of each document. Sets fall into size bands; for each band the universe of
shingles is hashed into m segments. Two sets with Jaccard similarity of at least t differ in at most
(a + b)(1 - t)/(1 + t) shingles, so of any choice of that many segments plus one, at least one holds the same shingles
in both sets. Every set indexes its segments in its own band; it probes its own band and the next smaller one with as
many units as the bound asks. Units are allocated by cost: the fullest segments (the most selective ones) are probed
exactly; where those don't suffice, a segment is probed with its one-deletion neighbourhood (worth two units, indexed
for bands of small sets) before segments of a single shingle are used. Candidates are verified on whole sets.

Signatures travel in arrays, one row per map batch and target part, so that neither the shuffle nor Python pays for
single rows; the number of parts grows with the text, that of tasks is bounded, and a task holds one part at a time.
Equal sets are met once per task and are linked by their set hash, not by pairs. In a large bucket the
members are first linked to one leader. Only members that the verified links leave in different components can still
have links between them; those go through a prefix-filtered join on their rarest shingles, so that sets which share a
frequent passage alone are never paired.

Defined cases: a null or word-less text has an empty set and links with nothing; fewer words than a shingle give the
whole sequence as the one shingle; a row without doc_id takes no part; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored. Shingles are 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm import common

WIDTH = 5
THRESHOLD = (3, 4)
#: Mean shingles in a segment of a set of the band's largest size.
LOAD = 2.2
#: Bands up to this size index one-deletion neighbourhoods.
DELETIONS_TO = 160
#: A bucket of at most so many different sets compares them all; a larger one goes by its leader first.
SMALL = 8
#: Bytes of text whose signatures make one part of the index, and shingles in one part of the prefix join.
PART_BYTES = 8 << 20
PART_SHINGLES = 1 << 20
#: Parts beyond this number share tasks.
MOST_TASKS = 8192

#: Bounds of the cost model: documents sampled for frequent shingles, and how many of those are kept.
SAMPLE = 4000
FREQUENT = 1 << 16
#: At most so many document ids (16 MB in memory) are broadcast to find their texts; more are joined by shuffle.
BROADCAST_NODES = 400_000

#: Slots of the table of shingle counts (2 MB), and the count beyond which a shingle is dealt over several parts.
SLOTS = 1 << 18
HOT = 20_000

_U = np.uint64
_BLOB = "part int, docs array<bigint>, sizes array<int>, h1 array<bigint>, h2 array<bigint>, home array<boolean>, counts array<int>, sigs array<bigint>"
_FOUND = "part int, doc array<bigint>, n array<int>, h1 array<bigint>, h2 array<bigint>, a array<bigint>, b array<bigint>, gid array<bigint>, node array<bigint>"
_ROWS = "kind int, x bigint, y bigint, z bigint, w bigint"
DOC, PAIR, MEMBER = 0, 1, 2


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row (A-Z lower-cased)."""
    starts, ends, rows = common.word_spans(data, offs)
    words = common.word_hashes(data, starts, ends, lower=True)
    runs = common.window_hashes(words, width)
    out = []
    for i in range(len(rows) - 1):
        s, e = int(rows[i]), int(rows[i + 1])
        if e - s >= width:
            out.append(np.unique(runs[s : e - width + 1]))
        elif e > s:
            out.append(common.mix(common.window_hashes(words[s:e], e - s) ^ _U(e - s)))
        else:
            out.append(np.zeros(0, _U))
    return out


class Scheme:
    """Size bands, segments and bounds for a threshold num/den."""

    def __init__(self, threshold: tuple[int, int] = THRESHOLD, load: float = LOAD) -> None:
        self.num, self.den = threshold
        self.load = load
        self.lows, self.highs = [1], [self.den // self.num]

    def band(self, n: int) -> int:
        while self.highs[-1] < n:
            self.lows.append(self.highs[-1] + 1)
            self.highs.append(self.lows[-1] * self.den // self.num)
        return int(np.searchsorted(self.highs, n))

    def bound(self, a: int, b: int) -> int:
        """The most shingles in which two linked sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int) -> int:
        high = self.highs[band]
        return max(self.bound(high, high * self.den // self.num) + 1, int(high / self.load) + 1)

    def signatures(self, tokens: np.ndarray, common_: np.ndarray | None = None) -> np.ndarray:
        """The set's signatures; the lowest bit tells probes (1) from mere index entries (0).

        `common_` (sorted) names frequent shingles: a segment is as selective as it has others.
        """
        n = len(tokens)
        rare = np.ones(n, dtype=np.int64)
        if common_ is not None and len(common_):
            at = np.minimum(np.searchsorted(common_, tokens), len(common_) - 1)
            rare = (common_[at] != tokens).astype(np.int64)
        own = self.band(n)
        out = [self._in_band(tokens, rare, own, self.bound(n, n) + 1, True)]
        if own and -(-n * self.num // self.den) <= self.highs[own - 1]:
            out.append(self._in_band(tokens, rare, own - 1, self.bound(self.highs[own - 1], n) + 1, False))
        return np.concatenate(out)

    def _in_band(self, tokens: np.ndarray, rare: np.ndarray, band: int, units: int, index: bool) -> np.ndarray:
        m = self.segments(band)
        salt = common.mix(np.array([band + 1], dtype=_U))[0]
        h = common.mix(tokens ^ salt)
        seg = ((h >> _U(32)) * _U(m)) >> _U(32)
        order = np.argsort(seg, kind="stable")
        seg, h = seg[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        counts = np.diff(np.append(first, len(seg)))
        sums = np.add.reduceat(h, first)
        keys = common.mix(seg[first] + salt)
        exact = common.mix(sums ^ keys)
        worth = np.add.reduceat(rare[order], first)
        rank = np.lexsort((-counts, -worth))
        small = self.highs[band] <= DELETIONS_TO
        probe = np.zeros(len(first), dtype=bool)
        deletion = np.zeros(len(first), dtype=bool)
        full = int((worth >= 2).sum())
        probe[rank[: min(units, full)]] = True
        short = units - min(units, full)
        if short and small:
            wide = rank[: int((worth >= 3).sum())][:short]
            deletion[wide] = True
            short -= len(wide)
        if short:
            single = rank[full : full + short]
            probe[single] = True
            short -= len(single)
        if short and small:
            rest = rank[probe[rank] & ~deletion[rank] & (counts[rank] >= 2)][:short]
            deletion[rest] = True
            short -= len(rest)
        if short:
            # Fewer filled segments than units: the set's shingles themselves, of which linked sets share at least one.
            probe_tokens = common.mix(tokens ^ _U(0x5DEECE66D))
        exact_bits = exact & ~_U(1) | probe.astype(_U)
        out = [exact_bits if index else exact_bits[probe]]
        if small and (index or deletion.any()):
            held = np.repeat(np.arange(len(first)), counts)
            use = (counts[held] >= 2) & (index | deletion[held])
            gone = common.mix((sums[held] - h) ^ keys[held])[use]
            out.append(gone & ~_U(1) | deletion[held][use].astype(_U))
        if small and index:
            out.append(common.mix(tokens ^ _U(0x5DEECE66D)) & ~_U(1))
        if short:
            if not small:
                raise ArithmeticError("a set fills fewer segments than its bound; lower the load")
            out.append(probe_tokens | _U(1))
        return np.concatenate(out)


@lru_cache(maxsize=4)
def scheme(threshold: tuple[int, int]) -> Scheme:
    return Scheme(threshold)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _emit(parts: int, width: int, threshold: tuple[int, int], frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = scheme(threshold)
        met: set[tuple[int, int]] = set()
        for batch in batches:
            data, offs, _ = common.text_buffers(batch.column(1))
            ids = np.asarray(batch.column(0))
            for i, j in common.row_chunks(offs, 8 * common.CHUNK_BYTES):
                docs, sizes, h1, h2, sigs, owners = ids[i:j], [], [], [], [], []
                sub = [shingle_sets(data, offs[s : e + 1], width) for s, e in ((i + s, i + e) for s, e in common.row_chunks(offs[i : j + 1]))]
                for k, tokens in enumerate(t for part in sub for t in part):
                    n = len(tokens)
                    one = int(common.mix(tokens ^ _U(0xA5A5A5A5)).sum(dtype=_U)) if n else 0
                    two = int(common.mix(tokens ^ _U(0xC3C3C3C3)).sum(dtype=_U)) if n else 0
                    sizes.append(n)
                    h1.append(one)
                    h2.append(two)
                    if n and (n, one) not in met:
                        met.add((n, one))
                        s = plan.signatures(tokens, frequent)
                        sigs.append(s)
                        owners.append(np.full(len(s), k, dtype=np.int32))
                sizes, h1, h2 = np.array(sizes, np.int32), np.array(h1, _U), np.array(h2, _U)
                sig = np.concatenate(sigs) if sigs else np.zeros(0, _U)
                owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
                part = ((sig >> _U(33)) % _U(parts)).astype(np.int32)
                home = ((h1 >> _U(7)) % _U(parts)).astype(np.int32) if len(h1) else np.zeros(0, np.int32)
                order = np.argsort(part, kind="stable")  # owners stay sorted inside a part
                sig, owner, part = sig[order], owner[order], part[order]
                homes = np.argsort(home, kind="stable")
                # only the parts that occur here, however many there are
                which = np.union1d(part, home)
                edges, ends = np.searchsorted(part, which, side="left"), np.searchsorted(part, which, side="right")
                h_edges, h_ends = np.searchsorted(home[homes], which, side="left"), np.searchsorted(home[homes], which, side="right")
                rows: list[list[np.ndarray]] = []
                for k, p in enumerate(which.tolist()):
                    own = owner[edges[k] : ends[k]]
                    here = np.union1d(own, homes[h_edges[k] : h_ends[k]]).astype(np.int64)
                    counts = np.bincount(np.searchsorted(here, own), minlength=len(here)).astype(np.int32)
                    rows.append([docs[here], sizes[here], common.signed(h1[here]), common.signed(np.where(home[here] == p, h2[here], _U(0))), home[here] == p, counts, common.signed(sig[edges[k] : ends[k]])])
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *[_lists(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[c.split()[0] for c in _BLOB.split(", ")])

    return run


def _flat(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()) if len(col) else np.zeros(0, np.int64)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """The arrays of each part in turn; rows come sorted by part, so that a task holds one part at a time."""
    now, held = None, []
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            part = row.column(0)[0].as_py()
            if held and part != now:
                yield held
                held = []
            now = part
            held.append(tuple(_flat(row.column(c)).copy() for c in range(1, batch.num_columns)))
    if held:
        yield held


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by part, sorted. There are never more than MOST_TASKS tasks: beyond, each takes several parts, one by one."""
    return rows.repartition(min(parts, max(MOST_TASKS, common.partitions(rows.sparkSession))), "part").sortWithinPartitions("part")


def _buckets(parts: int, threshold: tuple[int, int]):
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _by_part(batches):
            yield from _bucket(got)

    def _bucket(got: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        docs, sizes, h1, h2, home, counts, sigs = (np.concatenate(c) for c in zip(*got, strict=True))
        got.clear()
        node = np.repeat(np.arange(len(docs)), counts)
        sig = sigs.view(_U)
        key, probing = sig >> _U(1), (sig & _U(1)).astype(bool)
        order = np.argsort(key, kind="stable")
        key, probing, node = key[order], probing[order], node[order]
        same = key[1:] == key[:-1]
        live = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, probing, node = key[live], probing[live], node[live]
        del sig, sigs, order, same, live
        # one entry for each signature and set: the smallest document, a probe if any entry is one
        order = np.lexsort((~probing, docs[node], h1[node], sizes[node], key))
        key, probing, node = key[order], probing[order], node[order]
        if len(key):
            again = np.concatenate([[False], (key[1:] == key[:-1]) & (h1[node[1:]] == h1[node[:-1]]) & (sizes[node[1:]] == sizes[node[:-1]])])
            any_probe = np.logical_or.reduceat(probing, np.flatnonzero(~again))
            key, node = key[~again], node[~again]
            probing = any_probe
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key))
        big = np.flatnonzero(last - first >= 2)
        doc_l, size_l, probe_l = docs[node].tolist(), sizes[node].tolist(), probing.tolist()
        seen: set[int] = set()
        pairs: set[tuple[int, int]] = set()
        groups: dict[int, list[int]] = {}
        for g in big.tolist():
            s, e = int(first[g]), int(last[g])
            if not any(probe_l[s:e]):
                continue
            who = tuple(zip(doc_l[s:e], probe_l[s:e], size_l[s:e], strict=True))
            list_id = hash(who)
            if list_id in seen:
                continue
            seen.add(list_id)
            if e - s <= SMALL:
                pairs.update((min(x, y), max(x, y)) for i, (x, px, nx) in enumerate(who) for y, py, ny in who[:i] if (px or py) and num * max(nx, ny) <= den * min(nx, ny) and x != y)
            else:
                lead = min(x for x, _, _ in who)
                pairs.update((lead, x) for x, _, _ in who if x != lead)
                groups[list_id] = [x for x, _, _ in who]
        yield from _routed(docs[home], sizes[home], h1[home], h2[home], pairs, groups)

    def _routed(doc, n, h1, h2, pairs, groups) -> Iterator[pa.RecordBatch]:
        ab = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        members = np.array([(g, x) for g, who in groups.items() for x in who], dtype=np.int64).reshape(-1, 2)
        targets = [common.mix(doc.view(_U) + _U(1)) % _U(parts), common.mix(ab[:, 0].copy().view(_U) * _U(31) + ab[:, 1].copy().view(_U)) % _U(parts), common.mix(members[:, 0].copy().view(_U)) % _U(parts)]
        which = np.unique(np.concatenate(targets)).astype(np.int32)
        rows = []
        for p in which.tolist():
            d, e, m = (t == p for t in targets)
            rows.append([doc[d], n[d], h1[d], h2[d], ab[e, 0], ab[e, 1], members[m, 0], members[m, 1]])
        if rows:
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *[_lists(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, distinct candidate pairs and bucket members from the partitions' arrays."""
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        cols = [np.asarray(c, dtype=np.int64) for c in cols] + [np.zeros(len(cols[0]), np.int64)] * (4 - len(cols))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *[pa.array(c) for c in cols]], names=names)

    for got in _by_part(batches):
        doc, n, h1, h2, a, b, gid, node = (np.concatenate(c) for c in zip(*got, strict=True))
        if len(doc):
            yield rows(DOC, doc, n, h1, h2)
        for kind, x, y in ((PAIR, a, b), (MEMBER, gid, node)):
            if len(x):
                found = np.unique(np.stack([x, y], axis=1), axis=0)
                yield rows(kind, found[:, 0], found[:, 1])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = common.text_buffers(batch.column(1))
            for i, j in common.row_chunks(offs):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists([common.signed(t) for t in shingle_sets(data, offs[i : j + 1], width)], pa.int64())], names=["node", "tokens"])

    return run


def frequent_shingles(docs: DataFrame, n: int, width: int = WIDTH, sample: int = SAMPLE, most: int = FREQUENT) -> np.ndarray:
    """Shingles of passages that many of the `n` documents share, as seen in about `sample` of them; at most `most`.

    They only steer which segments are probed; candidates and links don't depend on them.
    """
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(1, n))))
    tokens = some.mapInArrow(common.released(_sets(width)), "node bigint, tokens array<bigint>").select(F.explode("tokens").alias("t"))
    rows = tokens.groupBy("t").count().filter("count >= 3").orderBy(F.desc("count"), "t").limit(most).collect()
    return np.sort(np.array([r["t"] for r in rows], dtype=np.int64).view(_U))


def candidates(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Documents (size and set hash), candidate pairs and members of large buckets, stored (see _ROWS)."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = common.partitions(docs.sparkSession, size or 0, PART_BYTES)
    blobs = docs.mapInArrow(common.released(_emit(parts, width, threshold, frequent_shingles(docs, n, width))), _BLOB)
    found = _dealt(blobs, parts).mapInArrow(common.released(_buckets(parts, threshold)), _FOUND)
    return common.stored(_dealt(found, parts).mapInArrow(common.released(_distinct), _ROWS), "candidates")


def stored_sets(nodes: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, tokens) of the nodes (doc_id, ...), stored, with the nodes' other columns."""
    held = common.stored(nodes, "nodes")
    asked = F.broadcast(held.select("doc_id").distinct()) if held.count() <= BROADCAST_NODES else held.select("doc_id").distinct()
    sets = texts.join(asked, "doc_id", "left_semi").mapInArrow(common.released(_sets(width)), "node bigint, tokens array<bigint>").dropDuplicates(["node"])
    return common.stored(sets.join(held.withColumnRenamed("doc_id", "node"), "node") if len(held.columns) > 1 else sets, "sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    num, den = threshold
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return joined.withColumn("shared", shared).filter(F.col("shared") * den >= (F.size("ta") + F.size("tb") - F.col("shared")) * num).select("a", "b")


def _token_lists(col: pa.Array) -> list[np.ndarray]:
    flat, offs = np.asarray(col.values).view(_U), np.asarray(col.offsets)
    return [flat[s:e] for s, e in zip(offs[:-1], offs[1:], strict=True)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's shingles fall on each slot."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        flat = np.asarray(batch.column(0).flatten()).view(_U)
        total += np.bincount(_slots(flat), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])


def _slots(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> _U(11)) % _U(SLOTS)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """The shingles of all sets by slot: a table of SLOTS counts. It orders shingles; links don't depend on it."""
    got = sets.select("tokens").mapInArrow(common.released(_counted), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


_PREFIX = "part int, nodes array<bigint>, comps array<bigint>, sizes array<int>, counts array<int>, tokens array<bigint>, places array<int>"


def _prefixes(parts: int, threshold: tuple[int, int], seen: np.ndarray, hot: int):
    """Each set's rarest shingles, as many as a linked set must share one of, dealt by shingle."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, comps = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            keys, places, owners, salts, sizes = [], [], [], [], []
            for k, tokens in enumerate(_token_lists(batch.column(2))):
                n = len(tokens)
                sizes.append(n)
                count = seen[_slots(tokens)]
                first = np.lexsort((tokens, count))[: n - -(-num * n // den) + 1]
                copies = np.maximum(1, -(-count[first] // hot))
                # a hot shingle is dealt over several parts: probes to one of them, index entries to all
                indexed = np.arange(len(first)) < n - -(-2 * num * n // (den + num)) + 1
                times = np.where(indexed, copies, 1)
                at = np.repeat(np.arange(len(first)), times)
                own = int(common.mix(nodes[k : k + 1].view(_U))[0] >> _U(20))
                salt = np.where(np.repeat(indexed, times), np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), own % np.repeat(copies, times))
                keys.append(tokens[first][at])
                places.append(at.astype(np.int32))
                salts.append(salt.astype(_U))
                owners.append(np.full(len(at), k, np.int32))
            if not keys:
                continue
            key, place, owner, salt = (np.concatenate(x) for x in (keys, places, owners, salts))
            part = (common.mix(key + salt * _U(0x9E3779B97F4A7C15)) >> _U(9)) % _U(parts)
            order = np.argsort(part, kind="stable")
            key, place, owner, part = key[order], place[order], owner[order], part[order]
            which, edges = np.unique(part, return_index=True)
            size, rows = np.array(sizes, np.int32), []
            for s, e in zip(edges.tolist(), np.append(edges[1:], len(part)).tolist(), strict=True):
                who, counts = np.unique(owner[s:e], return_counts=True)
                rows.append([nodes[who], comps[who], size[who], counts.astype(np.int32), common.signed(key[s:e]), place[s:e]])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *[_lists(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[c.split()[0] for c in _PREFIX.split(", ")])

    return run


def _across(threshold: tuple[int, int]):
    """Pairs of different components that share a rare shingle early enough to be similar."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _by_part(batches):
            nodes, comps, sizes, counts, keys, places = (np.concatenate(c) for c in zip(*got, strict=True))
            owner = np.repeat(np.arange(len(nodes)), counts)
            order = np.argsort(keys, kind="stable")
            key, owner, place = keys[order], owner[order], places[order].astype(np.int64)
            size, comp, node = sizes[owner].astype(np.int64), comps[owner], nodes[owner]
            index = place < size - -(-2 * num * size // (den + num)) + 1
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(key))
            if not len(first):
                continue
            mixed = (np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)) & np.logical_or.reduceat(index, first)
            found = []
            for s, e in zip(first[mixed].tolist(), last[mixed].tolist(), strict=True):
                n, c, at, who = size[s:e], comp[s:e], place[s:e], node[s:e]
                for i in np.flatnonzero(index[s:e]).tolist():
                    # the shared shingle is the first one of both, so no more than the rest of either can be shared
                    need = -(-num * (n[i] + n) // (den + num))
                    fit = (c != c[i]) & (n >= n[i]) & (num * n <= den * n[i]) & (np.minimum(n[i] - at[i], n - at) >= need)
                    if fit.any():
                        others = who[fit]
                        found.append(np.stack([np.minimum(others, who[i]), np.maximum(others, who[i])], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def pairs_across(sets: DataFrame, threshold: tuple[int, int] = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Candidate pairs (a, b) of sets (node, component, tokens) whose components differ.

    Shingles are ordered from rare to frequent. Of two linked sets, the smaller one's index prefix and the larger one's
    probe prefix share a shingle, and after the first one shared enough of both must be left.
    """
    seen = shingle_counts(sets)
    parts = common.partitions(sets.sparkSession, int(seen.sum()), PART_SHINGLES)
    dealt = sets.select("node", "component", "tokens").mapInArrow(common.released(_prefixes(parts, threshold, seen, hot)), _PREFIX)
    return _dealt(dealt, parts).mapInArrow(common.released(_across(threshold)), "a bigint, b bigint").distinct()


def similar_components(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id): each document with the smallest doc_id that links reach."""
    texts = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    rows = candidates(texts, width, threshold)
    all_docs = rows.filter(F.col("kind") == DOC).select(F.col("x").alias("doc_id"), F.col("y").cast("long").alias("n"), F.col("z").alias("h1"), F.col("w").alias("h2"))
    # stored, so that the join below has no aggregate in its stage and Spark can split the copies of a large class
    classes = common.stored(all_docs.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "firsts")
    reps = common.stored(all_docs.join(classes, ["n", "h1", "h2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    of = reps.select(F.col("doc_id").alias("node"), "rep").distinct()

    def canonical(pairs: DataFrame) -> DataFrame:
        one = pairs.join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b")
        return one.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    pairs = common.stored(canonical(rows.filter(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b"))), "pairs")
    sets = stored_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), texts, width)
    links = common.stored(verified(pairs, sets, threshold), "links")
    members = rows.filter(F.col("kind") == MEMBER).select(F.col("x").alias("gid"), F.col("y").alias("node"))
    label = common.stored(common.connected_components(links), "labels")
    in_groups = members.join(of, "node").select("gid", "rep").distinct().join(label.toDF("rep", "component"), "rep", "left").select("gid", "rep", F.coalesce("component", "rep").alias("component"))
    in_groups = common.stored(in_groups, "groups")
    split = in_groups.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("gid")
    open_ = in_groups.join(split, "gid", "left_semi").select(F.col("rep").alias("doc_id"), "component").distinct()
    open_sets = stored_sets(open_, texts, width)
    more = common.stored(pairs_across(open_sets, threshold), "more")
    if not more.isEmpty():
        label = common.stored(common.connected_components(links.union(verified(more, open_sets, threshold))), "labels")
    return reps.join(label.toDF("rep", "component"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
