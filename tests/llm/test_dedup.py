"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vigilspark.llm import common, jaccard, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text: str | None) -> set:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def removed(rows: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def planted(seed: int, n: int) -> list[tuple[int, str | None]]:
    """Texts with exact copies, edits of single words at all distances around the threshold, shared passages, blanks."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(70)]
    texts: list[str | None] = [None, "", " \n\t ", "one two", "ONE two", "one  two three four", "ä ö ü ß é"]
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 120, 400]))]
        if rng.random() < 0.3:
            at = rng.randrange(len(base))
            base[at:at] = passage
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            edit = list(base)
            for _ in range(rng.randrange(1 + max(1, len(edit) // 25))):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            if rng.random() < 0.3:
                del edit[: len(edit) // rng.choice([5, 10, 20])]
            texts.append(rng.choice([" ", "\n", "  "]).join(edit).upper() if rng.random() < 0.2 else " ".join(edit))
    ids = rng.sample(range(10_000), n)
    return list(zip(ids, texts[:n], strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = planted(seed, 220)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(rows)


def test_large_buckets_link_as_brute_force(spark):
    """More near copies than a bucket compares pairwise, in two clusters that share a passage."""
    rng = random.Random(7)
    words = [f"v{i}" for i in range(500)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for c in range(2):
        base = shared + [rng.choice(words) for _ in range(90)]
        for _ in range(30):
            edit = list(base)
            edit[rng.randrange(60, len(edit))] = rng.choice(words)
            rows.append((len(rows), " ".join(edit)))
    rows += [(100 + k, rows[0][1]) for k in range(40)]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == components(rows)


@pytest.mark.parametrize("window", [8, 50])
def test_removed_words_equal_brute_force(spark, window):
    rows = planted(window, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(docs, window=window, gram=min(8, window))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.collect()} == removed(rows, window)


def test_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(30_000))
    rows = [(5, long), (2, "x y " + long[: len(long) // 2]), (9, "short text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.collect()} == removed(rows, 50)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs).collect()} == components(rows)


def test_runs_of_the_index_are_compacted(spark):
    index = substring_dedup.Index(spark, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(p, k) for p in range(k, k + 4)], "print long, doc_id long")
        repeated = {(r["print"], r["first"]) for r in index.add(batch).collect()}
        assert repeated == {(p, 0 if p < 4 else p - 3) for p in range(k, k + 3)} if k else not repeated
    assert len(index.runs) <= 2


def test_runs_are_joined_without_shuffle_or_sort(spark):
    index = substring_dedup.Index(spark, fanout=9)
    for k in range(3):
        index.add(spark.createDataFrame([(p, k) for p in range(100 * k, 100 * k + 300)], "print long, doc_id long"))
    with index._ordered():
        plan = index.firsts(index._put_run(index._run(index.runs[0])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort [" not in plan
    index.compact()
    assert len(index.runs) == 1 and index._run(index.runs[0]).agg(F.count("*"), F.sum("first")).first() == (500, 0 * 300 + 1 * 100 + 2 * 100)
    index.close()


@pytest.mark.parametrize("cuts", [[80], [20, 90, 120, 130, 131]])
def test_a_stored_index_takes_further_batches(spark, tmp_path, cuts):
    """Batches that are added by jobs of their own give what one run over all gives, through compactions."""
    rows = [(d, t) for d, t in planted(8, 160) if d is not None]
    rows = sorted({d: t for d, t in rows}.items())
    folder, got, want = f"file://{tmp_path}/index", {}, removed(rows, 8)
    edges = [0, *cuts, len(rows)]
    for n, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        index = substring_dedup.Index.open(spark, folder) if n else substring_dedup.Index(spark, folder)
        docs = spark.createDataFrame(rows[low:high], "doc_id long, text string")
        for r in substring_dedup.remove_repeats(docs, window=8, gram=8, batches=1, index=index).collect():
            got[r["doc_id"]] = (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest())
        assert len(index.runs) <= substring_dedup.FANOUT
    assert got == want
    with pytest.raises(ValueError, match="the index holds ids up to"):
        substring_dedup.remove_repeats(spark.createDataFrame(rows[:3], "doc_id long, text string"), window=8, gram=8, index=substring_dedup.Index.open(spark, folder))


@pytest.mark.parametrize("operator", [jaccard.similar_components, substring_dedup.remove_repeats])
def test_empty_table_nulls_repeats_and_clashing_columns(spark, operator):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert operator(empty).count() == 0
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(1, text, 7, "p"), (1, text, 8, "q"), (2, text, 9, None), (None, text, 1, "r"), (3, None, 2, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, print string").withColumn("component_id", F.lit(5)).withColumn("n_words", F.lit("x"))
    got = operator(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3]
    if operator is jaccard.similar_components:
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 3)}
    else:
        assert {(r["doc_id"], r["n_removed"]) for r in got} == {(1, 0), (2, 60), (3, 0)}


def test_connected_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long").orderBy(F.rand(1))
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
