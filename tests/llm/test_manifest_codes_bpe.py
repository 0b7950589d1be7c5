"""Merkle manifests, vector codes and byte-pair encoding against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import bpe, codes, merkle, oracles

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top of a tree, and the siblings before and after each leaf's way up."""
    paths = [[] for _ in nodes]
    where, level = list(range(len(nodes))), nodes
    while len(level) > 1:
        for leaf, at in enumerate(where):
            lo = at - at % fanout
            paths[leaf].append(("".join(level[lo:at]), "".join(level[at + 1 : lo + fanout])))
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        where = [w // fanout for w in where]
    return level[0], paths


def brute_manifest(rows: list[tuple], fanout: int = 16) -> list[tuple]:
    def cell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc_id, text, lang, source, n_chars):
        return H(*map(cell, (doc_id, source, lang, n_chars, text)))

    def lowered(text):
        return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    trees: dict = {}
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        trees.setdefault(r[3], []).append((r[0], leaf(*r), leaf(r[0], lowered(r[1]), *r[2:]) if bad else leaf(*r)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops[s] = climb([x[1] for x in trees[s]], fanout)
    root, upper = climb([tops[s][0] for s in order], fanout) if order else ("", [])
    out = []
    for k, s in enumerate(order):
        for (doc_id, node, given), path in zip(trees[s], tops[s][1], strict=True):
            for left, right in (steps := path + upper[k]):
                given = H(left, given, right)
            out.append((doc_id, node, tops[s][0], root, H(*[x for step in steps for x in step]), given, given == root))
    return sorted(out, key=str)


def manifest_rows(df, fanout: int = 16) -> list[tuple]:
    return sorted((tuple(r) for r in merkle.manifest(df, fanout).drop("source_tree", "path").collect()), key=str)


def made_documents(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "Tame Text", "lower", "É UND ß", "x" * rng.randrange(40)]), rng.choice(["en", None]), "hot" if i % 3 else rng.choice(["a", "b", "", "ä", None, f"one{i}"]), rng.choice([0, 7, None])) for i in range(n)]
    return rows + [rows[0], rows[1], rows[1], (None, "No Id", "en", "hot", 5), (None, None, None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("fanout", [16, 3])
def test_manifest_equals_brute_force(spark, fanout):
    rows = made_documents(700)
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"tree": F.lit(1), "index": F.lit("x"), "path": F.lit(2), "size": F.lit(3), "kids": F.lit(0)})
    want = brute_manifest(rows, fanout)
    assert manifest_rows(df, fanout) == want
    assert 20 < sum(not r[-1] for r in want) < 200


def test_manifest_of_few_and_no_rows(spark):
    assert manifest_rows(spark.createDataFrame([], DOCS)) == []
    one = [(5, "Alone", "en", "s", 5)]
    assert manifest_rows(spark.createDataFrame(one, DOCS)) == brute_manifest(one)
    long = [(1, "Ab " * 1_000_000, None, None, 1), (2, "b", None, "s", 1)]
    assert manifest_rows(spark.createDataFrame(long, DOCS)) == brute_manifest(long)


def test_manifest_numbers_a_hot_source_in_many_parts(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.numbered(merkle.leaves(rows), ["doc_id", "node"], "numbered").select("doc_id", "index", "size", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["doc_id"] == r["index"] and r["size"] == 40_000 for r in got) and len(got) == 40_000


def test_manifest_sql_takes_nulls_alike(spark, tmp_path):
    rows = [r for r in made_documents(300, 4) if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted(con.execute(f"SELECT {names} FROM ({oracles.merkle_sql()})").fetchall(), key=str) == brute_manifest(rows)


def brute_codes(rows: list[tuple], entries: int, rounds: int) -> dict[tuple, tuple]:
    """Distances by the definition, in Python's whole numbers."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    found = []
    for width in {len(v) for _, _, v in kept}:
        own, at = [r for r in kept if len(r[2]) == width], [k * width // 4 for k in range(5)]
        codes_, errors, book = [""] * len(own), [0] * len(own), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            parts = [r[2][a:b] for r in own]
            held = parts[:entries]

            def best(p, held):
                return min((sum((x - y) ** 2 for x, y in zip(p, e, strict=True)), k) for k, e in enumerate(held))

            for _ in range(rounds):
                mine = [best(p, held)[1] for p in parts]
                held = [[sum(c) // len(g) for c in zip(*g, strict=True)] if (g := [p for p, m in zip(parts, mine, strict=True) if m == k]) else e for k, e in enumerate(held)]
            for k, p in enumerate(parts):
                far, e = best(p, held)
                codes_[k], errors[k] = codes_[k] + f"{e:02x}", errors[k] + far
            book += [x for e in held for x in e]
        digest = hashlib.sha256(",".join(map(str, book)).encode()).hexdigest()
        found += [(i, lab, c, e, digest) for (i, lab, _), c, e in zip(own, codes_, errors, strict=True)]
    sums: dict = {}
    for _, lab, _, e, _ in found:
        sums[lab] = sums.get(lab, 0) + e
    cap = (1 << 63) - 1
    return sorted(((i, lab, c, min(e, cap), min(sums[lab], cap), d) for i, lab, c, e, d in found), key=str)


VECTORS = "vec_id long, label int, embedding array<double>"


def test_codes_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, None]), [rng.choice([0.5, rng.gauss(0, 1), -0.25]) for _ in range(10)]) for i in range(300)]
    rows += [(300, 1, None), (301, 1, [1.0, None] * 5), (302, 1, [float("nan")] * 10), (303, 2, [float("inf")] + [0.0] * 9), (3, 1, rows[3][2]), (3, 0, [9.0] * 10), (None, None, [0.1] * 10), (400, 5, [1.0, 2.0, 3.0]), (401, 5, []), (402, 7, [1e9] * 10), (403, 7, [-3e11] * 10)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({"width": F.lit(1), "code": F.lit("x"), "part": F.lit(0)})
    got = codes.compress(df, entries=7, rounds=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, 7, 3)


def test_codes_of_no_rows_and_limits(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, 1, None)], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([], VECTORS), entries=300)
    with pytest.raises(OverflowError):
        codes.whole_numbers(np.array([[1e300]]))
    assert codes.whole_numbers(np.array([[-1e14, 0.3]])).tolist() == [[math.floor(1024 * -1e14), math.floor(1024 * 0.3)]]


def brute_digest(tokenizer, text: str | None) -> tuple:
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_tokenizer(spark, small):
    tokenizer = bpe.codec(TOKENIZER).whole
    rng = random.Random(8)
    bits = ["alpha", "the", "日本語", "é", "é", "Ünï", "'s", "don't", "123", "$$$", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "ſ", " ", "　", "İ", " ", "\n"]
    texts = [None, "", " ", " ", "a" * 5000, "=" * 3001, "".join(rng.choice("abcdefgh") for _ in range(4000)), "漢字" * 900 + "。" + "字" * 800, "word " * 3000, "<|endoftext|>" * 400, ("ab" * 700 + " ") * 3, "1" * 3000, "A" * 900 + "<|endoftext|>" + "B" * 1500]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(900))) for _ in range(40)]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rows = [(k % 70, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"row": F.lit(1), "kind": F.lit("x"), "leaf": F.lit(2)})
    want = sorted(((d, *brute_digest(tokenizer, t)) for d, t in rows), key=str)
    for long, leaf, fanin in ((200, 64, 3), (bpe.LONG, bpe.LEAF, bpe.FANIN)):
        assert sorted((tuple(r) for r in bpe.token_digests(df, TOKENIZER, long, leaf, fanin).collect()), key=str) == want


def test_bpe_of_long_unsplit_text(spark):
    rng = random.Random(9)
    text = "".join(rng.choice(["th", "ing", "er", "a", "q", "st"]) for _ in range(150_000))
    got = bpe.token_digests(spark.createDataFrame([(1, text), (2, "x" * 200_000)], "doc_id long, text string"), TOKENIZER).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {1: brute_digest(bpe.codec(TOKENIZER).whole, text), 2: brute_digest(bpe.codec(TOKENIZER).whole, "x" * 200_000)}
    assert bpe.token_digests(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_joins_grow_until_both_sides_agree():
    using = bpe.codec(TOKENIZER)
    rng = random.Random(10)
    for _ in range(300):
        word = "".join(rng.choice(["a", "aa", "an", "th", "x", "ing"]) for _ in range(rng.randrange(2, 60)))
        at = rng.randrange(1, len(word))
        left, right = using.encode(bpe.INNER, word[:at].encode()), using.encode(bpe.LAST, word[at:].encode())
        assert using.joined(left, right, True, 1).tolist() == using.encode(bpe.LAST, word.encode()).tolist()
