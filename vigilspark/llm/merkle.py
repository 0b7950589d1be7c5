"""A Merkle manifest of a table: a tree of its rows for each source, a tree of the sources' subroots, a proof per row.

Trees are DataFrame levels. Nodes get their index within their tree by a range partitioning that is written once, with
prefix sums over the written parts, so that a source with a third of all rows is numbered by many tasks. Each level
divides the index by the fanout and hashes the sorted children of a run into their parent; a level has a sixteenth of the
rows of the one below. Proofs come back down: each level joins its runs to their parents' siblings and prepends its own.
The rows themselves meet only the last of these joins, one row for sixteen of them.

Defined cases: a null field counts as `-`; rows of equal id are ordered by their digest, and repeated rows are leaves of
their own; a null id comes first and is never tampered with; null sources are a source of their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import common

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for a null, else the value's length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: dict[str, Column]) -> Column:
    return digest(*[field(values[c]) for c in FIELDS])


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the CRC of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, node, other): each row's digest, and where it is tampered with the digest that this gives.

    `tree` sorts as sources do, nulls first.
    """
    rows = common.pick(docs, *FIELDS)
    held = {c: F.col(c) for c in FIELDS}
    lowered = held | {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    return rows.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(held).alias("node"), F.when(tampered(F.col("doc_id")), leaf(lowered)).alias("other"))


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """`nodes` with their `index` in their tree and the tree's `size`.

    The sorted range partitions are written with each row's place, so that counting and numbering see the same parts.
    A last sort key of no meaning parts equal rows.
    """
    spare = F.xxhash64(F.monotonically_increasing_id())
    dealt = nodes.withColumn("spare", spare).repartitionByRange("tree", *order, "spare").sortWithinPartitions("tree", *order, "spare").drop("spare")
    dealt = common.stored(dealt.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33).alias("part")
    before = F.sum("count").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy("tree", part).agg(F.count("*").alias("count"), F.min("place").alias("first"))
    parts = parts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("count").over(Window.partitionBy("tree")).alias("size"))
    parts = common.stored(parts, f"{name}-parts")
    return dealt.withColumn("part", part).join(parts, ["tree", "part"]).withColumn("index", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def runs_of(nodes: DataFrame, *carried: str, fanout: int = FANOUT) -> DataFrame:
    """(tree, run, size, kids, parent) of nodes (tree, index, size, node): a lone node is its own parent."""
    kids = F.sort_array(F.collect_list(F.struct("index", "node", *carried)))
    runs = nodes.groupBy("tree", F.floor(F.col("index") / fanout).alias("run"), "size").agg(kids.alias("kids"))
    return runs.withColumn("parent", F.when(F.col("size") > 1, F.sha2(F.array_join(F.col("kids.node"), ""), 256)).otherwise(F.col("kids")[0]["node"]))


def levels(nodes: DataFrame, name: str, *carried: str, fanout: int = FANOUT) -> list[DataFrame]:
    """The written runs of each level, from the nodes up to one run for each tree."""
    out = [common.stored(runs_of(nodes, *carried, fanout=fanout), name)]
    largest = out[0].agg(F.max("size")).first()[0] or 1
    while (largest := -(-largest // fanout)) > 1:
        up = out[-1].select("tree", F.col("run").alias("index"), F.ceil(F.col("size") / fanout).alias("size"), F.col("parent").alias("node"))
        out.append(common.stored(runs_of(up, fanout=fanout), name))
    return out


def siblings(kids: Column, at: Column) -> Column:
    """struct<left, right>: the digests of the run before and after the child at `at`."""
    joined = lambda start, length: F.array_join(F.slice(kids["node"], start, length), "")
    return F.struct(joined(F.lit(1), at).alias("left"), joined(at + 2, F.size(kids)).alias("right"))


def below(runs: DataFrame, paths: DataFrame, *carried: str) -> DataFrame:
    """The children of `runs` with the siblings of their own run before those of `paths` (tree, index, path, ...)."""
    others = [c for c in paths.columns if c not in ("tree", "index", "path")]
    met = runs.join(paths.withColumnRenamed("index", "run"), ["tree", "run"]).select("tree", "size", "kids", "path", *others, F.posexplode("kids").alias("at", "kid"))
    step = F.when(F.col("size") > 1, F.array(siblings(F.col("kids"), F.col("at"))))
    return met.select("tree", F.col("kid.index").alias("index"), F.col("kid.node").alias("node"), *[F.col(f"kid.{c}").alias(c) for c in carried], F.concat(F.coalesce(step, F.array().cast("array<struct<left:string,right:string>>")), "path").alias("path"), *others)


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, source_tree, leaf, subroot, root, path, proof_sha256, folded_root, verified) of each row of `docs`.

    `path` has the siblings of each level, from the row's own run up to the root. `folded_root` is recomputed from the
    tampered leaf (else the leaf) and the path of the untampered tree.
    """
    rows = numbered(leaves(docs), ["doc_id", "node"], "merkle-leaves")
    trees = levels(rows, "merkle-runs", "doc_id", "other", fanout=fanout)
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("parent").alias("node"))
    upper = levels(numbered(tops, ["of"], "merkle-sources"), "merkle-tops", "of", fanout=fanout)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    paths = upper[-1].select("tree", F.col("run").alias("index"), empty.alias("path"), F.col("parent").alias("root"))
    for runs in reversed(upper[1:]):
        paths = common.stored(below(runs, paths).drop("node"), "merkle-paths")
    paths = below(upper[0], paths, "of").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("index"), "path", F.col("node").alias("subroot"), "root")
    paths = common.stored(paths, "merkle-paths")
    for runs in reversed(trees[1:]):
        paths = common.stored(below(runs, paths).drop("node"), "merkle-paths")
    found = below(trees[0], paths, "doc_id", "other")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("other", "node"), lambda node, s: digest(s["left"], node, s["right"]))
    found = found.select("doc_id", F.col("tree").alias("source_tree"), F.col("node").alias("leaf"), "subroot", "root", "path", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
