"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents are counted once into cells (source, language, topic). Each cell has a ratio, its raked tokens over its
tokens; a document is sampled with probability min(1, ratio). The ratios are raked in turn to the wanted tokens of the
three marginals: those of a category are multiplied by its want over what it keeps, where cells at probability 1 keep
no more than they have. So the cap is part of the raking and the probabilities are calibrated when it ends. A document
is sampled when a hash of its doc_id falls below its probability, so a rerun samples the same documents.

Target shares default to the observed token shares to the power `TEMPERATURE` (1 keeps the mix, 0 makes it uniform).
`BUDGET` is the share of all tokens that is sampled. A category that has fewer tokens than its target share of the budget
gives all that it has, and the others share the rest in proportion to their targets: a short category changes its own
share, never the size of the sample. `marginals` tells target, wanted and reached share of each category.

Defined cases: null or empty text has no tokens, takes the topic of prose and a probability of its cell like any other;
a cell without tokens has probability 1; null source or language is the category "(none)"; a null doc_id hashes as the
empty string; repeated rows are sampled alike; an empty table gives no rows; other columns are kept by `sample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import common

TEMPERATURE = 0.5
BUDGET = 0.8
CYCLES = 24
#: Cycles between two writes of the cells, which keep plans short.
STEP = 6
#: No ratio grows beyond this (targets that can't be met together would drive it without end).
MOST = 1e9
KEYS = ("mix_source", "mix_lang", "mix_topic")
#: A cell table of at most so many rows (under 10 MB) is raked in one partition, without shuffles, and broadcast; a larger
#: one is dealt by category and joined by shuffle. The results are the same.
SMALL_CELLS = 100_000

# The topics by what their texts contain, first match first.
TOPICS = (("legal", ("licens", "copyright")), ("contact", ("@",)), ("tabular", (" | ",)), ("noisy", ("###", "$$$")))


def topic(text: Column) -> Column:
    def of(low: Column) -> Column:
        out = F.lit("prose")
        for name, marks in reversed(TOPICS):
            has = low.contains(marks[0])
            for m in marks[1:]:
                has = has | low.contains(m)
            out = F.when(has, F.lit(name)).otherwise(out)
        return out

    return F.transform(F.array(F.lower(text)), of)[0]


def tokens(text: Column) -> Column:
    """White-space words: the parts between runs of white space, without the empty ones before the first and after the last."""
    parts = F.size(F.split(text, r"[ \t-\r]+"))
    empty = text.rlike(r"^[ \t-\r]").cast("int") + F.substring(text, -1, 1).rlike(r"[ \t-\r]").cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(parts - empty).cast("bigint")


def categorised(docs: DataFrame) -> DataFrame:
    """`docs` with the three categories and the tokens of each document."""
    return docs.withColumns({"mix_source": F.coalesce(F.col("source"), F.lit("(none)")), "mix_lang": F.coalesce(F.col("lang"), F.lit("(none)")), "mix_topic": topic(F.col("text")), "mix_tokens": tokens(F.col("text"))})


def wanted(cells: DataFrame, key: str, temperature: float, tokens_: float) -> DataFrame:
    """(category, m, target, want) of a marginal: its tokens, its target share, and the tokens it is to keep of `tokens_`.

    Categories by ascending tokens over target are short up to some one of them; from there on all have enough, and the
    level is what is left to keep over the targets left. The ordered pass is over categories, not documents.
    """
    rows = cells.groupBy(F.col(key).alias("category")).agg(F.sum("n").alias("m")).filter("m > 0")
    rows = rows.withColumn("t", F.pow("m", F.lit(temperature)))
    order = Window.orderBy(F.col("m") / F.col("t"), "category")
    short = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.lit(tokens_) - short) / F.sum("t").over(order.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.partitionBy(F.lit(0))
    level = F.coalesce(F.min(F.when(F.col("m") / F.col("t") >= F.col("level"), F.struct(F.col("m") / F.col("t"), "category", "level"))).over(whole)["level"], F.lit(float("inf")))
    return rows.select("category", "m", (F.col("t") / F.sum("t").over(whole)).alias("target"), F.least("m", level * F.col("t")).alias("want"))


def probabilities(rows: DataFrame, temperature: float = TEMPERATURE, budget: float = BUDGET, cycles: int = CYCLES) -> DataFrame:
    """(source, language, topic, probability) of each cell of `rows` (as made by `categorised`)."""
    cells = common.stored(rows.groupBy(*KEYS).agg(F.sum("mix_tokens").cast("double").alias("n")), "cells")
    held = cells.agg(F.count("*").alias("cells"), F.sum("n").alias("n")).first()
    few, total = held["cells"] <= SMALL_CELLS, held["n"] or 0.0
    made = cells.withColumn("ratio", F.lit(float(budget)))
    for k in KEYS:
        want = wanted(cells, k, temperature, budget * total).select(F.col("category").alias(k), F.col("want").alias(f"want_{k}"))
        made = made.join(want, k, "left")
    cells = common.stored(made, "cells")
    cells = cells.coalesce(1) if few else cells
    kept = F.col("n") * F.least(F.lit(1.0), F.col("ratio"))
    for c in range(cycles):
        for k in KEYS:
            now = F.sum(kept).over(Window.partitionBy(k))
            cells = cells.withColumn("ratio", F.least(F.lit(MOST), F.when(now > 0, F.col("ratio") * F.col(f"want_{k}") / now).otherwise(F.col("ratio"))))
        if c % STEP == STEP - 1:
            cells = common.stored(cells, "cells")
            cells = cells.coalesce(1) if few else cells
    return cells.select(*KEYS, F.round(F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("ratio"))).otherwise(F.lit(1.0)), 6).alias("probability"))


def draw(doc_id: Column) -> Column:
    """A uniform number in [0, 1) from the document's id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _met(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """`rows` (as made by `categorised`) with the probability of their cell and whether they are sampled."""
    if cells.count() <= SMALL_CELLS:
        cells = F.broadcast(cells)
    return rows.join(cells, list(KEYS)).withColumn("sampled", draw(F.col("doc_id")) < F.col("probability"))


def weighted(docs: DataFrame, temperature: float = TEMPERATURE, budget: float = BUDGET, cycles: int = CYCLES) -> DataFrame:
    """`docs` with its categories, tokens, `probability` and whether it is `sampled`; these replace columns so named."""
    rows = categorised(docs.drop("probability", "sampled"))
    return _met(rows, probabilities(rows, temperature, budget, cycles))


def weights(docs: DataFrame, temperature: float = TEMPERATURE, budget: float = BUDGET, cycles: int = CYCLES) -> DataFrame:
    """(doc_id, categories, tokens, probability, sampled): what `weighted` tells without the documents' own columns.

    Categories and token counts are written once, so that the texts are read in one pass.
    """
    rows = common.stored(categorised(common.pick(docs, "doc_id", "text", "source", "lang")).select("doc_id", *KEYS, "mix_tokens"), "categories")
    return _met(rows, probabilities(rows, temperature, budget, cycles))


def marginals(docs: DataFrame, temperature: float = TEMPERATURE, budget: float = BUDGET, cycles: int = CYCLES) -> DataFrame:
    """(marginal, category, tokens, target, wanted, reached): of each category the share of the sampled tokens that it
    is to have by temperature alone, that its tokens allow, and that it has."""
    rows = weights(docs, temperature, budget, cycles)
    cells = common.stored(rows.groupBy(*KEYS).agg(F.sum("mix_tokens").cast("double").alias("n"), F.first("probability").alias("p")), "reached")
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    one = None
    for k in KEYS:
        kept = cells.groupBy(F.col(k).alias("category")).agg(F.sum(F.col("n") * F.col("p")).alias("kept"))
        shares = kept.join(wanted(cells, k, temperature, budget * total), "category")
        every = Window.partitionBy(F.lit(0))
        shares = shares.select(F.lit(k).alias("marginal"), "category", F.col("m").cast("bigint").alias("tokens"), "target", F.try_divide("want", F.sum("want").over(every)).alias("wanted"), F.try_divide("kept", F.sum("kept").over(every)).alias("reached"))
        one = shares if one is None else one.unionByName(shares)
    return one


def sample(docs: DataFrame, temperature: float = TEMPERATURE, budget: float = BUDGET, cycles: int = CYCLES) -> DataFrame:
    """The sampled documents, with the columns of `docs`."""
    held = docs.select("doc_id", "text", "source", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_doc"))
    return weighted(held, temperature, budget, cycles).filter("sampled").select("mix_doc.*")
