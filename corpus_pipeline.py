"""The corpus pipeline: language ID, near-duplicate join, PII, mixing, packing.

Each stage works on all rows that its predecessor kept and, but for the last, returns the columns of documents:

1. language ID drops documents in which no language is found (no letters, or no text);
2. the n-gram Jaccard join keeps the document with the smallest doc_id of each linked group (a row without a doc_id
   links with nothing and stays);
3. PII puts pseudonyms in the place of validated personal data, and n_chars follows the text;
4. mixing samples documents by their calibrated probabilities;
5. packing fills training windows.

The rows that a stage keeps are stored in the shared folder, so that no stage runs again for the next one's passes.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import common, jaccard, langid, mixing, packing, pii


def _like(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identifier(model)(F.col("text").cast("string"))
    return _like(docs, docs.withColumn("__found", found).filter("__found.lang_pred <> 'und'"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.similar_components(docs)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return _like(docs, docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _like(docs, done)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Language mixtures and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
