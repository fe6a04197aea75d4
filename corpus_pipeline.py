"""From raw documents to packed training sequences: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage is written as Parquet to the shared folder and read again as the next one's documents.

A null, blank or letterless text goes in the first stage, as no language can be told. Rows are judged by their texts, so
a null or repeated doc_id takes no other row with it; of equal texts the longest original stays, then the smallest
doc_id, of near copies the row with the smallest doc_id (rows without one all stay). Texts of any length are read whole.
Columns beyond those of documents are dropped after the first stage, whatever their names. Empty documents, or an empty
benchmark, give empty results, or leave the documents as they are. Texts go to Python in small batches (`small_batches`);
a stage whose last step is in Python stores its result, so that this step runs so as well.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from teleflect.llm import benchmark, exact, language, packing, simhash
from teleflect.llm.common import small_batches, stored, table
from teleflect.llm.queries import word_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; they learn from the labelled documents of this input."""
    return stored(language.identify(docs, language.fit(docs)).filter("not rejected").select(*COLUMNS), "known-languages")


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs).select(*COLUMNS)


@in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs).select(*COLUMNS)


@in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, its place there and in its sequence."""
    return packing.pack_documents(docs, word_bpe(), end_id=1, with_ids=False)


STAGES = [
    ("language-id", known_languages),
    ("exact-dedup", first_copies),
    ("simhash-near-dedup", one_of_each_group),
    ("benchmark-decontamination", without_benchmark),
    ("best-fit-packing", packed),
]
#: Language models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
