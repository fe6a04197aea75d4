"""The corpus operators on the given tables: thin queries in the form that their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark, exact, language, licenses, middle, packing, records, simhash, substring, topk, toxicity, warc, whiten
from .common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    top = warc.write_index(warc.write_archives(pages))
    return warc.read_captures(pages, top).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = records.write_records(table(spark, sf_dir, "documents"), word_bpe(), end_id=2)
    rows = records.read_records(files)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), records.digest("ids").alias("ids_crc32"))


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), with_spans=True)
    predicted = (F.col("score") >= toxicity.CUT).cast("int")
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "spans")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe(), end_id=1, with_ids=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), hash_all=True)


def op8_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op11_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.fill_in_middle(table(spark, sf_dir, "documents"), with_text=False).drop("output")


def op13_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_capture_index, op2_kneser_ney_language_id, op3_token_records, op4_simhash_ball, op5_crf_toxicity, op6_best_fit_packing, op7_exact_dedup, op8_license_set_join, op9_template_decontamination, op10_substring_dedup, op11_block_max_top_k, op12_fill_in_middle, op13_jacobi_davidson_whitening)}
ORACLE_SQL = {"op1_warc_capture_index": warc.SQL, "op7_exact_dedup": exact.SQL, "op8_license_set_join": licenses.SQL, "op10_substring_dedup": substring.SQL, "op11_block_max_top_k": topk.SQL, "op12_fill_in_middle": middle.SQL}
