"""Queries opN over whole tables, and SQL beside them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import chat, contamination, extraction, fim, language, licenses, lines, lm, packing, quality, simhash, spelling, sql, urls
from assaylake.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(Tables(spark, folder).documents.select("doc_id", "text")).select("doc_id", "license_scan.*")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(Tables(spark, folder).pages.select("page_id", "url")).select("page_id", "url_filter.*")


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = extraction.extract(Tables(spark, folder).pages)
    return pages.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenized_pieces(docs, tokenizer_path(), keep_ids=False)
    return packing.place(pieces, ["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(Tables(spark, folder).documents)


def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(Tables(spark, folder).documents)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    q = quality.measure(Tables(spark, folder).documents.select("doc_id", "text"))
    return q.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines with text, those dropped, those of them dropped for an earlier near line only, and their numbers."""
    docs = Tables(spark, folder).documents.select("doc_id", "text")
    gone = lines.repeated_lines(docs)
    counted = docs.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(lines.MARGIN)) != "")).cast("long").alias("n_lines"))
    found = gone.select(F.col("doc_id").alias("decided_id"), F.col("lines").alias("dropped_lines"), F.size("lines").cast("long").alias("n_dropped"), F.col("near").alias("n_near"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counted.join(found, F.col("doc_id").eqNullSafe(F.col("decided_id")), "left").select("doc_id", "n_lines", zero("n_dropped"), zero("n_near"), F.coalesce("dropped_lines", F.array().cast("array<int>")).alias("dropped_lines"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return contamination.judge(t.documents.select("doc_id", "text"), t.benchmark).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(Tables(spark, folder).documents.select("doc_id", "text", "lang")).select("doc_id", "held_out", F.col("prediction.lang").alias("lang_pred"), "prediction.score")


def op10_simhash_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(Tables(spark, folder).documents.select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.fill_in_middle(Tables(spark, folder).documents.select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(Tables(spark, folder).documents)


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold the template's own strings."""
    given = Tables(spark, folder).conversations.select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(sql.ODD_CONVERSATION, k, role, sql.ODD_TEXT) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(given.unionByName(odd)))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_license_scan, op2_url_filter, op3_html_extraction, op4_best_fit_packing, op5_lm_score, op6_quality_rules, op7_line_dedup, op8_decontamination, op9_language_id, op10_simhash_near_dup,
    op11_fill_in_middle, op12_spelling_variants, op13_chat_format)}
ORACLES: dict[str, str] = {"op1_license_scan": sql.LICENSES, "op2_url_filter": sql.URLS, "op6_quality_rules": sql.QUALITY, "op8_decontamination": sql.CONTAMINATION,
                           "op11_fill_in_middle": sql.FIM, "op13_chat_format": sql.CHAT}
