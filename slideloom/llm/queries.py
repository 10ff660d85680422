"""The operators applied to whole tables, as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fill_middle, html_text, langid, license_scan, mixing, neardup, pii, quality, sql, substring, tokens, vector_codes
from ._shared import materialize, read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.drop_repeats(docs).select("doc_id", "n_sentences", "n_removed", "n_removed_words", "text")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=80, shingle=2)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents").drop("n_chars"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["first"].cast("string"), x["past"].cast("string")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(spans, ",").alias("spans"),
        F.coalesce(F.round(F.array_max(F.transform("licenses", lambda x: x["coverage"])), 6), F.lit(0.0)).alias("best_coverage"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("score"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress_vectors(read_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(read_table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    ids = F.col("ids")
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), bpe.ids_digest(ids).alias("ids_sha256"), F.sha2(bpe.decoded(ids, "byte_bpe_50k.json"), 256).alias("decoded_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = materialize(fill_middle.frame_store(read_table(spark, sf_dir, "documents")), "frames")
    made = fill_middle.fill_in_middle(store, seed="1", percent=90, suffix_first=20)
    made = made.withColumn("sha", fill_middle.digests(F.col("frames"), F.col("sizes"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("sha.output").alias("output_sha256"), F.col("sha.restored").alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup, op2_minhash_near_dedup, op3_token_counts, op4_mix_sources, op5_quality_rules, op6_html_text, op7_license_scan, op8_pii,
            op9_language_id, op10_decontaminate, op11_vector_codes, op12_bpe_codec, op13_fill_middle, pipeline,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": sql.mix_sources(), "op5_quality_rules": sql.quality_rules(), "op10_decontaminate": sql.decontaminate(), "op11_vector_codes": sql.vector_codes(), "op13_fill_middle": sql.fill_middle()}
