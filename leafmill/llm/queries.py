"""The registered queries of this folder with their DuckDB counterparts (None where SQL can't say it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, importance, jaccard_join, language_id, licences, line_dedup, mixing, packing, permutation_index, quality_model, quality_rules, scaled_sketch, suffix_dedup
from .common import crc_mod, read


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(read(spark, sf_dir, "embeddings"))


def op2_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda p: p.cast("string")), ",").alias("removed"))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    references = language_id.reference_texts(docs)
    found = language_id.identify_languages(docs.select("doc_id", "text"), references)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.dedup_substrings(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = scaled_sketch.compare_edits(read(spark, sf_dir, "documents"))
    return compared.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(read(spark, sf_dir, "conversations"))
    return conversation_repair.audit_conversations(rows, F.col("present"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_permutation_index": (op1_permutation_index, None),
    "op2_fair_mix": (op2_fair_mix, mixing.mix_sql()),
    "op3_rule_cascade": (op3_rule_cascade, None),
    "op4_line_dedup": (op4_line_dedup, line_dedup.dedup_sql()),
    "op5_cross_parsing": (op5_cross_parsing, None),
    "op6_cutting_stock": (op6_cutting_stock, None),
    "op7_two_stage_suffixes": (op7_two_stage_suffixes, None),
    "op8_chosen_path": (op8_chosen_path, None),
    "op9_quality_discriminant": (op9_quality_discriminant, None),
    "op10_licence_scan": (op10_licence_scan, licences.scan_sql()),
    "op11_importance_draw": (op11_importance_draw, importance.resample_sql()),
    "op12_scaled_sketch": (op12_scaled_sketch, scaled_sketch.compare_sql()),
    "op13_conversation_repair": (op13_conversation_repair, conversation_repair.audit_sql()),
    "pipeline": (pipeline, None),
}
