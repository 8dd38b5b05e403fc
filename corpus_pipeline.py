"""A corpus pipeline of five stages, each with the signature (spark, docs, sf_dir) -> DataFrame.

Every stage works on all rows that its predecessor kept and is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import jaccard_join, language_id, line_dedup, mixing, packing
from leafmill.llm.common import read
from leafmill.llm.queries import tokenizer_path
from leafmill.session import work_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A language found with a smaller lead over the next one doesn't replace a label.
SURE_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of undetermined language: null texts and texts without a letter.

    Of the others ``lang`` becomes the language found, unless the two nearest languages are all but alike
    and the document already has a label.
    """
    references = language_id.reference_texts(docs)
    found = language_id.identify_languages(docs.select(*COLUMNS), references)
    sure = F.col("lang").isNull() | (F.col("score") >= SURE_SCORE)
    lang = F.when(sure, F.col("lang_pred")).otherwise(F.col("lang"))
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).withColumn("lang", lang).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand earlier in the corpus, and documents of which no word is left.

    Such a document held nothing but lines that earlier documents keep. n_chars follows the text.
    """
    lines = line_dedup.dedup_lines(docs.select(*COLUMNS))
    some = lines.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return some.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; a document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]
# Automata, chosen paths and tokenizers are beyond SQL; tests hold the rows of the first and the third stage
# against plain Python, and of the others the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
