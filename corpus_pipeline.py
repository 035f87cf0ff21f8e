"""Clean a corpus: language, near copies, benchmark leaks, tokens.

Every stage takes the rows its predecessor kept and decides on all of them; all but the last
return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.llm.common import find_package, shared_folder, stored, table, written
from gritsieve.llm.hamming import near_duplicates
from gritsieve.llm.langid import UNKNOWN, predict, train
from gritsieve.llm.segment_bpe import VOCABULARY, encode_and_decode
from gritsieve.llm.templates import contaminated

LEAST_SCORE = 0.3  # below this no language stands out
SHINGLE_WORDS, PERCENT = 5, 80


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names the table does not use."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those in which no known language stands out.

    Rows are judged one by one; where nothing is labelled, no language is known and no row stays.
    """
    lang, score = free_names(docs, "lang_pred", "lang_score")
    told = predict(docs, train(docs), names=(lang, score))
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each class of near copies; texts without words are in no class and stay."""
    (at,) = free_names(docs, "at")
    rows = written(docs.withColumn(at, F.monotonically_increasing_id()), "near_copies")
    found = near_duplicates(rows, size=SHINGLE_WORDS, percent=PERCENT, at=at)
    copies = stored(found.where("class_at <> at").select(F.col("at").alias(at)))
    return rows.join(copies, at, "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the rows that hold a benchmark item, each by its own text, whatever its doc_id (null or repeated)."""
    (at,) = free_names(docs, "at")
    rows = written(docs.withColumn(at, F.monotonically_increasing_id()), "benchmark_leaks")
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), at=at)
    leaks = stored(found.select(F.col("at").alias(at)).distinct())
    return rows.join(leaks, at, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian unsigned 32-bit) and the digest of the text decoded from them."""
    return encode_and_decode(docs, public_tokenizers.path(VOCABULARY)).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    find_package(spark)
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
