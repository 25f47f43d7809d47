"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelog.llm import chat_format, decontaminate, html_extract, line_dedup, media, mixing, quality, simhash, suffix_dedup, token_counts
from framelog.llm.common import table


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy on each row. A table in fewer parts than there are cores (a single small file) is dealt out
    over the cores first; one in many parts is read as it lies, without a shuffle."""
    df = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.with_digest(suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(scan(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(scan(spark, sf_dir, "documents", "doc_id", "text"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat_format.gather(table(spark, sf_dir, "conversations"))
    return chat_format.preference_format(chat_format.swapped_replies(convs))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(scan(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(scan(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(scan(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(scan(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality, op3_token_counts, op4_chat_format, op5_decontaminate, op6_line_dedup, op7_simhash, op8_html_extract, op9_mixing, op10_media)}
ORACLES = {"op4_chat_format": chat_format.SQL, "op6_line_dedup": line_dedup.SQL, "op9_mixing": mixing.SQL}
