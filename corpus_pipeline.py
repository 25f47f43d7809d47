"""Corpus pipeline over documents: each stage is written as Parquet and read again as the next one's input.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents; the last returns a row per document that is
left, with the words that the mix takes of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelog.llm import decontaminate, line_dedup, mixing, quality, simhash
from framelog.llm.common import remove, shared_folder, table
from framelog.session import ship

THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``THRESHOLD`` go."""
    ship(spark)
    return quality.fit(docs, table(spark, sf_dir, "labels")).accepted(docs, THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text. No document goes."""
    ship(spark)
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word similarity 0.8 or more) the document with the smallest doc_id stays; so do rows without doc_id."""
    ship(spark)
    gone = simhash.near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document that is left."""
    ship(spark)
    return mixing.mix(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the hashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. What a stage leaves lies in the shared folder of the session's checkpoints until the next
    one has read it; the input of the last stage stays, as its result may be read at any time."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, done = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if done:
            remove(spark, done)
        done = f"{base}/{k}"
        docs = spark.read.parquet(done)
    return STAGES[-1][1](spark, docs, sf_dir)
