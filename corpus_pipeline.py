"""From raw documents to token ids: quality rules, line dedup, one of each group of similar documents, no benchmark
passages, byte-pair encoding. Each stage takes the table that the stage before it has written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from placebook.llm import bpe, decontam, jaccard, linededup, quality
from placebook.llm.queries import VOCABULARY
from placebook.llm.tables import table
from placebook.operators.joins import named, own_name
from placebook.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. The references are those of the given documents."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that a document with a smaller id has too; n_chars follows the text. A document that
    loses lines and has no word left, as a whole copy has, goes.
    """
    whole = own_name("whole")
    done = linededup.dedup_lines(docs.select("doc_id", "text", F.struct(*map(named, docs.columns)).alias(whole)))
    done = done.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*[new.get(name, F.col(whole)[name]).alias(name) for name in docs.columns])


def similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest id. By now near copies have lost the lines that
    they share with an earlier document, so what is found here are those that differ in each line, and those without any
    line in common that is long enough.
    """
    return jaccard.keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, as packed little-endian unsigned 32-bit integers, and digests of them and of what
    decoding them gives.
    """
    done = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return done.select("doc_id", n_tokens, "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("similar_documents", similar_documents),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Groups of similar documents and token ids are beyond SQL; tests compare with a plain version of all stages.
ORACLE_SQL = None
