"""A training corpus from documents: quality rules, line dedup, near-dedup, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.line_dedup import line_dedup
from tracelode.llm.packing import pack_documents
from tracelode.llm.quality import quality_rules
from tracelode.llm.shared import stored
from tracelode.llm.simhash import near_groups
from tracelode.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _documents(quality_rules(docs, public_tokenizers.path("piece_bpe_32k.model")).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document go; documents stay."""
    return _documents(line_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8 or more) the document with the smallest doc_id stays. Rows without a doc_id stay."""
    kept = near_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return _documents(docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go; documents stay."""
    return _documents(substring_dedup(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near), ("substring_dedup", passages), ("packing", pack)]

#: No SQL: fingerprints, MinHash and the tokenizer are outside it. tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each over all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
