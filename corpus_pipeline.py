"""Corpus pipeline: documents in, packed training sequences out. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import decontam, line_chunks, near_copies, packing, quality
from ledgerflow.llm.common import drop_shuffles, forget, numbered, stored

TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text is rejected; repeated rows are judged alike; an empty table gives an empty result, as in every stage.
    """
    return quality.passing(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without line chunks that an earlier document has; n_chars is that of what is left.

    A null id counts as the largest, a null text stays null; repeated rows stay alike.
    """
    plain, names = numbered(docs)
    found = line_chunks.remove_repeated_chunks(plain, f"c{names.index('doc_id')}", f"c{names.index('text')}")
    chars = F.length(f"c{names.index('text')}").cast("long")
    return found.select(*[(chars if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: Jaccard similarity of five-word shingles 0.8 or more, compared exactly.

    The smallest id stays, a null id counts as the largest; of repeated rows one stays; texts without words are copies of each other.
    """
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts are clean; repeated rows are judged alike."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per training sequence: doc_ids and lengths of its pieces, n_tokens, ids.

    A null or empty text is the end id alone; repeated rows are packed as often as they are there, null ids as null.
    """
    return packing.packed_sequences(packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY, special=True)[1])


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]
#: Tokenizing, hashing and packing have no SQL form; tests/llm/test_pipeline.py compares every stage and the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        forget(*done)  # what the stage has read
        done = [docs]
        drop_shuffles(spark)
    return docs
