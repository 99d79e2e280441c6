"""A training corpus in five stages: quality, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs, whatever
else these hold. An empty table gives an empty table in every stage; a null text counts as an empty one; texts are
used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import common, decontaminate, exact_dedup, near_copies, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go. Rows are judged one by one by their text, so equal
    texts share a verdict, and rows with a null doc_id are judged like others; without labels all stay."""
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks, the row with the most code points stays, then the one with the smallest
    doc_id, nulls last; of fully repeated rows one. Empty and null texts are equal to each other."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle similarities of 0.8 or more, the one with the smallest doc_id stays, nulls
    last; of fully repeated rows one. A text of under five words is one shingle, one without words an empty shingle."""
    return near_copies.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words (or the whole) of a benchmark item go. Items with a null id or without
    words match nothing; repeated rows share a verdict."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids. Each row is packed, a null doc_id stays null, and an empty
    text has its end id alone."""
    import public_tokenizers

    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", decontaminate_stage), ("pack", pack_stage)]

#: SQL can't express the classifier, XXH64 or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
