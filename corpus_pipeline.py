"""A corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, BPE.

Each stage works on all rows its predecessor kept.  All stages but the last return the columns of documents.  Null texts fail
the quality rules; of rows that repeat, with or without ids, one stays as of other near-duplicates; an empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession

from recurra.llm import bpe, difference_cover, mixing, quality, signature_tree
from recurra.llm.queries import documents, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_quality(docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by shingles of five words with a similarity of 0.8 or more."""
    return signature_tree.keep_one(docs, 5, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that occur twice."""
    return difference_cover.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of their sources."""
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, in the order of the mix."""
    return bpe.encode(docs, tokenizer_path(), digests=True, remember=250_000)


STAGES = [("quality rules", keep_good), ("n-gram Jaccard join", keep_one_of_group), ("suffix-array dedup", cut_repeats), ("mixing", mix), ("BPE", encode)]

#: Expectation-maximisation and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
