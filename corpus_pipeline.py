"""A training-data pipeline over ``documents``: each stage calls one operator
of ``fuzzrule.llm`` on all that its predecessor kept.

Stages take (spark, docs, sf_dir).  All but the last return the columns of
``documents``; the last returns the segments of the packed token rows.
``run`` writes each stage's result as Parquet in the shared folder and reads
it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fuzzrule.llm.common import read_table, written
from fuzzrule.llm.decontaminate import drop_contaminated
from fuzzrule.llm.mixing import sample_documents
from fuzzrule.llm.ngram_join import drop_near_copies
from fuzzrule.llm.packing import packed_segments
from fuzzrule.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier does not reject."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies: a Jaccard
    of at least 0.8 on five-word shingles."""
    return drop_near_copies(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the probabilities of the raked mix."""
    return sample_documents(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token rows: a row per segment, read back from the shards."""
    return packed_segments(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_packing),
]

# learned scores and tokenizer ids have no SQL form; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of all stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage_{i + 1}")
    return docs
