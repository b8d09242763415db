"""A training corpus from raw documents: quality, toxicity, near copies, benchmark leaks, packing.

Every stage is a function of (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealis.llm import decontamination, packing, quality, simhash, toxicity
from arealis.llm.common import stored
from arealis.llm.queries import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source."""
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples do not make them toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"),
                        ranks=vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_copies", near_copies_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # SQL can state neither the nearest neighbours' votes nor the fingerprints


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
