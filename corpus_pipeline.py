"""From raw documents to packed training sequences: quality, near-duplicates, decontamination, packing.

STAGES: (name, function) of (spark, docs, sf_dir); each gets what its predecessor kept, from Parquet. All but the last
return the columns of documents, extra ones too. Null texts are judged as empty ones, are alike, hold no benchmark item and
pack as one piece; rows with null or repeated ids are documents like others (of equal text and id one stays); an empty table
passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import decontaminate, packing, quality, similar
from stepweave.llm.common import load, written
from stepweave.plans.lineage import mark, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the ordinal classifier finds good; it is fitted to the labelled ones among docs."""
    return quality.select(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more. SimHash links by anchors come first, each held against the texts; then an exact search finds every pair that they leave."""
    return similar.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token sequences of what is left: pieces with their token ids and places; packing.sequences joins them."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES = [("quality classifier", quality_stage), ("simhash near-dedup", dedup_stage), ("benchmark decontamination", decontamination_stage), ("best-fit packing", packing_stage)]
#: The classifier and the packing are not expressible in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since = mark(spark)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
            release(spark, since, docs)
    return docs
