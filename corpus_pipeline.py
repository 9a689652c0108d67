"""The corpus pipeline: documents through five stages, each written and read again before the next.

Each stage has the defined results of its operator for nulls, empty and very long texts, ties, repeated rows, empty tables
and further columns: see the operator. What a stage has no decision for, such as rows without ``doc_id``, it keeps, up to
packing, which gives placements under a null id. An empty table passes through all stages and gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm.common import removed, shared_dir
from recordloom.llm.decontaminate import decontaminate
from recordloom.llm.linededup import line_dedup
from recordloom.llm.packing import pack
from recordloom.llm.quality import quality_rules
from recordloom.llm.simhash import near_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that are frequent on their host; rejected documents go. Null hosts are one host; rows without ``doc_id`` or text stay."""
    return quality_rules(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of passages; documents that were nothing else go. Rows without ``doc_id`` or text stay."""
    return line_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id, stays; so do rows without ``doc_id``, text or words."""
    return near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows without ``doc_id`` or text stay; with no items, all do."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. Texts without words have no row; a null id is packed as such."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The SimHash, Myers and packing stages can't be put in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table ``documents``. What a stage wrote goes when the next has been written; the last stays, for it is the result."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
