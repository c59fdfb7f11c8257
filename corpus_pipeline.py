"""From raw documents to packed training sequences.

Each stage calls one corpus operator on all that its predecessor kept; its result is written as Parquet and read
back as the next one's documents. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, line_dedup, packing, quality, simhash
from tidemark.llm.common import table, written
from tidemark.sources.tables import Scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.good_documents(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources go from all documents but their first; documents left with nothing go."""
    return line_dedup.with_lines_left(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    return simhash.without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there."""
    return packing.op8_differencing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Robust estimates, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes on its way goes when its result is written, and that when the next
    one's is; what the last stage reads and writes stays until the session ends."""
    docs, before = table(spark, sf_dir, "documents"), Scope()
    *others, (_, last) = STAGES
    for k, (name, stage) in enumerate(others):
        own, kept = Scope(), Scope()
        with own:
            out = stage(spark, docs, sf_dir)
        with kept if k < len(others) - 1 else nullcontext():
            docs = written(out, f"stage-{name}")
        own.close()
        before.close()
        before = kept
    return last(spark, docs, sf_dir)
