"""A training corpus from ``documents``: STAGES in order, each the work of one
operator over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return rows of ``documents`` unchanged, fewer of them.  ``run`` stores what
each stage returns in the shared folder and reads it again, as the next input.

Cases: columns beyond doc_id, text, lang and source pass through whatever their
names; null and empty texts, null ids, repeated rows and empty tables are as the
operators' docstrings say, and an empty table gives an empty result in each stage.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeweave.llm import exact_dedup, mixing, near_dedup, packing, quality  # noqa: E402
from codeweave.llm.common import Scratch  # noqa: E402
from codeweave.session import read_table, ship_code  # noqa: E402


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with names that no operator uses for its further columns, and the
    columns as they were."""
    own = {c: f"own_column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source")}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (probability of label 1 at least 0.7)."""
    ship_code(spark)
    inner, columns = _apart(docs)
    return quality.score(inner, read_table(spark, sf_dir, "labels")).where("predicted = 1").select(columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one with the smallest doc_id."""
    ship_code(spark)
    inner, columns = _apart(docs)
    return exact_dedup.drop_exact(inner).select(columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the one with the smallest doc_id."""
    ship_code(spark)
    inner, columns = _apart(docs)
    return near_dedup.drop_near(inner, shingle=5, percent=80).select(columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics are flatter than the corpus."""
    ship_code(spark)
    inner, columns = _apart(docs)
    return mixing.mix(inner, share=0.5).where("kept").select(columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    ship_code(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the packing; tests/llm holds the
#: rows of each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
