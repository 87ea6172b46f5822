"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

A stage takes ``(spark, docs, sf_dir)`` and works on every document its predecessor kept. All but the last return the
columns of ``documents``; the last returns where each document is packed.

When a stage starts, the result of the one before has been written, so the tables that one staged for itself are deleted
(those that ``docs`` still reads are not) and its shuffle files are let go. Stages of one process run one after another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from isotherm.llm import lines, packing, quality, secret_scan, simhash
from isotherm.llm.common import table
from isotherm.session import delete_staged, discard, free_shuffles, materialize, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: tables that the last stage staged for itself
_staged: list[str] = []


def stage(work: Stage) -> Stage:
    """``work`` as a stage that first clears up after the one before."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _staged:
            read = docs.inputFiles()
            delete_staged(spark, [p for p in _staged if not any(p.rsplit("/", 1)[1] in f for f in read)])
            _staged.clear()
        free_shuffles(spark)
        with recorded() as paths:
            out = work(spark, docs, sf_dir)
        _staged.extend(paths)
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line are taken out of the texts."""
    return lines.dedup(docs, stored=True)


@stage
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


@stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secret_scan.mask_secrets(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its length bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: trained scores, fingerprints and the packing programme have no SQL twin; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, materialize(step(spark, docs, sf_dir), name.split()[0].lower(), "zstd")
        discard(before)  # the given table is none of ours and stays
    return STAGES[-1][1](spark, docs, sf_dir)
