"""The corpus pipeline: quality rules, line and near-duplicate removal, secret removal, packing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from landsieve.llm.common import default_tokenizer, recorded, table
from landsieve.llm.line_dedup import without_repeats
from landsieve.llm.near_dedup import without_near_duplicates
from landsieve.llm.packing import pack_documents
from landsieve.llm.quality import clean
from landsieve.llm.secrets import mask_secrets
from landsieve.session import discard, materialize


#: Tables that the last stage wrote on its way.
_on_the_way: list[str] = []


def stage(fn):
    """A later stage starts when the one before is stored, so what that one wrote on its way can go."""
    @functools.wraps(fn)
    def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if fn.__name__ != STAGES[0][0]:
            for path in _on_the_way:
                discard(spark, path)
        _on_the_way.clear()
        with recorded(_on_the_way):
            return fn(spark, docs, sf_dir)

    return start


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return clean(docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows."""
    return without_repeats(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return without_near_duplicates(docs, width=5, percent=80)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return mask_secrets(docs)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every token piece of the documents that are left, in sequences of 1024 ids."""
    return pack_documents(docs, default_tokenizer())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Signatures and token ids can't be made in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = materialize(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
