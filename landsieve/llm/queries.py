"""Registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsieve.llm.automaton import encode_decode
from landsieve.llm.common import default_tokenizer, table, word_tokenizer
from landsieve.llm.hard_negatives import mine
from landsieve.llm.histogram_packing import pack_histogram
from landsieve.llm.hmm import score_documents
from landsieve.llm.html_text import page_texts
from landsieve.llm.line_dedup import summary
from landsieve.llm.manifest import manifest, tampered_fifth
from landsieve.llm.near_dedup import near_duplicates
from landsieve.llm.packing import pack_documents
from landsieve.llm.quality import verdicts
from landsieve.llm.secrets import digest, find_secrets
from landsieve.llm.separator_scan import document_token_counts
from landsieve.llm.top_k import embedding_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@query
def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("first")


@query
def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


@query
def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


@query
def op4_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_top_k(table(spark, sf_dir, "embeddings"))


@query
def op7_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_tokenizer())


@query
def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents"), default_tokenizer())


@query
def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered_fifth(F.col("doc_id")))


@query
def op12_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


@query
def op13_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_histogram(table(spark, sf_dir, "documents"), word_tokenizer())
