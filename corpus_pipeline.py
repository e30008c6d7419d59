"""The corpus pipeline: rejects toxic documents, keeps one of each near-duplicate group, takes benchmark passages out,
samples to target weights, and writes the rest as token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents (doc_id,
text, lang, source, n_chars), whatever else docs has, in any order of rows.  A stage decides on its own input alone.

Defined cases, for every stage: an empty table gives an empty one; null or empty texts are rows like any other (clean,
one near-duplicate group together, never contaminated, one token of weight); rows without doc_id stay rows; columns
whose names differ in case only are told apart by exact spelling.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, queries, simhash, token_binary, toxicity
from graphloom.llm._common import discard, stored_alone, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects, those with score 0.5 or more; repeated rows fare alike.

    It learns from docs and labels whose crc32(doc_id) mod 5 is not 0; without toxic ones among them nothing is rejected.
    """
    return toxicity.without_toxic(docs, toxicity.train_held_out(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest doc_id, one without only if all lack it; a row of it."""
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents, a twentieth or more of whose words is hit; the others lose their hit words, and n_chars follows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled by probabilities whose expected tokens have the target shares of languages, topics and sources; one choice per doc_id."""
    return mixing.sampled(docs, queries.mixing_targets())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the rest, read back: a row per document (doc_id, start, n_tokens, ids_crc32) in ascending doc_id order."""
    return token_binary.token_binary(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark_passages), ("mixing", mixture), ("token_binary", tokens)]

#: SQL can't express the learned model, fingerprints by XXH64 or the tokenizer; tests hold each stage and run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written as Parquet and read as the next one's input.

    What a stage has left in the shared folder is deleted once its result is written, and that once the next one's is.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, last = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
