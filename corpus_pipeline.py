"""Corpus preparation: language, repeated lines, near copies, benchmark leaks, tokens.

``STAGES`` are run in order, each over all that the stage before kept, written as Parquet and read
again. No stage needs ids that differ: repeated rows are treated alike, unless a stage says which of
equal rows stays. Rows without an id are copies of nothing and hold nothing, so they stay if their language does. Every stage but the last
returns the columns of ``documents``; a null text counts as empty, and all other columns pass as they
are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanwave import session
from spanwave.llm import bpe, decontaminate, language_id, line_dedup, near_dup
from spanwave.llm.storage import quoted, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts without letters and undecided ones go."""
    session.prepare(spark)
    return language_id.identify(docs).where("accepted").select(*[quoted(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them only."""
    session.prepare(spark)
    return line_dedup.dedup_lines(docs).select(*[quoted(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    session.prepare(spark)
    return near_dup.keep_one(docs).select(*[quoted(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = session.prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_leaks(docs, benchmark).select(*[quoted(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the bytes decoded from them."""
    session.prepare(spark)
    vocabulary = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(docs.select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    return bpe.digests(bpe.decode(encoded, vocabulary), keep_ids=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_copies),
    ("decontamination", leaks),
    ("byte_bpe", tokens),
]
#: Signatures, bit-parallel distances and byte pairs are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    _, step = STAGES[-1]
    return step(spark, docs, sf_dir)
