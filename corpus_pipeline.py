"""A training corpus from documents: five stages, each written and read again as the next one's input.

Every stage takes an empty table and gives an empty one, and passes on columns that it does not use, whatever their names.
Rows without a text, or without a letter in it, end at the first stage; the others keep nulls in any other column. Rows that repeat an id are judged each by its own
text, but for near_duplicates, where an id stands for one document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontam, jaccard, langid, secret_scan
from tessella.llm.common import delete, shared_dir, table, workspace
from tessella.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized; those rejected go, null and letterless texts among them."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id, once. Rows with a null id all stay."""
    return jaccard.distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item. An item of fewer words than a window is no passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars brought up to date; a null text stays null."""
    return secret_scan.redact(docs, secret_scan.fit(docs), count_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(bpe.encode_decode(docs, *tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Learned models, whole-corpus links and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote goes once the next one's result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        with workspace(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
