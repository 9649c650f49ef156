"""Corpus pipeline: toxic documents go, one document of each group of near copies stays, live secrets are masked, and
what is left is packed into training sequences.

Each stage is (name, function of (spark, docs, sf_dir)); what a stage returns is written and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm.common import lasting, own_name, scope, semi_join, table, written
from inkgauge.llm.jaccard import near_duplicates
from inkgauge.llm.packing import pack_documents
from inkgauge.llm.secret_scan import mask_live_secrets
from inkgauge.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it learns from the labelled ones among docs.

    Null and empty texts aren't rejected; without labels of both classes all documents stay.
    """
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("not is_toxic").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once; one without id only if none has one.

    Rows are told apart by a number of their own, so ids may be null or repeat: different texts under one id all stay.
    Documents without words have no links and all stay.
    """
    with scope(spark):
        row = own_name(docs, "__row")
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
        linked = near_duplicates(numbered, row).join(numbered.select(row, "doc_id"), row)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first")
        keep = linked.groupBy("component_id").agg(first, F.count("*").alias("n")).where("n > 1").select("component_id", F.col(f"first.{row}").alias("__kept"))
        keep = written(keep)  # groups of one need no decision
        go = linked.select(row, "component_id").join(keep, "component_id").where(F.col(row) != F.col("__kept"))
        return lasting(semi_join(numbered, written(go.select(row)), row, anti=True).select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; credentials that look live are overwritten in their texts, n_chars follows. Null texts stay null."""
    clean = mask_live_secrets(docs)
    n = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return clean.withColumn("n_chars", n) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 4096 tokens; a null or empty text is one end token."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]
#: Trained models and shingle sets aren't within SQL's reach; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scope(spark):
        for k, (_, stage) in enumerate(STAGES):
            docs = (written if k + 1 < len(STAGES) else lasting)(stage(spark, docs, sf_dir))
    return docs
