"""Messages that the queries read, and the SQL of them: documents stand in for mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded_as_sql(x: Column, places: int = 6) -> Column:
    """x rounded as the SQL's engine does it: x times ten to the places, half away from zero.

    F.round goes by the decimal digits, so that the engines part where x is within a bit of a tie, as shares of rounded scores often are.
    """
    scale = 10.0**places

    def part(v: Column) -> Column:
        whole = F.floor(F.abs(v) * scale).cast("double")
        up = F.when(F.abs(v) * scale - whole >= 0.5, 1.0).otherwise(0.0)
        return F.when(F.abs(v) * scale < 2.0**52, F.signum(v) * (whole + up) / scale).otherwise(v)

    return F.get(F.transform(F.array(x), part), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores if its tasks would be fewer: a small file is one task, whatever is computed of its texts.

    Large files are split by the reader and stay as they are, however few they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def messages(spark: SparkSession, sf: str | DataFrame) -> DataFrame:
    """msg_id, author, recipients, subject, body, sent. In place of a folder sf may be messages that are at hand.

    Documents have no recipients, subjects and times. Their language stands for the recipient, every fourth answers, and
    a time follows from the number.
    """
    if isinstance(sf, DataFrame):
        return sf
    sent = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 500000 * 37 as int))")
    subject = F.concat(F.when(F.col("doc_id") % 4 == 0, "Re: ").otherwise(""), F.coalesce("source", F.lit("")))
    return spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text")).select(F.col("doc_id").alias("msg_id"), F.col("source").alias("author"), F.concat(F.coalesce("lang", F.lit("xx")), F.lit("@example.org")).alias("recipients"), subject.alias("subject"), F.coalesce("text", F.lit("")).alias("body"), sent.alias("sent"))


MESSAGES = "msgs AS (SELECT doc_id AS msg_id, source AS author, coalesce(lang, 'xx') || '@example.org' AS recipients, CASE WHEN doc_id % 4 = 0 THEN 'Re: ' ELSE '' END || coalesce(source, '') AS subject, coalesce(text, '') AS body, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 500000 * 37 AS BIGINT)) AS sent FROM documents)"
