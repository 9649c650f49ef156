"""The batch expressions over streams: each message once, scored as it comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import risk
from ..operators import profiles as P


def once(stream: DataFrame, id_col: str, time_col: str, within: str = "1 day") -> DataFrame:
    """Rows whose id hasn't come within the time; state older than that goes."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([id_col])


def scored(stream: DataFrame, text_col: str, policies: DataFrame | None = None, key: str = "author") -> DataFrame:
    """Payload score and verdict of each message, with the thresholds of its sender where a policy table is given."""
    rows = stream.withColumn("hits", risk.payload_hits(F.col(text_col))).withColumn("score", risk.payload_score(F.col("hits")))
    if policies is not None:
        rows = rows.join(policies.select(key, "warn", "hold"), key, "left")
    else:
        rows = rows.withColumns({"warn": F.lit(None).cast("double"), "hold": F.lit(None).cast("double")})
    verdict = F.when(F.col("score") >= F.coalesce("hold", F.lit(0.55)), "hold").when(F.col("score") >= F.coalesce("warn", F.lit(0.35)), "warn").otherwise("pass")
    return rows.withColumn("verdict", verdict).drop("hits")


def judged(messages: DataFrame, profiles: DataFrame, policies: DataFrame | None = None, min_confidence: str = "medium", block_at: float = 0.9) -> DataFrame:
    """Each message with payload, sensitive_action, the deviations from its author's profile, score and verdict; of a stream or a table.

    profiles are author_profiles, policies have author, warn and hold. The verdict is that of score_messages (deviations,
    policy and sensitive data), and block where the payload's score is block_at or more. A map and joins with tables: no state.
    """
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    hits = messages.select("*", F.explode(F.array(risk.payload_hits(text))).alias("__hits"))
    rows = hits.select(*messages.columns, F.explode(F.array(risk.payload_score(F.col("__hits")))).alias("payload"))
    rows = risk.scan_sensitive(rows, min_confidence=min_confidence).withColumn("sensitive_action", F.col("scan.recommended_action"))
    scored_rows = P.score_messages(rows, profiles, policies, F.col("sensitive_action"), keep=["payload", "sensitive_action"])
    return scored_rows.withColumn("verdict", F.when(F.col("payload") >= block_at, "block").otherwise(F.col("verdict")))


def counts_by_hour(stream: DataFrame, time_col: str, key: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, "1 hour"), key).agg(F.count("*").alias("n"))


def with_known(stream: DataFrame, sender: str, recipient: str, time_col: str, known_after: int = 3, name: str = "is_known", count: str = "n_sends") -> DataFrame:
    """Adds the messages that the pair of sender and recipient has had so far, this one included, and whether they are enough.

    State is one number for each pair and is never dropped, so a pair stays known. A batch's messages of a pair count by
    time within each Arrow batch; a null sender or recipient is a value like any other.
    """
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + f", `{count}` bigint, `{name}` boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for b in batches:
            b = b.sort_values(time_col, kind="stable")
            b[count] = range(n + 1, n + len(b) + 1)
            b[name] = b[count] >= known_after
            n += len(b)
            yield b
        state.update((n,))

    return stream.groupBy(sender, recipient).applyInPandasWithState(run, out, "n bigint", "append", "NoTimeout")


def write_log(stream: DataFrame, path: str, checkpoint: str, time_col: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Appends a stream to the log at path, each batch sorted by time in a folder of its own (batch=<number>).

    A batch that runs again after a failure overwrites its folder, so that the log holds each row once. checkpoint lies in
    a folder that driver and executors share. Without every, what is there is taken and the query ends.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.orderBy(time_col).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()
