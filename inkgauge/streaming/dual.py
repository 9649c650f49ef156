"""Two profiles of every sender as messages come: over a lifetime, and over the last days; each message against both.

State of a sender is one row of sums, and one of sums for each of the last days. A message is held against what was known before
it: earlier batches, and the earlier messages of its own. Timers drop the days of senders that fall silent; lifetimes stay.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAYS, KNOWN = 90, 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
VALUES = ["n_life", "mean_life", "z_life", "n_recent", "mean_recent", "z_recent"]


def z_scores(x: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and deviations from it by the population's deviation; null where nothing is known, 0 where nothing deviates."""
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, total / n, np.nan)
        spread = np.sqrt(np.maximum(squares / n - mean * mean, 0))
        z = np.where(n > 0, np.where(spread > 0, (x - mean) / spread, 0.0), np.nan)
    return mean, z


class DualProfile(StatefulProcessor):
    """Rows of a sender: row_id, row_at (milliseconds), row_x (names that a named tuple can have). What comes in several Arrow batches is put in order as a whole; of a row 24 bytes are held."""

    def __init__(self, days: int, schema: str):
        self.days, self.schema = days, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "n bigint, total double, squares double")
        self.recent = handle.getValueState("recent", "day array<int>, n array<bigint>, total array<double>, squares array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [b for b in rows if len(b)]
        if not parts:
            return
        rows = pd.concat([b[["row_id", "row_at", "row_x"]] for b in parts]).sort_values(["row_at", "row_id"], kind="stable")
        x = rows["row_x"].to_numpy(float)
        day = (rows["row_at"].to_numpy(np.int64) // DAY_MS).astype(np.int64)
        n0, t0, s0 = self.life.get() if self.life.exists() else (0, 0.0, 0.0)
        before = lambda v: np.r_[0, np.cumsum(v)]
        count, total, squares = np.arange(len(x) + 1), before(x), before(x * x)
        life = n0 + count[:-1], t0 + total[:-1], s0 + squares[:-1]

        held = [np.array(c, float) for c in self.recent.get()] if self.recent.exists() else [np.zeros(0)] * 4
        # days after day - DAYS: of those held from earlier batches, and of this batch from the first such row on
        first, start = np.searchsorted(held[0], day - self.days, "right"), np.searchsorted(day, day - self.days, "right")
        last = np.searchsorted(held[0], day, "right")
        recent = [h[last] - h[first] + own[:-1] - own[start] for h, own in zip(map(before, held[1:]), (count, total, squares), strict=True)]

        self.life.update((int(n0 + len(x)), float(t0 + total[-1]), float(s0 + squares[-1])))
        days = np.unique(np.r_[held[0].astype(np.int64), day])
        days = days[days > day[-1] - self.days]
        added = [np.bincount(np.searchsorted(days, day[day >= days[0]]), v[day >= days[0]], len(days)) for v in (np.ones(len(x)), x, x * x)]
        kept = held[0] >= days[0]
        at = np.searchsorted(days, held[0][kept])
        for a, h in zip(added, held[1:], strict=True):
            np.add.at(a, at, h[kept])
        self.recent.update((days.tolist(), added[0].astype(int).tolist(), added[1].tolist(), added[2].tolist()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((days[-1] + self.days) * DAY_MS))

        mean, z = z_scores(x, *life)
        mean_recent, z_recent = z_scores(x, *recent)
        out = pd.DataFrame({"sender": key[0], "id": rows["row_id"].to_numpy(), "n_life": life[0], "mean_life": mean, "z_life": z, "n_recent": recent[0].astype(np.int64), "mean_recent": mean_recent, "z_recent": z_recent})
        out["known"] = out["n_life"] >= KNOWN
        yield out.astype({c: object for c in VALUES if c[0] in "mz"}).where(out.notna(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # every one of its days lies behind the watermark by the whole window
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def dual_profiles(stream: DataFrame, sender: str, id_col: str, time_col: str, value: str, days: int = DAYS, late: str = "1 day") -> DataFrame:
    """sender, id, n_life, mean_life, z_life, n_recent, mean_recent, z_recent, known of every message.

    n and mean are of the sender's messages before this one, by time and id: all of them, and those of this day and the days - 1 days
    before it. z is the message's distance from the mean in deviations; mean and z are null for a first message. known says whether there were
    KNOWN before. Rows without sender, time or value take no part; rows that come later than late behind the latest time go.
    The session's state store must be RocksDB (with_rocks).
    """
    kind = stream.schema[sender].dataType.simpleString(), stream.schema[id_col].dataType.simpleString()
    schema = f"sender {kind[0]}, id {kind[1]}, n_life bigint, mean_life double, z_life double, n_recent bigint, mean_recent double, z_recent double, known boolean"
    at = F.col(time_col).cast("timestamp")
    rows = stream.select(F.col(sender).alias("row_key"), F.col(id_col).alias("row_id"), at.alias("row_time"), F.unix_millis(at).alias("row_at"), F.col(value).cast("double").alias("row_x")).where("row_key is not null and row_time is not null and row_x is not null")
    return rows.withWatermark("row_time", late).groupBy("row_key").transformWithStateInPandas(DualProfile(days, schema), schema, "Append", "EventTime")


def with_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def dual_profiles_batch(rows: DataFrame, sender: str, id_col: str, time_col: str, value: str, days: int = DAYS) -> DataFrame:
    """The same over a table, by running totals that a frequent sender's parts share, and a point-in-time join with the totals before the window."""
    from ..operators.asof import as_of
    from ..operators.running import running

    at = F.col(time_col).cast("timestamp")
    src = rows.select(F.col(sender).alias("sender"), F.col(id_col).alias("id"), at.alias("at"), F.col(value).cast("double").alias("x")).where("sender is not null and at is not null and x is not null")
    totals = {"n_life": ("sum", F.lit(1).cast("long")), "t": ("sum", F.col("x")), "s": ("sum", F.col("x") * F.col("x"))}
    life = running(src, "sender", [F.col("at"), F.col("id")], totals, {"id": F.col("id"), "at": F.col("at"), "x": F.col("x")}, inclusive=False)
    life = life.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_life", "t", "s")})
    # totals up to and with each day, taken where the window begins
    daily = src.groupBy("sender", F.to_date("at").alias("day")).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    ended = running(daily, "sender", [F.col("day")], {"dn": ("sum", F.col("n")), "dt": ("sum", F.col("x")), "ds": ("sum", F.col("xx"))}, {"ended": F.col("day").cast("timestamp")})
    edge = life.withColumn("edge", F.date_sub(F.to_date("at"), days).cast("timestamp"))
    both = as_of(edge, ended, ["sender"], "edge", "ended").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dn", "dt", "ds")})
    both = both.withColumns({"n_recent": F.col("n_life") - F.col("dn"), "rt": F.col("t") - F.col("dt"), "rs": F.col("s") - F.col("ds")})

    def held(n: str, t: str, s: str, name: str) -> list:
        mean = F.col(t) / F.nullif(F.col(n), F.lit(0))
        spread = F.sqrt(F.greatest(F.col(s) / F.nullif(F.col(n), F.lit(0)) - mean * mean, F.lit(0.0)))
        return [mean.alias(f"mean_{name}"), F.when(F.col(n) > 0, F.when(spread > 0, (F.col("x") - mean) / spread).otherwise(0.0)).alias(f"z_{name}")]

    return both.select("sender", "id", "n_life", *held("n_life", "t", "s", "life"), "n_recent", *held("n_recent", "rt", "rs", "recent"), (F.col("n_life") >= KNOWN).alias("known"))
