"""Profiles kept by a stream equal those of a table, over restarts, batches of several Arrow parts, and days that fall out."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkgauge.streaming import dual

START = datetime(2024, 1, 1)
SCHEMA = "author string, id long, sent timestamp, words double"


def plain(rows, days):
    out = {}
    for a, i, t, x in rows:
        if a is None or t is None or x is None:
            continue
        before = [(tt, xx) for aa, ii, tt, xx in rows if aa == a and tt is not None and xx is not None and (tt, ii) < (t, i)]
        day = lambda tt: (tt - START).days
        sides = []
        for xs in ([xx for _, xx in before], [xx for tt, xx in before if day(tt) > day(t) - days]):
            mean = sum(xs) / len(xs) if xs else None
            spread = math.sqrt(max(sum(v * v for v in xs) / len(xs) - mean * mean, 0)) if xs else None
            sides += [len(xs), mean, None if mean is None else (x - mean) / spread if spread else 0.0]
        out[i] = (*sides, len(before) >= dual.KNOWN)
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for i, values in got.items():
        for a, b in zip(values, expected[i], strict=True):
            assert a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)), (i, values, expected[i])


@pytest.fixture(scope="module")
def mail():
    rng, rows, t = random.Random(1), [], START
    for i in range(700):
        t += timedelta(hours=rng.choice([0, 1, 5, 30]))
        rows.append((rng.choice(["hot"] * 6 + ["b", "c", None]), i, rng.choice([t] * 30 + [None]), rng.choice([None] + [float(rng.randrange(50))] * 20)))
    return rows


def values(df):
    return {r.id: (r.n_life, r.mean_life, r.z_life, r.n_recent, r.mean_recent, r.z_recent, r.known) for r in df.collect()}


def test_batch(spark, mail):
    same(values(dual.dual_profiles_batch(spark.createDataFrame(mail, SCHEMA).repartition(4), "author", "id", "sent", "words", 20)), plain(mail, 20))


def test_stream(spark, mail, tmp_path):
    """Seven files, three queries one after the other; parts of ten rows in Arrow."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    dual.with_rocks(spark)
    try:
        for part in range(3):
            piece = mail[part * 250 : (part + 1) * 250]
            for k in range(2):
                spark.createDataFrame(piece[k * 125 : (k + 1) * 125], SCHEMA).coalesce(1).write.mode("append").parquet(source)
                stream = dual.dual_profiles(spark.readStream.schema(SCHEMA).parquet(source), "author", "id", "sent", "words", 20)
                stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    found = spark.read.parquet(out)
    assert found.count() == len(plain(mail, 20))
    same(values(found), plain(mail, 20))
    assert found.where(F.col("n_recent") < F.col("n_life")).count() > 100


def test_silent_sender(spark, tmp_path):
    """A sender's days go once the watermark is past them; the lifetime stays."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    day = lambda d: START + timedelta(days=d)
    dual.with_rocks(spark)
    for rows in ([("a", 1, day(0), 10.0), ("a", 2, day(0), 20.0)], [("b", 3, day(60), 1.0)], [("b", 4, day(61), 1.0)], [("a", 5, day(62), 30.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        dual.dual_profiles(spark.readStream.schema(SCHEMA).parquet(source), "author", "id", "sent", "words", 20).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = values(spark.read.parquet(out))
    assert got[5][:2] == (2, 15.0) and got[5][3:6] == (0, None, None)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
