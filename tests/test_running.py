"""Running totals and point-in-time joins against plain loops, with keys that span many parts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkgauge.operators.asof import as_of
from inkgauge.operators.running import running


@pytest.fixture
def parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, parts, inclusive):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), i, rng.randrange(1000), rng.choice([None, None, i])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, x long, v long").repartition(5)
    got = {r.t: (r.n, r.x, r.v) for r in running(df, "k", [F.col("t")], {"n": ("sum", F.col("x")), "x": ("xor", F.col("x")), "v": ("last", F.col("v"))}, {"t": F.col("t")}, inclusive=inclusive).collect()}
    state, expected = defaultdict(lambda: (0, 0, None)), {}
    for k, t, x, v in rows:
        n, y, last = state[k]
        state[k] = (n + x, y ^ x, last if v is None else v)
        expected[t] = state[k] if inclusive else (n, y, last)
    assert {t: (n or 0, x or 0, v) for t, (n, x, v) in got.items()} == expected


@pytest.mark.parametrize("strict", [True, False])
def test_as_of(spark, parts, strict):
    """One key holds most rows; equal times, repeated rows, nulls and keys of one side only."""
    rng = random.Random(2)
    left = [(i // 2, rng.choice(["hot"] * 8 + ["b", "left", None]), rng.choice([None, *range(100)])) for i in range(500)]
    right = [(rng.choice(["hot"] * 5 + ["b", "right", None]), rng.randrange(100), rng.randrange(5), "p") for _ in range(150)]
    at = lambda c: F.timestamp_seconds(c)
    ldf = spark.createDataFrame(left, "id long, k string, s long").withColumn("sent", at("s")).repartition(4)
    rdf = spark.createDataFrame(right, "k string, s long, version long, p string").withColumn("built", at("s")).select("k", "built", "version", "p")
    got = sorted((r.id, str(r.k), str(r.s), str(r.r_version)) for r in as_of(ldf, rdf, ["k"], "sent", "built", "r_", strict).collect())
    expected = []
    for i, k, s in left:
        held = [(t, v) for kk, t, v, _ in right if kk == k and k is not None and s is not None and (t < s if strict else t <= s)]
        expected.append((i, str(k), str(s), str(max(held)[1] if held else None)))
    assert got == sorted(expected)
    recent = as_of(ldf, rdf, ["k"], "sent", "built", "r_", strict, within="5 seconds").where("r_built is not null")
    assert recent.where("r_built < sent - interval 5 seconds").isEmpty() and 0 < recent.count() < ldf.count()
    with pytest.raises(ValueError, match="prefix"):
        as_of(ldf.withColumn("p", F.lit(1)), rdf, ["k"], "sent", "built")


def test_as_of_empty(spark):
    ldf = spark.createDataFrame([(1, "a", "2024-01-01")], "id long, k string, sent string").withColumn("sent", F.col("sent").cast("timestamp"))
    rdf = ldf.select("k", F.col("sent").alias("built")).limit(0)
    assert [tuple(r) for r in as_of(ldf, rdf, ["k"], "sent", "built").select("id", "built").collect()] == [(1, None)]
    assert as_of(ldf.limit(0), rdf, ["k"], "sent", "built").collect() == []
