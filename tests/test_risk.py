"""Golden cases of the payload scanner, the composer and the checksums."""

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import risk
from inkgauge.functions import text as T

COMPOSED = [
    (0.0015, 0.20, 0.0, "pass", 0.150, "clean"), (0.0015, 0.85, 0.0, "flag", 0.605, "context_high"), (0.0050, 0.20, 0.0, "pass", 0.288, "clean"), (0.0050, 0.80, 0.0, "flag", 0.653, "context_high"),
    (0.0300, 0.20, 0.0, "block", 0.904, "style_high"), (0.0015, 0.20, 0.9, "block", 0.900, "dlp_hit"), (0.0050, 0.20, 0.9, "block", 0.900, "dlp_hit"), (0.3000, 0.20, 0.0, "block", 1.000, "style_high"),
]


def test_composer(spark):
    df = spark.createDataFrame([c[:3] for c in COMPOSED], "s double, x double, d double")
    got = df.select("s", "x", "d", risk.compose(F.col("s"), F.col("x"), F.col("d")).alias("v")).collect()
    by = {(r.s, r.x, r.d): r.v for r in got}
    for s, x, d, verdict, composite, reason in COMPOSED:
        v = by[s, x, d]
        assert (v.verdict, v.reason) == (verdict, reason)
        assert v.composite == pytest.approx(composite, abs=6e-4)


def test_payload(spark):
    cases = [("lunch on friday?", 0.0), ("please answer asap", 0.1), ("buy gift cards now, asap, keep this quiet", 0.895), ("send the team roster", 0.7), ("reset your password", 0.75)]
    df = spark.createDataFrame(cases, "t string, expected double").withColumn("h", risk.payload_hits(F.col("t")))
    for r in df.select("t", "expected", risk.payload_score(F.col("h")).alias("s")).collect():
        assert r.s == pytest.approx(r.expected, abs=1e-6), r.t


def test_checksums(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", True), ("4111111111111112", False), ("0", False)], "v string, ok boolean")
    assert all(r.ok == r.g for r in df.select("ok", risk.luhn(F.col("v")).alias("g")).collect())
    df = spark.createDataFrame([("021000021", True), ("021000022", False), ("12", False)], "v string, ok boolean")
    assert all(r.ok == r.g for r in df.select("ok", risk.aba(F.col("v")).alias("g")).collect())


def test_sensitive_summary(spark):
    text = "My ssn: 123-45-6789 and card 4111 1111 1111 1111."
    r = spark.createDataFrame([(text,)], "t string").select(risk.sensitive_summary(risk.sensitive_matches(F.col("t"))).alias("s")).first().s
    assert (r.total_matches, r.highest_confidence, r.recommended_action) == (2, "high", "hold")


def test_text_traps(spark):
    r = spark.createDataFrame([("one two",)], "t string").select(T.ngrams(T.words(F.col("t")), 3).alias("g"), T.last(T.words(F.col("t")), 3).alias("l"), T.occurrences(F.col("t"), "o").alias("o")).first()
    assert r.g == [] and r.l == ["one", "two"] and r.o == 2


def test_cleaners(spark):
    body = "Hello\n> quoted\nFrom: x\nmail me at a@b.co\n--\nname"
    r = spark.createDataFrame([(body,)], "t string").select(T.strip_artifacts(F.col("t")).alias("s"), T.strip_replies(F.lit("a\nOn Monday Lee wrote:\nb")).alias("r"), T.html_spaced(F.lit("<div>a<br>b</div>")).alias("h")).first()
    assert r.s == "Hello\nmail me at _EMAIL_" and r.r == "a" and r.h == "a b"
