"""Whole profiles, online verdicts and scans of any messages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import risk
from inkgauge.operators import profiles as P
from inkgauge.plans import portrait
from inkgauge.plans import profile_queries as Q
from inkgauge.streaming import live

SCHEMA = "msg_id long, author string, recipients string, subject string, body string, sent timestamp"


@pytest.fixture(scope="module")
def mail(spark):
    body = lambda i: f"Hi Ana,\n\nPlease send the quarterly report number {i} today. I think it's fine; thanks for the help.\n\nBest regards,\nLee"
    rows = [(i, "lee" if i % 3 else "mo", "ana@x.org", "Report", body(i), datetime(2024, 1, 1 + i)) for i in range(20)]
    rows += [(50, "lee", "ana@x.org", "Urgent", "buy gift cards now and keep this secret, my card is 4111 1111 1111 1111", datetime(2024, 2, 1)), (51, "new", "ana@x.org", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_build_profile(spark, mail):
    """One row, whose blocks are those of the queries over the messages as one writer's."""
    r = portrait.build_profile(mail, "lee").collect()
    assert len(r) == 1 and r[0].author == "lee" and r[0].corpus.total_messages == 22
    mine = mail.withColumn("author", F.lit("lee"))
    for block, query in portrait.SINGLE.items():
        df = query(spark, mine)
        assert r[0][block] == df.drop("author").first(), block
    for block in ("phrases", "greetings", "closings", "words"):
        df = portrait.LISTS[block](spark, mine).drop("author")
        assert sorted(map(str, r[0][block])) == sorted(map(str, df.collect())) and r[0][block], block
    empty = portrait.build_profile(mail.limit(0)).first()
    assert empty.vocabulary is None and empty.phrases == [] and empty.corpus.total_messages == 0
    assert Q is not None


def test_judged_online(spark, mail, tmp_path):
    """A stream's verdicts are those of the table: payload blocks, card numbers hold, unknown authors pass unknown."""
    profiles = P.author_profiles(mail.where("msg_id < 20"))
    policies = spark.createDataFrame([("mo", 0.0, 2.0)], "author string, warn double, hold double")
    batch = {r.msg_id: (r.payload, r.sensitive_action, r.score, r.verdict) for r in live.judged(mail, profiles, policies, block_at=0.3).collect()}
    assert {r.msg_id: r.verdict for r in live.judged(mail.where("msg_id = 50"), profiles).collect()}[50] in ("warn", "hold")
    assert batch[50][3] == "block" and batch[50][1] in ("warn", "hold") and batch[51][3] == "unknown" and batch[3][3] == "warn" and batch[1][3] == "pass"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    mail.write.parquet(source)
    live.judged(spark.readStream.schema(mail.schema).parquet(source), profiles, policies, block_at=0.3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.msg_id: (r.payload, r.sensitive_action, r.score, r.verdict) for r in spark.read.parquet(out).collect()} == batch


def test_scan_sensitive(spark, mail):
    rows = {r.msg_id: r for r in risk.scan_sensitive(mail).collect()}
    assert rows[50].matches[0].pattern_type == "credit_card" and rows[50].matches[0].redacted.endswith("1111") and rows[50].scan.has_sensitive_data
    assert not rows[51].scan.has_sensitive_data and rows[1].matches == []
    assert risk.scan_sensitive(mail, subject=None, min_confidence="high").where("scan.has_sensitive_data").count() <= 1
