"""Profiles of merged cells equal those of all messages, and both equal a plain computation."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.operators import partials
from inkgauge.operators import profiles as P
from inkgauge.sources import store

SCHEMA = "msg_id long, author string, recipients string, subject string, body string, sent timestamp"


@pytest.fixture(scope="module")
def mail():
    rng, rows = random.Random(3), []
    for i in range(300):
        to = ", ".join(rng.sample(["list@x.org"] * 3 + ["a@x.org", "b@x.org", "c@x.org"], rng.choice([1, 1, 2])))
        body = " ".join(rng.choice(["Hi Ana thanks", "Dear Bo please"]).split() + rng.choices(["word", "more", "so!", "then...", "well --"], k=rng.randrange(25)) + rng.choice(["best Lee", "cheers Mo", ""]).split())
        sent = rng.choice([None, *[datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 40) // 7 * 7) for _ in range(12)]])
        rows.append((i, rng.choice(["ann", "bo", "cy", None]), to, rng.choice(["Re: x", "x", None]), body, sent))
    return rows


def comparable(df):
    def value(v):
        if hasattr(v, "asDict"):
            return {k: value(x) for k, x in v.asDict().items()}
        return [value(x) for x in v] if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v

    return {r.address: value(r) for r in df.collect()}


def test_profiles(spark, mail):
    """Every figure of every profile, the global one's too, against numpy over the measured messages."""
    df = spark.createDataFrame(mail, SCHEMA).repartition(4)
    m = [r.asDict() for r in P.measured(df).collect()]
    got = comparable(partials.finished(partials.cells(P.measured(df)), top=3))
    assert set(got) == {a for r in m for a in r["addresses"]} | {"_global"}
    for address, p in got.items():
        rows = sorted((r for r in m if address == "_global" for _ in [0]), key=lambda r: r["msg_id"]) if address == "_global" else [r for r in m for a in r["addresses"] if a == address]
        times = sorted(r["sent"] for r in rows if r["sent"])
        series = {"words": [r["full_words"] for r in rows], "own_words": [r["own_words"] for r in rows], "gap_days": [(b - a).total_seconds() / 86400 for a, b in zip(times, times[1:], strict=False)]}
        series |= {k: [r[k] for r in rows if r[k] is not None] for k in P.RATES}
        for name, xs in series.items():
            want = {"mean": np.mean(xs), "median": np.percentile(xs, 50), "p10": np.percentile(xs, 10), "p90": np.percentile(xs, 90), "std": np.std(xs)}
            assert all(math.isclose(p[name][k], v, abs_tol=1e-6) for k, v in want.items()), (address, name, p[name], want)
        hours, days = [r["hour"] for r in rows if r["hour"] is not None], [r["day"] for r in rows if r["day"] is not None]
        assert np.allclose(p["hours"], [hours.count(h) / len(hours) for h in range(24)]) and np.allclose(p["days"], [days.count(d) / len(days) for d in range(7)])
        replies = [r["reply"] for r in rows if r["reply"] is not None]
        assert math.isclose(p["reply_rate"], sum(replies) / len(replies), abs_tol=1e-9) and p["n_sends"] == len(rows) and p["is_known"] == (len(rows) >= 3)
        assert (p["first_seen"], p["last_seen"]) == (times[0], times[-1])
        for name, c in (("greetings", "opens"), ("closings", "closes")):
            held = [(r[c], r["msg_id"]) for r in rows if r[c]]
            want = sorted({x for x, _ in held}, key=lambda x: (-sum(y == x for y, _ in held), min(i for y, i in held if y == x), x))[:3]
            assert [(x["phrase"], x["n"]) for x in p[name]] == [(x, sum(y == x for y, _ in held)) for x in want]


def test_halves_merge(spark, mail):
    """Cells of halves that interleave in time merge into those of all; nothing goes through a single partition."""
    df = spark.createDataFrame(mail, SCHEMA).repartition(4)
    cells = lambda rows: partials.cells(P.measured(rows))
    whole, halves = cells(df), partials.merged(cells(df.where("msg_id % 2 = 0")), cells(df.where("msg_id % 2 = 1")))
    assert sorted(map(str, whole.collect())) == sorted(map(str, halves.select(whole.columns).collect()))
    assert comparable(partials.finished(whole)) == comparable(partials.finished(halves))
    for made in (whole, partials.gap_cells(whole), partials.spreads(whole.where("measure = 'words'"))):
        assert "SinglePartition" not in made._jdf.queryExecution().toString()


def test_new_mail_alone(spark, mail, tmp_path):
    """Batches that overlap, come again, or hold a message twice add each message once; a lost write adds none."""
    at = f"file://{tmp_path}/cells"
    df = spark.createDataFrame(mail, SCHEMA)
    assert partials.add_mail(df.where("msg_id < 200"), at, P.measured) == {"new": 200, "known": 0}
    assert partials.add_mail(df.where("msg_id >= 100").union(df.where("msg_id = 250")), at, P.measured) == {"new": 100, "known": 100}
    assert partials.add_mail(df, at, P.measured) == {"new": 0, "known": 300}
    assert comparable(partials.kept(spark, at)) == comparable(partials.finished(partials.cells(P.measured(df))))
    assert store.load(spark, at).where("measure = 'seen'").count() == 300


def test_build_all(spark, mail, tmp_path):
    df, at = spark.createDataFrame(mail, SCHEMA), f"file://{tmp_path}/cells"
    users = spark.createDataFrame([("ann", 1), ("bo", 1), ("new", 2), ("few", 2)], "author string, tenant_id long")
    extra = spark.createDataFrame([(1000, "few", "a@x.org", "s", "hello there you two", datetime(2024, 1, 1))], SCHEMA)
    out, counts = partials.build_all(df.union(extra), users, at, P.measured, least=10, at="2024-02-01")
    rows = {r.author: r for r in out.collect()}
    assert {a: r.cpp_status for a, r in rows.items()} == {"ann": "ready", "bo": "ready", "few": "skipped", "new": "pending"}
    assert rows["ann"].profile.words.mean > 0 and rows["few"].profile is None and rows["few"].n_messages == 1
    assert counts == {"new": 301, "known": 0, "ready": 2, "skipped": 1, "pending": 1}
    assert sum(1 for r in mail if r[1] == "ann") == rows["ann"].n_messages
    again, counts = partials.build_all(df, users, at, P.measured, least=10)
    assert counts["new"] == 0 and {r.author: r.n_messages for r in again.collect()}["ann"] == rows["ann"].n_messages
    assert rows["ann"].built_at is not None and F is not None
