"""Abbreviations are learnt from a corpus without labels, and sentences cut by them beat those cut at every mark."""

import random

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import text as T
from inkgauge.operators import sentences as S


@pytest.fixture(scope="module")
def corpus():
    """Messages with the places at which sentences truly end."""
    rng, out = random.Random(6), []
    words = ["report", "budget", "meeting", "invoice", "team", "plan", "client", "number", "review"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(2, 5)):
            w = [rng.choice(["The", "Our", "This"]), *rng.choices(words, k=rng.randint(2, 5))]
            if rng.random() < 0.6:
                w[2:2] = rng.choice([["Dr.", "Lee"], ["approx.", "40"], ["e.g.", "the", "plan"], ["Inc.", "and"], ["J.", "Smith"]])
            parts.append(" ".join(w) + rng.choice([".", ".", "!", "?"]))
        out.append(parts)
    return out


def test_learnt(spark, corpus):
    df = spark.createDataFrame([(" ".join(p),) for p in corpus], "body string")
    known = {r.word for r in S.abbreviations(S.period_counts(df)).collect()}
    assert {"dr", "approx", "e.g", "inc"} <= known and not known & {"report", "budget", "meeting", "team", "review"}
    begin = [r.word for r in S.starters(df).collect()]
    assert set(begin) == {"the", "our", "this"}
    got = [r.s for r in df.select(S.split_sentences(F.col("body"), sorted(known), begin).alias("s")).collect()]
    plain = [r.s for r in df.select(T.marks(F.col("body")).alias("s")).collect()]
    right = lambda found: sum([x.strip(" .!?") for x in f] == [x.strip(" .!?") for x in p] for f, p in zip(found, corpus, strict=True)) / len(corpus)
    assert right(got) > 0.95 > 0.4 > right(plain)


def test_cuts(spark):
    cases = {
        "One. Two! Three?": ["One.", "Two!", "Three?"],
        "See Dr. Lee. He knows.": ["See Dr. Lee.", "He knows."],
        "Ask the dr. He knows.": ["Ask the dr.", "He knows."],
        'He said "Go." Then left.': ['He said "Go."', "Then left."],
        "a\n\nb": ["a", "b"],
        "J. Smith is in": ["J. Smith is in"],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.s for r in df.select("t", S.split_sentences(F.col("t"), ["dr"], ["he"]).alias("s")).collect()}
    assert got == cases
    assert spark.sql("SELECT cast(null AS string) AS t").select(S.split_sentences(F.col("t"), [], []).alias("s")).first().s == []
