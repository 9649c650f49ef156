"""what kept the trees by style from ending at size; each test failed before its change."""

import random
import time

from pyspark.sql import functions as F

from inkgauge.operators import style_bundle
from inkgauge.plans import model_queries
from inkgauge.plans.profile_queries import style_vector

SF = "/root/testdata/sf0.001"


def labelled_texts(n):
    rng = random.Random(4)
    return [(i, float(i % 2), " ".join(rng.choice(("xaba", "xoco", "both") if i % 2 else ("yebe", "yici", "both")) for _ in range(12)), 1.0) for i in range(n)]


def test_long_messages_cost_in_proportion(spark):
    """The mean length of sentences is taken once, not once for each sentence."""
    n = 40_000
    rows = spark.createDataFrame([(1, "a", "One two. " * n + "One two three.")], "msg_id long, author string, body string")
    began = time.time()
    got = style_vector(rows).first()
    assert time.time() - began < 15
    mean = (2 * n + 3) / (n + 1)
    assert got.sentence_mean == round(mean, 5) and got.sentence_sd == round(((n * (2 - mean) ** 2 + (3 - mean) ** 2) / (n + 1)) ** 0.5, 5)


def test_sample_is_known_before_texts_are_read(spark, monkeypatch):
    """The fit reads the rows that it takes, and only these; they are the ones it takes from all rows."""
    rows = spark.createDataFrame(labelled_texts(120), "doc_id long, label double, body string, flat double")
    estimator = style_bundle.StyleEstimator(style=("flat",), rounds=2, grams=20, most_labelled=25)
    taken = estimator.taken(rows.select("doc_id", "label"))
    assert taken.count() == 50 and {r["label"]: r["count"] for r in taken.groupBy("label").count().collect()} == {0.0: 25, 1.0: 25}
    few = estimator.fit(rows.join(taken.select("doc_id"), "doc_id"))
    assert few.feature_names() == estimator.fit(rows).feature_names() and [p["mean"] for p, *_ in few.parts] == [p["mean"] for p, *_ in estimator.fit(rows).parts]
    seen, plain = [], style_bundle.StyleEstimator.fit
    monkeypatch.setattr(style_bundle.StyleEstimator, "fit", lambda self, df: seen.append(df) or plain(self, df))
    monkeypatch.setattr(model_queries, "StyleEstimator", lambda **k: style_bundle.StyleEstimator(rounds=2, grams=20, most_labelled=9, **k))
    got = model_queries.stylometric_trees(spark, SF)
    assert got.count() == model_queries.labelled(spark, SF).count() > 18
    assert len(seen) == 1 and "documents.parquet" not in "".join(seen[0].inputFiles())


def test_sample_is_many_tasks_and_holds_no_grams(spark, monkeypatch):
    """What a limit leaves in one task is dealt again, and texts aren't stored as their grams, which took several GB."""
    made, plain = [], style_bundle.written
    monkeypatch.setattr(style_bundle, "written", lambda df: made.append((df.columns, df.rdd.getNumPartitions())) or plain(df))
    rows = spark.createDataFrame(labelled_texts(60), "doc_id long, label double, body string, flat double")
    style_bundle.StyleEstimator(style=("flat",), rounds=1, grams=20).fit(rows)
    assert made[0][1] == style_bundle.SAMPLE_TASKS and not any("__grams" in c for c, _ in made)


def test_grams_by_remembered_words(spark, monkeypatch):
    """Counts from remembered words are those of all runs, with more words than are remembered and longer ones."""
    monkeypatch.setattr(style_bundle, "CACHE", 2)
    monkeypatch.setattr(style_bundle, "LONG_WORD", 3)
    vocabulary = [" ab", "bcd", "ab ", " é ", "é́x", "aaa"]
    for text in ("ab abcd ab\tabcd\nabcde aaaaaaa é\r\né́x  ab", "", " \n ", "zz"):
        places = style_bundle._Places(vocabulary)
        got = [i for w in text.translate(str.maketrans("\t\r\n", "   ")).split(" ") for i in places[w]]
        grams = spark.createDataFrame([(text,)], "t string").select(style_bundle.word_grams(F.col("t")).alias("g")).first().g
        assert [got.count(i) for i in range(len(vocabulary))] == [grams.count(g) for g in vocabulary]
