"""each test failed before its change."""

from pyspark.sql import functions as F

from inkgauge.operators import style_bundle
from inkgauge.plans import model_queries, portrait
from inkgauge.plans import profile_queries as Q

SF = "/root/testdata/sf0.001"


def test_trees_are_fitted_on_all_labelled_rows(spark, monkeypatch):
    """more than 10,000 rows of a class, all taken; the query sets no bound, and its fit is given every labelled document."""
    rows = spark.range(25_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 25 == 0, 1.0).otherwise(0.0).alias("label"))
    assert style_bundle.StyleEstimator().taken(rows).count() == 25_000
    seen, plain = [], style_bundle.StyleEstimator.fit
    monkeypatch.setattr(style_bundle.StyleEstimator, "fit", lambda self, df: seen.append((self.most, df.count())) or plain(self, df))
    monkeypatch.setattr(model_queries, "StyleEstimator", lambda **k: style_bundle.StyleEstimator(rounds=1, grams=20, **k))
    got = model_queries.stylometric_trees(spark, SF)
    assert seen == [(None, model_queries.labelled(spark, SF).count())] and got.count() == seen[0][1]


def test_percentiles_of_all_scores(spark):
    """percentiles from running totals are the exact ones, with equal values and with one alone."""
    for n in (1, 2, 777):
        rows = spark.range(n).select((F.hash("id") % 50 / 7.0).alias("p"))
        exact = rows.agg(F.percentile("p", F.lit(style_bundle.PERCENTS))).first()[0]
        assert all(abs(a - b) < 1e-12 for a, b in zip(style_bundle.percentiles(rows, "p", style_bundle.PERCENTS), exact, strict=True))


def test_whole_profile_takes_texts_apart_once(spark, monkeypatch):
    """blocks that tell of words, lexicons or sentences share tables, no block is left to one plan of broadcasts, and all are the queries' own."""
    body = "Hi Ana,\n\nI don't think it's very good; we really do not need you. Is it? Thanks for the help. The plan was changed!\n\nBest regards,\nLee"
    texts = [body, body + " the the plan", "?", "", "maybe this week, very VERY well-known: don’t"]
    rows = [(i, ("a", "b", None)[i % 3], "ana@x.org", "Re: x", t, None) for i, t in enumerate(texts * 3)]
    mail = spark.createDataFrame(rows, "msg_id long, author string, recipients string, subject string, body string, sent timestamp")
    mine = mail.withColumn("author", F.lit("all"))
    got, calls = portrait.build_profile(mail).first(), []
    for block, query in (portrait.SINGLE | portrait.LISTS).items():
        df = query(spark, mine)
        want = [r.asDict() for r in (df.drop("author") if "author" in df.columns else df).collect()]
        have = [got[block].asDict()] if block in portrait.SINGLE else [r.asDict() for r in got[block]]
        assert sorted(map(str, have)) == sorted(map(str, want)), block
    plain = Q.lexicon_usage
    monkeypatch.setattr(Q, "lexicon_usage", lambda *a: calls.append(1) or plain(*a))
    for block in ("vocabulary", "readability", "grammar"):
        monkeypatch.setitem(portrait.SINGLE, block, lambda *a: 1 / 0)
    frame = portrait.build_profile(mail)
    assert len(calls) == 1 and "Broadcast" not in "".join(frame._jdf.queryExecution().executedPlan().toString())


def test_profile_of_texts_without_words(spark):
    """messages without a word keep the blocks that they have in the queries."""
    mail = spark.createDataFrame([(1, "a", "x@y.z", None, " 12 ", None), (2, "a", "x@y.z", None, "", None)], "msg_id long, author string, recipients string, subject string, body string, sent timestamp")
    got, mine = portrait.build_profile(mail).first(), mail.withColumn("author", F.lit("all"))
    for block, query in portrait.SINGLE.items():
        df = query(spark, mine)
        assert got[block] == (df.drop("author") if "author" in df.columns else df).first(), block
