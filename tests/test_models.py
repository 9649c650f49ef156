"""Models see style, not only length; scores are calibrated, held out, and the same after a model is loaded elsewhere."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkgauge.operators.style_bundle import StyleEstimator, StyleModel, prepared, vectors, word_grams
from inkgauge.operators.style_model import calibrated_anomalies
from inkgauge.plans import model_queries

ROOT = Path(__file__).resolve().parent.parent


def test_word_grams(spark):
    got = spark.sql("SELECT 'Ab  c' AS t").select(word_grams(F.col("t")).alias("g")).first().g
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " c "])


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, float(i % 2), " ".join(rng.choice(("xaba", "xoco", "xudu", "both") if i % 2 else ("yebe", "yici", "yafa", "both")) for _ in range(12)), 1.0) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(texts(150, 2), "doc_id long, label double, body string, flat double")
    return rows, StyleEstimator(style=("flat",), rounds=3, grams=40).fit(rows)


def test_style_is_seen(spark, fitted):
    """Texts of one length and shape that differ in words only are told apart, unseen ones too."""
    _, model = fitted
    for seed in (2, 9):
        scores = model.transform(spark.createDataFrame(texts(100, seed), "doc_id long, label double, body string, flat double")).collect()
        assert min(r.score for r in scores if r.doc_id % 2) > max(r.score for r in scores if r.doc_id % 2 == 0)
    assert all(0 <= r.percentile <= 1 for r in scores) and all(len(names) == 1 + 150 + 40 for names in model.feature_names())


def test_vectors(spark, fitted):
    """Grams' weights have length 1, and are (1 + ln tf) idf."""
    import math

    _, model = fitted
    part = model.parts[0][0]
    row = vectors(prepared(spark.createDataFrame([(1, "xaba xaba yebe")], "doc_id long, body string").withColumn("flat", F.lit(1.0)), "body", ["flat"]), part, "x").first()
    grams = [g for w in ("xaba", "xaba", "yebe") for t in [f" {w} "] for n in (3, 4, 5) for g in (t[i : i + n] for i in range(len(t) - n + 1))]
    raw = [(1 + math.log(grams.count(g))) * w if g in grams else 0.0 for g, w in zip(part["vocabulary"], part["idf"], strict=True)]
    size = math.sqrt(sum(x * x for x in raw))
    assert size > 0 and all(math.isclose(a, b / size, abs_tol=1e-12) for a, b in zip(row.x.toArray()[151:], raw, strict=True))


def test_bundle_in_a_new_session(spark, fitted, tmp_path):
    """A model that another process loads scores unseen messages as this one does; rows keep their columns."""
    _, model = fitted
    model.write().overwrite().save(str(tmp_path / "m"))
    model.write().overwrite().save(str(tmp_path / "m"))
    unseen = spark.createDataFrame([(i, b, f, "kept", 7) for i, _, b, f in texts(60, 33)], "doc_id long, body string, flat double, x string, score int")
    unseen.write.parquet(str(tmp_path / "in"))
    say = f"""
from pyspark.sql import SparkSession
from inkgauge.operators.style_bundle import StyleModel
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
StyleModel.load({str(tmp_path / 'm')!r}).transform(s.read.parquet({str(tmp_path / 'in')!r})).write.parquet({str(tmp_path / 'out')!r})
"""
    subprocess.run([sys.executable, "-c", say], check=True, cwd=ROOT, env={**__import__("os").environ, "PYTHONPATH": str(ROOT)}, capture_output=True)
    here = {r.doc_id: (r.score, r.percentile, r.x) for r in model.transform(unseen).collect()}
    there = {r.doc_id: (r.score, r.percentile, r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert here == there and len(here) == 60 and here[1][2] == "kept"
    again = StyleModel.load(str(tmp_path / "m"))
    assert again.quantiles == model.quantiles and again.feature_names() == model.feature_names()


def test_held_out(spark):
    """Scores of rows that the estimator never saw rank by their class, with labels that are wrong one time in ten."""
    rng = random.Random(7)
    rows = [(i, 1 - y if rng.random() < 0.1 else y, b, f) for i, y, b, f in texts(300, 5)]
    df = spark.createDataFrame(rows, "doc_id long, label double, body string, flat double")
    model = StyleEstimator(style=("flat",), rounds=3, grams=40, most_labelled=60).fit(df.where("doc_id < 200"))
    held = sorted((r.score, r.doc_id % 2) for r in model.transform(df.where("doc_id >= 200")).collect())
    pos = [k for k, (_, y) in enumerate(held) if y]
    auc = (sum(pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (100 - len(pos)))
    assert auc > 0.95
    with pytest.raises(ValueError, match="both classes"):
        StyleEstimator(rounds=1).fit(df.where("label = 1"))


def test_stylometric_rows(spark):
    rows = model_queries.stylometric_rows(spark, "/root/testdata/sf0.001")
    assert len(rows.columns) == 23 and rows.count() > 0


def test_forest_calibrated(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 97).cast("double").alias("x"))
    scores = [r.anomaly for r in calibrated_anomalies(df, ["x"], "doc_id").collect()]
    assert min(scores) == 0 and max(scores) == 1
