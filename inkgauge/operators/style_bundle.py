"""Own or not, by style, as one estimator: what it learns (grams, idf, scaling, trees, curves, quantiles) is one model that writes itself.

Fitting takes all labelled rows (most_labelled bounds them for a quick try). Folds of them go by a hash of the id; for each fold, grams are chosen by chi-square,
weighed and scaled, and trees are boosted, on the other folds only, and a logistic curve is fitted on the fold itself. A score
is the mean of the folds' calibrated probabilities, and its percentile is taken among the scores of rows that no model of theirs had seen.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import FUNCTION_WORDS
from ..shared import scope, written
from .running import running

PERCENTS = [k / 100 for k in range(101)]
ROWS_A_TASK = 4096  # of those fitted on; many small tasks would cost each round of boosting more than they save
BOOSTING_TASKS, MOST_A_TASK = 24, 32_768  # beyond so many tasks they get larger instead, up to so many rows
SAMPLE_TASKS, PREPARED_A_TASK = 32, 8192  # that prepare the rows fitted on: so many at least, and one for so many rows
FOLDS_BESIDE = 100_000  # rows up to which the folds are boosted at once; beyond, one fold's rows at a time are kept in memory


CACHE = 200_000  # words whose grams a task remembers, each of LONG_WORD characters at most
LONG_WORD = 64


def word_grams(text: Column) -> Column:
    """Runs of 3 to 5 characters within lower-cased words that have a blank at both ends."""
    return _runs(T.fields(F.lower(text)))


def _runs(words: Column) -> Column:
    runs = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda x: F.flatten(F.transform(F.array(F.concat(F.lit(" "), x, F.lit(" "))), lambda w: F.concat(*[runs(w, n) for n in (3, 4, 5)])))))


def prepared(rows: DataFrame, text: str, style: list[str], cleaned: bool = False) -> DataFrame:
    """rows with __dense (the style columns and the share of each function word) and __low, the cleaned text in lower case."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    made = rows.withColumn("__t", own if cleaned else T.strip_artifacts(own)).withColumn("__w", T.words(F.col("__t"))).withColumn("__low", F.lower("__t"))
    made = CountVectorizerModel.from_vocabulary(list(FUNCTION_WORDS), inputCol="__w", outputCol="__f").transform(made)
    shares = F.transform(vector_to_array("__f"), lambda c: c / F.greatest(F.size("__w"), F.lit(1)))
    return made.withColumn("__dense", F.concat(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in style]), shares)).drop("__t", "__w", "__f")


class _Places(dict):
    """Places of a word's grams in a vocabulary, by word; words that were met are remembered."""

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.place = {g: i for i, g in enumerate(vocabulary)}

    def __missing__(self, word: str) -> list[int]:
        w, place = f" {word} ", self.place
        found = [place[g] for n in (3, 4, 5) for i in range(len(w) - n + 1) if (g := w[i : i + n]) in place] if word else []
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


def _weigher(parts: list[dict]):
    """Lower-cased text to (1 + ln tf) idf of each part's grams, of length 1 for each part, one part after the other."""
    union = sorted({g for p in parts for g in p["vocabulary"]})
    at = {g: i for i, g in enumerate(union)}
    takes = [(np.array([at[g] for g in p["vocabulary"]], np.int64), np.array(p["idf"], float)) for p in parts]

    @F.pandas_udf("array<double>")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places, parted = _Places(union), str.maketrans("\t\r\n", "   ")

        def one(text: str) -> np.ndarray:
            held = np.fromiter(chain.from_iterable(map(places.__getitem__, text.translate(parted).split(" "))), np.int64)
            tf = np.bincount(held, minlength=len(union))
            weights = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0.0)
            each = [weights[take] * idf for take, idf in takes]
            return np.concatenate([w / (math.sqrt(w @ w) or 1.0) for w in each])

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=object)

    return weigh


def weighed(made: DataFrame, parts: list[dict], outs: list[str]) -> DataFrame:
    """made with a vector for each part: dense values put in scale, then the weights of the part's grams."""
    made, begin = made.withColumn("__v", _weigher(parts)("__low")), 1
    for part, out in zip(parts, outs, strict=True):
        scaled = F.zip_with(F.zip_with("__dense", F.lit(part["mean"]), lambda x, m: x - m), F.lit(part["std"]), lambda x, s: x / s)
        made = made.withColumn(out, array_to_vector(F.concat(scaled, F.slice("__v", begin, len(part["vocabulary"])))))
        begin += len(part["vocabulary"])
    return made.drop("__v")


def vectors(made: DataFrame, part: dict, out: str) -> DataFrame:
    """As weighed, for one part."""
    return weighed(made, [part], [out])


class StyleEstimator(Estimator):
    """text and style name columns of rows; label is 0 or 1, rows without one are left out. All others are fitted on, or with most_labelled
    so many of each class, by a hash of their id. cleaned says that the text needs no cleaning any more."""

    def __init__(self, text: str = "body", style: tuple[str, ...] = (), label: str = "label", id_col: str = "doc_id", rounds: int = 200, folds: int = 3, grams: int = 300, least: int = 3, most_labelled: int | None = None, cleaned: bool = False):
        super().__init__()
        self.text, self.style, self.label, self.id, self.cleaned = text, list(style), label, id_col, cleaned
        self.rounds, self.folds, self.grams, self.least, self.most = rounds, folds, grams, least, most_labelled

    def taken(self, rows: DataFrame) -> DataFrame:
        """The labelled rows that a fit on rows takes: a fit on these is the same. rows need no more than id and label."""
        y = F.col(f"`{self.label}`").cast("double")
        known = rows.where(y.isin(0.0, 1.0) & F.col(f"`{self.id}`").isNotNull())
        if self.most is None:
            return known
        picked = [known.where(y == v).orderBy(F.xxhash64(F.col(f"`{self.id}`")), f"`{self.id}`").limit(self.most) for v in (0.0, 1.0)]
        return picked[0].unionByName(picked[1])

    def _fit(self, dataset: DataFrame) -> StyleModel:
        with scope(dataset.sparkSession):
            known = dataset.select(F.col(f"`{self.id}`"), F.col(f"`{self.label}`"), *[F.col(f"`{c}`") for c in dict.fromkeys([self.text, *self.style]) if c not in (self.id, self.label)])
            taken = self.taken(known)
            dealt = max(SAMPLE_TASKS, math.ceil(taken.count() / PREPARED_A_TASK))
            made = prepared(taken.repartition(dealt, F.col(f"`{self.id}`")), self.text, self.style, self.cleaned).select(F.col(f"`{self.id}`").alias("__id"), F.col(f"`{self.label}`").cast("double").alias("__y"), "__dense", "__low")
            sample = written(made.withColumn("__fold", F.pmod(F.xxhash64("__id"), F.lit(self.folds)).cast("int")))
            size = {(r["__fold"], r["__y"]): r["n"] for r in sample.groupBy("__fold", "__y").agg(F.count("*").alias("n")).collect()}
            total = sum(size.values())
            if len({y for _, y in size}) < 2:
                raise ValueError("rows of both classes are needed")
            cell = lambda f, v: F.sum(F.when((F.col("__fold") == f) & (F.col("__y") == v), 1).otherwise(0)).alias(f"n{f}_{v}")
            cells = [cell(f, v) for f in range(self.folds) for v in (0, 1)]
            grams = F.array_distinct(_runs(F.array_distinct(T.fields(F.col("__low")))))
            counts = written(sample.select("__fold", "__y", F.explode(grams).alias("gram")).groupBy("gram").agg(*cells))
            tasks = max(1, min(BOOSTING_TASKS, math.ceil(total / ROWS_A_TASK)), math.ceil(total / MOST_A_TASK))
            with ThreadPoolExecutor(self.folds if total <= FOLDS_BESIDE else 1) as pool:
                chosen = list(pool.map(lambda k: self._part(sample, counts, size, k), range(self.folds)))
                outs = [f"x{k}" for k in range(self.folds)]
                ready = written(weighed(sample, chosen, outs).select("__id", "__y", "__fold", *outs))
                parts = list(pool.map(lambda k: (chosen[k], *self._boosted(ready, k, tasks)), range(self.folds)))
            model = StyleModel(self.text, self.style, [p[:3] for p in parts], [0.0] * len(PERCENTS), self.cleaned)
            held = None
            for *_, scores in parts:
                held = scores if held is None else held.unionByName(scores)
            model.quantiles = percentiles(held, "p", PERCENTS)
            return model

    def _chosen(self, counts: DataFrame, size: dict, k: int) -> tuple[list[str], list[float]]:
        """The grams that part the classes best among the folds but k, and their idf there."""
        others = [f for f in range(self.folds) if f != k]
        n0, n1 = (float(sum(size.get((f, float(v)), 0) for f in others)) for v in (0, 1))
        t0, t1 = (sum((F.col(f"n{f}_{v}") for f in others), F.lit(0)).cast("double") for v in (0, 1))
        df = t0 + t1
        chi = F.lit(n0 + n1) * F.pow(t1 * (F.lit(n0) - t0) - t0 * (F.lit(n1) - t1), F.lit(2.0)) / (F.lit(max(n0, 1.0) * max(n1, 1.0)) * df * (F.lit(n0 + n1) - df))
        best = counts.where((df >= self.least) & (df < n0 + n1)).select("gram", df.alias("df"), chi.alias("chi")).orderBy(F.desc("chi"), "gram").limit(self.grams).collect()
        return [r.gram for r in best], [math.log((1 + n0 + n1) / (1 + r.df)) + 1 for r in best]

    def _part(self, sample: DataFrame, counts: DataFrame, size: dict, k: int) -> dict:
        """What the folds but k say of grams and scales."""
        vocabulary, idf = self._chosen(counts, size, k)
        width = len(self.style) + len(FUNCTION_WORDS)
        values = [F.get("__dense", F.lit(i)) for i in range(width)]
        found = sample.where(F.col("__fold") != k).agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
        return {"vocabulary": vocabulary, "idf": idf, "mean": [x or 0.0 for x in found[:width]], "std": [x or 1.0 for x in found[width:]]}

    def _boosted(self, ready: DataFrame, k: int, tasks: int) -> tuple[GBTClassificationModel, LogisticRegressionModel, DataFrame]:
        """Trees by the folds but k, their curve on fold k and the probabilities there."""
        mine = F.col("__fold") == k
        rows = ready.select("__id", "__y", "__fold", F.col(f"x{k}").alias("x")).repartition(tasks, "__id").sortWithinPartitions("__id")  # the same on any number of cores
        trees = GBTClassifier(featuresCol="x", labelCol="__y", maxDepth=3, maxIter=self.rounds, stepSize=0.1, seed=42, checkpointInterval=20).fit(rows.where(~mine))
        margins = written(_margins(trees, rows.where(mine)).select("__y", "z"))
        curve = LogisticRegression(featuresCol="z", labelCol="__y", predictionCol="own", rawPredictionCol="raw", probabilityCol="p").fit(margins)
        return trees, curve, curve.transform(margins).select(vector_to_array("p")[1].alias("p"))


def percentiles(rows: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Values at the shares of all rows' values, between neighbours in proportion. They come from running totals, as one task can't hold all values."""
    by = written(rows.groupBy(value).agg(F.count("*").alias("k")))
    n = by.agg(F.sum("k")).first()[0]
    places = [share * (n - 1) for share in shares]
    wanted = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    upto = running(by.withColumn("every", F.lit(0)), "every", [F.col(value)], {"upto": ("sum", F.col("k"))}, {"v": F.col(value), "k": F.col("k")})
    here = F.filter(F.lit(wanted), lambda i: (i >= F.col("upto") - F.col("k")) & (i < F.col("upto")))
    at = {r.i: float(r.v) for r in upto.select("v", F.explode(here).alias("i")).collect()}
    return [at[math.floor(x)] + (x - math.floor(x)) * (at[math.ceil(x)] - at[math.floor(x)]) for x in places]


def _margins(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """rows with z, the sum of the trees' votes as a vector of one."""
    scored = trees.setRawPredictionCol("__raw").setProbabilityCol("__prob").setPredictionCol("__pred").transform(rows)
    return scored.withColumn("z", array_to_vector(F.array(vector_to_array("__raw")[1]))).drop("__raw", "__prob", "__pred")


class StyleModel(Model, MLWritable, MLReadable):
    """Adds score (probability of label 1) and percentile (share of held-out scores at or below it, in hundredths)."""

    def __init__(self, text: str, style: list[str], parts: list[tuple[dict, GBTClassificationModel, LogisticRegressionModel]], quantiles: list[float], cleaned: bool = False):
        super().__init__()
        self.text, self.style, self.parts, self.quantiles, self.cleaned = text, style, parts, quantiles, cleaned

    def feature_names(self) -> list[list[str]]:
        """Of each fold's vectors."""
        return [[*self.style, *FUNCTION_WORDS, *part["vocabulary"]] for part, _, _ in self.parts]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """A map over rows without a shuffle; rows' columns may have any names, but score and percentile are replaced."""
        out = prepared(dataset.select(F.struct("*").alias("__row"), *[F.col(f"`{c}`").alias(f"__s{i}") for i, c in enumerate([self.text, *self.style])]), "__s0", [f"__s{i + 1}" for i in range(len(self.style))], self.cleaned)
        out = weighed(out, [part for part, _, _ in self.parts], [f"__x{k}" for k in range(len(self.parts))])
        for k, (_, trees, curve) in enumerate(self.parts):
            out = _margins(trees, out.withColumnRenamed(f"__x{k}", "x"))
            out = curve.transform(out).withColumn(f"__p{k}", vector_to_array("p")[1]).drop("x", "z", "own", "raw", "p")
        score = sum(F.col(f"__p{k}") for k in range(len(self.parts))) / len(self.parts)
        out = out.select("__row.*", score.alias("__score")) if not {"score", "percentile"} & set(dataset.columns) else out.select(*[F.col(f"__row.`{c}`") for c in dataset.columns if c not in ("score", "percentile")], score.alias("__score"))
        below = F.size(F.filter(F.lit(self.quantiles), lambda q: q <= F.col("__score")))
        return out.withColumns({"score": F.col("__score"), "percentile": F.greatest(below - 1, F.lit(0)) / F.lit(100.0)}).drop("__score")

    def write(self) -> StyleWriter:
        return StyleWriter(self)

    @classmethod
    def read(cls) -> StyleReader:
        return StyleReader()


class StyleWriter(MLWriter):
    def __init__(self, model: StyleModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        held = {"text": m.text, "style": m.style, "quantiles": m.quantiles, "cleaned": m.cleaned, "parts": [part for part, _, _ in m.parts]}
        for k, (_, trees, curve) in enumerate(m.parts):
            trees.write().overwrite().save(f"{path}/fold{k}/trees")
            curve.write().overwrite().save(f"{path}/fold{k}/curve")
        # last, so that a model without it is seen to be incomplete
        spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


class StyleReader(MLReader):
    def load(self, path: str) -> StyleModel:
        spark = SparkSession.getActiveSession()
        held = json.loads(spark.read.text(f"{path}/bundle").first().value)
        parts = [(part, GBTClassificationModel.load(f"{path}/fold{k}/trees"), LogisticRegressionModel.load(f"{path}/fold{k}/curve")) for k, part in enumerate(held["parts"])]
        return StyleModel(held["text"], held["style"], parts, held["quantiles"], held.get("cleaned", False))
