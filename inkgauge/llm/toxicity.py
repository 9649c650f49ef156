"""Toxicity by a classifier chain over words and stems.

Categories are predicted in a fixed order by linear models; each model sees, beside the words, the probabilities of
the categories before it. For training these are out-of-fold: fold by fold, the earlier model that predicts a row has
not seen it, as it won't have seen the rows it is later applied to. Labels say only toxic or not; the categories before
it are read off the labelled toxic rows by the evidence they hold: explicit terms, stems alone, or several terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name, scope, text_or_empty, written

CATEGORIES = ("insult", "coded", "sustained", "toxic")
FOLDS = 5
HALF = 1 << 17  # hashed words below, hashed stems from here
STEM = 4
STRIP = " \t\r\n.,;:!?\"'()[]{}<>|/\\%&$#*+-=_~`"
CACHE = 300_000


def word_features(word: str) -> list[int]:
    """Hashed word and hashed stem of a white-space run, without case and outer punctuation; stems of longer words only."""
    word = word.strip(STRIP).lower()
    if not word:
        return []
    out = [xxhash.xxh3_64_intdigest(word.encode()) % HALF]
    if len(word) > STEM:
        out.append(HALF + xxhash.xxh3_64_intdigest(word[:STEM].encode(), 1) % HALF)
    return out


def text_features(text: str) -> list[int]:
    return sorted({f for w in {*text.split()} for f in word_features(w)})


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression with an L2 penalty, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def select_features(toxic: np.ndarray, clean: np.ndarray, rows: tuple[int, int], most: int) -> np.ndarray:
    """Places of features of at least 3 rows whose rates in the two classes (of so many rows) differ clearly, the clearest most, in order."""
    share = rows[0] / max(1, sum(rows))
    log = lambda o, e: o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9))
    # signed root of the likelihood ratio: large numbers of rows in one class only
    both = toxic + clean
    clear = np.where(both >= 3, np.sqrt(np.maximum(0, 2 * (log(toxic, both * share) + log(clean, both * (1 - share))))), 0)
    best = np.argsort(-clear, kind="stable")[:most]
    return np.sort(best[clear[best] > 4.5])


def dense(rows: list[list[int]], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(chosen)))
    for i, r in enumerate(rows):
        r = np.array(r, np.int64)
        at = np.searchsorted(chosen, r)
        ok = at < len(chosen)
        x[i, at[ok][chosen[at[ok]] == r[ok]]] = 1
    return x


def categories_of(x: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """0/1 by row and category. Evidence is a feature that at least 9 of 10 of its rows are toxic with."""
    with_it = x.sum(0)
    evidence = (x * y[:, None]).sum(0) >= 0.9 * np.maximum(with_it, 1)
    terms = x[:, evidence & (chosen < HALF) & (with_it >= 0.01 * y.sum())].sum(1)
    stems = x[:, evidence & (chosen >= HALF)].sum(1)
    return np.c_[y * (terms > 0), y * ((terms == 0) & (stems > 0)), y * (terms + stems >= 3), y]


def train_chain(rows: list[list[int]], y: np.ndarray, folds: np.ndarray, chosen: list[np.ndarray]) -> dict | None:
    """The chain's models and the threshold of its last category; None where a class is missing.

    chosen are the features of each fold's models, found without its rows, and at last those of all rows. A fold's rows are
    predicted by models, features and categories of the other folds. From the second category on this is out of fold
    only approximately: the earlier probabilities of the other folds' rows come from models that have seen this fold's labels. That
    moves the held-out probabilities, from which the threshold is taken, by little; nested folds would fit four times as many models.
    """
    if not len(y) or y.min() == y.max():
        return None
    outside = np.zeros((len(y), len(CATEGORIES)))
    xs = [dense(rows, c) for c in chosen]
    targets = [categories_of(x[folds != f], y[folds != f], c) for f, (x, c) in enumerate(zip(xs, chosen, strict=True))]
    models = []
    for c in range(len(CATEGORIES)):
        for f in range(FOLDS):
            here = folds == f
            t = targets[f][:, c].astype(float)
            outside[here, c] = t.mean() if len(t) else 0
            if here.any() and len(t) and t.min() < t.max():
                seen = np.c_[xs[f], outside[:, :c]]
                outside[here, c] = predict(seen[here], fit_linear(seen[~here], t))
        t = targets[FOLDS][:, c].astype(float)
        seen = np.c_[xs[FOLDS], outside[:, :c]]
        models.append(fit_linear(seen, t) if t.min() < t.max() else np.r_[np.zeros(seen.shape[1]), np.log((t.mean() + 1e-6) / (1 - t.mean() + 1e-6))])
    p, grid = outside[:, -1], np.linspace(0.02, 0.98, 97)
    gain = np.array([(p[y == 1] >= g).mean() - 10 * (p[y == 0] >= g).mean() for g in grid])
    threshold = float(np.median(grid[gain >= gain.max() - 1e-12]))
    return {"chosen": chosen[FOLDS], "models": models, "threshold": threshold, "held_out": p}


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """id, y, fold, features of at most most rows of each class, chosen by a hash of their id; a written table."""
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("__id")).agg(F.max(f"`{label_col}`").cast("int").alias("__y"))
    order = F.xxhash64("__id")
    picked = known.where("__y > 0").orderBy(order, "__id").limit(most).unionByName(known.where("__y <= 0").orderBy(order, "__id").limit(most))
    picked = docs.sparkSession.createDataFrame(picked.collect(), "__id long, __y int")  # at most 2 * most rows
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    found = ids.join(F.broadcast(picked), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_features(t) for t in b.column("__text").to_pylist()]
            fold = [xxhash.xxh3_64_intdigest(str(i).encode()) % FOLDS for i in b.column("__id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array([int(y > 0) for y in b.column("__y").to_pylist()], pa.int32()), pa.array(fold, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["id", "y", "fold", "features"])

    # An id that many rows hold is one labelled row.
    one = found.groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    return written(one.mapInArrow(run, "id long, y int, fold int, features array<int>"))


def trained(sample: DataFrame, most_features: int) -> dict | None:
    """The chain of a labelled sample. Features are counted by Spark; the driver holds counts of hashed features, of which there are 2 * HALF at most, and of each row the chosen ones."""
    of = lambda f, y: F.count(F.when((F.col("fold") == f) & (F.col("y") == y), 1)).cast("int").alias(f"n{f}_{y}")
    cells = [of(f, y) for f in range(FOLDS) for y in (0, 1)]
    counts = sample.select("y", "fold", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), *cells).where("n >= 3").orderBy("feature").toArrow()
    rows = [[int(x) for x in r] for r in np.array(sample.agg(*cells).collect()[0], np.int64).reshape(FOLDS, 2)]
    feature = counts["feature"].to_numpy().astype(np.int64)
    n = np.stack([counts[f"n{f}_{y}"].to_numpy() for f in range(FOLDS) for y in (0, 1)], 1).reshape(-1, FOLDS, 2).astype(np.float64) if len(feature) else np.zeros((0, FOLDS, 2))
    chosen = []
    for f in range(FOLDS + 1):
        use = [g for g in range(FOLDS) if g != f]
        clean, toxic = n[:, use].sum(1).T
        chosen.append(feature[select_features(toxic, clean, (sum(rows[g][1] for g in use), sum(rows[g][0] for g in use)), most_features)])
    wanted = sorted({int(x) for c in chosen for x in c})
    kept = F.array_intersect("features", F.array(*[F.lit(x) for x in wanted])) if wanted else F.array().cast("array<int>")
    table = sample.select("id", "y", "fold", kept.alias("features")).orderBy("id").toArrow()
    return train_chain(table["features"].to_pylist(), table["y"].to_numpy().astype(np.int64), table["fold"].to_numpy().astype(np.int64), chosen)


class Scorer:
    """Chain probabilities of a text; words are looked up, most hold no chosen feature."""

    def __init__(self, model: dict):
        self.position = {int(f): i for i, f in enumerate(model["chosen"])}
        self.models = model["models"]
        self.words: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.words) >= CACHE:
            self.words.clear()
        got = tuple(self.position[f] for f in word_features(word) if f in self.position)
        if len(word) <= 64:
            self.words[word] = got
        return got

    def __call__(self, text: str) -> list[float]:
        known = self.words
        active: set[int] = set()
        for w in {*text.split()}:
            got = known.get(w)
            active.update(self._of(w) if got is None else got)
        on, n, out = [*active], len(self.position), []
        for w in self.models:
            z = w[-1] + w[on].sum() + sum(p * w[n + i] for i, p in enumerate(out))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -35, 35)))))
        return out


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = 6000, most_features: int = 400) -> DataFrame:
    """All columns of docs, with p_insult, p_coded, p_sustained, p_toxic (double) and is_toxic (boolean).

    The chain is trained on at most most_labelled labelled rows of each class, a documented bound; every document is
    scored over its whole text. Without labels of both classes all probabilities are 0. Null texts count as empty;
    null labels are left out; a repeated label counts as toxic if one is; repeated documents are scored each. Columns of
    docs that clash with the new names are replaced. A map over rows: no shuffle of documents.
    """
    with scope(docs.sparkSession):
        model = trained(labelled_sample(docs, labels, id_col, text_col, label_col, most_labelled), most_features)
    names = [f"p_{c}" for c in CATEGORIES]
    docs = docs.drop(*names, "is_toxic")
    if model is None:
        return docs.select("*", *[F.lit(0.0).alias(n) for n in names], F.lit(False).alias("is_toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole, score = own_name(docs, "__text"), own_name(docs, "__score")

    def chain(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for t in texts:
            yield pd.Series([scorer(x) for x in t])

    chain = F.pandas_udf(chain, "array<double>")
    scored = docs.withColumn(whole, text_or_empty(text_col)).withColumn(score, chain(whole))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(score)[i].alias(n) for i, n in enumerate(names)], (F.col(score)[len(names) - 1] >= model["threshold"]).alias("is_toxic"))
