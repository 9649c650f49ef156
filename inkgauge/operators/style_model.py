"""An isolation forest: anomalies of vectors, calibrated by their own percentiles. The trees by style are in style_bundle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    width = x.max(0) - x.min(0) if len(x) else np.zeros(0)
    if depth == 0 or len(x) <= 1 or not (width > 0).any():
        n = max(len(x), 1)
        return (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2),)
    f = int(rng.choice(np.flatnonzero(width > 0)))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    return f, cut, _grow(x[x[:, f] < cut], rng, depth - 1), _grow(x[x[:, f] >= cut], rng, depth - 1)


def _path(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, cut, low, high = tree
    out, left = np.ones(len(x)), x[:, f] < cut
    out[left] += _path(low, x[left])
    out[~left] += _path(high, x[~left])
    return out


def isolation_scores(rows: DataFrame, features: list[str], id_col: str, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """id_col, anomaly (0 to 1). The forest is grown from a bounded sample, trees * sample rows at most, by hash of the id."""
    taken = rows.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(trees * sample).select(*features).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    forest = [_grow(taken[rng.choice(len(taken), min(sample, len(taken)), replace=False)], rng, 8) for _ in range(trees)]
    n = min(sample, max(len(taken), 2))
    usual = 2 * (np.log(max(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            x = b[features].to_numpy(float)
            yield pd.DataFrame({id_col: b[id_col], "anomaly": 2 ** (-np.mean([_path(t, x) for t in shared.value], 0) / usual)})

    return rows.select(id_col, *features).mapInPandas(run, f"{id_col} long, anomaly double")


def calibrated_anomalies(rows: DataFrame, features: list[str], id_col: str, **options) -> DataFrame:
    """isolation_scores put in line from 0 at their 1st percentile to 1 at their 99th, over all rows, and cut there."""
    raw = isolation_scores(rows, features, id_col, **options).persist()
    low, high = raw.agg(F.percentile("anomaly", F.lit(0.01)), F.percentile("anomaly", F.lit(0.99))).first()
    if low is None:
        return raw
    return raw.select(id_col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("anomaly") - F.lit(low)) / F.lit(max(high - low, 1e-6)))).alias("anomaly"))
