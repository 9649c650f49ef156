"""What every operator of this subpackage shares: the shared folder, written tables, safe names."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import lasting, scope, shared_dir, written  # noqa: F401


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; then memory that they took goes back to the system, as workers live on through later stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


FEW = 1 << 20  # rows of a key that may be broadcast


def semi_join(df: DataFrame, keys: DataFrame, on: str, anti: bool = False) -> DataFrame:
    """Rows of df with (or, anti, without) a key in keys, which is broadcast only after a count of at most FEW rows."""
    keys = keys.select(on)
    return df.join(F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys.distinct(), on, "left_anti" if anti else "left_semi")


def own_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
