"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix; DataFrame functions only.

Every input partition permutes its rows locally. The matrix says how many of them go to each shard: its rows add up to
the partitions, its columns to the shards, and it is drawn from the multivariate hypergeometric law, which is the law
of those counts under a uniform permutation of all rows. After the exchange each shard is permuted again.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own_name, text_or_empty, written


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement are good: inversion from the mode outwards, in any size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - top
    left = right = mode
    p = q = top
    while u > 0 and (left > low or right < high):
        if right < high:
            q *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= q
            if u <= 0:
                return right
        if left > low:
            p *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p
            if u <= 0:
                return left
        if p + q < 1e-300:
            break
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts from each partition (rows) to each shard (columns); sum(rows) is sum(columns)."""
    rng, left, matrix = random.Random(seed), list(columns), []
    for n in rows:
        total, line = sum(left), []
        for s, size in enumerate(left):
            total -= size
            k = hypergeometric(rng, size, total, n)
            line.append(k)
            left[s] -= k
            n -= k
        matrix.append(line)
    return matrix


def uniform_shards(docs: DataFrame, n_shards: int, seed: int = 7, block_rows: int = 65536) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (from 0 without gaps in each shard); sizes differ by one at most.

    Only counts by partition reach the driver, a few numbers for each. Slots are ranks of a random number: within
    blocks of about block_rows rows of one shard, plus the rows of the blocks before, so that no task holds a shard.
    Nulls, empty texts, ties and repeated rows don't matter, as no value of a row is looked at. Columns of docs named
    shard or slot are replaced. An empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards is at least 1")
    docs = docs.drop("shard", "slot")
    part, place, first, second = (own_name(docs, f"__{x}") for x in ("part", "place", "first", "second"))
    local = docs.withColumns({part: F.spark_partition_id(), first: F.rand(seed), second: F.rand(seed + 1)}).sortWithinPartitions(first)
    local = written(local.withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop(first))
    counts = sorted((r[0], r[1]) for r in local.groupBy(part).count().collect())
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    bounds, edges = own_name(docs, "__bounds"), []
    for (p, _), line in zip(counts, matrix, strict=True):
        at, row = 0, []
        for k in line:
            row.append(at := at + k)
        edges.append((p, row))
    plan = docs.sparkSession.createDataFrame(edges, f"`{part}` int, `{bounds}` array<bigint>")
    sent = local.join(plan, part).withColumn("shard", F.size(F.filter(bounds, lambda b: b <= F.col(place))).cast("int")).drop(bounds)
    blocks = max(1, math.ceil(total / n_shards / block_rows))
    block, offset = own_name(docs, "__block"), own_name(docs, "__offset")
    sent = sent.withColumn(block, F.floor(F.col(second) * blocks).cast("int"))
    held = sent.groupBy("shard", block).agg(F.count("*").alias(offset))
    before = held.withColumn(offset, F.sum(offset).over(Window.partitionBy("shard").orderBy(block)) - F.col(offset))
    slot = F.row_number().over(Window.partitionBy("shard", block).orderBy(second, part, place)) - 1 + F.col(offset)
    return sent.join(before, ["shard", block]).withColumn("slot", slot.cast("long")).select(*docs.columns, "shard", "slot")


def shard_digest(docs: DataFrame, n_shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law ("rows"), shard, slot, grown_shard (null: only law "key" has it)."""
    text = text_or_empty(text_col)
    narrow = docs.select(F.col(f"`{id_col}`").alias(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    done = uniform_shards(narrow, n_shards, seed)
    return done.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
