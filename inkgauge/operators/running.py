"""Totals and values carried along a key in an order, without gathering the key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written as kept_table

#: How the value of the parts before and that of this part become one; a part's own may be null.
JOINED = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "xor": lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))), "last": lambda a, b: F.coalesce(b, a)}
OVER: dict[str, Callable[[str], Column]] = {"sum": F.sum, "xor": F.bit_xor, "last": lambda c: F.last(c, ignorenulls=True)}


def running(rows: DataFrame, keys: list[str] | str, order: list[Column], totals: dict[str, tuple[str, Column]], keep: dict[str, Column] | None = None, written: Callable[[DataFrame], DataFrame] = kept_table, inclusive: bool = True) -> DataFrame:
    """keys, the columns of keep, and for each of totals (kind, column) its value over the rows of the key up to this one.

    kinds: sum, xor (of whole numbers), last (that isn't null). With inclusive false the row itself isn't counted. Keys aren't null;
    equal rows in the order come in any order. Rows are dealt by ranges of keys and order, so a frequent key lies in several
    parts: each part runs by itself, and a key that spans parts (at most one a cut) takes on what the parts before hold.
    written is how the table between is kept.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    values, kept = {f"__{name}": column for name, (_, column) in totals.items()}, keep or {}
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = written(dealt.select(*keys, F.monotonically_increasing_id().alias("__seq"), *[c.alias(n) for n, c in (kept | values).items()]))
    dealt = dealt.withColumn("__part", F.shiftright("__seq", 33))
    here = Window.partitionBy("__part", *keys).orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = dealt.select(*keys, "__part", *kept, *[OVER[kind](f"__{name}").over(here).alias(name) for name, (kind, _) in totals.items()])
    key = F.struct(*keys)
    ends = dealt.groupBy("__part").agg(F.min(key).alias("least"), F.max(key).alias("most"))
    spans = written(ends.select("__part", F.explode(F.array_distinct(F.array("least", "most"))).alias("k")).groupBy("k").agg(F.count("*").alias("parts")).where("parts > 1").select("k.*"))
    if spans.isEmpty():
        return out.drop("__part")
    # at most one key a cut between parts: no more rows than the shuffle has partitions
    cut = dealt.join(F.broadcast(spans), keys, "left_semi")
    last = lambda name: F.max_by(f"__{name}", F.when(F.col(f"__{name}").isNotNull(), F.col("__seq")))
    whole = {"sum": lambda n: F.sum(f"__{n}"), "xor": lambda n: F.bit_xor(f"__{n}"), "last": last}
    sums = cut.groupBy(*keys, "__part").agg(*[whole[kind](name).alias(name) for name, (kind, _) in totals.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(sums.select(*keys, "__part", *[OVER[kind](name).over(before).alias(f"__{name}") for name, (kind, _) in totals.items()]))
    joined = out.join(F.broadcast(carried), [*keys, "__part"], "left")
    return joined.select(*keys, *kept, *[JOINED[kind](F.col(f"__{name}"), F.col(name)).alias(name) for name, (kind, _) in totals.items()])
