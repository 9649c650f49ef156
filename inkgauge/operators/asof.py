"""Point-in-time joins: each row with what was current of its key when it happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, prefix: str = "", strict: bool = False, within: str | None = None) -> DataFrame:
    """left with the columns of the last row of right with the same keys whose time isn't after (strict: is before) its own.

    Columns of right other than its keys come with prefix; they are null where right has no such row, where a key or the time of left is
    null, or with within (an interval such as `90 days`) where that row is older. Of several rows of right at one time the greatest by their columns in order
    is taken. All rows of left stay, repeated ones too.

    Both sides are one sorted table and the last row of right is carried forward: one exchange by ranges of keys and time, so
    a key with a third of all rows is shared by many tasks, and nothing grows with the number of pairs.
    """
    values = [c for c in right.columns if c not in keys]
    clash = {f"{prefix}{c}".lower() for c in values} & {c.lower() for c in left.columns}
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}; give a prefix")
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(f"`{k}`").isNotNull()
    mine, named = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`").alias(c) for c in values])
    rank = {False: (0, 1), True: (1, 0)}[strict]
    of = lambda df, time, side, own, other: df.where(complete & F.col(f"`{time}`").isNotNull()).select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(f"`{time}`").cast("timestamp").alias("__t"), F.lit(side).alias("__side"), own.alias("__own"), other.alias("__value"))
    kind = right.select(named.alias("v")).schema["v"].dataType
    both = of(left, left_time, rank[1], mine, F.lit(None).cast(kind)).unionByName(of(right, right_time, rank[0], F.lit(None).cast(left.select(mine.alias("m")).schema["m"].dataType), named))
    slots = [f"__k{i}" for i in range(len(keys))]
    carried = running(both, slots, [F.col("__t"), F.col("__side"), F.col("__value")], {"__last": ("last", F.col("__value"))}, {"__own": F.col("__own"), "__t": F.col("__t")})
    found = carried.where("__own is not null")
    if within:
        found = found.withColumn("__last", F.when(F.col(f"__last.`{right_time}`").cast("timestamp") >= F.col("__t") - F.expr(f"interval {within}"), F.col("__last")))
    out = found.select("__own.*", *[F.col(f"__last.`{c}`").alias(f"{prefix}{c}") for c in values])
    rest = left.where(~(complete & F.col(f"`{left_time}`").isNotNull())).select("*", *[F.lit(None).cast(kind[c].dataType).alias(f"{prefix}{c}") for c in values])
    return out.unionByName(rest)
