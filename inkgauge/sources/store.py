"""Tables of the service and of runs as Parquet folders: appends, upserts, loads, splits and the latest of many runs.

A write that replaces puts its rows into a folder of its own and is named current only when that is complete, by creating
the next numbered file of the table's log, which only one writer can. A lost job leaves the version before it in place.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICY_COLUMNS = ("tenant_id", "policy_name", "is_default", "score_threshold_warn", "score_threshold_hold", "dlp_enabled", "dlp_min_confidence", "dlp_action", "warn_action", "hold_action", "notify_emails", "priority")
STALE_S = 86400  # age at which folders that no version names are taken for those of dead writers


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and folders of the table's complete versions, the current one last."""
    fs, at = _fs(spark, f"{path}/log")
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        number, _, folder = status.getPath().getName().partition("-")
        if number.isdigit() and fs.exists(_fs(spark, f"{path}/data/{folder}/_SUCCESS")[1]):
            found.append((int(number), f"{path}/data/{folder}"))
    return sorted(found)


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the table's current version; None if it has none."""
    known = versions(spark, path)
    return known[-1][1] if known else None


def load(spark: SparkSession, path: str) -> DataFrame | None:
    at = current(spark, path)
    return spark.read.parquet(at) if at else None


def _publish(spark: SparkSession, path: str, folder: str, number: int) -> bool:
    """Makes the complete folder version number, unless another writer has that number."""
    fs, claim = _fs(spark, f"{path}/claims/{number:012}")
    if not fs.createNewFile(claim):
        return False
    fs, entry = _fs(spark, f"{path}/log/{number:012}-{folder}")
    fs.create(entry, False).close()
    return True


def _next(spark: SparkSession, path: str) -> int:
    fs, at = _fs(spark, f"{path}/claims")
    return 1 + max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=-1) if fs.exists(at) else 0


def _clean(spark: SparkSession, path: str, keep: int) -> None:
    """The last keep versions stay, and the folders of writers that may still be at work."""
    known = versions(spark, path)
    kept = {folder.rsplit("/", 1)[1] for _, folder in known[-keep:]}
    old = {folder.rsplit("/", 1)[1] for _, folder in known[:-keep]}
    fs, at = _fs(spark, f"{path}/data")
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name in old or (name not in kept and s.getModificationTime() < (time.time() - STALE_S) * 1000):
            fs.delete(s.getPath(), True)
    for number, folder in known[:-keep]:
        fs.delete(_fs(spark, f"{path}/log/{number:012}-{folder.rsplit('/', 1)[1]}")[1], False)


def replace(df: DataFrame, path: str, keep: int = 2, options: dict[str, str] | None = None) -> None:
    """df becomes the table; keep complete versions stay. Of several writers the last to finish wins. options are the Parquet writer's."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    df.write.options(**(options or {})).parquet(f"{path}/data/{folder}")
    while not _publish(spark, path, folder, _next(spark, path)):
        pass
    _clean(spark, path, max(1, keep))


def clustered(df: DataFrame, path: str, by: list[str], looked_up: list[str], row_group_bytes: int = 8 << 20, distinct: int = 1_000_000) -> None:
    """df becomes a table laid out for look-ups: in order of by, in row groups of that size, with a Bloom filter of each column of looked_up.

    find reads a few row groups of it: by ranges of by, and by the filters of the other columns. distinct is how many values of
    a column a row group is made for.
    """
    options = {"parquet.block.size": str(row_group_bytes)}
    for c in looked_up:
        options |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(distinct)}
    replace(df.repartitionByRange(*by).sortWithinPartitions(*by), path, options=options)


def find(spark: SparkSession, path: str, **equal) -> DataFrame | None:
    """Rows of the table whose columns have the values given (or one of a list of them); None if there is no table."""
    rows = load(spark, path)
    if rows is None:
        return None
    for c, v in equal.items():
        rows = rows.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v))
    return rows


def members(users: DataFrame, groups: list, col: str = "group_ids") -> DataFrame:
    """Users in one of the groups; those without a list are in none."""
    return users.where(F.coalesce(F.arrays_overlap(col, F.array(*[F.lit(g) for g in groups])), F.lit(False)) if groups else F.lit(False))


def append(df: DataFrame, path: str, once: list[str] | None = None) -> None:
    """Rows join the log at path; with once, rows whose key the log or this batch has already don't."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    if once:
        df = df.dropDuplicates(once)
        if fs.exists(at):
            df = df.join(spark.read.parquet(path).select(*once), once, "left_anti")
    df.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of equal keys in new the last by order stays."""
    if order is not None:
        r = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        new = new.withColumn("__r", r).where("__r = 1").drop("__r")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], keep: int = 2, tries: int = 10) -> None:
    """The table becomes change(table), None if there is none yet. If another writer finishes first, change starts again from that one's."""
    for _ in range(tries):
        number, old, folder = _next(spark, path), load(spark, path), uuid.uuid4().hex
        change(old).write.parquet(f"{path}/data/{folder}")
        if _publish(spark, path, folder, number):
            return _clean(spark, path, max(1, keep))
        _fs(spark, path)[0].delete(_fs(spark, f"{path}/data/{folder}")[1], True)
    raise RuntimeError(f"{tries} other writers finished before this one: {path}")


def upsert(df: DataFrame, path: str, keys: list[str], order: Column | None = None, keep: int = 2) -> None:
    """The table with df's rows in place of those with the same keys. If another writer finishes first, on top of that one's."""
    update(df.sparkSession, path, lambda old: upserted(old if old is not None else df.limit(0), df, keys, order), keep)


def insert_allowed(df: DataFrame, path: str, allowed: tuple[str, ...] = POLICY_COLUMNS) -> None:
    """Appends the columns that are on the list, whatever else comes."""
    append(df.select(*[c for c in df.columns if c in allowed]), path)


def insert_tenants(tenants: DataFrame, tenants_path: str, policies_path: str) -> None:
    """Appends tenants, and a default policy for each that has none."""
    spark = tenants.sparkSession
    append(tenants, tenants_path, once=["tenant_id"])
    wanted = spark.read.parquet(tenants_path).select("tenant_id").distinct()
    fs, at = _fs(spark, policies_path)
    if fs.exists(at):
        wanted = wanted.join(spark.read.parquet(policies_path).where("is_default").select("tenant_id"), "tenant_id", "left_anti")
    append(wanted.select("tenant_id", F.lit("Default").alias("policy_name"), F.lit(True).alias("is_default"), F.lit(0.35).alias("score_threshold_warn"), F.lit(0.55).alias("score_threshold_hold")), policies_path)


def log_scores(scores: DataFrame, path: str, at: str) -> None:
    """Appends scored messages to the log, with the time given."""
    append(scores.withColumn("scored_at", F.lit(at).cast("timestamp")), path)


def log_hits(found: DataFrame, path: str, matches: str = "matches") -> None:
    """Appends a row for each pattern that matched in a message; a field named as one of the row's own columns gets match_ before it."""
    kept = [c for c in found.columns if c != matches]
    fields = next(f.dataType.elementType for f in found.schema.fields if f.name == matches).names
    each = found.select(*kept, F.explode(matches).alias("__m"))
    append(each.select(*kept, *[F.col(f"__m.{f}").alias(f"match_{f}" if f.lower() in {c.lower() for c in kept} else f) for f in fields]), path)


def log_run(metrics: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's metrics; latest_run finds the last."""
    append(metrics.withColumn("run_id", F.lit(run_id)), path, once=["run_id", *[c for c in metrics.columns if c in ("tier", "signal", "metric")]])


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs.join(F.broadcast(runs.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")


def split(df: DataFrame, id_col: str, folder: str, held_out: int = 300, seed_rows: int = 5) -> None:
    """Writes heldout, seed and train by the order of a hash of the id."""
    ordered = df.withColumn("__h", F.md5(F.col(id_col).cast("string")))
    first = ordered.orderBy("__h", id_col).limit(held_out + seed_rows).withColumn("__r", F.row_number().over(Window.orderBy("__h", id_col)))
    for name, rows in (("heldout", first.where(F.col("__r") <= held_out)), ("seed", first.where(F.col("__r") > held_out))):
        replace(rows.drop("__h", "__r"), f"{folder}/{name}")
    replace(df.join(F.broadcast(first.select(id_col)), id_col, "left_anti"), f"{folder}/train")


def pending(tasks: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """Tasks that no result has."""
    return tasks.join(done.select(key), key, "left_anti")


def save_profiles_json(profiles: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """A JSON document a line, one for each profile, and the metadata beside them."""
    profiles.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/profiles")
    if meta is not None:
        meta.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/metadata")


def latest(rows: DataFrame, key: str, time_col: str) -> DataFrame:
    """The last row of each key by time."""
    cols = [c for c in rows.columns if c not in (key, time_col)]
    return rows.groupBy(key).agg(F.max_by(F.struct(time_col, *cols), F.col(time_col)).alias("l")).select(key, "l.*")


def stats(log: DataFrame, hits: DataFrame, users: DataFrame, tenants: DataFrame, scope: dict[str, str], as_of: str, hours: int = 24) -> DataFrame:
    """kind, name, n: verdicts and pattern matches of the last hours, users and ready profiles, of the tenants in scope.

    scope names columns of tenants and their values, such as reseller_id or distributor_id; empty means all.
    """
    inside = tenants
    for c, v in scope.items():
        inside = inside.where(F.col(c) == v)
    inside = inside.select("tenant_id").distinct()
    recent = lambda df, c: df.join(inside, "tenant_id", "left_semi").where((F.col(c) > F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))) & (F.col(c) <= F.lit(as_of).cast("timestamp")))
    verdicts = recent(log, "scored_at").groupBy(F.col("verdict").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("verdict"))
    patterns = recent(hits, "created_at").groupBy(F.col("pattern_type").alias("name")).agg(F.sum("match_count").alias("n")).withColumn("kind", F.lit("pattern"))
    own = users.join(inside, "tenant_id", "left_semi")
    counts = own.agg(F.count("*").alias("users"), F.count_if(F.col("cpp_status") == "ready").alias("ready")).select(F.expr("stack(2, 'users', users, 'ready', ready) as (name, n)")).withColumn("kind", F.lit("users"))
    return verdicts.unionByName(patterns).unionByName(counts).select("kind", "name", "n")


def effective_policy(users: DataFrame, layers: list[tuple[str, DataFrame, str]], defaults: dict[str, float]) -> DataFrame:
    """users with each setting of defaults and the layer it comes from.

    layers are (name, table, key in both), the first one wins where it isn't null; a table has a row for each key, or a
    priority column by which the highest is taken, ties to the smaller policy_id.
    """
    out = users
    for name, df, key in layers:
        if "priority" in df.columns:
            df = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in defaults if c in df.columns]), F.struct("priority", -F.col("policy_id"))).alias("b")).select(key, "b.*")
        held = [c for c in defaults if c in df.columns]
        out = out.join(df.select(key, *[F.col(c).alias(f"__{name}_{c}") for c in held]), key, "left")
    for c, default in defaults.items():
        have = [(n, F.col(f"__{n}_{c}")) for n, df, _ in layers if c in df.columns]
        out = out.withColumn(c, F.coalesce(*[v for _, v in have], F.lit(default)))
        source = F.lit("constant")
        for n, v in reversed(have):
            source = F.when(v.isNotNull(), n).otherwise(source)
        out = out.withColumn(f"{c}_source", source)
    return out.drop(*[c for c in out.columns if c.startswith("__")])
