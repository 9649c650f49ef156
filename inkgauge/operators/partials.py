"""Profiles from cells that add up: counts by key, measure and value, which two sets of messages merge by a sum.

A cell says how often a key has a value: words, marks a hundred words, hour, weekday, reply, opening, closing, or a time of
sending. Whatever a profile holds (means, deviations, interpolated percentiles, histograms, gaps between sends, commonest phrases)
follows from cells alone, so that a profile of all messages is that of its parts merged, and new mail is added without reading
the old. Percentiles and gaps come from running totals over parts of a key: no key, not even all messages as one, is gathered in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import lasting, scope, written
from ..sources import store
from .running import running

KNOWN, GLOBAL, TOP = 3, "_global", 5
RATES = ("dash", "ellipsis", "exclamation")
SPREAD = {"words": "full_words", "own_words": "own_words"} | {r: r for r in RATES}
PHRASES = {"greetings": "opens", "closings": "closes"}
QUANTILES = {"median": 0.5, "p10": 0.1, "p90": 0.9}
CELL = ["key", "measure", "value", "phrase"]
SEEN = "seen"


def cells(measured: DataFrame, key: str | None = "addresses") -> DataFrame:
    """key, measure, value (double), phrase, n, first (least msg_id of a phrase) of measured messages.

    Each address of a message is a key, and all messages together are one, GLOBAL; with key a plain column, that column's
    values are the keys instead, null left out.
    """
    kind = dict(measured.dtypes)["msg_id"]
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast(kind)
    cell = lambda measure, value=None, phrase=None: F.struct(F.lit(measure).alias("measure"), (F.lit(None) if value is None else F.col(value)).cast("double").alias("value"), (none if phrase is None else F.col(phrase)).alias("phrase"), (no_id if phrase is None else F.col("msg_id")).alias("first"))
    found = [cell(m, c) for m, c in SPREAD.items()] + [cell(c, c) for c in ("hour", "day", "reply", "micros")] + [cell(m, None, c) for m, c in PHRASES.items()]
    rows = measured.withColumns({"reply": F.col("reply").cast("double"), "micros": F.unix_micros(F.col("sent").cast("timestamp"))})
    keys = F.concat(F.coalesce("addresses", F.array().cast("array<string>")), F.array(F.lit(GLOBAL))) if key == "addresses" else F.array(F.col(key).cast("string"))
    # counted by message's values before keys come in, so that a message to many isn't taken apart for each
    each = rows.select(keys.alias("keys"), F.explode(F.filter(F.array(*found), lambda c: c["value"].isNotNull() | (F.coalesce(c["phrase"], F.lit("")) != ""))).alias("c"))
    return each.select(F.explode("keys").alias("key"), "c.*").where("key is not null").groupBy(*CELL).agg(F.count("*").alias("n"), F.min("first").alias("first"))


def merged(*parts: DataFrame) -> DataFrame:
    """The cells of the messages of all parts, which have no message in common."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*CELL).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def gap_cells(parts: DataFrame) -> DataFrame:
    """Cells of the days between neighbouring sends of each key."""
    sends = parts.where("measure = 'micros'")
    before = running(sends, "key", [F.col("value")], {"before": ("last", F.col("value"))}, {"value": F.col("value"), "n": F.col("n")}, inclusive=False)
    between = before.where("before is not null").select("key", ((F.col("value") - F.col("before")) / F.lit(86400e6)).alias("value"), F.lit(1).cast("long").alias("n"))
    same = before.where("n > 1").select("key", F.lit(0.0).alias("value"), (F.col("n") - 1).alias("n"))
    return between.unionByName(same).groupBy("key", "value").agg(F.sum("n").alias("n")).select("key", F.lit("gap_days").alias("measure"), "value", "n")


def spreads(parts: DataFrame) -> DataFrame:
    """key, measure, s: struct<mean,median,p10,p90,std> of the values of cells, as of their rows: interpolated, population's deviation."""
    rows = written(parts.select("key", "measure", "value", "n"))
    totals = written(rows.groupBy("key", "measure").agg(F.sum("n").alias("total"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")))
    upto = running(rows, ["key", "measure"], [F.col("value")], {"upto": ("sum", F.col("n"))}, {"value": F.col("value"), "n": F.col("n")})
    j = upto.join(totals, ["key", "measure"])
    place = {q: F.lit(p) * (F.col("total") - 1) for q, p in QUANTILES.items()}
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))
    g = j.groupBy("key", "measure").agg(
        F.first("mean").alias("mean"), F.first("total").alias("total"), F.sqrt(F.sum(F.col("n") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))) / F.sum("n")).alias("std"),
        *[at(F.floor(p)).alias(f"{q}_low") for q, p in place.items()], *[at(F.ceil(p)).alias(f"{q}_high") for q, p in place.items()],
    )
    between = lambda q, p: F.when(F.col(f"{q}_low") == F.col(f"{q}_high"), F.col(f"{q}_low")).otherwise((F.ceil(p) - p) * F.col(f"{q}_low") + (p - F.floor(p)) * F.col(f"{q}_high"))
    return g.select("key", "measure", F.struct("mean", *[between(q, p).alias(q) for q, p in place.items()], "std").alias("s"))


def _histogram(measure: str, size: int) -> Column:
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    known = count(F.col("measure") == measure)
    return F.array(*[F.coalesce(count((F.col("measure") == measure) & (F.col("value") == i)) / F.nullif(known, F.lit(0.0)), F.lit(0.0)) for i in range(size)])


def finished(parts: DataFrame, top: int = TOP) -> DataFrame:
    """A profile for each key of cells: address, n_sends, is_known, first_seen, last_seen, words, own_words, hours, days, gap_days,
    reply_rate, dash, ellipsis, exclamation, greetings, closings. A written table.
    """
    with scope(parts.sparkSession):
        rows = written(parts.where(F.col("measure") != SEEN))
        of = lambda m: F.col("measure") == m
        total = lambda c, v=None: F.sum(F.when(c, F.col("n") if v is None else F.col("n") * v))
        seen = lambda f: F.timestamp_micros(f(F.when(of("micros"), F.col("value"))).cast("long"))
        base = rows.groupBy("key").agg(
            total(of("words")).alias("n_sends"), seen(F.min).alias("first_seen"), seen(F.max).alias("last_seen"), _histogram("hour", 24).alias("hours"), _histogram("day", 7).alias("days"),
            (total(of("reply"), F.col("value")) / total(of("reply"))).alias("reply_rate"),
        )
        names = [*SPREAD, "gap_days"]
        numbers = spreads(rows.where(F.col("measure").isin(*SPREAD)).select("key", "measure", "value", "n").unionByName(gap_cells(rows)))
        none = F.struct(*[F.lit(0.0).alias(x) for x in ("mean", *QUANTILES, "std")])
        wide = numbers.groupBy("key").agg(*[F.coalesce(F.max(F.when(of(m), F.col("s"))), none).alias(m) for m in names])
        r = F.row_number().over(Window.partitionBy("key", "measure").orderBy(F.desc("n"), "first", "phrase"))
        best = rows.where(F.col("measure").isin(*PHRASES)).withColumn("__r", r).where(F.col("__r") <= top)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("__r", "phrase", "n"))), lambda x: F.struct(x["phrase"].alias("phrase"), x["n"].alias("n")))
        phrases = best.groupBy("key", "measure").agg(ordered.alias("top")).groupBy("key").agg(*[F.max_by("top", F.when(of(m), F.lit(1))).alias(m) for m in PHRASES])
        out = base.join(wide, "key").join(phrases, "key", "left")
        return lasting(out.select(F.col("key").alias("address"), "n_sends", (F.col("n_sends") >= KNOWN).alias("is_known"), "first_seen", "last_seen", "words", "own_words", "hours", "days", "gap_days", "reply_rate", *RATES, *PHRASES))


def manifest(messages: DataFrame) -> Column:
    """What a message is known by: a digest of sender, recipients, time, subject and body."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ("author", "recipients", "sent", "subject", "body")]), {"ignoreNullFields": "false"}), 256)


def add_mail(messages: DataFrame, path: str, measure, key: str | None = "addresses", known_by: Column | None = None) -> dict[str, int]:
    """Adds to the cells kept at path those of messages that they don't hold yet; returns how many were new and known.

    A message is known by its manifest, so that equal mail counts once, or else by known_by: where messages have numbers of their own,
    equal ones under two numbers are two.

    The digests of the messages lie in the same version of the table as their cells, so that a job that is lost or runs again adds
    each message once, whatever batches it comes in. measure makes measured messages of messages. Of two writers the second goes on top
    of the first.
    """
    spark = messages.sparkSession
    with scope(spark):
        came = written(messages.withColumn("__digest", manifest(messages) if known_by is None else known_by.cast("string")).dropDuplicates(["__digest"]))
        counts = {}

        def grown(old: DataFrame | None) -> DataFrame:
            new = came if old is None else came.join(old.where(F.col("measure") == SEEN).select(F.col("phrase").alias("__digest")), "__digest", "left_anti")
            new = written(new)
            counts["new"] = new.count()
            counts["known"] = came.count() - counts["new"]
            own = cells(measure(new.drop("__digest")), key)
            none = own.select("first").schema["first"].dataType
            seen = new.select(F.lit("").alias("key"), F.lit(SEEN).alias("measure"), F.lit(None).cast("double").alias("value"), F.col("__digest").alias("phrase"), F.lit(1).cast("long").alias("n"), F.lit(None).cast(none).alias("first"))
            return merged(own, seen) if old is None else merged(old, own, seen)

        store.update(spark, path, grown)
    return counts


def kept(spark, path: str) -> DataFrame | None:
    """The profiles of the cells at path; None if there are none yet."""
    held = store.load(spark, path)
    return None if held is None else finished(held)


def build_all(messages: DataFrame, users: DataFrame, path: str, measure, key: str = "author", least: int = 10, at: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """A job over all users: their new mail is added, and users come back with n_messages, cpp_status and, where it is ready, its profile.

    users have a column named as key. A user with at least `least` messages is ready, one with fewer is skipped, one without
    any is pending. Counters: new and known messages, users of each status. Mail of others is kept, but has no user.
    """
    counts = add_mail(messages, path, measure, key)
    p = kept(messages.sparkSession, path)
    cols = [c for c in p.columns if c not in ("address", "n_sends")]
    status = F.when(F.coalesce("n_messages", F.lit(0)) >= least, "ready").when(F.col("n_messages") > 0, "skipped").otherwise("pending")
    out = users.join(p.select(F.col("address").alias(key), F.col("n_sends").alias("n_messages"), F.struct(*cols).alias("profile")), key, "left")
    out = out.withColumns({"cpp_status": status, "n_messages": F.coalesce("n_messages", F.lit(0))}).withColumn("profile", F.when(F.col("cpp_status") == "ready", F.col("profile")))
    if at:
        out = out.withColumn("built_at", F.when(F.col("cpp_status") == "ready", F.lit(at).cast("timestamp")))
    return out, counts | {r.cpp_status: r["n"] for r in out.groupBy("cpp_status").agg(F.count("*").alias("n")).collect()}
