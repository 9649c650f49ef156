"""Dashboards, policy resolution, upserts and corpus writers, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .base import messages, table

AS_OF = "2024-01-31 00:00:00"


def windowed(spark, sf, hours: int = 240) -> DataFrame:
    """Events of the last hours before AS_OF."""
    return table(spark, sf, "events").where((F.col("ts") > F.expr(f"timestamp'{AS_OF}' - interval {hours} hours")) & (F.col("ts") <= F.lit(AS_OF).cast("timestamp")))


WINDOWED = f"recent AS (SELECT * FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR AND ts <= TIMESTAMP '{AS_OF}')"


def verdict_counts_window(spark, sf):
    return windowed(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))


def pattern_totals(spark, sf):
    """Hits and matches by pattern; the order is total."""
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("hits"), F.sum((F.col("event_id") % 5).cast("long")).alias("matches"))
    return e.orderBy(F.desc("hits"), "event_type")


def alert_summary(spark, sf):
    """Conditional counts without groups; a condition that never holds counts 0."""
    return windowed(spark, sf).agg(F.count("*").alias("scored"), F.count_if(F.col("value") >= 50).alias("held"), F.count_if((F.col("value") >= 20) & (F.col("value") < 50)).alias("flagged"), F.count_if(F.col("event_type") == "none").alias("never"), F.round(F.avg("value"), 6).alias("avg_value"))


def recent_alerts(spark, sf):
    """The latest 50 of two event types with their customer, if there is one."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return e.join(c, "user_id", "left").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "c_name", "event_type")


def scoped(spark, sf):
    """Customers below one region, by semi joins."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")


def scope_stats_distributor(spark, sf):
    o = table(spark, sf, "orders")
    return o.join(scoped(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def scope_tenants_with_orders(spark, sf):
    c = scoped(spark, sf)
    return c.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count("*").alias("tenants"))


KEYS = {"warn": (0.35, 10), "hold": (0.55, 20)}


def effective_policy(spark, sf):
    """Thresholds of each customer by layers: group, default policy, customer, nation, region, constant; with the layer that decided."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    groups = table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("member"), (F.col("p_size") % 7).alias("priority"), F.col("p_partkey").alias("group_id"))
    best = groups.groupBy("member").agg(F.max_by("group_id", F.struct("priority", -F.col("group_id"))).alias("group_id"))
    c = c.join(best, (F.col("c_custkey") % 50) == F.col("member"), "left")
    value = lambda col, mod, rest, scale: F.when(F.col(col) % mod == rest, (F.col(col) % 10).cast("double") / scale)
    out = [F.col("c_custkey")]
    for name, (default, scale) in KEYS.items():
        layers = [("group", value("group_id", 2, 0, scale)), ("default", value("c_custkey", 11, 0, scale)), ("tenant", value("c_custkey", 5, 1, scale)), ("reseller", value("n_nationkey", 3, 1, scale)), ("distributor", value("r_regionkey", 2, 0, scale))]
        out.append(F.round(F.coalesce(*[v for _, v in layers], F.lit(default)), 6).alias(name))
        source = F.lit("constant")
        for layer, v in reversed(layers):
            source = F.when(v.isNotNull(), F.lit(layer)).otherwise(source)
        out.append(source.alias(f"{name}_source"))
    return c.select(*out)


def _policy_sql() -> str:
    value = lambda col, mod, rest, scale: f"CASE WHEN {col} % {mod} = {rest} THEN CAST({col} % 10 AS DOUBLE) / {scale} END"
    cols = []
    for name, (default, scale) in KEYS.items():
        layers = [("group", value("group_id", 2, 0, scale)), ("default", value("c_custkey", 11, 0, scale)), ("tenant", value("c_custkey", 5, 1, scale)), ("reseller", value("n_nationkey", 3, 1, scale)), ("distributor", value("r_regionkey", 2, 0, scale))]
        cols.append(f"round(coalesce({', '.join(v for _, v in layers)}, CAST({default} AS DOUBLE)), 6) AS {name}")
        cols.append("CASE " + " ".join(f"WHEN ({v}) IS NOT NULL THEN '{layer}'" for layer, v in layers) + f" ELSE 'constant' END AS {name}_source")
    return f"""WITH g AS (SELECT p_partkey % 20 AS member, p_partkey AS group_id, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_size % 7 DESC, p_partkey) AS r FROM part)
SELECT c_custkey, {", ".join(cols)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN g ON c_custkey % 50 = member AND r = 1"""


def latest_per_key(spark, sf):
    o = table(spark, sf, "orders")
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))
    return o.groupBy("o_custkey").agg(last.alias("l")).select("o_custkey", F.col("l.o_orderkey").alias("orderkey"), F.col("l.o_totalprice").alias("total"))


def upsert_latest_wins(spark, sf):
    """A second batch of rows replaces those with the same key."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("bal"), F.lit(0).alias("batch"))
    new = table(spark, sf, "customer").where("c_custkey % 7 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1000000)).alias("c_custkey"), F.lower("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("bal"), F.lit(1).alias("batch"))
    r = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("batch")))
    return c.unionByName(new).withColumn("r", r).where("r = 1").select("c_custkey", "c_name", F.round("bal", 2).alias("bal"), F.col("batch").cast("long").alias("batch"))


def tenants_without_policy(spark, sf):
    """Rows for which a default has to be created: a left anti join."""
    p = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return table(spark, sf, "customer").join(p, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def resume_pending(spark, sf):
    """Tasks that no result has."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


def writer_stats(spark, sf):
    d = messages(spark, sf).withColumn("w", F.size(T.fields(F.col("body"))))
    return d.groupBy("author").agg(F.count("*").alias("sent"), F.min("msg_id").alias("first_id"), F.max("msg_id").alias("last_id"), F.round(F.avg("w"), 1).alias("avg_words"), F.round(F.stddev_samp("w"), 1).alias("sd_words"), F.countDistinct("recipients").alias("recipients"))


WORDS = "CAST(len(list_filter(regexp_split_to_array(body, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS BIGINT)"


def eligible_writers(spark, sf):
    return messages(spark, sf).groupBy("author").count().where("count >= 50").agg(F.count("*").alias("writers"))


def per_writer_cap(spark, sf):
    """At most 20 messages of each author, the smallest ids first."""
    r = F.row_number().over(Window.partitionBy("author").orderBy("msg_id"))
    return messages(spark, sf).withColumn("r", r).where("r <= 20").select("msg_id", "author")


def holdout_split(spark, sf):
    """The first 300 documents by a hash of their id are held out, 5 of the others are the seed sample."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    # the first ones by a limit, numbered among themselves, instead of a sort of all rows in one task
    first = d.orderBy("h", "doc_id").limit(305).withColumn("r", F.row_number().over(Window.orderBy("h", "doc_id"))).select("doc_id", "r")
    return d.join(F.broadcast(first), "doc_id", "left").select("doc_id", F.when(F.col("r") <= 300, "heldout").when(F.col("r") <= 305, "seed").otherwise("train").alias("part"))


def corpus_stats_by_month(spark, sf):
    e = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return e.groupBy("month").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("senders"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def sampled_recipients(spark, sf):
    """Each labelled toxic document gets a customer, drawn by weight: a range join of a pick with cumulative weights."""
    w = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 5 + 1).cast("long").alias("weight"))
    hi = F.sum("weight").over(Window.orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, 0))
    w = w.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("weight"))
    pick = table(spark, sf, "labels").where("toxic = 1").select("doc_id", (F.col("doc_id") * 31 % 75).alias("pick"))
    return pick.join(F.broadcast(w), (F.col("pick") >= F.col("lo")) & (F.col("pick") < F.col("hi"))).select("doc_id", "n_nationkey")


def sync_counters(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("rows"), F.countDistinct("conv_id").alias("conversations"), F.count_if(F.length("text") < 200).alias("skipped"))


def category_totals_by_hour(spark, sf):
    """Tumbling hours over events."""
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


QUERIES = {f.__name__: f for f in (verdict_counts_window, pattern_totals, alert_summary, recent_alerts, scope_stats_distributor, scope_tenants_with_orders, effective_policy, latest_per_key, upsert_latest_wins, tenants_without_policy, resume_pending, writer_stats, eligible_writers, per_writer_cap, holdout_split, corpus_stats_by_month, sampled_recipients, sync_counters, category_totals_by_hour)}
from .base import MESSAGES  # noqa: E402

SCOPED = "scoped AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey = 1)))"
SQL = {
    "verdict_counts_window": f"WITH {WINDOWED} SELECT event_type, count(*) AS n FROM recent GROUP BY event_type",
    "pattern_totals": "SELECT event_type, count(*) AS hits, CAST(sum(event_id % 5) AS BIGINT) AS matches FROM events GROUP BY event_type ORDER BY hits DESC, event_type",
    "alert_summary": f"WITH {WINDOWED} SELECT count(*) AS scored, count(*) FILTER (value >= 50) AS held, count(*) FILTER (value >= 20 AND value < 50) AS flagged, count(*) FILTER (event_type = 'none') AS never, round(avg(value), 6) AS avg_value FROM recent",
    "recent_alerts": "SELECT event_id, user_id, c_name, event_type FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 50",
    "scope_stats_distributor": f"WITH {SCOPED} SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM scoped) GROUP BY o_orderstatus",
    "scope_tenants_with_orders": f"WITH {SCOPED} SELECT count(*) AS tenants FROM scoped WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "effective_policy": _policy_sql(),
    "latest_per_key": "SELECT o_custkey, o_orderkey AS orderkey, o_totalprice AS total FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "upsert_latest_wins": "WITH u AS (SELECT c_custkey, c_name, c_acctbal AS bal, 0 AS batch FROM customer UNION ALL SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END, lower(c_name), c_acctbal + 1, 1 FROM customer WHERE c_custkey % 7 = 0) SELECT c_custkey, c_name, round(bal, 2) AS bal, CAST(batch AS BIGINT) AS batch FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY batch DESC) = 1",
    "tenants_without_policy": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "resume_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "writer_stats": f"WITH {MESSAGES}, w AS (SELECT *, {WORDS} AS w FROM msgs) SELECT author, count(*) AS sent, min(msg_id) AS first_id, max(msg_id) AS last_id, round(avg(w), 1) AS avg_words, round(stddev_samp(w), 1) AS sd_words, count(DISTINCT recipients) AS recipients FROM w GROUP BY author",
    "eligible_writers": f"WITH {MESSAGES}, g AS (SELECT author FROM msgs GROUP BY author HAVING count(*) >= 50) SELECT count(*) AS writers FROM g",
    "per_writer_cap": f"WITH {MESSAGES} SELECT msg_id, author FROM msgs QUALIFY row_number() OVER (PARTITION BY author ORDER BY msg_id) <= 20",
    "holdout_split": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) SELECT doc_id, CASE WHEN r <= 300 THEN 'heldout' WHEN r <= 305 THEN 'seed' ELSE 'train' END AS part FROM r",
    "corpus_stats_by_month": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT o_custkey) AS senders, round(avg(o_totalprice), 2) AS mean, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "sampled_recipients": "WITH w AS (SELECT n_nationkey, sum(n_nationkey % 5 + 1) OVER (ORDER BY n_nationkey) AS hi, n_nationkey % 5 + 1 AS weight FROM nation) SELECT doc_id, n_nationkey FROM labels JOIN w ON doc_id * 31 % 75 >= hi - weight AND doc_id * 31 % 75 < hi WHERE toxic = 1",
    "sync_counters": "SELECT role, count(*) AS rows, count(DISTINCT conv_id) AS conversations, count(*) FILTER (length(text) < 200) AS skipped FROM conversations GROUP BY role",
    "category_totals_by_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
