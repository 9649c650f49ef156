"""Detector quality, send behaviour, context vectors and cleaning; each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .base import MESSAGES, messages, rounded_as_sql, table
from .risk_queries import COMPOSED, composed


def by_score(scores: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by, score, p, n: rows of both classes at each distinct score; windows over these are as long as scores differ."""
    return scores.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("double")).alias("p"), F.sum((F.col(label) != 1).cast("double")).alias("n"))


def auc(scores: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Rank AUC with ties at their mean rank, by groups."""
    g = by_score(scores, by, score, label)
    below = F.sum(F.col("p") + F.col("n")).over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    mid = F.coalesce(below, F.lit(0.0)) + (F.col("p") + F.col("n") + 1) / F.lit(2.0)
    t = g.withColumn("mid", mid).groupBy(*by).agg(F.sum(F.col("mid") * F.col("p")).alias("ranks"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.where("p > 0 and n > 0").select(*by, F.round((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n")), 6).alias("auc"))


def long_signals(spark, sf) -> DataFrame:
    """One row for each document and signal."""
    s = composed(spark, sf).withColumn("composite", F.col("v.composite"))
    return s.select("doc_id", "toxic", F.expr("stack(4, 'style', style, 'context', context, 'payload', payload, 'composite', composite) as (signal, score)")).withColumn("score", rounded_as_sql(F.col("score")))


LONG = f"{COMPOSED}, long AS (SELECT doc_id, toxic, 'style' AS signal, round(style, 6) AS score FROM composed UNION ALL SELECT doc_id, toxic, 'context', round(context, 6) FROM composed UNION ALL SELECT doc_id, toxic, 'payload', round(payload, 6) FROM composed UNION ALL SELECT doc_id, toxic, 'composite', round(composite, 6) FROM composed)"
AUC = "mids AS (SELECT signal, toxic, rank() OVER (PARTITION BY signal ORDER BY score) + (count(*) OVER (PARTITION BY signal, score) - 1) / 2.0::DOUBLE AS mid FROM long), sums AS (SELECT signal, CAST(sum(mid) FILTER (toxic = 1) AS DOUBLE) AS ranks, CAST(count(*) FILTER (toxic = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (toxic <> 1) AS DOUBLE) AS n FROM mids GROUP BY signal), aucs AS (SELECT signal, round((ranks - p * (p + 1) / 2) / (p * n), 6) AS auc FROM sums)"


def rank_auc(spark, sf):
    return auc(long_signals(spark, sf), ["signal"], "score", "toxic")


def per_feature_auc(spark, sf):
    """Signals by how far their AUC is from chance."""
    return rank_auc(spark, sf).select("signal", "auc", F.round(F.abs(F.col("auc") - 0.5), 6).alias("strength"))


def roc_curve(spark, sf):
    """Rates of both classes at every distinct score, highest first."""
    g = long_signals(spark, sf).where("signal = 'composite'").groupBy("score").agg(F.sum((F.col("toxic") == 1).cast("double")).alias("p"), F.sum((F.col("toxic") != 1).cast("double")).alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return g.select("score", rounded_as_sql(F.sum("p").over(w) / F.sum("p").over(every)).alias("tpr"), rounded_as_sql(F.sum("n").over(w) / F.sum("n").over(every)).alias("fpr"))


def catch_at_fpr(spark, sf):
    """Share of toxic documents strictly over the score of the clean one at place int(n f)."""
    g = by_score(long_signals(spark, sf), ["signal"], "score", "toxic")
    down = Window.partitionBy("signal").orderBy(F.desc("score"))
    upto = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy("signal")), "over": F.coalesce(F.sum("p").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "toxic": F.sum("p").over(Window.partitionBy("signal"))})
    place = F.floor(F.col("total") * F.col("rate")) + 1
    cuts = g.withColumn("rate", F.explode(F.array(F.lit(0.02), F.lit(0.05)))).where((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place) & (F.col("toxic") > 0))
    return cuts.select("signal", "rate", F.round(F.col("over") / F.col("toxic"), 6).alias("catch"))


CATCH = "clean AS (SELECT signal, score, row_number() OVER (PARTITION BY signal ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY signal) AS n FROM long WHERE toxic <> 1), cuts AS (SELECT signal, rate, score AS cut FROM clean, (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) f(rate) WHERE r = floor(n * rate) + 1), catches AS (SELECT signal, rate, round(avg(CASE WHEN score > cut THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS catch FROM long JOIN cuts USING (signal) WHERE toxic = 1 GROUP BY ALL)"


def score_stats(spark, sf):
    """Mean, median, spread and 95th percentile (interpolated, and by place) of clean scores."""
    s = long_signals(spark, sf).where("toxic <> 1")
    # scores have six places, so what lies between two of them has eight and is no tie
    r = lambda c, a, places=6: F.round(c, places).alias(a)
    blocks = s.groupBy("signal").agg(r(F.avg("score"), "mean"), r(F.percentile("score", F.lit(0.5)), "median", 9), r(F.stddev_pop("score"), "sd"), r(F.percentile("score", F.lit(0.95)), "p95", 9))
    g = s.groupBy("signal", "score").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("signal").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy("signal"))})
    place = F.floor(F.col("total") * 0.95) + 1
    return blocks.join(g.where((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place)).select("signal", F.col("score").alias("p95_by_place")), "signal", "left")


def calibration_ece(spark, sf):
    """Ten bins of the composite score: size, mean score, toxic share and the weighted gap."""
    s = long_signals(spark, sf).where("signal = 'composite'").withColumn("bin", F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("long"))
    total = F.sum("n").over(Window.partitionBy())
    g = s.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.avg(F.col("toxic").cast("double")).alias("share"))
    return g.select("bin", "n", F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"), F.round(F.col("n") / total * F.abs(F.col("mean") - F.col("share")), 6).alias("gap"))


def ship_gate(spark, sf):
    """False-flag rate of clean documents, catch at 2 %, and whether both reach the gate."""
    v = composed(spark, sf).where("toxic <> 1").agg(F.round(F.avg((F.col("v.verdict") != "pass").cast("double")), 6).alias("false_flags"))
    c = catch_at_fpr(spark, sf).where("signal = 'composite' and rate = 0.02").select("catch")
    return v.crossJoin(c).select("false_flags", "catch", ((F.col("false_flags") <= 0.03) & (F.col("catch") >= 0.85)).alias("ships"))


def verdicts_by_label(spark, sf):
    return composed(spark, sf).groupBy("toxic", "v.verdict").agg(F.count("*").alias("n")).select(F.col("toxic").cast("long").alias("toxic"), "verdict", "n")


def lowest_scores(spark, sf):
    """The three toxic documents that each signal scores lowest."""
    # the filter on the rank lets Spark keep three rows of each signal before the shuffle
    r = F.row_number().over(Window.partitionBy("signal").orderBy("score", "doc_id"))
    return long_signals(spark, sf).where("toxic = 1").withColumn("r", r).where("r <= 3").select("signal", "doc_id", "score")


def gaps(spark, sf) -> DataFrame:
    """Days since the send before, by user."""
    e = table(spark, sf, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", "user_id", "ts", "value", "event_type", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(86400e6)).alias("gap"))


GAPS = "gaps AS (SELECT event_id, user_id, ts, value, event_type, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) / 86400e6::DOUBLE AS gap FROM events)"


def send_gaps(spark, sf):
    g = gaps(spark, sf).where("gap is not null").groupBy("user_id")
    return g.agg(F.round(F.avg("gap"), 6).alias("mean"), F.round(F.percentile("gap", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("gap", F.lit(0.9)), 6).alias("p90"), F.round(F.stddev_pop("gap"), 6).alias("sd"))


def send_profile(spark, sf):
    """Profile of each user: size, range, a block of statistics, histograms of hours and weekdays."""
    e = table(spark, sf, "events")
    hours = [F.round(F.avg((F.hour("ts") == h).cast("double")), 6) for h in range(24)]
    days = [F.round(F.avg((F.weekday("ts") == d).cast("double")), 6) for d in range(7)]
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.1)), 6).alias("p10"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.avg((F.col("event_type") == "click").cast("double")), 6).alias("reply_rate"), *[h.alias(f"h{i:02}") for i, h in enumerate(hours)], *[d.alias(f"d{i}") for i, d in enumerate(days)])
    return g.withColumn("known", F.col("n") >= 3)


def top_event_types(spark, sf):
    """The three commonest types of each user; ties by who came first."""
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first"))
    return g.withColumn("r", r).where("r <= 3").select("user_id", "event_type", "n")


def best_recipient_profile(spark, sf):
    """Each message with recipients: the profile of the recipient written to most, first listed on ties, else the global one."""
    m = messages(spark, sf).select("msg_id", F.posexplode(F.filter(F.transform(F.split("recipients", ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")).alias("place", "address"))
    p = m.groupBy("address").agg(F.count("*").alias("n_sends")).where("n_sends >= 3")
    j = m.join(p, "address", "left")
    best = F.max_by(F.struct("address", "n_sends"), F.struct(F.coalesce("n_sends", F.lit(0)), -F.col("place")))
    total = m.select("msg_id").distinct().agg(F.count("*").alias("all_sends"))
    return j.groupBy("msg_id").agg(best.alias("b"), F.count("*").alias("recipients")).crossJoin(F.broadcast(total)).select("msg_id", "b.address", F.coalesce("b.n_sends", "all_sends").alias("n_sends"), "recipients")


def clean_transcript(spark, sf):
    return messages(spark, sf).select("msg_id", F.md5(T.clean_transcript(F.col("body"))).alias("digest"), F.length(T.clean_transcript(F.col("body"))).cast("long").alias("n"))


def style_similarity(spark, sf):
    """Cosine of each vector with the mean of its label."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    m = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.join(m, "label").select("vec_id", F.round(dot(F.col("v"), F.col("c")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("c"), F.col("c"))), 5).alias("cosine"))


QUERIES = {f.__name__: f for f in (rank_auc, per_feature_auc, roc_curve, catch_at_fpr, score_stats, calibration_ece, ship_gate, verdicts_by_label, lowest_scores, send_gaps, send_profile, top_event_types, best_recipient_profile, clean_transcript, style_similarity)}
STAT = lambda c, n: f"round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_pop({c}), 6) AS sd"
SQL = {
    "rank_auc": f"WITH {LONG}, {AUC} SELECT * FROM aucs",
    "per_feature_auc": f"WITH {LONG}, {AUC} SELECT signal, auc, round(abs(auc - 0.5), 6) AS strength FROM aucs",
    "roc_curve": f"WITH {LONG}, g AS (SELECT score, CAST(count(*) FILTER (toxic = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (toxic <> 1) AS DOUBLE) AS n FROM long WHERE signal = 'composite' GROUP BY score) SELECT score, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 6) AS fpr FROM g",
    "catch_at_fpr": f"WITH {LONG}, {CATCH} SELECT * FROM catches",
    "score_stats": f"WITH {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score, doc_id) AS r, count(*) OVER (PARTITION BY signal) AS n FROM long WHERE toxic <> 1) SELECT signal, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 9) AS median, round(stddev_pop(score), 6) AS sd, round(quantile_cont(score, 0.95), 9) AS p95, max(CASE WHEN r = floor(n * 0.95) + 1 THEN score END) AS p95_by_place FROM r GROUP BY signal",
    "calibration_ece": f"WITH {LONG}, g AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(score) AS mean, avg(CAST(toxic AS DOUBLE)) AS share FROM long WHERE signal = 'composite' GROUP BY 1) SELECT bin, n, round(mean, 6) AS mean, round(share, 6) AS share, round(n / CAST(sum(n) OVER () AS DOUBLE) * abs(mean - share), 6) AS gap FROM g",
    "ship_gate": f"WITH {LONG}, {CATCH}, v AS (SELECT round(avg(CASE WHEN verdict <> 'pass' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS false_flags FROM composed WHERE toxic <> 1) SELECT false_flags, catch, false_flags <= 0.03 AND catch >= 0.85 AS ships FROM v, catches WHERE signal = 'composite' AND rate = 0.02::DOUBLE",
    "verdicts_by_label": f"WITH {COMPOSED} SELECT CAST(toxic AS BIGINT) AS toxic, verdict, count(*) AS n FROM composed GROUP BY ALL",
    "lowest_scores": f"WITH {LONG} SELECT signal, doc_id, score FROM long WHERE toxic = 1 QUALIFY row_number() OVER (PARTITION BY signal ORDER BY score, doc_id) <= 3",
    "send_gaps": f"WITH {GAPS} SELECT user_id, {STAT('gap', 0)}, round(quantile_cont(gap, 0.9), 6) AS p90 FROM gaps WHERE gap IS NOT NULL GROUP BY user_id",
    "send_profile": f"SELECT user_id, count(*) AS n, min(event_id) AS first, {STAT('value', 0)}, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS reply_rate, {', '.join(f'round(avg(CASE WHEN hour(ts) = {h} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS h{h:02}' for h in range(24))}, {', '.join(f'round(avg(CASE WHEN isodow(ts) = {d + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS d{d}' for d in range(7))}, count(*) >= 3 AS known FROM events GROUP BY user_id",
    "top_event_types": "WITH g AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) <= 3",
    "best_recipient_profile": f"WITH {MESSAGES}, a AS (SELECT msg_id, list_filter(list_transform(string_split(recipients, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS rs FROM msgs), m AS (SELECT msg_id, unnest(range(1, len(rs) + 1)) AS place, unnest(rs) AS address FROM a), p AS (SELECT address, count(*) AS n_sends FROM m GROUP BY address HAVING count(*) >= 3), t AS (SELECT count(DISTINCT msg_id) AS all_sends FROM m), j AS (SELECT m.msg_id, m.address, n_sends, row_number() OVER (PARTITION BY msg_id ORDER BY coalesce(n_sends, 0) DESC, place) AS r, count(*) OVER (PARTITION BY msg_id) AS recipients FROM m LEFT JOIN p ON m.address = p.address) SELECT msg_id, address, coalesce(n_sends, all_sends) AS n_sends, recipients FROM j, t WHERE r = 1",
    "clean_transcript": f"WITH {MESSAGES}, c AS (SELECT msg_id, trim(regexp_replace(regexp_replace(regexp_replace(body, '\\[?[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?\\]?', '', 'g'), '(?m)^[A-Z][A-Za-z]{{0,30}}:[ \\t]*', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM msgs) SELECT msg_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM c",
    "style_similarity": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), x AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e), c AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), m AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label) SELECT vec_id, round(list_inner_product(v, c) / sqrt(list_inner_product(v, v) * list_inner_product(c, c)), 5) AS cosine FROM e JOIN m USING (label)",
}
