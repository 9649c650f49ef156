"""Queries on payload, sensitive data and verdicts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk
from ..functions import text as T
from ..functions.lexicons import PAYLOAD, SOFT, SOFT_AMPLIFIER
from ..shared import scope, written
from . import feature_queries as features
from .base import MESSAGES, messages, quoted, rounded_as_sql, table

CARD = risk.SENSITIVE[0][1]
ALL = [(c, w, p) for c, ps in PAYLOAD.items() for w, p in ps]
HARD = [c for c in PAYLOAD if c not in SOFT]
HITS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {quoted(p)}, 'i') THEN {{'category': {quoted(c)}, 'weight': CAST({w} AS DOUBLE), 'match': substr(regexp_extract(t, {quoted('(?i)' + p)}), 1, 80)}} END" for c, w, p in ALL) + "], lambda x: x IS NOT NULL)"
weight_sql = lambda c: f"coalesce(list_max(list_transform(list_filter(hits, lambda h: h.category = '{c}'), lambda h: h.weight)), 0.0::DOUBLE)"
SCORED_SQL = f"""{MESSAGES}, texts AS (SELECT msg_id, author, body, subject || chr(10) || body AS t FROM msgs), hit AS (SELECT *, {HITS_SQL} AS hits FROM texts),
weights AS (SELECT *, list_sort([{", ".join(map(weight_sql, HARD))}], 'DESC') AS hard, least({" + ".join(f"CASE WHEN {weight_sql(c)} > 0 THEN 1 ELSE 0 END" for c in SOFT)}, 2) AS soft FROM hit),
based AS (SELECT *, 1 - (1 - hard[1]) * (1 - hard[2]) AS base FROM weights),
scored AS (SELECT *, CAST(least(CASE WHEN base > 0 THEN base + {SOFT_AMPLIFIER}::DOUBLE * soft * (1 - base) ELSE 0.1::DOUBLE * soft END, 1.0) AS DOUBLE) AS score FROM based)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws("\n", "subject", "body")
    return messages(spark, sf).withColumn("hits", risk.payload_hits(text)).withColumn("score", risk.payload_score(F.col("hits")))


def payload_scan(spark, sf) -> DataFrame:
    return scored(spark, sf).select("msg_id", F.round("score", 6).alias("score"), F.size("hits").cast("long").alias("n_hits"))


def payload_scan_by_source(spark, sf) -> DataFrame:
    s = scored(spark, sf)
    return s.groupBy("author").agg(F.count("*").alias("messages"), F.count_if(F.col("score") > 0).alias("fired"), F.count_if(F.col("score") >= 0.5).alias("risky"), F.round(F.max("score"), 6).alias("worst"))


def payload_hits(spark, sf) -> DataFrame:
    return scored(spark, sf).select("msg_id", F.inline("hits"))


def payload_fire_diagnosis(spark, sf) -> DataFrame:
    """Categories by messages that fired them, at each level of score."""
    s = scored(spark, sf).select("msg_id", "score", F.explode(F.array_distinct(F.transform("hits", lambda h: h["category"]))).alias("category"))
    return s.groupBy("category").agg(F.count("*").alias("fired"), F.count_if(F.col("score") >= 0.9).alias("at_90"), F.count_if(F.col("score") >= 0.7).alias("at_70"), F.count_if(F.col("score") >= 0.5).alias("at_50"))


def sensitive_card_scan(spark, sf) -> DataFrame:
    """Card numbers of four brands, in groups or not, that pass the checksum."""
    cards = F.filter(F.regexp_extract_all("body", F.lit(CARD), F.lit(0)), risk.luhn)
    rows = messages(spark, sf).where(F.col("body").rlike(CARD)).withColumn("cards", cards)
    return rows.where(F.size("cards") > 0).select("msg_id", F.size("cards").cast("long").alias("n_cards"), F.concat(F.lit("************"), F.right(F.get("cards", F.lit(0)), F.lit(4))).alias("sample"))


def sensitive_all(spark, sf) -> DataFrame:
    """Every pattern that reaches medium confidence, by message."""
    return messages(spark, sf).select("msg_id", F.explode(risk.sensitive_matches(F.concat_ws("\n", "subject", "body"))).alias("m")).select("msg_id", "m.pattern_type", "m.match_count", "m.redacted", F.get(F.array(*[F.lit(c) for c in ("none", "low", "medium", "high")]), "m.rank").alias("confidence"))


def sensitive_summary(spark, sf) -> DataFrame:
    rows = messages(spark, sf).select("msg_id", "author", risk.sensitive_summary(risk.sensitive_matches(F.concat_ws("\n", "subject", "body"))).alias("s"))
    return rows.where("s.has_sensitive_data").select("msg_id", "s.total_matches", "s.highest_confidence", F.array_join("s.compliance_tags", "|").alias("tags"), "s.recommended_action")


def routing_numbers(spark, sf) -> DataFrame:
    """Nine-digit numbers that pass the bank checksum."""
    found = F.filter(F.regexp_extract_all("body", F.lit(r"\b[0-3][0-9]{8}\b"), F.lit(0)), risk.aba)
    return messages(spark, sf).select("msg_id", F.explode(found).alias("number"))


_signals: dict[tuple[str, str], DataFrame] = {}


def context_score(v: DataFrame) -> DataFrame:
    """msg_id, context: how far a message is from what its recipient gets: length, reply or not, known or not, marks; 1 where two of the four are fully off."""
    far = lambda c: F.least(F.lit(1.0), F.abs(F.col(c)) / F.lit(3.0))
    return v.select("msg_id", rounded_as_sql(F.least(F.lit(1.0), (far("wc_z_rec") + F.col("reply_mismatch") + (1 - F.col("rec_is_known")) + far("exclamation_z")) / F.lit(2.0))).alias("context"))


def signals(spark, sf) -> DataFrame:
    """Three scores of each labelled document: its deviation from its author's profile, its context, its payload.

    The composer's limits of style are for a probability that is rarely above .02; deviations are scaled so that .35, at which
    a deviation warns by itself, is .02.
    Profiles are those of all messages; what only labelled documents are asked is computed of these alone.
    Many queries read these scores: they are written once in a session for a folder.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _signals:
        with scope(spark):
            labels = table(spark, sf, "labels").select(F.col("doc_id").alias("msg_id"), "toxic")
            ids = labels.select("msg_id").distinct()
            mine = written(messages(spark, sf).join(ids, "msg_id", "left_semi"))
            style = features.deviation_score(spark, sf, mine).select("msg_id", (F.coalesce("score", F.lit(0.0)) / F.lit(17.5)).alias("style"))
            payload = scored(spark, mine).select("msg_id", F.round("score", 6).alias("payload"))
            context = context_score(features.context_features(spark, sf, ids))
            j = labels.join(style, "msg_id").join(context, "msg_id").join(payload, "msg_id")
            _signals[key] = written(j.select(F.col("msg_id").alias("doc_id"), "toxic", "style", "context", "payload"), -99)
    return _signals[key]


FAR = lambda c: f"least(1.0::DOUBLE, abs(c.{c}) / 3.0::DOUBLE)"
SIGNALS = f"""signals AS (SELECT l.doc_id, l.toxic, coalesce(d.score, 0) / 17.5::DOUBLE AS style, round(least(1.0::DOUBLE, ({FAR('wc_z_rec')} + c.reply_mismatch + (1 - c.rec_is_known) + {FAR('exclamation_z')}) / 2.0::DOUBLE), 6) AS context, p.score AS payload
FROM labels l JOIN ({features.SQL['deviation_score']}) d ON d.msg_id = l.doc_id JOIN ({features.SQL['context_features']}) c ON c.msg_id = l.doc_id JOIN (WITH {SCORED_SQL} SELECT msg_id, round(score, 6) AS score FROM scored) p ON p.msg_id = l.doc_id)"""
COMPOSED = f"""{SIGNALS}, normal AS (SELECT *, CASE WHEN style <= 0 THEN 0 WHEN style < 0.002::DOUBLE THEN style / 0.002::DOUBLE * 0.2::DOUBLE WHEN style < 0.007::DOUBLE THEN 0.2::DOUBLE + (style - 0.002::DOUBLE) / (0.007::DOUBLE - 0.002::DOUBLE) * 0.3::DOUBLE
WHEN style < 0.02::DOUBLE THEN 0.5::DOUBLE + (style - 0.007::DOUBLE) / (0.02::DOUBLE - 0.007::DOUBLE) * 0.4::DOUBLE WHEN style < 0.3::DOUBLE THEN 0.9::DOUBLE + (style - 0.02::DOUBLE) / (0.3::DOUBLE - 0.02::DOUBLE) * 0.1::DOUBLE ELSE 1 END AS c FROM signals),
rules AS (SELECT *, CASE WHEN style >= 0.02::DOUBLE THEN 1 WHEN style >= 0.007::DOUBLE AND payload >= 0.5 THEN 2 WHEN payload >= 0.5 THEN 3 WHEN style >= 0.007::DOUBLE AND context >= 0.7::DOUBLE THEN 4 WHEN context >= 0.7::DOUBLE THEN 5 WHEN style >= 0.002::DOUBLE AND context >= 0.5 THEN 6 ELSE 7 END AS rule FROM normal),
composed AS (SELECT *, CASE rule WHEN 1 THEN greatest(c, 0.9::DOUBLE) WHEN 2 THEN greatest(c, payload, 0.9::DOUBLE) WHEN 3 THEN greatest(payload, 0.85::DOUBLE) WHEN 4 THEN 0.5::DOUBLE * c + 0.5::DOUBLE * context WHEN 5 THEN 0.35::DOUBLE * c + 0.65::DOUBLE * context WHEN 6 THEN 0.5::DOUBLE * c + 0.5::DOUBLE * context ELSE 0.6::DOUBLE * c + 0.3::DOUBLE * context + 0.1::DOUBLE * payload END AS composite,
['style_high', 'style_mid+dlp_hit', 'dlp_hit', 'style_mid+context_high', 'context_high', 'grey_zone', 'clean'][rule] AS reason, ['block', 'block', 'block', 'flag', 'flag', 'pass', 'pass'][rule] AS verdict FROM rules)"""


def composed(spark, sf) -> DataFrame:
    return signals(spark, sf).withColumn("v", risk.compose(F.col("style"), F.col("context"), F.col("payload")))


def compose_verdict(spark, sf) -> DataFrame:
    return composed(spark, sf).select("doc_id", "v.verdict", rounded_as_sql(F.col("v.composite")).alias("composite"), "v.reason")


def reason_distribution(spark, sf) -> DataFrame:
    return composed(spark, sf).groupBy("v.verdict", "v.reason").agg(F.count("*").alias("n"))


def style_and_risk_by_author(spark, sf) -> DataFrame:
    """By author: messages, length, variety of words, risky share, verified cards, what to do."""
    m = messages(spark, sf).withColumn("own", T.strip_artifacts(F.col("body")))
    m = m.withColumn("w", T.words(F.col("own"))).withColumn("hits", risk.payload_hits(F.col("own"))).withColumn("score", risk.payload_score(F.col("hits"))).withColumn("cards", F.size(F.filter(risk.sensitive_values(F.col("own"), "credit_card", risk.SENSITIVE[0][1], 0), risk.luhn)))
    by = m.groupBy("author").agg(F.count("*").alias("messages"), F.round(F.avg(F.size("w")), 3).alias("avg_words"), F.round(F.avg(F.try_divide(F.size(F.array_distinct("w")).cast("double"), F.size("w").cast("double"))), 6).alias("variety"), F.round(F.avg((F.col("score") > 0).cast("double")), 6).alias("fired"), F.sum("cards").alias("cards"))
    return by.withColumn("action", F.when(F.col("cards") >= 3, "hold").when(F.col("cards") > 0, "warn").otherwise("log"))


def recommended_by_count(spark, sf) -> DataFrame:
    """Escalation: hold forces hold, warn lifts pass."""
    c = composed(spark, sf).withColumn("own", F.when(F.col("payload") >= 0.9, "hold").when(F.col("payload") >= 0.8, "warn").otherwise("log"))
    v = F.when(F.col("own") == "hold", "hold").when((F.col("own") == "warn") & (F.col("v.verdict") == "pass"), "warn").otherwise(F.col("v.verdict"))
    return c.groupBy(v.alias("final")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (style_and_risk_by_author, payload_scan, payload_scan_by_source, payload_hits, payload_fire_diagnosis, sensitive_card_scan, sensitive_all, sensitive_summary, routing_numbers, compose_verdict, reason_distribution, recommended_by_count)}
LUHN = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN (len({0}) - i) % 2 = 1 THEN CASE WHEN CAST({0}[i] AS INT) * 2 > 9 THEN CAST({0}[i] AS INT) * 2 - 9 ELSE CAST({0}[i] AS INT) * 2 END ELSE CAST({0}[i] AS INT) END)) % 10 = 0"
SQL = {
    "payload_scan": f"WITH {SCORED_SQL} SELECT msg_id, round(score, 6) AS score, CAST(len(hits) AS BIGINT) AS n_hits FROM scored",
    "payload_scan_by_source": f"WITH {SCORED_SQL} SELECT author, count(*) AS messages, count(*) FILTER (score > 0) AS fired, count(*) FILTER (score >= 0.5) AS risky, round(max(score), 6) AS worst FROM scored GROUP BY author",
    "payload_hits": f"WITH {SCORED_SQL}, e AS (SELECT msg_id, unnest(hits) AS h FROM scored) SELECT msg_id, h.category AS category, h.weight AS weight, h.match AS match FROM e",
    "payload_fire_diagnosis": f"WITH {SCORED_SQL}, e AS (SELECT DISTINCT msg_id, score, unnest(list_transform(hits, lambda h: h.category)) AS category FROM scored) SELECT category, count(*) AS fired, count(*) FILTER (score >= 0.9) AS at_90, count(*) FILTER (score >= 0.7) AS at_70, count(*) FILTER (score >= 0.5) AS at_50 FROM e GROUP BY category",
    "sensitive_card_scan": f"WITH {MESSAGES}, f AS (SELECT msg_id, list_filter(regexp_extract_all(body, {quoted(CARD)}), lambda s: length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND {LUHN.format("regexp_replace(s, '[^0-9]', '', 'g')")}) AS cards FROM msgs) SELECT msg_id, CAST(len(cards) AS BIGINT) AS n_cards, '************' || right(cards[1], 4) AS sample FROM f WHERE len(cards) > 0",
    "routing_numbers": f"WITH {MESSAGES}, f AS (SELECT msg_id, unnest(regexp_extract_all(body, '\\b[0-3][0-9]{{8}}\\b')) AS number FROM msgs) SELECT msg_id, number FROM f WHERE list_sum(list_transform(range(1, 10), lambda i: CAST(number[i] AS INT) * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0",
    "compose_verdict": f"WITH {COMPOSED} SELECT doc_id, verdict, round(composite, 6) AS composite, reason FROM composed",
    "reason_distribution": f"WITH {COMPOSED} SELECT verdict, reason, count(*) AS n FROM composed GROUP BY ALL",
    "recommended_by_count": f"WITH {COMPOSED} SELECT CASE WHEN payload >= 0.9::DOUBLE THEN 'hold' WHEN payload >= 0.8::DOUBLE AND verdict = 'pass' THEN 'warn' ELSE verdict END AS final, count(*) AS n FROM composed GROUP BY ALL",
}
