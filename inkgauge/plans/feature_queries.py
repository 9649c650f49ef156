"""Vectors, checks and cleaning of messages, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import BULK, CLOSING_WORDS, CONTRACTION, EXPANDED, FOOTERS, MESSAGE_CLOSINGS, MESSAGE_GREETINGS, REPLY_CUTS, SIGNATURE_CUTS
from ..operators import partials
from ..operators import profiles as P
from ..shared import written
from .base import MESSAGES, messages, quoted, table
from .profile_queries import FIELDS, GREETED, LINES, MARKS, NOISY, WORDS, count_sql, grams_sql, style_vector

SELF = "fr@example.org"


def rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def context_features(spark, sf, of=None):
    """The 20 context values of each message (or of those of the msg_ids in of) against its recipient's profile and the global one."""
    m = messages(spark, sf)
    rows = written(P.measured(m))
    every = partials.finished(partials.cells(rows))
    one = F.col("address") == partials.GLOBAL
    mine = rows if of is None else rows.join(of, "msg_id", "left_semi")
    return rounded(P.context_vector(m, every.where(~one), every.where(one), SELF, rows=mine))


def profile_meta(spark, sf):
    m = messages(spark, sf)
    return P.profile_meta(m, P.recipient_profiles(m)).select("n_emails", "n_recipients", "n_known_recipients")


def author_profiles(spark, sf):
    p = P.author_profiles(messages(spark, sf))
    return rounded(p.select("author", "messages", "avg_words", "grade", "contraction_ratio", "exclamation_per_1000", "formality", "formality_label", "perspective", F.array_join("greetings", "|").alias("greetings"), F.array_join("closings", "|").alias("closings")))


def deviation_score(spark, sf, of=None):
    """Each message (or each of those in of) against its author's profile: eight checks, score and verdict."""
    m = messages(spark, sf)
    return rounded(P.score_messages(m if of is None else of, P.author_profiles(m)))


def message_traits(spark, sf):
    """Grade, formality, contractions, greeting, closing and perspective of each message by itself."""
    b = F.col("body")
    return rounded(messages(spark, sf).select("msg_id", T.quick_grade(b).alias("grade"), T.quick_formality(b).alias("formality"), T.contraction_ratio(b).alias("contractions"), T.message_greeting(b).alias("greeting"), T.message_closing(b).alias("closing"), T.perspective(b).alias("perspective")))


def negative_space(spark, sf):
    """What each message does that the benchmark never does: nine values."""
    return rounded(P.negative_space(table(spark, sf, "benchmark"), messages(spark, sf), "text"))


def recipient_conditional(spark, sf):
    """Six values of each message against its recipient's baseline, if that is among the five largest, else all."""
    return rounded(P.recipient_conditional(messages(spark, sf)))


def extraction_summary(spark, sf):
    return P.extraction_summary(messages(spark, sf))


def bulk_rejected(spark, sf):
    """Messages that look automated, and those that answer."""
    return messages(spark, sf).select("msg_id", T.is_bulk(F.col("subject"), F.col("body")).alias("bulk"), F.trim("subject").rlike(r"(?i)^(re|fwd|fw)\s*:").alias("reply"))


def own_text(spark, sf):
    t = T.own_text(F.col("body"))
    return messages(spark, sf).withColumn("t", t).select("msg_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def mail_cleaning(spark, sf):
    """Typographic characters made plain, replies and signatures cut."""
    rows = messages(spark, sf).withColumn("t", T.strip_signature(T.strip_replies(T.unformatted(F.col("body")))))
    return rows.select("msg_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def quotes_stripped(spark, sf):
    """Messages without quotes and trailing signatures, by both rules."""
    rows = messages(spark, sf).withColumns({"t": T.strip_quotes(F.col("body")), "s": T.strip_quoted(F.col("body"))})
    return rows.select("msg_id", F.length("t").cast("long").alias("n"), F.length("s").cast("long").alias("n_simple"))


def strip_artifacts(spark, sf):
    rows = messages(spark, sf).withColumn("t", T.strip_artifacts(F.col("body")))
    return rows.select("msg_id", F.length("t").cast("long").alias("n"), T.occurrences(F.col("t"), "_EMAIL_").alias("emails"), T.occurrences(F.col("t"), "_PHONE_").alias("phones"))


def style_features(spark, sf):
    return style_vector(messages(spark, sf))


def signature_noise(spark, sf):
    """Sentences of each author that are contact data or words of a signature."""
    s = messages(spark, sf).select("author", F.explode(T.marks(F.col("body"))).alias("s"))
    return s.groupBy("author").agg(F.count("*").alias("sentences"), F.count_if(T.is_signature_noise(F.col("s"))).alias("noise"))


def split_diagnosis(spark, sf):
    """Range of times and distinct recipients of the held-out tenth and the rest."""
    m = messages(spark, sf)
    return m.groupBy((F.col("msg_id") % 10 == 0).alias("held_out")).agg(F.count("*").alias("messages"), F.date_format(F.min("sent"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("sent"), "yyyy-MM-dd").alias("last_day"), F.countDistinct("recipients").alias("recipients"))


def sampled_hours(spark, sf):
    """An hour for each toxic document, drawn by the weights of the hours of all messages."""
    from pyspark.sql import Window

    h = messages(spark, sf).groupBy(F.hour("sent").alias("hour")).agg(F.count("*").alias("w"))
    hi = F.sum("w").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))  # 24 rows
    h = h.withColumns({"hi": hi, "total": F.sum("w").over(Window.partitionBy())}).withColumn("lo", F.col("hi") - F.col("w"))
    pick = table(spark, sf, "labels").where("toxic = 1").select("doc_id", (F.col("doc_id") * 7919 % 10007).alias("p"))
    return pick.join(F.broadcast(h), (F.col("p") * F.col("total") >= F.col("lo") * 10007) & (F.col("p") * F.col("total") < F.col("hi") * 10007)).select("doc_id", F.col("hour").cast("long").alias("hour"))


QUERIES = {f.__name__: f for f in (context_features, profile_meta, author_profiles, deviation_score, message_traits, negative_space, recipient_conditional, extraction_summary, bulk_rejected, own_text, mail_cleaning, quotes_stripped, strip_artifacts, style_features, signature_noise, split_diagnosis, sampled_hours)}

match_sql = lambda t, p: f"regexp_matches({t}, {quoted(p)})"
one_of = lambda ws: quoted("^(" + "|".join(ws) + ")")
FAR = "1073741824"
EARLY = "^d*[^d]d*[^d][^d]*"
STRIP = lambda t: f"regexp_replace({t}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"
TRIM = lambda t: f"regexp_replace({t}, '^[\\r\\t ]+|[\\r\\t ]+$', '', 'g')"
OWN = f"""kinds AS (SELECT msg_id, ls, array_to_string(list_transform(ls, lambda s: CASE WHEN {match_sql('s', T.MOBILE)} OR ({match_sql('s', T.FORWARDED)} AND length({TRIM('s')}) < 60) THEN 'X' WHEN {match_sql('s', T.FORWARD_HEADER)} THEN 'H' WHEN {match_sql('s', T.DIVIDER)} THEN 'd' ELSE '.' END), '') AS k FROM (SELECT msg_id, string_split(body, chr(10)) AS ls FROM msgs)),
ends AS (SELECT *, CASE WHEN instr(k, 'X') > 0 THEN instr(k, 'X') ELSE {FAR} END AS hard, CASE WHEN regexp_matches(k, '{EARLY}d') THEN length(regexp_extract(k, '{EARLY}')) + 1 ELSE {FAR} END AS divider, CASE WHEN instr(k, 'HH') > 0 THEN instr(k, 'HH') + 1 ELSE {FAR} END AS heads FROM kinds),
cuts AS (SELECT *, least(hard, divider, CASE WHEN heads < least(hard, divider) THEN heads - 1 ELSE {FAR} END, len(ls) + 1) AS stop FROM ends),
own AS (SELECT msg_id, {STRIP("array_to_string(list_filter(list_transform(range(1, stop), lambda i: CASE WHEN substr(k, CAST(i AS BIGINT), 1) <> 'd' THEN ls[i] END), lambda s: s IS NOT NULL), chr(10))")} AS own FROM cuts)"""
TOKENS = lambda t: f"list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))"
RATE = lambda p: f"CASE WHEN own_words > 0 THEN 100.0::DOUBLE * len(regexp_extract_all(own, {quoted(p)})) / own_words END"
MEASURED = f"""{MESSAGES}, {OWN}, m0 AS (SELECT msgs.msg_id, author, sent, subject, body, own, {TOKENS('own')} AS w, list_filter(list_transform(string_split(recipients, ','), lambda x: lower(trim(CASE WHEN regexp_matches(x, '<[^>]+>') THEN regexp_extract(x, '<([^>]+)>', 1) ELSE x END))), lambda x: x <> '') AS addresses FROM msgs JOIN own USING (msg_id)),
m1 AS (SELECT *, CAST(len(w) AS BIGINT) AS own_words, CAST(len({TOKENS('body')}) AS BIGINT) AS full_words, hour(sent) AS hour, isodow(sent) - 1 AS day, regexp_matches(trim(subject), '(?i)^(re|fwd|fw)\\s*:') AS reply, array_to_string(w[1:3], ' ') AS first3, array_to_string(w[greatest(len(w) - 2, 1):len(w)], ' ') AS last3 FROM m0),
ms AS (SELECT *, CASE WHEN own_words >= 4 THEN first3 END AS opens, CASE WHEN own_words >= 4 THEN last3 END AS closes, {', '.join(f'{RATE(p)} AS {k}' for k, p in P.RATES.items())} FROM m1),
ex AS (SELECT *, unnest(addresses) AS address FROM ms)"""
STATS = lambda c, a: f"coalesce(avg({c}), 0) AS {a}_m, coalesce(stddev_pop({c}), 0) AS {a}_s"
PROFILED = lambda name, rows, key: f"{name} AS (SELECT {key} AS address, count(*) AS n_sends, avg(CASE WHEN reply THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS reply_rate, {STATS('full_words', 'words')}, {', '.join(STATS(k, k) for k in P.RATES)} FROM {rows} GROUP BY 1), {name}_top AS (SELECT {key} AS address, opens, count(*) AS n, min(msg_id) AS f FROM {rows} WHERE opens <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, f, opens) <= 5), {name}_end AS (SELECT {key} AS address, closes, count(*) AS n, min(msg_id) AS f FROM {rows} WHERE closes <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, f, closes) <= 5), {name}_hour AS (SELECT {key} AS address, hour, count(*) AS c FROM {rows} GROUP BY ALL), {name}_day AS (SELECT {key} AS address, day, count(*) AS c FROM {rows} GROUP BY ALL)"
Z = lambda x, p, k: f"CASE WHEN {p}.{k}_s <= 1e-9 THEN 0.0::DOUBLE ELSE greatest(-10.0::DOUBLE, least(10.0::DOUBLE, ({x} - {p}.{k}_m) / {p}.{k}_s)) END"
FLAG = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
R6 = lambda c, a: f"round({c}, 6) AS {a}"
FIT = lambda p, unit: f"coalesce((SELECT c FROM {p}_{unit} t WHERE t.address = b.address AND t.{unit} = b.{unit}), 0) / CAST(p.n_sends AS DOUBLE)"
CONTEXT_SQL = [
    FLAG("p.n_sends >= 3"), "ln(1 + p.n_sends)", Z("b.full_words", "p", "words"), Z("b.full_words", "g", "words"),
    "coalesce(rh.c, 0) / CAST(p.n_sends AS DOUBLE)", "coalesce(gh.c, 0) / CAST(g.n_sends AS DOUBLE)", "coalesce(rd.c, 0) / CAST(p.n_sends AS DOUBLE)", "coalesce(gd.c, 0) / CAST(g.n_sends AS DOUBLE)",
    "p.reply_rate", FLAG("b.reply"), f"abs({FLAG('b.reply')} - p.reply_rate)",
    FLAG("EXISTS (FROM prof_top t WHERE t.address = b.address AND t.opens = b.first3)"), FLAG("EXISTS (FROM overall_top t WHERE t.opens = b.first3)"), FLAG("EXISTS (FROM overall_end t WHERE t.closes = b.last3)"),
    *[Z(f"coalesce(b.{k}, 0)", "p", k) for k in P.RATES], "coalesce(b.own_words / nullif(CAST(b.full_words AS DOUBLE), 0), 0)", "CAST(len(b.addresses) AS DOUBLE)", FLAG(f"list_contains(b.addresses, '{SELF}')"),
]

FOLDED = lambda t: f"regexp_replace(replace(lower({t}), '’', ''''), '[^\\x00-\\x7f]', 'x', 'g')"
PRONOUN = lambda ws: f"len(regexp_extract_all(low, '\\b(?:{ws})\\b'))"
VOWELS = lambda ws, p="[aeiouy]+": f"CAST(coalesce(list_sum(list_transform({ws}, lambda x: greatest(len(regexp_extract_all(x, '{p}')), 1))), 0) AS DOUBLE)"
TRAITS = f"""t0 AS (SELECT msg_id, author, body, {FIELDS} AS fs, {LINES} AS ls, CAST(len({MARKS}) AS DOUBLE) AS s, {WORDS} AS w, {FOLDED('body')} AS low, CAST({count_sql('body', '!')} AS DOUBLE) AS x FROM msgs),
t1 AS (SELECT *, CAST(len(fs) AS DOUBLE) AS n, CAST({count_sql('low', CONTRACTION)} AS DOUBLE) AS c, CAST({count_sql('low', EXPANDED)} AS DOUBLE) AS e, {PRONOUN('i|me|my|mine')} AS p1, {PRONOUN('we|us|our|ours')} AS p2, {PRONOUN('you|your|yours')} AS p3 FROM t0),
traits AS (SELECT *, CASE WHEN n >= 10 AND s > 0 THEN greatest(0.39::DOUBLE * n / s + 11.8::DOUBLE * {VOWELS('fs', '(?i)[aeiouy]+')} / n - 15.59::DOUBLE, 0) END AS qg,
greatest(0, least(10, 5.0::DOUBLE + CASE WHEN c / greatest(n, 1) > 0.03::DOUBLE THEN -1.5 WHEN c / greatest(n, 1) < 0.005::DOUBLE THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(lower(body), '^dear[ \\t\\r\\n]') THEN 1.5 WHEN regexp_matches(lower(body), '^(hey|yo|sup)([^a-z0-9_]|$)') THEN -1.5 ELSE 0 END + CASE WHEN x > greatest(n, 1) * 0.01::DOUBLE THEN -0.5 ELSE 0 END)) AS qf,
coalesce(c / nullif(c + e, 0), 0.5) AS qc, CASE WHEN len(list_filter(regexp_split_to_array(ls[1], '[ \\t\\r\\n]+'), lambda x: x <> '')) <= 8 AND regexp_matches(lower(ls[1]), {one_of(MESSAGE_GREETINGS)}) THEN regexp_replace(ls[1], '[,!. ]+$', '') END AS hi,
CASE WHEN len(ls) >= 2 THEN regexp_replace(list_filter(ls[greatest(len(ls) - 2, 1):len(ls)], lambda x: regexp_matches(lower(x), {one_of(MESSAGE_CLOSINGS)}))[1], '[,!. ]+$', '') END AS bye,
CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'self_focused' WHEN p2 >= p3 THEN 'team_focused' ELSE 'audience_focused' END AS qp FROM t1)"""
AUTHORS = f"""a0 AS (SELECT author, count(*) AS messages, avg(n) AS avg_words, sum(n) AS total_words, CAST(sum(len(w)) AS DOUBLE) AS W_, sum(s) AS S_, sum({VOWELS('w')}) AS Y_, sum(c) AS c, sum(e) AS e, sum(x) AS x, sum(p1) AS p1, sum(p2) AS p2, sum(p3) AS p3 FROM traits GROUP BY author),
a1 AS (SELECT *, CASE WHEN W_ > 0 AND S_ > 0 THEN 0.39::DOUBLE * W_ / S_ + 11.8::DOUBLE * Y_ / W_ - 15.59::DOUBLE END AS grade, coalesce(c / nullif(c + e, 0), 0) AS ratio, 1000.0::DOUBLE * x / greatest(total_words, 1) AS per FROM a0),
a2 AS (SELECT *, greatest(0, least(10, 5.0::DOUBLE + CASE WHEN ratio > 0.7::DOUBLE THEN -1.5 WHEN ratio > 0.3::DOUBLE THEN 0 ELSE 1.5 END + CASE WHEN per > 8 THEN -1.0 WHEN per > 3 THEN 0 ELSE 0.5 END + CASE WHEN grade > 12 THEN 1.0 WHEN grade < 6 THEN -1.0 ELSE 0 END)) AS formality, CASE WHEN p1 > p2 AND p1 > p3 THEN 'self_focused' WHEN p2 > p3 THEN 'team_focused' ELSE 'audience_focused' END AS perspective FROM a1),
h0 AS (SELECT author, pattern AS v, count(*) AS n, min(msg_id) AS f FROM g WHERE pattern IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, f, v) <= 20), h1 AS (SELECT author, list(v ORDER BY n DESC, f, v) AS greetings FROM h0 GROUP BY author),
b0 AS (SELECT author, msg_id, unnest(ls[greatest(len(ls) - 2, 1):len(ls)]) AS l FROM traits), b1 AS (SELECT author, regexp_replace(l, '[,!. ]+$', '') AS v, count(*) AS n, min(msg_id) AS f FROM b0 WHERE regexp_matches(lower(l), {one_of(CLOSING_WORDS)}) GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, f, v) <= 20), b2 AS (SELECT author, list(v ORDER BY n DESC, f, v) AS closings FROM b1 GROUP BY author),
authors AS (SELECT a2.*, coalesce(greetings, []) AS greetings, coalesce(closings, []) AS closings FROM a2 LEFT JOIN h1 USING (author) LEFT JOIN b2 USING (author))"""
WHOLE = f"WITH {GREETED}, {TRAITS}, {AUTHORS}"
cap = lambda x, most: f"least(1.0, ({x}) / {most}::DOUBLE)"
DEVIATIONS = f"""{WHOLE}, j AS (SELECT t.*, a.*, t.n / greatest(avg_words, 1.0) AS q, abs(qg - grade) AS dg, abs(qf - formality) AS df, abs(qc - ratio) AS dc, abs(1000.0::DOUBLE * t.x / greatest(t.n, 1) - per) AS dx FROM traits t JOIN authors a ON t.author IS NOT DISTINCT FROM a.author),
d AS (SELECT msg_id, CASE WHEN q > 3 OR q < 0.2 THEN {cap('abs(q - 1)', 3.0)} END AS word_count, CASE WHEN qg <> 0 AND grade <> 0 AND dg > 3 THEN {cap('dg', 10.0)} END AS readability, CASE WHEN df > 2 THEN {cap('df', 7.0)} END AS formality, CASE WHEN dc > 0.3::DOUBLE THEN {cap('dc', 0.7)} END AS contractions,
CASE WHEN len(greetings) > 0 AND hi IS NOT NULL AND len(list_filter(greetings, lambda k: starts_with(lower(hi), trim(split_part(lower(k), '[', 1))))) = 0 THEN 0.8::DOUBLE END AS greeting, CASE WHEN len(closings) > 0 AND bye IS NOT NULL AND len(list_filter(closings, lambda k: starts_with(lower(bye), lower(k)))) = 0 THEN 0.6::DOUBLE END AS closing,
CASE WHEN dx > 5 THEN {cap('dx', 15.0)} END AS exclamation_energy, CASE WHEN qp <> perspective THEN 0.4::DOUBLE END AS perspective_shift FROM j),
e AS (SELECT *, round(least(1.0, {' + '.join(f'coalesce({k}, 0) * {w}::DOUBLE' for k, w in P.WEIGHTS.items())}), 9) AS score FROM d)
SELECT msg_id, {', '.join(f'CAST(round({k}, 6) AS DOUBLE) AS {k}' for k in P.WEIGHTS)}, CAST(round(score, 6) AS DOUBLE) AS score, CASE WHEN score >= {P.HOLD}::DOUBLE THEN 'hold' WHEN score >= {P.WARN}::DOUBLE THEN 'warn' ELSE 'pass' END AS verdict FROM e"""

LOWER_WORDS = lambda t: f"list_transform(regexp_extract_all({t}, '[A-Za-z'']+'), lambda x: lower(x))"
LINES_OF = lambda t: LINES.replace("body", t)
FIRST = lambda ls, n: f"coalesce(array_to_string({LOWER_WORDS(f'{ls}[1]')}[1:{n}], ' '), '')"
LAST = lambda ls, n: f"coalesce(array_to_string(list_reverse(list_reverse({LOWER_WORDS(f'{ls}[-1]')})[1:{n}]), ' '), '')"
TWO = lambda o: f"array_to_string(string_split({o}, ' ')[1:2], ' ')"
NEGATIVE = f"""WITH {MESSAGES}, r AS (SELECT coalesce(text, '') AS t, {LINES_OF("coalesce(text, '')")} AS ls FROM benchmark), r1 AS (SELECT t, {FIRST('ls', 4)} AS o, {LAST('ls', 3)} AS c, {LOWER_WORDS('t')} AS w FROM r),
opened AS (SELECT o FROM r1 WHERE o <> '' UNION SELECT {TWO('o')} FROM r1 WHERE o <> ''), closed AS (SELECT DISTINCT c FROM r1 WHERE c <> ''), bg AS (SELECT unnest({grams_sql('w', 2)}) AS gram FROM r1 UNION ALL SELECT unnest({grams_sql('w', 3)}) FROM r1), seen AS (SELECT gram FROM bg GROUP BY gram HAVING count(*) >= 2),
u AS (SELECT coalesce(bool_or(contains(t, '—')), false) AS r_dash, coalesce(bool_or(contains(t, '…') OR contains(t, '...')), false) AS r_dots FROM r),
x0 AS (SELECT msg_id, body, {LINES} AS ls, {WORDS} AS w FROM msgs), x1 AS (SELECT msg_id, body, w, {FIRST('ls', 4)} AS o4, {LAST('ls', 3)} AS c FROM x0), x2 AS (SELECT *, {TWO('o4')} AS o2 FROM x1),
gs AS (SELECT msg_id, unnest({grams_sql('w', 2)}) AS gram, 2 AS n FROM x1 UNION ALL SELECT msg_id, unnest({grams_sql('w', 3)}), 3 FROM x1), b AS (SELECT msg_id, count(*) FILTER (n = 2 AND s.gram IS NULL) AS v2, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3 AND s.gram IS NULL) AS v3, count(*) FILTER (n = 3) AS n3 FROM gs LEFT JOIN seen s ON gs.gram = s.gram GROUP BY msg_id),
f AS (SELECT x2.msg_id, {FLAG("o4 <> '' AND o4 NOT IN (SELECT o FROM opened)")} AS opening, {FLAG("o2 <> '' AND o2 NOT IN (SELECT o FROM opened)")} AS opening_2w, {FLAG("c <> '' AND c NOT IN (SELECT c FROM closed)")} AS closing, coalesce(v2 / CAST(greatest(n2, 1) AS DOUBLE), 0) AS two_rate, coalesce(v3 / CAST(greatest(n3, 1) AS DOUBLE), 0) AS three_rate, CAST(coalesce(v2, 0) AS DOUBLE) AS two_count, {FLAG("contains(body, '—') AND NOT r_dash")} AS dash, {FLAG("(contains(body, '…') OR contains(body, '...')) AND NOT r_dots")} AS ellipsis FROM x2 LEFT JOIN b USING (msg_id), u)
SELECT msg_id, opening, opening_2w, closing, round(two_rate, 6) AS two_rate, round(three_rate, 6) AS three_rate, two_count, dash, ellipsis, round(3 * opening + opening_2w + 2 * closing + 2 * three_rate + two_rate + 0.5::DOUBLE * dash + 0.5::DOUBLE * ellipsis, 6) AS composite FROM f"""
BASELINE = lambda name, rows: f"{name} AS (SELECT k.*, s_m, s_s FROM (SELECT key, count(*) AS k, avg(n) AS m, stddev_pop(n) AS s, count(*) FILTER (dash) >= greatest(1.0, count(*) * 0.1::DOUBLE) AS dashes FROM {rows} GROUP BY key) k LEFT JOIN (SELECT key, avg(x) AS s_m, stddev_pop(x) AS s_s FROM (SELECT key, unnest(lens) AS x FROM {rows}) GROUP BY key) USING (key)), {name}_top AS (SELECT key, o, count(*) AS c, min(msg_id) AS f FROM {rows} WHERE o <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, f, o) <= 10)"
SD = lambda c: f"CASE WHEN coalesce({c}, 0) > 0 THEN {c} ELSE 1.0::DOUBLE END"
CONDITIONAL = f"""WITH {MESSAGES}, x0 AS (SELECT msg_id, recipients, body, {LINES} AS ls FROM msgs), x AS (SELECT msg_id, lower(trim(string_split(recipients, ',')[1])) AS key, CAST(len({WORDS}) AS DOUBLE) AS n, {FIRST('ls', 3)} AS o, contains(body, '—') AS dash, list_transform(list_filter(regexp_split_to_array(body, '[.!?\\n]+'), lambda s: length(regexp_replace(s, '[ \\t\\r\\n]+', '', 'g')) > 0), lambda s: CAST(len(regexp_extract_all(s, '[A-Za-z'']+')) AS DOUBLE)) AS lens FROM x0),
best AS (SELECT key FROM x WHERE key <> '' GROUP BY key HAVING count(*) >= 8 ORDER BY count(*) DESC, key LIMIT 5), mine AS (SELECT * FROM x WHERE key IN (FROM best)), every AS (SELECT * REPLACE ('_all' AS key) FROM x), {BASELINE('ra', 'mine')}, {BASELINE('ga', 'every')},
j AS (SELECT x.*, r.k IS NOT NULL AS known, coalesce(r.m, g.m) AS m, CASE WHEN r.k IS NOT NULL THEN r.s ELSE g.s END AS s, CASE WHEN r.k IS NOT NULL THEN r.s_m ELSE g.s_m END AS s_m, CASE WHEN r.k IS NOT NULL THEN r.s_s ELSE g.s_s END AS s_s, coalesce(r.dashes, g.dashes) AS dashes FROM x LEFT JOIN ra r USING (key), ga g)
SELECT msg_id, {FLAG('known')} AS rec_is_known, round((n - m) / {SD('s')}, 6) AS rec_len_z, round((coalesce(list_sum(lens) / len(lens), 0) - coalesce(s_m, 0)) / {SD('s_s')}, 6) AS rec_sent_len_z, {FLAG("CASE WHEN known THEN EXISTS (FROM ra_top t WHERE t.key = j.key AND t.o = j.o) ELSE EXISTS (FROM ga_top t WHERE t.o = j.o) END")} AS rec_opening_known, {FLAG('dash AND NOT dashes')} AS rec_em_dash_mismatch, {FLAG('NOT known')} AS rec_skepticism FROM j"""

CUT = lambda t, p, share: f"CASE WHEN length(regexp_split_to_array({t}, {quoted(p)})[1]) > length({t}) * {share} THEN regexp_split_to_array({t}, {quoted(p)})[1] ELSE {t} END"
PLAIN = "replace(replace(translate(body, '–“”‘’ •', '-\"\"'''' -'), '—', '--'), '…', '...')"


def chain(start: str, steps: list[tuple[str, str]]) -> str:
    """CTEs that apply steps (name, expression over t) one by one."""
    out, before = [], start
    for name, step in steps:
        out.append(f"{name} AS (SELECT msg_id, {step} AS t FROM {before})")
        before = name
    return ", ".join(out)


CLEANED = chain("msgs", [("k0", PLAIN), *[(f"r{i}", f"regexp_split_to_array(t, {quoted('(?i)' + p)})[1]") for i, p in enumerate(REPLY_CUTS)], ("r9", STRIP("t")), *[(f"s{i}", CUT("t", "(?is)" + p, "0.3::DOUBLE")) for i, p in enumerate(SIGNATURE_CUTS)], ("cleaned", STRIP("t"))])
ARTIFACTS = f"""l0 AS (SELECT msg_id, author, list_filter(list_transform(string_split(body, chr(10)), lambda s: regexp_replace(s, '\\r$', '')), lambda s: NOT regexp_matches({TRIM('s')}, {quoted('^>|' + T.HEADER)})) AS ls FROM msgs),
l1 AS (SELECT *, coalesce(list_position(list_transform(ls, lambda s: regexp_matches({TRIM('s')}, {quoted(T.FOOTER)})), true), 0) AS stop FROM l0), l2 AS (SELECT msg_id, author, array_to_string(CASE WHEN stop > 0 THEN ls[1:stop - 1] ELSE ls END, chr(10)) AS t FROM l1),
l3 AS (SELECT msg_id, author, regexp_replace(regexp_replace(regexp_replace(t, {quoted(T.EMAIL)}, ' _EMAIL_ ', 'g'), {quoted(T.PHONE)}, ' _PHONE_ ', 'g'), {quoted(T.URL)}, ' _URL_ ', 'g') AS t FROM l2), clean AS (SELECT msg_id, author, {STRIP("regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM l3)"""
OCC = lambda c: f"((length(t) - length(replace(t, {quoted(c)}, ''))) // {len(c)})"
THOSE = lambda c: f"len(list_filter(w, lambda x: {c}))"
STYLE = {
    "sentence_mean": "mean", "sentence_sd": "sqrt(greatest(list_sum(list_transform(lens, lambda x: (x - mean) * (x - mean))) / k, 0))", "word_length": "CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: CAST(length(x) AS DOUBLE))) / n ELSE 0 END",
    "long_words": f"1000 * {THOSE('length(x) > 8')} / n", "short_words": f"1000 * {THOSE('length(x) <= 3')} / n", "variety": "len(list_distinct(w)) / n", "fragments": "len(list_filter(lens, lambda x: x <= 5)) / k",
    "dashes": f"1000 * ({OCC('—')} + {OCC('--')}) / n", "semicolons": f"1000 * {OCC(';')} / n", "exclamations": f"1000 * {OCC('!')} / n", "questions": f"1000 * {OCC('?')} / n", "ellipses": f"1000 * {OCC('...')} / n", "commas": f"1000 * {OCC(',')} / n",
    "parens": f"1000 * ({OCC('(')} + {OCC(')')}) / n", "colons": f"1000 * {OCC(':')} / n", "all_caps": f"1000 * {THOSE('length(x) > 1 AND upper(x) = x')} / n", "contractions": "1000 * " + THOSE("contains(x, '''')") + " / n",
    "first_person": "1000 * " + THOSE("x IN ('i', 'i''m', 'i''ve')") + " / n", "first_plural": "1000 * " + THOSE("x IN ('we', 'we''re', 'we''ve')") + " / n", "log_length": "ln(1 + n)",
}
SENTENCES = f"list_filter(list_transform(regexp_split_to_array(t, '[.!?]+[ \\t\\r\\n]+|\\n\\n+'), lambda s: trim({TRIM('s').replace(chr(92) + 'r', chr(92) + 'r' + chr(92) + 'n')})), lambda s: s <> '')"
STYLED = f"""{ARTIFACTS}, c1 AS (SELECT msg_id, author, t, {LOWER_WORDS('t')} AS w, {SENTENCES} AS ss FROM clean), c2 AS (SELECT msg_id, author, t, w, CAST(greatest(len(w), 1) AS DOUBLE) AS n, list_transform(CASE WHEN len(ss) > 0 THEN ss ELSE [trim(t)] END, lambda s: CAST(len(regexp_extract_all(s, '[A-Za-z'']+')) AS DOUBLE)) AS lens FROM c1), c3 AS (SELECT *, CAST(len(lens) AS DOUBLE) AS k, list_sum(lens) / len(lens) AS mean FROM c2)"""

SQL = {
    "signature_noise": f"WITH {MESSAGES}, s AS (SELECT author, unnest({MARKS}) AS s FROM msgs) SELECT author, count(*) AS sentences, count(*) FILTER ({NOISY('s')}) AS noise FROM s GROUP BY author",
    "context_features": f"WITH {MEASURED}, {PROFILED('prof', 'ex', 'address')}, {PROFILED('overall', 'ms', quoted('_global'))}, pick AS (SELECT m.msg_id, x.address FROM (SELECT msg_id, unnest(addresses) AS address, unnest(range(1, len(addresses) + 1)) AS place FROM ms) m JOIN prof x USING (address) QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY n_sends DESC, place) = 1) SELECT b.msg_id, {', '.join(R6(c, a) for c, a in zip(CONTEXT_SQL, P.CONTEXT, strict=True))} FROM (SELECT ms.*, pick.address FROM ms JOIN pick USING (msg_id)) b JOIN prof p ON p.address = b.address LEFT JOIN prof_hour rh ON rh.address = b.address AND rh.hour = b.hour LEFT JOIN prof_day rd ON rd.address = b.address AND rd.day = b.day LEFT JOIN overall_hour gh ON gh.hour = b.hour LEFT JOIN overall_day gd ON gd.day = b.day, overall g",
    "profile_meta": f"WITH {MESSAGES}, k AS (SELECT recipients, count(*) AS n FROM msgs GROUP BY 1), t AS (SELECT count(*) AS n_emails FROM msgs) SELECT n_emails, (SELECT count(*) FROM k) AS n_recipients, (SELECT count(*) FROM k WHERE n >= 3) + CAST(n_emails >= 3 AS BIGINT) AS n_known_recipients FROM t",
    "author_profiles": f"{WHOLE} SELECT author, messages, round(avg_words, 6) AS avg_words, round(grade, 6) AS grade, round(ratio, 6) AS contraction_ratio, round(per, 6) AS exclamation_per_1000, CAST(round(formality, 6) AS DOUBLE) AS formality, CASE WHEN formality > 7 THEN 'formal' WHEN formality > 5 THEN 'professional' WHEN formality > 3 THEN 'conversational' ELSE 'casual' END AS formality_label, perspective, array_to_string(greetings, '|') AS greetings, array_to_string(closings, '|') AS closings FROM authors",
    "deviation_score": DEVIATIONS,
    "message_traits": f"WITH {MESSAGES}, {TRAITS} SELECT msg_id, round(qg, 6) AS grade, CAST(round(qf, 6) AS DOUBLE) AS formality, CAST(round(qc, 6) AS DOUBLE) AS contractions, hi AS greeting, bye AS closing, qp AS perspective FROM traits",
    "negative_space": NEGATIVE,
    "recipient_conditional": CONDITIONAL,
    "extraction_summary": f"WITH {MESSAGES}, m AS (SELECT recipients, CAST(len({FIELDS}) AS BIGINT) AS n, CAST(length(body) AS BIGINT) AS chars, starts_with(lower(subject), 're:') AS re, starts_with(lower(subject), 'fw:') OR starts_with(lower(subject), 'fwd:') AS fw FROM msgs), o AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS k FROM m), d AS (SELECT string_split(recipients, '@')[-1] AS domain, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, domain LIMIT 20) SELECT count(*) AS total_messages, CAST(sum(n) AS BIGINT) AS total_words, CAST(sum(chars) AS BIGINT) AS total_characters, round(avg(n), 1) AS avg_words, round(avg(chars), 1) AS avg_chars, round(avg({FLAG('re')}) * 100, 1) AS reply_pct, round(avg({FLAG('fw')}) * 100, 1) AS forward_pct, round(avg({FLAG('NOT re AND NOT fw')}) * 100, 1) AS original_pct, (SELECT n FROM o WHERE r = k // 2 + 1) AS median_words, (SELECT string_agg(domain || ':' || n, ',' ORDER BY n DESC, domain) FROM d) AS top_domains FROM m",
    "bulk_rejected": f"WITH {MESSAGES} SELECT msg_id, regexp_matches(lower(subject || ' ' || body), {quoted('|'.join(BULK))}) AS bulk, regexp_matches(trim(subject), '(?i)^(re|fwd|fw)\\s*:') AS reply FROM msgs",
    "own_text": f"WITH {MESSAGES}, {OWN} SELECT msg_id, length(own) AS n, md5(own) AS digest FROM own",
    "mail_cleaning": f"WITH {MESSAGES}, {CLEANED} SELECT msg_id, length(t) AS n, md5(t) AS digest FROM cleaned",
    "strip_artifacts": f"WITH {MESSAGES}, {ARTIFACTS} SELECT msg_id, length(t) AS n, {OCC('_EMAIL_')} AS emails, {OCC('_PHONE_')} AS phones FROM clean",
    "style_features": f"WITH {MESSAGES}, {STYLED} SELECT msg_id, author, {', '.join(f'CAST(round({c}, 5) AS DOUBLE) AS {a}' for a, c in STYLE.items())} FROM c3",
    "split_diagnosis": f"WITH {MESSAGES} SELECT msg_id % 10 = 0 AS held_out, count(*) AS messages, strftime(min(sent), '%Y-%m-%d') AS first_day, strftime(max(sent), '%Y-%m-%d') AS last_day, count(DISTINCT recipients) AS recipients FROM msgs GROUP BY 1",
    "sampled_hours": f"WITH {MESSAGES}, h AS (SELECT hour(sent) AS hour, count(*) AS w FROM msgs GROUP BY 1), c AS (SELECT hour, w, sum(w) OVER (ORDER BY hour) AS hi, sum(w) OVER () AS total FROM h), p AS (SELECT doc_id, doc_id * 7919 % 10007 AS p FROM labels WHERE toxic = 1) SELECT doc_id, hour FROM p JOIN c ON p * total >= (hi - w) * 10007 AND p * total < hi * 10007",
}
