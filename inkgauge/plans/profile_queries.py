"""Writing profiles: vocabulary, phrases, readability, shape, grammar and tone; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import CLOSING_WORDS, CONTRACTION, EXPANDED, FUNCTION_WORDS, GREETING_WORDS, LEXICON, NOISE_PHRASES, SIGNATURE_WORDS, SKIP_STARTERS
from ..operators import phrases as R
from ..operators import sentences as S
from ..operators.profiles import small
from .base import MESSAGES, messages, quoted

sql_list = lambda xs: "(" + ", ".join(map(quoted, xs)) + ")"
WORDS = "list_transform(regexp_extract_all(body, '[A-Za-z'']+'), lambda x: lower(x))"
FIELDS = "list_filter(regexp_split_to_array(body, '[ \\t\\r\\n]+'), lambda x: x <> '')"
LINES = "list_filter(list_transform(string_split(body, chr(10)), lambda s: regexp_replace(s, '^[\\r\\t ]+|[\\r\\t ]+$', '', 'g')), lambda s: s <> '')"
MARKS = "list_filter(regexp_split_to_array(body, '[.!?]+'), lambda s: length(regexp_replace(s, '[ \\t\\r\\n]+', '', 'g')) > 0)"
PARAS = "list_filter(regexp_split_to_array(body, '\\n[ \\t\\r\\n]*\\n'), lambda s: length(regexp_replace(s, '[ \\t\\r\\n]+', '', 'g')) > 0)"
count_sql = lambda t, p: f"CAST(len(regexp_extract_all({t}, {quoted(p)})) AS BIGINT)"


def token_frequency(spark, sf) -> DataFrame:
    """Top 100 words of all messages; ties by the word."""
    w = messages(spark, sf).select(F.explode(T.words(F.col("body"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


def vocabulary_by_author(spark, sf):
    """Words, distinct words, mean length and share of words with three vowel groups or more."""
    w = messages(spark, sf).select("author", F.explode(T.words(F.col("body"))).alias("word"))
    hard = (T.matches(F.col("word"), "[aeiouy]+") >= 3).cast("double")
    return levelled(w.groupBy("author").agg(F.count("*").alias("words"), F.countDistinct("word").alias("distinct_words"), F.round(F.avg(F.length("word")), 6).alias("mean_length"), F.round(F.avg(hard), 6).alias("complex")))


def levelled(g: DataFrame) -> DataFrame:
    return g.withColumn("level", F.when((F.col("complex") > 0.12) & (F.col("mean_length") > 5), "advanced").when(F.col("complex") > 0.06, "intermediate").otherwise("conversational"))


def document_frequency(spark, sf):
    """Up to 40 signature words of each author: in at least 15 % of the messages, over three letters."""
    m = messages(spark, sf)
    n = m.groupBy("author").agg(F.count("*").alias("total"))
    w = m.select("author", F.explode(F.array_distinct(T.words(F.col("body")))).alias("word")).where(F.length("word") > 3).groupBy("author", "word").agg(F.count("*").alias("df"))
    return signature_words(w, n)


def signature_words(w: DataFrame, n: DataFrame) -> DataFrame:
    """From author, word, df of words over three letters and author, total."""
    r = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("df"), "word"))
    return w.join(n, "author").where("df >= total * 0.15").withColumn("r", r).where("r <= 40").select("author", "word", "df", F.col("r").cast("long").alias("r"))


def word_counts(m: DataFrame) -> DataFrame:
    """author, word, n (uses), df (messages that use it): what profiles tell of words follows from these."""
    # in order, equal words of a message are neighbours, and the first of them counts the message
    first = lambda ws: F.transform(ws, lambda x, i: F.struct(x.alias("word"), ((i == 0) | (F.get(ws, i - 1) != x)).alias("first")))
    w = m.select("author", F.explode(T.bound(F.sort_array(T.words(F.col("body"))), first)).alias("x"))
    return w.groupBy("author", F.col("x.word").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("x.first")).alias("df"))


def sentences_of(spark, sf):
    """msg_id, author, place of each sentence, its words."""
    s = messages(spark, sf).select("msg_id", "author", T.marks(F.col("body")).alias("ss")).select("msg_id", "author", F.size("ss").alias("k"), F.posexplode("ss").alias("at", "s"))
    place = F.when(F.col("at") == 0, "opening").when(F.col("at") >= F.col("k") - 2, "closing").otherwise("body")
    return s.select("msg_id", "author", place.alias("place"), T.words(F.col("s")).alias("w"))


def phrases(s: DataFrame, pairs: DataFrame) -> DataFrame:
    """msg_id, author, place, phrase: runs of 2 to 5 words within sentences that begin and end with one of pairs.

    A run can't be commoner than a pair within it, so with all pairs of a support no phrase of that support is lost. pairs
    is broadcast only if it is small.
    """
    p = R.runs(s, ["msg_id", "author", "place"], small(pairs.select("pair")))
    return p.where(~F.col("phrase").isin(*NOISE_PHRASES))


def pair_counts(s: DataFrame) -> DataFrame:
    """pair and n: pairs of neighbouring words within sentences."""
    return s.select(F.explode(T.ngrams(F.col("w"), 2)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


PHRASES = f"""{MESSAGES}, s0 AS (SELECT msg_id, author, {MARKS} AS ss FROM msgs), s1 AS (SELECT msg_id, author, ss, unnest(range(1, len(ss) + 1)) AS i FROM s0),
s2 AS (SELECT msg_id, author, i - 1 AS pos, CASE WHEN i = 1 THEN 'opening' WHEN i - 1 >= len(ss) - 2 THEN 'closing' ELSE 'body' END AS place, list_transform(regexp_extract_all(ss[i], '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM s1),
phrases AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT msg_id, author, pos, place, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase FROM s2" for n in (2, 3, 4, 5))}) WHERE phrase NOT IN {sql_list(NOISE_PHRASES)})"""


def phrase_fingerprint(spark, sf):
    """The 100 commonest phrases of enough support, with their places: one aggregation, no rescans."""
    s = sentences_of(spark, sf)
    least = F.broadcast(messages(spark, sf).agg(F.greatest(F.lit(3.0), F.count("*") * 0.005).alias("least")))
    p = phrases(s, pair_counts(s).crossJoin(least).where("n >= least"))
    g = p.groupBy("phrase").agg(F.count("*").alias("n"), F.countDistinct("msg_id").alias("in_messages"), F.count_if(F.col("place") == "opening").alias("opening"), F.count_if(F.col("place") == "closing").alias("closing"), F.min("msg_id").alias("first_id"))
    return g.crossJoin(least).where("n >= least").drop("least").orderBy(F.desc("n"), "phrase").limit(100)


def phrase_records(spark, sf):
    """The 200 commonest phrases that say something, with places, domains, sources and first sentences."""
    return R.phrase_records(messages(spark, sf)).withColumn("sentences", F.array_join("sentences", " / "))


def period_counts(spark, sf):
    """How often each word has a period after it: what abbreviations are learnt from."""
    return S.period_counts(messages(spark, sf)).where("with_period > 0")


def learnt_abbreviations(spark, sf):
    """Words that the corpus shows to be abbreviations, with their score."""
    return S.abbreviations(S.period_counts(messages(spark, sf)))


COUNTED = f"""{MESSAGES}, w AS (SELECT unnest(regexp_extract_all(body, {quoted(S.WORD + "[.]?")})) AS w FROM msgs), c AS (SELECT lower(rtrim(w, '.')) AS word, count(*) FILTER (ends_with(w, '.')) AS with_period, count(*) FILTER (NOT ends_with(w, '.')) AS without FROM w GROUP BY 1)"""
LEARNT = f"""{COUNTED}, t AS (SELECT sum(with_period) / sum(with_period + without) AS p FROM c), v AS (SELECT word, with_period AS k, CAST(with_period + without AS DOUBLE) AS n, CAST(length(replace(word, '.', '')) AS DOUBLE) AS letters, length(word) - length(replace(word, '.', '')) + 1 AS inner_, p FROM c, t WHERE with_period >= 3 AND NOT regexp_matches(word, '^[\\p{{N}}.]+$')),
s AS (SELECT word, k AS n, round(2 * (k * ln({S.SURE}) + (n - k) * ln(1 - {S.SURE}) - k * ln(p) - (n - k) * ln(1 - p)) * exp(-letters) * inner_ * pow(letters, k - n), 6) AS score FROM v)"""
NOISY = lambda s: f"""(regexp_matches({s}, {quoted(r"[(]?[0-9]{3}[)]?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.-]+")}) OR regexp_matches(lower({s}), 'https?://|mailto:')
OR coalesce(list_transform([list_filter(regexp_split_to_array(lower({s}), '[ \\t\\r\\n]+'), lambda w: regexp_matches(w, '^[a-z]{{2,}}$'))], lambda ws: len(ws) > 0 AND len(list_filter(ws, lambda w: w IN {sql_list(SIGNATURE_WORDS)})) > len(ws) * 0.4)[1], false))"""  # noqa: E731
PLAIN_WORD = f"lambda w: w IN {sql_list(FUNCTION_WORDS)}"
PLACE = "CASE WHEN i = 1 THEN 'opening' WHEN i - 1 >= len(ss) - 2 THEN 'closing' ELSE 'body' END"
RECORDS = f"""{MESSAGES}, s0 AS (SELECT msg_id, author, regexp_extract(recipients, '[^@]*$') AS domain, {MARKS} AS ss FROM msgs), s1 AS (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s0),
s2 AS (SELECT msg_id, coalesce(author, 'unknown') AS source, domain, i, {PLACE} AS place, regexp_replace(ss[i], '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS sentence FROM s1 WHERE NOT {NOISY('ss[i]')}), s3 AS (SELECT *, list_transform(regexp_extract_all(sentence, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM s2),
p AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT msg_id, source, domain, i, place, sentence, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase FROM s3" for n in (2, 3, 4, 5))}) WHERE phrase NOT IN {sql_list(NOISE_PHRASES)}),
g AS (SELECT phrase, count(*) AS n, count(*) FILTER (place = 'opening') AS opening, count(*) FILTER (place = 'body') AS body, count(*) FILTER (place = 'closing') AS closing, string_split(phrase, ' ') AS ws FROM p GROUP BY phrase HAVING count(*) >= greatest(3, (SELECT count(*) FROM msgs) * 0.005)),
t AS (SELECT phrase, n, opening, body, closing FROM g WHERE len(list_filter(ws, {PLAIN_WORD})) < len(ws) AND NOT (len(ws) = 2 AND len(list_filter(ws, {PLAIN_WORD})) > 0 AND len(list_filter(ws, lambda w: length(w) <= 3)) = 2) ORDER BY n DESC, phrase LIMIT 200),
x AS (SELECT p.* FROM p JOIN t USING (phrase)), e AS (SELECT phrase, sentence, min((msg_id, i)) AS f FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY f) <= 5),
{", ".join(f"{c}s AS (SELECT phrase, string_agg({c} || ':' || k, '|' ORDER BY k DESC, {c}) AS {c} FROM (SELECT phrase, {c}, count(*) AS k FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY k DESC, {c}) <= 5) GROUP BY phrase)" for c in ("domain", "source"))},
es AS (SELECT phrase, string_agg(regexp_replace(sentence, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), ' / ' ORDER BY f) AS sentences FROM e GROUP BY phrase)"""


def top_phrases(spark, sf, k: int = 20) -> DataFrame:
    """msg_id, author, phrase of the k commonest phrases: none of them is rarer than the k-th pair that isn't noise."""
    s = sentences_of(spark, sf)
    pairs = small(pair_counts(s))  # read twice
    kth = F.broadcast(pairs.where(~F.col("pair").isin(*NOISE_PHRASES)).orderBy(F.desc("n"), "pair").limit(k).agg(F.coalesce(F.min("n"), F.lit(0)).alias("least")))
    p = small(phrases(s, pairs.crossJoin(kth).where("n >= least")))  # texts are taken apart once for both uses
    top = p.groupBy("phrase").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "phrase").limit(k)
    return p.join(F.broadcast(top), "phrase")


def phrase_sources(spark, sf):
    """The five authors that use each of the 20 commonest phrases most."""
    g = top_phrases(spark, sf).groupBy("phrase", "author").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("n"), "author"))
    return g.withColumn("r", r).where("r <= 5").select("phrase", "author", "n")


def phrase_examples(spark, sf):
    """First three messages of each phrase of the top 20."""
    p = top_phrases(spark, sf).groupBy("phrase", "msg_id").agg(F.lit(1))
    r = F.row_number().over(Window.partitionBy("phrase").orderBy("msg_id"))
    return p.withColumn("r", r).where("r <= 3").select("phrase", "msg_id")


def sentence_templates(spark, sf):
    """First 3, 4 or 5 words of sentences of four words or more, top 50."""
    return templates_of(messages(spark, sf).select(F.explode(T.marks(F.col("body"))).alias("s")).select(T.fields(F.lower("s")).alias("w")))


def templates_of(s: DataFrame) -> DataFrame:
    """From w, the lower-cased fields of each sentence, at least the first five."""
    s = s.where((F.size("w") >= 4) & ~F.get("w", F.lit(0)).isin(*SKIP_STARTERS))
    t = s.select(F.explode(F.filter(F.array(*[F.when(F.size("w") >= n, F.array_join(F.slice("w", 1, n), " ")) for n in (3, 4, 5)]), lambda x: x.isNotNull())).alias("template"))
    return t.groupBy("template").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "template").limit(50)


def greeting(body):
    """First line if it is a greeting of at most 8 words, names replaced."""
    name = r"^((?:Hi|Hey|Hello|Dear|Good morning|Good afternoon|Good evening|Howdy|Greetings))[, ]+([A-Z][a-z]+(?: [A-Z][a-z]+)?)$"
    is_one = lambda first: F.lower(first).rlike("^(" + "|".join(GREETING_WORDS) + ")") & (F.size(T.fields(first)) <= 8)
    return T.bound(F.get(T.lines(body), F.lit(0)), lambda first: F.when(is_one(first), F.regexp_replace(F.regexp_replace(first, "[,!. ]+$", ""), name, "$1 [Name]")))


def greeting_patterns(spark, sf):
    g = messages(spark, sf).select("author", greeting(F.col("body")).alias("pattern")).where("pattern is not null")
    return g.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors")).where("n >= 2").orderBy(F.desc("n"), "pattern").limit(20)


def closing_patterns(spark, sf):
    line = messages(spark, sf).select(F.explode(T.last(T.lines(F.col("body")), 3)).alias("line"))
    c = line.where(F.lower("line").rlike("^(" + "|".join(CLOSING_WORDS) + ")")).select(F.regexp_replace("line", "[,!. ]+$", "").alias("closing"))
    return c.groupBy("closing").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "closing").limit(20)


def lexicon_usage(spark, sf):
    """Uses of every phrase of the lexicons over all messages, in one pass over the rows."""
    low = F.col("low")
    # few messages hold a phrase, and to see that one doesn't is cheaper than to count; explode keeps low from being computed for each phrase
    counts = [F.when(low.contains(p), T.matches(low, rf"\b{p}\b") if whole else T.occurrences(low, p)).otherwise(F.lit(0).cast("long")) for _, p, whole, _ in LEXICON]
    g = messages(spark, sf).select(F.explode(F.array(F.lower(F.col("body")))).alias("low")).agg(*[F.sum(c).alias(f"c{i}") for i, c in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("phrase"), F.col(f"c{i}").alias("n"), F.lit(least).alias("least")) for i, (k, p, _, least) in enumerate(LEXICON)])
    return g.select(F.inline(rows)).where("n >= least").select("kind", "phrase", "n")


def assertiveness(spark, sf):
    """Intensifiers against softeners, and urgent against relaxed expressions."""
    return asserted(lexicon_usage(spark, sf))


def asserted(u: DataFrame) -> DataFrame:
    """From the usage of the lexicons."""
    urgent, relaxed = ("asap", "immediately", "urgent", "right away"), ("no rush", "take your time", "when you get a chance", "at your convenience")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    t = F.col("kind") == "temporal"
    g = u.agg(total(F.col("kind") == "intensifier").alias("strong"), total(F.col("kind") == "softener").alias("soft"), total(t & F.col("phrase").isin(*urgent)).alias("urgent"), total(t & F.col("phrase").isin(*relaxed)).alias("relaxed"))
    return g.select("strong", "soft", "urgent", "relaxed", F.when(F.col("strong") > F.col("soft") * 1.5, "assertive").when(F.col("soft") > F.col("strong") * 1.5, "diplomatic").otherwise("balanced").alias("style"), F.when(F.col("urgent") > F.col("relaxed") * 2, "pressing").when(F.col("relaxed") > F.col("urgent") * 2, "relaxed").otherwise("balanced").alias("urgency"))


LEXICON_SQL = f"{MESSAGES}, low AS (SELECT lower(body) AS t FROM msgs), usage AS ({' UNION ALL '.join(f'SELECT {quoted(k)} AS kind, {quoted(p)} AS phrase, CAST(coalesce(sum(' + (f'len(regexp_extract_all(t, {quoted(chr(92) + "b" + p + chr(92) + "b")}))' if whole else f'(length(t) - length(replace(t, {quoted(p)}, {quoted("")}))) // {len(p)}') + f'), 0) AS BIGINT) AS n, {least} AS least FROM low' for k, p, whole, least in LEXICON)}), used AS (SELECT kind, phrase, n FROM usage WHERE n >= least)"


def sentence_stats(spark, sf):
    """Sentence lengths of each author: mean, upper median, bands, share of questions and exclamations."""
    m = messages(spark, sf)
    s = m.select("author", F.explode(T.marks(F.col("body"))).alias("s")).select("author", F.size(T.fields(F.col("s"))).cast("long").alias("n"))
    p = m.groupBy("author").agg(*mark_sums(("questions", "[?]"), ("exclamations", "!")))
    return lengths_of(s, p)


def mark_sums(*marks):
    return [F.sum(T.matches(F.col("body"), p)).alias(name) for name, p in marks]


def lengths_of(s: DataFrame, p: DataFrame) -> DataFrame:
    """From author and n, the fields of each sentence, and each author's questions and exclamations."""
    by = s.groupBy("author", "n").agg(F.count("*").alias("k"))  # lengths are few, however many sentences have them
    here = Window.partitionBy("author")
    r = by.withColumn("upto", F.sum("k").over(here.orderBy("n"))).withColumn("total", F.sum("k").over(here))
    band = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    n = F.col("n")
    g = r.groupBy("author").agg(F.sum("k").alias("sentences"), F.round(F.sum(n * F.col("k")) / F.sum("k"), 6).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), n)).alias("upper_median"), band(n <= 8).alias("short"), band(n.between(9, 20)).alias("medium"), band(n.between(21, 35)).alias("long"), band(n > 35).alias("very_long"))
    return g.join(p, "author")


def sentence_starters(spark, sf):
    s = messages(spark, sf).select(F.explode(T.marks(F.col("body"))).alias("s")).select(F.lower(F.get(T.fields(F.col("s")), F.lit(0))).alias("starter"))
    return starters_of(s)


def starters_of(s: DataFrame) -> DataFrame:
    return s.groupBy("starter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "starter").limit(15)


def paragraph_stats(spark, sf):
    p = messages(spark, sf).select("author", F.explode(T.paragraphs(F.col("body"))).alias("p")).select("author", F.size(T.fields(F.col("p"))).alias("n"), F.size(T.marks(F.col("p"))).alias("k"))
    g = p.groupBy("author").agg(F.count("*").alias("paragraphs"), F.round(F.avg("n"), 6).alias("mean_words"), F.round(F.avg((F.col("k") <= 1).cast("double")), 6).alias("single"))
    return g.withColumn("style", F.when(F.col("single") > 0.6, "fragmented").when(F.col("single") > 0.3, "balanced").otherwise("dense"))


PRONOUNS = {"self": ("i", "me", "my", "mine"), "team": ("we", "us", "our", "ours"), "audience": ("you", "your", "yours")}


def within(words):
    return lambda w: w.isin(*words)


def grammar_signature(spark, sf):
    return grammar_of(messages(spark, sf).groupBy("author").agg(*form_sums(), F.sum(F.size(T.words(F.col("body")))).alias("words"), *[F.sum(F.size(F.filter(T.words(F.col("body")), within(p)))).alias(f"{k}_n") for k, p in PRONOUNS.items()]))


def form_sums():
    low = F.lower(F.col("body"))
    apostrophe = low.contains("'") | low.contains("’")  # few texts without one need a look
    return [F.sum(F.when(apostrophe, T.matches(low, CONTRACTION)).otherwise(F.lit(0).cast("long"))).alias("contracted"), F.sum(T.matches(low, EXPANDED)).alias("expanded"), F.sum(T.matches(low, r"\b(?:is|are|was|were|been|being)[ ]+[a-z]+ed\b")).alias("passive")]


def grammar_of(g: DataFrame) -> DataFrame:
    """From each author's contracted, expanded, passive, words and number of pronouns of each kind."""
    ratio = F.coalesce(F.try_divide(F.col("contracted"), F.col("contracted") + F.col("expanded")), F.lit(0.0))
    per = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * F.lit(1000.0), F.col("words").cast("double")), F.lit(0.0)), 4)
    top = F.when((F.col("self_n") > F.col("team_n")) & (F.col("self_n") > F.col("audience_n")), "self_focused").when(F.col("team_n") > F.col("audience_n"), "team_focused").otherwise("audience_focused")
    return g.select("author", "contracted", "expanded", "passive", F.round(ratio, 6).alias("ratio"), F.when(ratio > 0.7, "informal").when(ratio > 0.3, "mixed").otherwise("formal").alias("style"), *[per(f"{k}_n").alias(k) for k in PRONOUNS], top.alias("dominant"))


MARK_PATTERNS = {"exclamation": "!", "question": "[?]", "comma": ",", "semicolon": ";", "colon": ":", "ellipsis": "[.]{3}", "dash": "—|--", "paren": "[(]"}


def punctuation_profile(spark, sf):
    return punctuation_of(messages(spark, sf).groupBy("author").agg(F.sum(F.size(T.fields(F.col("body")))).alias("words"), *mark_sums(*MARK_PATTERNS.items())))


def punctuation_of(g: DataFrame) -> DataFrame:
    """From each author's words (fields) and marks."""
    per = lambda k: F.round(F.coalesce(F.try_divide(F.col(k) * F.lit(1000.0), F.col("words").cast("double")), F.lit(0.0)), 4)
    return g.select("author", *[per(k).alias(k) for k in MARK_PATTERNS], F.when(per("exclamation") > 8, "enthusiastic").when(per("exclamation") > 3, "moderate").otherwise("restrained").alias("energy"))


def readability(spark, sf):
    """Published formulas over words, sentences, vowel groups and letters of each author."""
    syllables = F.aggregate(F.transform(F.col("w"), lambda x: F.greatest(F.size(F.regexp_extract_all(x, F.lit("[aeiouy]+"), F.lit(0))), F.lit(1)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    hard = F.size(F.filter("w", lambda x: F.size(F.regexp_extract_all(x, F.lit("[aeiouy]+"), F.lit(0))) >= 3)).cast("long")
    letters = F.aggregate(F.transform(F.col("w"), lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    m = messages(spark, sf).select("author", T.words(F.col("body")).alias("w"), F.size(T.marks(F.col("body"))).cast("long").alias("s"))
    g = m.groupBy("author").agg(F.sum(F.size("w").cast("long")).cast("double").alias("W"), F.sum("s").cast("double").alias("S"), F.sum(syllables).cast("double").alias("Y"), F.sum(hard).cast("double").alias("C"), F.sum(letters).cast("double").alias("L"))
    return graded(g)


def graded(g: DataFrame) -> DataFrame:
    """From each author's words W, sentences S, vowel groups Y, complex words C and letters L."""
    g = g.where("W > 0 and S > 0")
    e = lambda x: F.round(F.expr(x), 4)
    return g.select("author", e("206.835D - 1.015D * W / S - 84.6D * Y / W").alias("ease"), e("0.39D * W / S + 11.8D * Y / W - 15.59D").alias("grade"), e("0.4D * (W / S + 100D * C / W)").alias("fog"), e("5.88D * L / W - 29.6D * S / W - 15.8D").alias("coleman"))


def structure_share(spark, sf):
    """Share of messages with a greeting, a closing, a question in the first sentence."""
    return messages(spark, sf).groupBy("author").agg(*structure_means())


def structure_means():
    closing = F.exists(T.bound(T.lines(F.col("body")), lambda ls: T.last(ls, 3)), lambda s: F.lower(s).rlike("^(" + "|".join(CLOSING_WORDS) + ")"))
    pct = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 4)
    return [pct(greeting(F.col("body")).isNotNull()).alias("greeting"), pct(closing).alias("closing"), pct(F.get(T.lines(F.col("body")), F.lit(0)).contains("?")).alias("hook")]


def recipient_summary(spark, sf):
    a = messages(spark, sf).select("author", F.explode(F.filter(F.split("recipients", ","), lambda x: F.trim(x) != "")).alias("r")).select("author", F.lower(F.trim("r")).alias("address"))
    g = a.groupBy("address").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"))
    return g.select(F.substring(F.sha2("address", 256), 1, 12).alias("hash"), F.substring_index("address", "@", -1).alias("domain"), "n", "authors")


def style_vector(m: DataFrame, *kept: Column | str) -> DataFrame:
    """Twenty rates of each message after cleaning (and the columns kept, t the cleaned text); all_caps counts lower-cased words, so only those of apostrophes."""
    # explode of one element holds what is computed above it: no later expression repeats it
    m = m.select("*", F.explode(F.array(T.strip_artifacts(F.col("body")))).alias("t"))
    m = m.select("*", F.explode(F.array(F.struct(T.words(F.col("t")).alias("w"), F.transform(T.sentences(F.col("t")), lambda s: F.size(F.regexp_extract_all(s, F.lit("[A-Za-z']+"), F.lit(0))).cast("double")).alias("lens")))).alias("x")).select("*", "x.*")
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rate = lambda c: F.lit(1000.0) * c / n
    k = F.size("lens").cast("double")
    mean = total(F.col("lens")) / k
    var = T.bound(mean, lambda mean: total(F.transform("lens", lambda x: (x - mean) * (x - mean)))) / k  # else each sentence would cost a sum over all
    those = lambda f: F.size(F.filter("w", f)).cast("double")
    t = F.col("t")
    out = {
        "sentence_mean": mean, "sentence_sd": F.sqrt(F.greatest(var, F.lit(0.0))), "word_length": F.when(F.size("w") > 0, total(F.transform("w", lambda x: F.length(x).cast("double"))) / n).otherwise(0.0),
        "long_words": rate(those(lambda x: F.length(x) > 8)), "short_words": rate(those(lambda x: F.length(x) <= 3)), "variety": F.size(F.array_distinct("w")) / n, "fragments": F.size(F.filter("lens", lambda x: x <= 5)) / k,
        "dashes": rate(T.occurrences(t, "—") + T.occurrences(t, "--")), "semicolons": rate(T.occurrences(t, ";")), "exclamations": rate(T.occurrences(t, "!")), "questions": rate(T.occurrences(t, "?")), "ellipses": rate(T.occurrences(t, "...")), "commas": rate(T.occurrences(t, ",")),
        "parens": rate(T.occurrences(t, "(") + T.occurrences(t, ")")), "colons": rate(T.occurrences(t, ":")), "all_caps": rate(those(lambda x: (F.length(x) > 1) & (F.upper(x) == x))), "contractions": rate(those(lambda x: x.contains("'"))),
        "first_person": rate(those(lambda x: x.isin("i", "i'm", "i've"))), "first_plural": rate(those(lambda x: x.isin("we", "we're", "we've"))), "log_length": F.log1p(n),
    }
    return m.select("msg_id", "author", *kept, *[F.round(c, 5).alias(name) for name, c in out.items()])


def function_word_freq(spark, sf):
    """Relative frequency of each function word by author, those that occur."""
    m = messages(spark, sf).select("author", T.words(F.col("body")).alias("w"))
    total = m.groupBy("author").agg(F.sum(F.size("w")).alias("total"))
    w = m.select("author", F.explode("w").alias("word")).where(F.col("word").isin(*FUNCTION_WORDS)).groupBy("author", "word").agg(F.count("*").alias("n"))
    return shares_of(w, total)


def shares_of(w: DataFrame, total: DataFrame) -> DataFrame:
    return w.join(total, "author").select("author", "word", F.round(F.col("n") / F.col("total"), 8).alias("freq"))


QUERIES = {f.__name__: f for f in (token_frequency, vocabulary_by_author, document_frequency, phrase_fingerprint, phrase_records, period_counts, learnt_abbreviations, phrase_sources, phrase_examples, sentence_templates, greeting_patterns, closing_patterns, lexicon_usage, assertiveness, sentence_stats, sentence_starters, paragraph_stats, grammar_signature, punctuation_profile, readability, structure_share, recipient_summary, function_word_freq)}
EXPLODED = f"{MESSAGES}, w AS (SELECT msg_id, author, unnest({WORDS}) AS word FROM msgs)"
GREETING = r"^((?:Hi|Hey|Hello|Dear|Good morning|Good afternoon|Good evening|Howdy|Greetings))[, ]+([A-Z][a-z]+(?: [A-Z][a-z]+)?)$"
GREETED = f"{MESSAGES}, l AS (SELECT msg_id, author, body, {LINES} AS ls FROM msgs), g AS (SELECT *, CASE WHEN len(list_filter(regexp_split_to_array(ls[1], '[ \\t\\r\\n]+'), lambda x: x <> '')) <= 8 AND regexp_matches(lower(ls[1]), '^({'|'.join(GREETING_WORDS)})') THEN regexp_replace(regexp_replace(ls[1], '[,!. ]+$', ''), {quoted(GREETING)}, '\\1 [Name]') END AS pattern FROM l)"
LAST3 = "ls[greatest(len(ls) - 2, 1):len(ls)]"
CLOSES = f"'^({'|'.join(CLOSING_WORDS)})'"
SENT = f"{MESSAGES}, s AS (SELECT author, unnest({MARKS}) AS s FROM msgs), c AS (SELECT author, CAST(len(list_filter(regexp_split_to_array(s, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS BIGINT) AS n, s FROM s)"
per_sql = lambda c: f"round(coalesce(CAST({c} AS DOUBLE) * 1000.0::DOUBLE / nullif(CAST(words AS DOUBLE), 0), 0.0::DOUBLE), 4)"
grams_sql = lambda w, n: f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"
SQL = {
    "period_counts": f"WITH {COUNTED} SELECT * FROM c WHERE with_period > 0",
    "learnt_abbreviations": f"WITH {LEARNT} SELECT * FROM s WHERE score >= {S.SCORE}",
    "phrase_records": f"WITH {RECORDS} SELECT t.*, domain, source, sentences FROM t JOIN domains USING (phrase) JOIN sources USING (phrase) JOIN es USING (phrase)",
    "token_frequency": f"WITH {EXPLODED} SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 100",
    "vocabulary_by_author": f"WITH {EXPLODED}, g AS (SELECT author, count(*) AS words, count(DISTINCT word) AS distinct_words, round(avg(length(word)), 6) AS mean_length, round(avg(CASE WHEN len(regexp_extract_all(word, '[aeiouy]+')) >= 3 THEN 1.0 ELSE 0.0 END), 6) AS complex FROM w GROUP BY author) SELECT *, CASE WHEN complex > 0.12 AND mean_length > 5 THEN 'advanced' WHEN complex > 0.06 THEN 'intermediate' ELSE 'conversational' END AS level FROM g",
    "document_frequency": f"WITH {MESSAGES}, n AS (SELECT author, count(*) AS total FROM msgs GROUP BY author), w AS (SELECT author, unnest(list_distinct({WORDS})) AS word FROM msgs), d AS (SELECT author, word, count(*) AS df FROM w WHERE length(word) > 3 GROUP BY ALL), r AS (SELECT author, word, df, row_number() OVER (PARTITION BY author ORDER BY df DESC, word) AS r FROM d JOIN n USING (author) WHERE df >= total * 0.15) SELECT author, word, df, r FROM r WHERE r <= 40",
    "phrase_fingerprint": f"WITH {PHRASES}, t AS (SELECT count(*) AS total FROM msgs) SELECT phrase, count(*) AS n, count(DISTINCT msg_id) AS in_messages, count(*) FILTER (place = 'opening') AS opening, count(*) FILTER (place = 'closing') AS closing, min(msg_id) AS first_id FROM phrases GROUP BY phrase HAVING count(*) >= greatest(3, (SELECT total FROM t) * 0.005) ORDER BY n DESC, phrase LIMIT 100",
    "phrase_sources": f"WITH {PHRASES}, t AS (SELECT phrase FROM phrases GROUP BY phrase ORDER BY count(*) DESC, phrase LIMIT 20), g AS (SELECT phrase, author, count(*) AS n FROM phrases JOIN t USING (phrase) GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY n DESC, author) <= 5",
    "phrase_examples": f"WITH {PHRASES}, t AS (SELECT phrase FROM phrases GROUP BY phrase ORDER BY count(*) DESC, phrase LIMIT 20), g AS (SELECT DISTINCT phrase, msg_id FROM phrases JOIN t USING (phrase)) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY msg_id) <= 3",
    "sentence_templates": f"WITH {MESSAGES}, s AS (SELECT unnest({MARKS}) AS s FROM msgs), w AS (SELECT list_filter(regexp_split_to_array(lower(s), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM s), k AS (SELECT w FROM w WHERE len(w) >= 4 AND w[1] NOT IN {sql_list(SKIP_STARTERS)}), t AS (SELECT array_to_string(w[1:3], ' ') AS template FROM k UNION ALL SELECT array_to_string(w[1:4], ' ') FROM k UNION ALL SELECT array_to_string(w[1:5], ' ') FROM k WHERE len(w) >= 5) SELECT template, count(*) AS n FROM t GROUP BY template HAVING count(*) >= 3 ORDER BY n DESC, template LIMIT 50",
    "greeting_patterns": f"WITH {GREETED} SELECT pattern, count(*) AS n, count(DISTINCT author) AS authors FROM g WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) >= 2 ORDER BY n DESC, pattern LIMIT 20",
    "closing_patterns": f"WITH {MESSAGES}, l AS (SELECT {LINES} AS ls FROM msgs), e AS (SELECT unnest({LAST3}) AS line FROM l) SELECT regexp_replace(line, '[,!. ]+$', '') AS closing, count(*) AS n FROM e WHERE regexp_matches(lower(line), {CLOSES}) GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, closing LIMIT 20",
    "lexicon_usage": f"WITH {LEXICON_SQL} SELECT * FROM used",
    "assertiveness": f"WITH {LEXICON_SQL}, t AS (SELECT CAST(coalesce(sum(n) FILTER (kind = 'intensifier'), 0) AS BIGINT) AS strong, CAST(coalesce(sum(n) FILTER (kind = 'softener'), 0) AS BIGINT) AS soft, CAST(coalesce(sum(n) FILTER (kind = 'temporal' AND phrase IN ('asap', 'immediately', 'urgent', 'right away')), 0) AS BIGINT) AS urgent, CAST(coalesce(sum(n) FILTER (kind = 'temporal' AND phrase IN ('no rush', 'take your time', 'when you get a chance', 'at your convenience')), 0) AS BIGINT) AS relaxed FROM used) SELECT *, CASE WHEN strong > soft * 1.5 THEN 'assertive' WHEN soft > strong * 1.5 THEN 'diplomatic' ELSE 'balanced' END AS style, CASE WHEN urgent > relaxed * 2 THEN 'pressing' WHEN relaxed > urgent * 2 THEN 'relaxed' ELSE 'balanced' END AS urgency FROM t",
    "sentence_stats": f"WITH {SENT}, r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n) AS r, count(*) OVER (PARTITION BY author) AS k FROM c), g AS (SELECT author, count(*) AS sentences, round(avg(n), 6) AS mean, max(CASE WHEN r = k // 2 + 1 THEN n END) AS upper_median, count(*) FILTER (n <= 8) AS short, count(*) FILTER (n BETWEEN 9 AND 20) AS medium, count(*) FILTER (n BETWEEN 21 AND 35) AS long, count(*) FILTER (n > 35) AS very_long FROM r GROUP BY author), p AS (SELECT author, CAST(sum(len(regexp_extract_all(body, '[?]'))) AS BIGINT) AS questions, CAST(sum(len(regexp_extract_all(body, '!'))) AS BIGINT) AS exclamations FROM msgs GROUP BY author) SELECT * FROM g JOIN p USING (author)",
    "sentence_starters": f"WITH {MESSAGES}, s AS (SELECT unnest({MARKS}) AS s FROM msgs) SELECT lower(list_filter(regexp_split_to_array(s, '[ \\t\\r\\n]+'), lambda x: x <> '')[1]) AS starter, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, starter LIMIT 15",
    "paragraph_stats": f"WITH {MESSAGES}, p AS (SELECT author, unnest({PARAS}) AS body FROM msgs), k AS (SELECT author, len({FIELDS}) AS n, len({MARKS}) AS k FROM p), g AS (SELECT author, count(*) AS paragraphs, round(avg(n), 6) AS mean_words, round(avg(CASE WHEN k <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS single FROM k GROUP BY author) SELECT *, CASE WHEN single > 0.6 THEN 'fragmented' WHEN single > 0.3 THEN 'balanced' ELSE 'dense' END AS style FROM g",
    "grammar_signature": f"WITH {MESSAGES}, g AS (SELECT author, CAST(sum({count_sql('lower(body)', CONTRACTION)}) AS BIGINT) AS contracted, CAST(sum({count_sql('lower(body)', EXPANDED)}) AS BIGINT) AS expanded, CAST(sum(len(regexp_extract_all(lower(body), '\\b(?:is|are|was|were|been|being)[ ]+[a-z]+ed\\b'))) AS BIGINT) AS passive, sum(len({WORDS})) AS words, {', '.join(f'CAST(sum(len(list_filter({WORDS}, lambda x: x IN {sql_list(p)}))) AS BIGINT) AS {k}_n' for k, p in PRONOUNS.items())} FROM msgs GROUP BY author), r AS (SELECT *, coalesce(contracted / nullif(contracted + expanded, 0), 0.0::DOUBLE) AS q FROM g) SELECT author, contracted, expanded, passive, round(q, 6) AS ratio, CASE WHEN q > 0.7 THEN 'informal' WHEN q > 0.3 THEN 'mixed' ELSE 'formal' END AS style, {', '.join(per_sql(f'{k}_n') + f' AS {k}' for k in PRONOUNS)}, CASE WHEN self_n > team_n AND self_n > audience_n THEN 'self_focused' WHEN team_n > audience_n THEN 'team_focused' ELSE 'audience_focused' END AS dominant FROM r",
    "punctuation_profile": f"WITH {MESSAGES}, g AS (SELECT author, sum(len({FIELDS})) AS words, {', '.join(f'sum({count_sql("body", p)}) AS {k}' for k, p in MARK_PATTERNS.items())} FROM msgs GROUP BY author), r AS (SELECT author, {', '.join(per_sql(k) + f' AS {k}' for k in MARK_PATTERNS)} FROM g) SELECT *, CASE WHEN exclamation > 8 THEN 'enthusiastic' WHEN exclamation > 3 THEN 'moderate' ELSE 'restrained' END AS energy FROM r",
    "readability": f"WITH {MESSAGES}, m AS (SELECT author, {WORDS} AS w, len({MARKS}) AS s FROM msgs), g AS (SELECT author, CAST(sum(len(w)) AS DOUBLE) AS W_, CAST(sum(s) AS DOUBLE) AS S_, CAST(sum(coalesce(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1))), 0)) AS DOUBLE) AS Y, CAST(sum(len(list_filter(w, lambda x: len(regexp_extract_all(x, '[aeiouy]+')) >= 3))) AS DOUBLE) AS C, CAST(sum(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)) AS DOUBLE) AS L FROM m GROUP BY author) SELECT author, round(206.835::DOUBLE - 1.015::DOUBLE * W_ / S_ - 84.6::DOUBLE * Y / W_, 4) AS ease, round(0.39::DOUBLE * W_ / S_ + 11.8::DOUBLE * Y / W_ - 15.59::DOUBLE, 4) AS grade, round(0.4::DOUBLE * (W_ / S_ + 100::DOUBLE * C / W_), 4) AS fog, round(5.88::DOUBLE * L / W_ - 29.6::DOUBLE * S_ / W_ - 15.8::DOUBLE, 4) AS coleman FROM g WHERE W_ > 0 AND S_ > 0",
    "structure_share": f"WITH {GREETED} SELECT author, round(avg(CASE WHEN pattern IS NOT NULL THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS greeting, round(avg(CASE WHEN len(list_filter({LAST3}, lambda s: regexp_matches(lower(s), {CLOSES}))) > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS closing, round(avg(CASE WHEN contains(ls[1], '?') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS hook FROM g GROUP BY author",
    "recipient_summary": f"WITH {MESSAGES}, a AS (SELECT author, unnest(string_split(recipients, ',')) AS r FROM msgs), c AS (SELECT author, lower(trim(r)) AS address FROM a WHERE trim(r) <> '') SELECT substr(sha256(address), 1, 12) AS hash, string_split(address, '@')[-1] AS domain, count(*) AS n, count(DISTINCT author) AS authors FROM c GROUP BY address",
    "function_word_freq": f"WITH {MESSAGES}, m AS (SELECT author, {WORDS} AS w FROM msgs), t AS (SELECT author, sum(len(w)) AS total FROM m GROUP BY author), e AS (SELECT author, unnest(w) AS word FROM m), g AS (SELECT author, word, count(*) AS n FROM e WHERE word IN {sql_list(FUNCTION_WORDS)} GROUP BY ALL) SELECT author, word, round(n / CAST(total AS DOUBLE), 8) AS freq FROM g JOIN t USING (author)",
}
