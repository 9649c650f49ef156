"""Profiles of senders and recipients, and the vectors and checks that hold a message against them; DataFrame to DataFrame.

messages have msg_id, author, recipients (a field of addresses), subject, body and sent (may be null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import CLOSING_WORDS, GREETING_WORDS
from ..shared import written
from . import partials

KNOWN = 3  # sends that make a recipient known
RATES = {"dash": "—|--", "ellipsis": r"\.{3,}|…", "exclamation": "!"}
WEIGHTS = {"word_count": 0.1, "readability": 0.15, "formality": 0.15, "contractions": 0.1, "greeting": 0.15, "closing": 0.1, "exclamation_energy": 0.1, "perspective_shift": 0.15}
WARN, HOLD = 0.35, 0.55
BROADCAST_GRAMS = 200_000  # some 20 MB


def small(df: DataFrame) -> DataFrame:
    """df as a written table, whose size Spark knows: it is broadcast by Spark's own limit of bytes, or else joined by a shuffle."""
    return written(df)


def ranked(rows: DataFrame, keys: list[str], value: str, k: int, first: str = "msg_id") -> DataFrame:
    """keys and top: the k commonest values of each key; ties by who came first."""
    g = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(first).alias("__f"))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), "__f", value))
    best = g.withColumn("__r", r).where(F.col("__r") <= k)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(value).alias("phrase"), F.col("__n").alias("n")))), lambda x: F.struct(x["phrase"].alias("phrase"), x["n"].alias("n"))).alias("top"))


def measured(messages: DataFrame, owner: str | None = None) -> DataFrame:
    """What profiles and vectors read of each message: addresses, words in full and of its own text, time, marks, first and last words."""
    m = messages.withColumn("__own", T.own_text(F.col("body"), owner)).withColumn("__w", T.tokens(F.col("__own")))
    m = m.withColumn("own_words", F.size("__w")).withColumn("full_words", F.size(T.tokens(F.col("body"))))
    rate = lambda p: F.when(F.col("own_words") > 0, F.lit(100.0) * T.matches(F.col("__own"), p) / F.col("own_words"))
    return m.select(
        "msg_id", "author", T.recipients(F.col("recipients")).alias("addresses"), "full_words", "own_words", F.hour("sent").alias("hour"), F.weekday("sent").alias("day"), "sent",
        F.trim("subject").rlike(r"(?i)^(re|fwd|fw)\s*:").alias("reply"), F.when(F.col("own_words") >= 4, T.first_words(F.col("__w"), 3)).alias("opens"), F.when(F.col("own_words") >= 4, T.last_words(F.col("__w"), 3)).alias("closes"),
        T.first_words(F.col("__w"), 3).alias("first3"), T.last_words(F.col("__w"), 3).alias("last3"), *[rate(p).alias(k) for k, p in RATES.items()],
    )


def _profiles(messages: DataFrame, owner: str | None, rows: DataFrame | None) -> DataFrame:
    return partials.finished(partials.cells(rows if rows is not None else measured(messages, owner)))


def recipient_profiles(messages: DataFrame, owner: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """A row for each address written to: sends, statistics, histograms, gaps, reply rate, openings and closings.

    A message to several counts for each of them. rows are the measured messages, if they are at hand.
    """
    return _profiles(messages, owner, rows).where(F.col("address") != partials.GLOBAL)


def global_profile(messages: DataFrame, owner: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The same over all messages, each once, as address _global."""
    return _profiles(messages, owner, rows).where(F.col("address") == partials.GLOBAL)


def profile_meta(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """n_emails, n_recipients, n_known_recipients; the global profile counts among the known."""
    total = messages.agg(F.count("*").alias("n_emails"))
    p = profiles.agg(F.count("*").alias("n_recipients"), F.count_if("is_known").alias("known"))
    return total.crossJoin(p).select("n_emails", "n_recipients", (F.col("known") + (F.col("n_emails") >= KNOWN).cast("long")).alias("n_known_recipients"), F.lit(KNOWN).alias("min_sends_known"))


def clipped_z(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std <= 1e-9, F.lit(0.0)).otherwise(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (x - mean) / std)))


CONTEXT = ["rec_is_known", "rec_n_sends_log1p", "wc_z_rec", "wc_z_glob", "hour_fit_rec", "hour_fit_glob", "dow_fit_rec", "dow_fit_glob", "rec_reply_rate", "is_reply", "reply_mismatch", "greet_match_rec", "greet_match_glob", "close_match_glob", "dash_z", "ellipsis_z", "exclamation_z", "own_over_full", "n_recipients", "rec_is_self"]


def context_vector(messages: DataFrame, profiles: DataFrame, overall: DataFrame, self_address: str = "", owner: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """msg_id and the 20 context values of each message, against its main recipient's profile and the global one.

    The main recipient is the one written to most, the first on ties; a message without a profiled recipient is held
    against the global profile, which counts as known. rows are the measured messages, if they are at hand.
    """
    m = rows if rows is not None else measured(messages, owner)
    cols = [c for c in profiles.columns if c != "address"]
    each = m.select("msg_id", F.posexplode("addresses").alias("place", "address")).join(small(profiles.select("address", "n_sends")), "address")
    best = each.groupBy("msg_id").agg(F.max_by("address", F.struct("n_sends", -F.col("place"))).alias("address"))
    p = profiles.select("address", F.struct(*cols).alias("p"))
    g = overall.select(F.struct(*cols).alias("g"))
    j = m.join(best, "msg_id", "left").join(small(p), "address", "left").crossJoin(F.broadcast(g)).withColumn("p", F.coalesce("p", "g"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    at = lambda h, i: F.coalesce(F.get(F.col(h), F.col(i)), F.lit(0.0))
    among = lambda c, top: flag(F.coalesce((F.col(c) != "") & F.exists(F.col(top), lambda x: x["phrase"] == F.col(c)), F.lit(False)))
    reply = flag(F.col("reply"))
    full = F.col("full_words").cast("double")
    out = [
        flag(F.col("p.is_known")), F.log1p(F.col("p.n_sends").cast("double")), clipped_z(full, F.col("p.words.mean"), F.col("p.words.std")), clipped_z(full, F.col("g.words.mean"), F.col("g.words.std")),
        at("p.hours", "hour"), at("g.hours", "hour"), at("p.days", "day"), at("g.days", "day"), F.col("p.reply_rate"), reply, F.abs(reply - F.col("p.reply_rate")),
        among("first3", "p.greetings"), among("first3", "g.greetings"), among("last3", "g.closings"),
        *[clipped_z(F.coalesce(k, F.lit(0.0)), F.col(f"p.{k}.mean"), F.col(f"p.{k}.std")) for k in RATES],
        F.coalesce(F.try_divide(F.col("own_words").cast("double"), full), F.lit(0.0)), F.size("addresses").cast("double"), flag(F.array_contains("addresses", self_address)),
    ]
    return j.select("msg_id", *[c.alias(n) for n, c in zip(CONTEXT, out, strict=True)])


# Profiles of authors, and the checks of a message against its author's.


def _greeting_pattern(body: Column) -> Column:
    """First line if it is a greeting of at most eight words, names replaced."""
    name = r"^((?:Hi|Hey|Hello|Dear|Good morning|Good afternoon|Good evening|Howdy|Greetings))[, ]+([A-Z][a-z]+(?: [A-Z][a-z]+)?)$"
    one = lambda s: F.when((F.size(T.fields(s)) <= 8) & F.lower(s).rlike("^(" + "|".join(GREETING_WORDS) + ")"), F.regexp_replace(F.regexp_replace(s, "[,!. ]+$", ""), name, "$1 [Name]"))
    return T.bound(F.get(T.lines(body), F.lit(0)), one)


def _frequent(rows: DataFrame, value: str, name: str) -> DataFrame:
    """author and the 20 commonest values that occur twice."""
    g = rows.groupBy("author", value).agg(F.count("*").alias("__n"), F.min("msg_id").alias("__f")).where("__n >= 2")
    r = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("__n"), "__f", value))
    best = g.withColumn("__r", r).where("__r <= 20")
    return best.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", value))), lambda x: x[value]).alias(name))


def author_profiles(messages: DataFrame) -> DataFrame:
    """A row for each author: sizes, readability, formality, contractions, marks, perspective, greetings and closings."""
    b = F.col("body")
    syllables = lambda ws: F.aggregate(F.transform(ws, lambda w: F.greatest(F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0))), F.lit(1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    m = messages.withColumns({"__w": T.words(b), "__low": T.folded(b), "__n": F.size(T.fields(b)).cast("long"), "__s": F.size(T.marks(b)).cast("long")})
    count = lambda ws: F.sum(T.matches(F.col("__low"), rf"\b(?:{ws})\b"))
    g = m.groupBy("author").agg(
        F.count("*").alias("messages"), F.avg("__n").alias("avg_words"), F.sum("__n").alias("total_words"), F.sum(F.size("__w").cast("long")).cast("double").alias("__W"), F.sum("__s").cast("double").alias("__S"),
        F.sum(syllables(F.col("__w"))).cast("double").alias("__Y"), F.sum(T.matches(F.col("__low"), T.CONTRACTION)).cast("double").alias("__c"), F.sum(T.matches(F.col("__low"), T.EXPANDED)).cast("double").alias("__e"), F.sum(T.matches(b, "!")).cast("double").alias("__x"),
        count("i|me|my|mine").alias("__self"), count("we|us|our|ours").alias("__team"), count("you|your|yours").alias("__you"),
    )
    ratio = F.coalesce(F.try_divide(F.col("__c"), F.col("__c") + F.col("__e")), F.lit(0.0))
    marks = F.lit(1000.0) * F.col("__x") / F.greatest(F.col("total_words"), F.lit(1)).cast("double")
    g = g.withColumns({"grade": F.when((F.col("__W") > 0) & (F.col("__S") > 0), F.expr("0.39D * __W / __S + 11.8D * __Y / __W - 15.59D")), "contraction_ratio": ratio, "exclamation_per_1000": marks})
    formality = F.lit(5.0) + F.when(ratio > 0.7, -1.5).when(ratio > 0.3, 0.0).otherwise(1.5) + F.when(marks > 8, -1.0).when(marks > 3, 0.0).otherwise(0.5) + F.when(F.col("grade") > 12, 1.0).when(F.col("grade") < 6, -1.0).otherwise(0.0)
    dominant = F.when((F.col("__self") > F.col("__team")) & (F.col("__self") > F.col("__you")), "self_focused").when(F.col("__team") > F.col("__you"), "team_focused").otherwise("audience_focused")
    g = g.withColumns({"formality": F.greatest(F.lit(0.0), F.least(F.lit(10.0), formality)), "perspective": dominant})
    greet = _frequent(messages.select("msg_id", "author", _greeting_pattern(b).alias("v")).where("v is not null"), "v", "greetings")
    lines = messages.select("msg_id", "author", F.explode(T.last(T.lines(b), 3)).alias("l")).where(F.lower("l").rlike("^(" + "|".join(CLOSING_WORDS) + ")"))
    close = _frequent(lines.select("msg_id", "author", F.regexp_replace("l", "[,!. ]+$", "").alias("v")), "v", "closings")
    out = g.join(greet, "author", "left").join(close, "author", "left")
    label = F.when(F.col("formality") > 7, "formal").when(F.col("formality") > 5, "professional").when(F.col("formality") > 3, "conversational").otherwise("casual")
    return out.select("author", "messages", "total_words", "avg_words", "grade", "contraction_ratio", "exclamation_per_1000", "formality", label.alias("formality_label"), "perspective", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("greetings", "closings")])


def score_messages(messages: DataFrame, profiles: DataFrame, policies: DataFrame | None = None, sensitive_action: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """msg_id, the eight deviations (null where a check doesn't apply), score and verdict of each message.

    policies has author, warn and hold; without a policy the limits are .35 and .55. A message without a profile is
    unknown. keep names columns of messages that stay. sensitive_action is the action of a scan for sensitive data: hold forces hold, warn lifts pass to warn.
    """
    b = F.col("body")
    m = messages.withColumns({"__n": F.size(T.fields(b)).cast("double"), "__g": T.quick_grade(b), "__f": T.quick_formality(b), "__c": T.contraction_ratio(b), "__hi": T.message_greeting(b), "__bye": T.message_closing(b), "__x": T.matches(b, "!").cast("double"), "__p": T.perspective(b)})
    m = m.withColumn("__action", sensitive_action if sensitive_action is not None else F.lit("log"))
    j = m.join(small(profiles), "author", "left")
    j = j.join(small(policies.select("author", "warn", "hold")), "author", "left") if policies is not None else j.withColumns({"warn": F.lit(None).cast("double"), "hold": F.lit(None).cast("double")})
    capped = lambda x, most: F.least(F.lit(1.0), x / most)
    ratio = F.col("__n") / F.greatest(F.col("avg_words"), F.lit(1.0))
    grade, form = F.abs(F.col("__g") - F.col("grade")), F.abs(F.col("__f") - F.col("formality"))
    contr, marks = F.abs(F.col("__c") - F.col("contraction_ratio")), F.abs(F.lit(1000.0) * F.col("__x") / F.greatest(F.col("__n"), F.lit(1.0)) - F.col("exclamation_per_1000"))
    knows = lambda list_, value, prefix: F.exists(F.col(list_), lambda k: F.startswith(F.lower(F.col(value)), prefix(F.lower(k))))
    checks = {
        "word_count": F.when((ratio > 3) | (ratio < 0.2), capped(F.abs(ratio - 1), 3.0)),
        # a grade of exactly 0 is no grade
        "readability": F.when((F.col("__g") != 0) & (F.col("grade") != 0) & (grade > 3), capped(grade, 10.0)),
        "formality": F.when(form > 2, capped(form, 7.0)),
        "contractions": F.when(contr > 0.3, capped(contr, 0.7)),
        "greeting": F.when((F.size("greetings") > 0) & F.col("__hi").isNotNull() & ~knows("greetings", "__hi", lambda k: F.trim(F.substring_index(k, "[", 1))), 0.8),
        "closing": F.when((F.size("closings") > 0) & F.col("__bye").isNotNull() & ~knows("closings", "__bye", lambda k: k), 0.6),
        "exclamation_energy": F.when(marks > 5, capped(marks, 15.0)),
        "perspective_shift": F.when(F.col("__p") != F.col("perspective"), 0.4),
    }
    known = F.col("avg_words").isNotNull()
    j = j.withColumns({f"__d_{k}": c for k, c in checks.items()})
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + F.coalesce(F.col(f"__d_{k}"), F.lit(0.0)) * F.lit(w)
    # rounded far beyond any limit, so that a sum's last bits don't decide
    j = j.withColumn("__score", F.when(known, F.round(F.least(F.lit(1.0), total), 9)))
    verdict = F.when(F.col("__score") >= F.coalesce("hold", F.lit(HOLD)), "hold").when(F.col("__score") >= F.coalesce("warn", F.lit(WARN)), "warn").otherwise("pass")
    verdict = F.when(F.col("__action") == "hold", "hold").when((F.col("__action") == "warn") & (verdict == "pass"), "warn").otherwise(verdict)
    verdict = F.when(known, verdict).when(F.col("__action").isin("hold", "warn"), F.col("__action")).otherwise("unknown")
    return j.select("msg_id", *(keep or []), *[F.col(f"__d_{k}").alias(k) for k in WEIGHTS], F.col("__score").alias("score"), verdict.alias("verdict"))


# What an author never does, and what differs from the recipient's baseline.


def negative_space(real: DataFrame, messages: DataFrame, body: str = "body") -> DataFrame:
    """msg_id and nine values: unseen openings and closing, runs of two and three words that real doesn't hold twice, marks it never uses."""
    r = real.select(F.coalesce(F.col(body), F.lit("")).alias("t"))
    opened = r.select(T.opening_phrase(F.col("t")).alias("o"), T.closing_phrase(F.col("t")).alias("c"))
    two = lambda o: F.array_join(F.slice(F.split(o, " "), 1, 2), " ")
    openings = opened.where("o <> ''").select(F.explode(F.array(F.col("o"), two(F.col("o")))).alias("o")).distinct()
    closings = opened.where("c <> ''").select("c").distinct()
    grams = lambda c: F.concat(*[T.ngrams(c, n) for n in (2, 3)])
    seen = r.select(F.explode(grams(T.words(F.col("t")))).alias("gram")).groupBy("gram").count().where("count >= 2").select("gram", F.lit(1).alias("seen"))
    uses = r.agg(F.coalesce(F.max(F.col("t").contains("—")), F.lit(False)).alias("r_dash"), F.coalesce(F.max(F.col("t").contains("…") | F.col("t").contains("...")), F.lit(False)).alias("r_dots"))
    m = messages.select("msg_id", F.coalesce(F.col("body"), F.lit("")).alias("t")).withColumns({"w": T.words(F.col("t")), "o4": T.opening_phrase(F.col("t")), "c": T.closing_phrase(F.col("t")), "dash": F.col("t").contains("—"), "dots": F.col("t").contains("…") | F.col("t").contains("...")})
    seen, g = small(seen), m.select("msg_id", F.explode(grams(F.col("w"))).alias("gram"))
    if seen.count() <= BROADCAST_GRAMS:  # each task looks up and counts its own messages' grams, and only counts move
        j = g.withColumn("k", F.lit(1).cast("long")).join(F.broadcast(seen), "gram", "left")
    else:  # equal grams of a message go as one row with their number
        j = g.groupBy("msg_id", "gram").agg(F.count("*").alias("k")).join(seen, "gram", "left")
    j = j.withColumn("n", F.when(F.length("gram") - F.length(F.replace("gram", F.lit(" "), F.lit(""))) == 1, 2).otherwise(3))
    total = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    new = F.col("seen").isNull()
    by = j.groupBy("msg_id").agg(total((F.col("n") == 2) & new).alias("v2"), total(F.col("n") == 2).alias("n2"), total((F.col("n") == 3) & new).alias("v3"), total(F.col("n") == 3).alias("n3"))
    mark = lambda df, c, to: df.withColumnRenamed(c, to).withColumn(f"has_{to}", F.lit(1))
    x = m.drop("t", "w").withColumn("o2", two(F.col("o4")))
    x = x.join(small(mark(openings, "o", "o4")), "o4", "left").join(small(mark(openings, "o", "o2")), "o2", "left").join(small(mark(closings, "c", "c")), "c", "left").join(by, "msg_id", "left").crossJoin(F.broadcast(uses))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    rate = lambda n: F.coalesce(F.col(f"v{n}") / F.greatest(F.col(f"n{n}"), F.lit(1)).cast("double"), F.lit(0.0))
    unseen = {k: flag((F.col(k) != "") & F.col(f"has_{k}").isNull()) for k in ("o4", "o2", "c")}
    x = x.select("msg_id", unseen["o4"].alias("opening"), unseen["o2"].alias("opening_2w"), unseen["c"].alias("closing"), rate(2).alias("two_rate"), rate(3).alias("three_rate"), F.coalesce("v2", F.lit(0)).cast("double").alias("two_count"), flag(F.col("dash") & ~F.col("r_dash")).alias("dash"), flag(F.col("dots") & ~F.col("r_dots")).alias("ellipsis"))
    return x.withColumn("composite", F.expr("3D * opening + opening_2w + 2D * closing + 2D * three_rate + two_rate + 0.5D * dash + 0.5D * ellipsis"))


def _baseline(rows: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    g = rows.groupBy(key).agg(F.count("*").alias("k"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), (F.count_if("dash") >= F.greatest(F.lit(1.0), F.count("*") * F.lit(0.1))).alias("dashes"))
    s = sentences.groupBy(key).agg(F.avg("ns").alias("s_mean"), F.stddev_pop("ns").alias("s_sd"))
    return g.join(s, key, "left").join(ranked(rows.where("o <> ''"), [key], "o", 10), key, "left")


def recipient_conditional(messages: DataFrame, top: int = 5, least: int = 8) -> DataFrame:
    """msg_id and six values of each message against the baseline of its first recipient, if that is among the top ones, else all."""
    b = F.col("body")
    parts = F.filter(F.split(b, r"[.!?\n]+"), lambda s: F.length(F.regexp_replace(s, r"[ \t\r\n]+", "")) > 0)
    m = messages.select("msg_id", F.coalesce(F.get(T.recipients(F.col("recipients")), F.lit(0)), F.lit("")).alias("to"), F.size(T.words(b)).cast("double").alias("n"), T.opening_phrase(b, 3).alias("o"), b.contains("—").alias("dash"), F.transform(parts, lambda s: F.size(T.words(s)).cast("double")).alias("lens"), F.lit("_all").alias("all"))
    best = m.where("to <> ''").groupBy("to").agg(F.count("*").alias("k")).where(F.col("k") >= least).orderBy(F.desc("k"), "to").limit(top).select("to")
    mine = m.join(F.broadcast(best), "to", "left_semi")
    own = _baseline(mine, mine.select("to", F.explode("lens").alias("ns")), "to")
    every = _baseline(m, m.select("all", F.explode("lens").alias("ns")), "all")
    cols = [c for c in own.columns if c != "to"]
    j = m.join(F.broadcast(own.select("to", F.struct(*cols).alias("r"))), "to", "left").crossJoin(F.broadcast(every.select(F.struct(*cols).alias("e")))).withColumn("known", F.col("r").isNotNull()).withColumn("r", F.coalesce("r", "e"))
    sd = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, F.col(c)).otherwise(1.0)
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    mean_len = F.when(F.size("lens") > 0, F.aggregate("lens", F.lit(0.0), lambda s, x: s + x) / F.size("lens")).otherwise(0.0)
    return j.select("msg_id", flag(F.col("known")).alias("rec_is_known"), ((F.col("n") - F.col("r.mean")) / sd("r.sd")).alias("rec_len_z"), ((mean_len - F.coalesce("r.s_mean", F.lit(0.0))) / sd("r.s_sd")).alias("rec_sent_len_z"), flag(F.exists(F.col("r.top"), lambda x: x["phrase"] == F.col("o"))).alias("rec_opening_known"), flag(F.col("dash") & ~F.col("r.dashes")).alias("rec_em_dash_mismatch"), F.when(F.col("known"), 0.0).otherwise(1.0).alias("rec_skepticism"))


def extraction_summary(messages: DataFrame) -> DataFrame:
    """One row on a corpus: totals, means, upper median of words, shares of replies, forwards and originals, 20 commonest domains."""
    low = F.lower(F.coalesce("subject", F.lit("")))
    m = messages.select("msg_id", F.size(T.fields(F.col("body"))).cast("long").alias("n"), F.length("body").cast("long").alias("chars"), low.startswith("re:").alias("re"), (low.startswith("fw:") | low.startswith("fwd:")).alias("fw"), T.recipients(F.col("recipients")).alias("to"))
    # the upper median by counts of lengths, not by a sort of all rows
    by = m.groupBy("n").agg(F.count("*").alias("k"))
    upto = by.agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("h"))
    half = F.floor(F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x["k"]) / 2) + 1
    median = upto.select(F.aggregate("h", F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("out")), lambda s, x: F.struct((s["at"] + x["k"]).alias("at"), F.coalesce(s["out"], F.when(s["at"] + x["k"] >= half, x["n"])).alias("out")), lambda s: s["out"]).alias("median_words"))
    pct = lambda c: F.round(F.avg(c.cast("double")) * 100, 1)
    g = m.agg(F.count("*").alias("total_messages"), F.sum("n").alias("total_words"), F.sum("chars").alias("total_characters"), F.round(F.avg("n"), 1).alias("avg_words"), F.round(F.avg("chars"), 1).alias("avg_chars"), pct(F.col("re")).alias("reply_pct"), pct(F.col("fw")).alias("forward_pct"), pct(~F.col("re") & ~F.col("fw")).alias("original_pct"))
    d = m.select("msg_id", F.explode(F.transform("to", lambda x: F.substring_index(x, "@", -1))).alias("domain")).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(20)
    top = d.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "domain"))), lambda x: F.concat(x["domain"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("top_domains"))
    return g.crossJoin(median).crossJoin(top)


def invalid_phrases(profiles: DataFrame, phrase: str = "phrase", n: str = "n") -> DataFrame:
    """Phrases that a profile mustn't hold: over four words, fewer than five uses, or with contact data."""
    p = F.col(phrase)
    why = F.when(F.size(T.fields(p)) > 4, "long").when(F.col(n) < 5, "rare").when(p.rlike(T.EMAIL) | p.rlike(T.PHONE) | p.rlike(T.URL), "contact")
    return profiles.withColumn("why", why).where("why is not null")


def top_reasons(rows: DataFrame, names: list[str], means: dict[str, float], spreads: dict[str, float], k: int = 3, least: float = 1.5) -> DataFrame:
    """rows with reasons: up to k values that lie over least deviations from their mean, the farthest first, as text."""
    every = []
    for name in names:
        m, s = float(means[name]), max(float(spreads[name]), 1e-6)
        z = F.abs((F.col(name) - m) / s)
        side = F.when(F.col(name) > m, "higher than").otherwise("lower than")
        every.append(F.struct(z.alias("z"), F.format_string(f"{name}: %.2f (%s typical {m:.2f}, z=%.1f)", F.col(name), side, z).alias("text")))
    found = F.transform(F.filter(F.slice(F.sort_array(F.array(*every), False), 1, k), lambda x: x["z"] > least), lambda x: x["text"])
    return rows.withColumn("reasons", T.bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("overall linguistic pattern deviates from user baseline")))))


def gated(score: Column, words: Column, least: int = 50, most: float = 0.3) -> Column:
    """A score of a text too short for a judgement is most at most."""
    return F.when(words < least, F.least(score, F.lit(most))).otherwise(score)


def live_verdict(score: Column, words: Column, flag: float = 0.55, block: float = 0.8, least: int = 15) -> Column:
    return F.when(words < least, "verified").when(score >= block, "blocked").when(score >= flag, "flagged").otherwise("verified")


def anomaly(raw: Column, low: float, high: float) -> Column:
    """Raw decision put in line: 0 at the 99th percentile (high), 1 at the 1st (low), cut there."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(high) - raw) / F.lit(max(high - low, 1e-9))))
