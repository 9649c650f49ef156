"""Text expressions, Column to Column: tokenisers, splitters, cleaners. No UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import BULK, CONTRACTION, EXPANDED, FOOTERS, MESSAGE_CLOSINGS, MESSAGE_GREETINGS, REPLY_CUTS, SIGNATURE_CUTS, SIGNATURE_TITLES, SIGNATURE_WORDS

EMAIL = r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b"
PHONE = r"\b(?:\+?\d{1,2}[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b"
URL = r"https?://[^ \t\r\n]+|www\.[^ \t\r\n]+"
HEADER = r"(?i)^(From|Sent|To|Cc|Bcc|Subject|Date):\s"


def bound(value: Column, f) -> Column:
    """f(value), with value evaluated once: within an expression a repeated part is computed again each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and apostrophes."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0)), F.lower)


def fields(text: Column) -> Column:
    """White-space separated parts; none of an empty text."""
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Parts between sentence ends or blank lines, trimmed; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]+[ \t\r\n]+|\n\n+"), lambda s: F.trim(F.regexp_replace(s, r"^[\r\n\t ]+|[\r\n\t ]+$", ""))), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(text)))


def marks(text: Column) -> Column:
    """Parts between runs of sentence marks, without white space only."""
    return F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike(r"[^ \t\r\n]"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n[ \t\r\n]*\n"), lambda s: s.rlike(r"[^ \t\r\n]"))


def lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^[\r\t ]+|[\r\t ]+$", "")), lambda s: s != "")


def last(parts: Column, n: int) -> Column:
    """The last n of an array, all if it has fewer."""
    return F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), n)


def ngrams(parts: Column, n: int) -> Column:
    """Runs of n joined by a blank; none of a shorter array."""
    at = F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1)))
    return F.when(F.size(parts) >= n, F.transform(at, lambda i: F.array_join(F.slice(parts, i, n), " "))).otherwise(F.array().cast("array<string>"))


def occurrences(text: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a string."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


FOOTER = "(?i)^(?:" + "|".join(FOOTERS) + ")"


def edges_trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\r\t ]+|[\r\t ]+$", "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def strip_artifacts(text: Column) -> Column:
    """The author's own lines: no quotes and header lines, nothing after a footer; addresses become placeholders."""
    every = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"\r$", ""))
    kept = F.filter(every, lambda s: ~edges_trimmed(s).rlike("^>|" + HEADER))

    def own(lines: Column) -> Column:
        stop = F.array_position(F.transform(lines, lambda s: edges_trimmed(s).rlike(FOOTER)), True)
        return bound(stop, lambda at: F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines))

    body = F.array_join(bound(kept, own), "\n")
    for pattern, mark in ((EMAIL, " _EMAIL_ "), (PHONE, " _PHONE_ "), (URL, " _URL_ ")):
        body = F.regexp_replace(body, pattern, mark)
    return stripped(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_transcript(text: Column) -> Column:
    """Without time stamps and speaker names; white space collapsed."""
    t = F.regexp_replace(text, r"\[?\d{1,2}:\d{2}(?::\d{2})?\]?", "")
    t = F.regexp_replace(t, r"(?m)^[A-Z][A-Za-z]{0,30}:[ \t]*", "")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


# Lines that end own text, and lines that stand before quoted mail.
MOBILE = r"(?i)^[ \t]*(sent from my|get outlook for|sent from mail for|sent from the|sent via|outlook for (ios|android))"
FORWARDED = r"(?i)begin forwarded message|forwarded message|original message"
FORWARD_HEADER = r"(?i)^[ \t]*(from|sent|to|cc|subject|date):[ \t\r]"
DIVIDER = r"^[ \t]*(_{5,}|-{5,}|>)"


def line_kinds(lines: Column, owner: str | None) -> Column:
    """One letter for each line: X ends own text, H is a header line, d a divider or quote, others are dots."""
    hard = lambda s: s.rlike(MOBILE) | (s.rlike(FORWARDED) & (F.length(edges_trimmed(s)) < 60)) | (s.rlike(owner) if owner else F.lit(False))
    return F.array_join(F.transform(lines, lambda s: F.when(hard(s), "X").when(s.rlike(FORWARD_HEADER), "H").when(s.rlike(DIVIDER), "d").otherwise(".")), "")


def own_text(text: Column, owner: str | None = None) -> Column:
    """What the sender wrote: lines before a signature (owner: a pattern of the owner's), a forward mark or two header lines in a row.

    A divider or quoted line ends it too once two lines are kept, and goes before that. The kinds of all lines make a
    string, in which the end is found by patterns: no state is carried from line to line.
    """
    open_ = F.lit(1 << 30)

    def cut(r: Column) -> Column:
        kinds, rows = r["k"], r["l"]
        hard = F.when(F.instr(kinds, "X") > 0, F.instr(kinds, "X")).otherwise(open_)
        headers = F.when(F.instr(kinds, "HH") > 0, F.instr(kinds, "HH") + 1).otherwise(open_)
        early = r"^d*[^d]d*[^d][^d]*"
        divider = F.when(kinds.rlike(early + "d"), F.length(F.regexp_extract(kinds, early, 0)) + 1).otherwise(open_)
        # the header line before the second one goes with it
        end = F.least(hard, divider, F.when(headers < F.least(hard, divider), headers - 1).otherwise(open_))
        pairs = F.filter(F.arrays_zip(F.slice(rows, F.lit(1), F.least(end - 1, F.size(rows))).alias("s"), F.split(kinds, "").alias("k")), lambda x: x["s"].isNotNull() & (x["k"] != "d"))
        return F.array_join(F.transform(pairs, lambda x: x["s"]), "\n")

    lines = F.split(text, "\n")
    return stripped(bound(bound(lines, lambda x: F.struct(x.alias("l"), line_kinds(x, owner).alias("k"))), cut))


def cut_at(text: Column, pattern: str, beyond: float | None = None) -> Column:
    """text before the first match, if the match starts beyond that share of the text."""
    before = lambda t: F.get(F.split(t, pattern, 2), F.lit(0))
    return bound(text, lambda t: bound(before(t), lambda b: b if beyond is None else F.when(F.length(b) > F.length(t) * F.lit(beyond), b).otherwise(t)))


def strip_replies(text: Column, cuts: list[str] = REPLY_CUTS) -> Column:
    """Ordered cuts at reply and forward marks."""
    for p in cuts:
        text = cut_at(text, f"(?i){p}")
    return stripped(text)


def strip_signature(text: Column, cuts: list[str] = SIGNATURE_CUTS, owner: list[str] | None = None) -> Column:
    """Ordered cuts at signature marks (owner's patterns first), each only beyond 30 % of what is left."""
    for p in [*(owner or []), *cuts]:
        text = cut_at(text, f"(?is){p}", 0.3)
    return stripped(text)


REPLY_STOP = r"^On .+ wrote:[ \t]*$|(?i:^-{3,}\s*Original Message\s*-{3,})|(?i:^-{3,}\s*Forwarded\s)|(?i:^-{2,}\s*Forwarded message\s*-{2,})|^-{2,3}\s*[A-Z][a-z]|^--$"


def strip_quotes(text: Column) -> Column:
    """Message without quoted lines, without what follows a reply or forward mark or a signature mark, and without a
    signature block among its last eleven lines. A From line or a rule of underscores ends it only after three kept
    lines, the From line only if one of the next four lines is a header too."""
    rows = F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    heads = lambda ls: F.array_join(F.transform(ls, lambda s: F.when(edges_trimmed(s).rlike("(?i)^(Sent|To|Subject|Date|Cc):"), "h").otherwise(".")), "")

    def kind(s: Column, i: Column, head: Column) -> Column:
        t = edges_trimmed(s)
        header = t.rlike("(?i)^From:") & (F.instr(F.substring(head, i + 2, F.lit(4)), "h") > 0)
        return F.when(t == "", "b").when(F.startswith(t, F.lit(">")), "q").when(t.rlike(REPLY_STOP), "X").when(header | t.rlike("^_{3,}[ \t]*$"), "F").otherwise(".")

    marked = bound(rows, lambda ls: bound(heads(ls), lambda h: F.filter(F.transform(ls, lambda s, i: F.struct(s.alias("s"), kind(s, i, h).alias("k"))), lambda x: x["k"] != "q")))

    def cut(xs: Column) -> Column:
        kinds = F.array_join(F.transform(xs, lambda x: x["k"]), "")
        def of(k: Column) -> Column:
            lead = F.length(F.regexp_extract(k, "^b*", 0))
            left = F.substring(k, lead + 1, F.length(k))
            before = F.least(F.length(F.regexp_extract(left, "^[^X]*", 0)), F.length(F.regexp_extract(left, "^.{0,3}[^F]*", 0)))
            return F.array_join(F.transform(F.slice(xs, lead + 1, before), lambda x: x["s"]), "\n")
        return bound(kinds, of)

    body = stripped(bound(marked, cut))
    for p in (r"\n--\s*\n", r"\nSent from my (?:iPhone|iPad|Android|Galaxy)", r"\nGet Outlook for ", r"\nSent via "):
        body = cut_at(body, p)

    def signature(s: Column) -> Column:
        t = edges_trimmed(s)
        title = (F.size(fields(t)) <= 4) & t.rlike("^[A-Z]") & F.lower(t).rlike("|".join(SIGNATURE_TITLES))
        like = t.rlike(r"[()0-9\-+]{7,}") | t.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+") | t.rlike("^https?://") | t.rlike(r"^\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}") | title
        return F.when(t == "", "b").when(like, "s").otherwise(".")

    def tail(ls: Column) -> Column:
        kinds = F.array_join(F.transform(last(ls, 11), signature), "")
        run = lambda k: F.regexp_extract(k, "s[sb]*$", 0)
        return bound(kinds, lambda k: F.array_join(F.slice(ls, F.lit(1), F.size(ls) - F.length(run(k))), "\n"))

    return stripped(bound(F.split(body, "\n"), tail))


def strip_quoted(text: Column) -> Column:
    """Lines that aren't quoted, up to a reply mark, or to a From line after three kept ones."""
    def kind(s: Column) -> Column:
        t = edges_trimmed(s)
        return F.when(F.startswith(t, F.lit(">")), "q").when(t.rlike(r"^On .+(wrote|sent):$|(?i:^-+\s*Original Message\s*-+)"), "X").when(t.rlike(r"^From:[ \t]"), "F").otherwise(".")

    marked = F.filter(F.transform(F.split(text, "\r?\n"), lambda s: F.struct(s.alias("s"), kind(s).alias("k"))), lambda x: x["k"] != "q")
    kinds = lambda xs: F.array_join(F.transform(xs, lambda x: x["k"]), "")
    before = lambda k: F.least(F.length(F.regexp_extract(k, "^[^X]*", 0)), F.length(F.regexp_extract(k, "^.{0,3}[^F]*", 0)))
    return stripped(bound(marked, lambda xs: F.array_join(F.transform(F.slice(xs, F.lit(1), before(kinds(xs))), lambda x: x["s"]), "\n")))


def is_bulk(subject: Column, body: Column) -> Column:
    """Whether a message looks like bulk or automated mail."""
    return F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))).rlike("|".join(BULK))


def is_signature_noise(sentence: Column) -> Column:
    """Whether a sentence is contact data or mostly words of a signature."""
    low = F.lower(sentence)
    own = lambda ws: F.filter(ws, lambda w: w.rlike("^[a-z]{2,}$"))
    # words of a signature are plain words; most sentences have none and need no pattern for each word
    noise = bound(fields(low), lambda ws: bound(F.size(F.filter(ws, lambda w: w.isin(*SIGNATURE_WORDS))), lambda k: F.when(k > 0, k > F.size(own(ws)) * F.lit(0.4)).otherwise(F.lit(False))))
    number = sentence.rlike("[0-9]{3}") & sentence.rlike(r"\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}")
    address = sentence.contains("@") & sentence.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+")
    return number | address | low.contains("http://") | low.contains("https://") | low.contains("mailto:") | noise


def unformatted(text: Column) -> Column:
    """Typographic characters in plain form."""
    t = F.translate(text, "\u2013\u201c\u201d\u2018\u2019\u00a0\u2022", "-\"\"'' -")
    return F.replace(F.replace(t, F.lit("\u2014"), F.lit("--")), F.lit("\u2026"), F.lit("..."))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower)


def first_words(parts: Column, n: int) -> Column:
    return F.array_join(F.slice(parts, 1, n), " ")


def last_words(parts: Column, n: int) -> Column:
    return F.array_join(last(parts, n), " ")


def opening_phrase(text: Column, n: int = 4) -> Column:
    """First n words of the first line that isn't blank; empty without any."""
    return F.coalesce(first_words(words(F.get(lines(text), F.lit(0))), n), F.lit(""))


def closing_phrase(text: Column, n: int = 3) -> Column:
    """Last n words of the last line that isn't blank."""
    return F.coalesce(last_words(words(F.get(last(lines(text), 1), F.lit(0))), n), F.lit(""))


def recipients(field: Column) -> Column:
    """Addresses of a comma-separated field in lower case; names before <address> go."""
    one = lambda x: F.lower(F.trim(F.when(x.rlike("<[^>]+>"), F.regexp_extract(x, "<([^>]+)>", 1)).otherwise(x)))
    return F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ","), one), lambda x: x != "")


def folded(text: Column) -> Column:
    """Lower case, straight apostrophes, and one letter for every other character beyond ASCII, so that word edges are the same everywhere."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("\u2019"), F.lit("'")), r"[^\x00-\x7f]", "x")


def contractions(text: Column) -> Column:
    return matches(folded(text), CONTRACTION)


def expansions(text: Column) -> Column:
    return matches(folded(text), EXPANDED)


def quick_grade(text: Column) -> Column:
    """Grade of one message by its words, sentences and vowel groups, 0 at least; null under ten words."""
    ws, k = fields(text), F.size(marks(text))
    syllables = lambda a: F.aggregate(F.transform(a, lambda w: F.greatest(F.size(F.regexp_extract_all(w, F.lit("(?i)[aeiouy]+"), F.lit(0))), F.lit(1)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    grade = bound(ws, lambda a: F.when((F.size(a) >= 10) & (k > 0), F.lit(0.39) * F.size(a) / k + F.lit(11.8) * syllables(a) / F.size(a) - F.lit(15.59)))
    return bound(grade, lambda g: F.when(g.isNotNull(), F.greatest(g, F.lit(0.0))))


def quick_formality(text: Column) -> Column:
    """0 to 10 for one message, by contractions, opening and exclamations."""
    n = F.greatest(F.size(fields(text)), F.lit(1)).cast("double")
    rate, low = contractions(text) / n, F.lower(text)
    by_rate = bound(rate, lambda r: F.when(r > 0.03, -1.5).when(r < 0.005, 1.0).otherwise(0.0))
    opening = F.when(low.rlike(r"^dear[ \t\r\n]"), 1.5).when(low.rlike(r"^(hey|yo|sup)([^a-z0-9_]|$)"), -1.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.lit(5.0) + by_rate + opening + F.when(matches(text, "!") > n * 0.01, -0.5).otherwise(0.0)))


def contraction_ratio(text: Column, none: float = 0.5) -> Column:
    return bound(F.array(contractions(text), expansions(text)), lambda a: F.coalesce(F.try_divide(a[0].cast("double"), (a[0] + a[1]).cast("double")), F.lit(none)))


def message_greeting(text: Column) -> Column:
    """First line if it has at most eight words and greets; null else."""
    first = F.get(lines(text), F.lit(0))
    return bound(first, lambda s: F.when((F.size(fields(s)) <= 8) & F.lower(s).rlike("^(" + "|".join(MESSAGE_GREETINGS) + ")"), F.regexp_replace(s, "[,!. ]+$", "")))


def message_closing(text: Column) -> Column:
    """The first of the last three lines that closes, of two lines or more; null without any."""
    closing = lambda ls: F.get(F.filter(last(ls, 3), lambda s: F.lower(s).rlike("^(" + "|".join(MESSAGE_CLOSINGS) + ")")), F.lit(0))
    return bound(lines(text), lambda ls: F.when(F.size(ls) >= 2, F.regexp_replace(closing(ls), "[,!. ]+$", "")))


def perspective(text: Column) -> Column:
    """self_focused, team_focused or audience_focused by pronouns; the first of equals, so also without any."""
    count = lambda t, ws: matches(t, rf"\b(?:{ws})\b")
    three = bound(folded(text), lambda t: F.array(count(t, "i|me|my|mine"), count(t, "we|us|our|ours"), count(t, "you|your|yours")))
    return bound(three, lambda a: F.when((a[0] >= a[1]) & (a[0] >= a[2]), "self_focused").when(a[1] >= a[2], "team_focused").otherwise("audience_focused"))


def parsed_time(value: Column) -> Column:
    """Time of an ISO string (Z allowed) or of a mail header's date, in UTC; null if neither."""
    mail = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*|\s*\([^)]*\)$", ""), F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(F.try_to_timestamp(F.trim(value)), mail)


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _entities(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_spaced(html: Column) -> Column:
    """Scripts and styles dropped, tags as blanks; only where there is markup. Line ends become one kind, at most two in a row, blanks single."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", ""), r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        t = F.regexp_replace(t, f"(?i)&{a};", b)
    t = F.when(F.lower(html).rlike("<html|<div|<p>"), F.regexp_replace(t, "&#[0-9]+;", "")).otherwise(html)
    return stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def html_lined(html: Column) -> Column:
    """Breaks and paragraph ends as line ends, other tags dropped."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", ""), r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n")
    t = _entities(F.regexp_replace(t, r"(?s)<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
