"""Sentences by a list of abbreviations that the corpus itself teaches.

A word that nearly always has a period after it is an abbreviation, the more so the shorter it is and the more periods it holds. How far
its counts speak for that is a likelihood ratio: of the word having a period as often as words have in general, or nearly always. A period after
an abbreviation ends no sentence unless a capital letter begins the next word and that word is one that
begins sentences more often than it stands within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURE = 0.99  # share of periods after an abbreviation
SCORE = 0.3  # of a word that counts as one
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'&-]*(?:\.[\p{L}\p{N}]+)*"


def period_counts(texts: DataFrame, text: str = "body") -> DataFrame:
    """word (in lower case), with_period, without: of all words of the texts."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"{WORD}\.?"), F.lit(0))
    words = texts.select(F.explode(found).alias("w"))
    dotted = F.col("w").endswith(".")
    return words.select(F.lower(F.rtrim(F.col("w"), F.lit("."))).alias("word"), dotted.cast("long").alias("d")).groupBy("word").agg(F.sum("d").alias("with_period"), F.sum(1 - F.col("d")).alias("without"))


def abbreviations(counts: DataFrame, score: float = SCORE, least: int = 3) -> DataFrame:
    """word, n, score of the words of period_counts that are abbreviations: logarithms of the ratio, lowered for long words and for those often without a period, raised for inner periods."""
    total = counts.agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("without")).alias("words"))
    j = counts.where((F.col("with_period") >= least) & ~F.col("word").rlike(r"^[\p{N}.]+$")).crossJoin(F.broadcast(total))
    p = F.col("periods") / F.col("words")
    k, n = F.col("with_period").cast("double"), (F.col("with_period") + F.col("without")).cast("double")
    likely = lambda q: k * F.log(q) + (n - k) * F.log(1 - q)
    ratio = 2 * (likely(F.lit(SURE)) - likely(p))
    inner = F.length(F.regexp_replace("word", "[^.]", "")) + 1
    letters = F.length(F.regexp_replace("word", "[.]", "")).cast("double")
    value = ratio * F.exp(-letters) * inner * F.pow(letters, -(n - k))
    return j.select("word", F.col("with_period").alias("n"), F.round(value, 6).alias("score")).where(F.col("score") >= score)


def starters(texts: DataFrame, text: str = "body", least: int = 3) -> DataFrame:
    """word: those that begin sentences after ! or ? at least `least` times, and more often than they stand within one."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = lambda pattern, group: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), F.lower)
    first, within = found(r"[!?]\s+(\p{L}+)", 1), found(r"(?<=[\p{L}\p{N},;:]\s)\p{L}+", 0)
    one = lambda c, v: texts.select(F.explode(c).alias("word"), F.lit(v).cast("long").alias("first"))
    g = one(first, 1).unionByName(one(within, 0)).groupBy("word").agg(F.sum("first").alias("first"), F.sum(1 - F.col("first")).alias("within"))
    return g.where((F.col("first") >= least) & (F.col("first") > F.col("within"))).select("word")


def split_sentences(text: Column, known: list[str], begin: list[str]) -> Column:
    """Sentences of a text: it is cut behind . ! or ? and closing marks where a blank follows, but not behind one of known abbreviations
    or a single letter, unless one of begin follows with a capital letter. Blank lines cut as well."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?][\"')\]]{0,3})\s+(?=\S)|\n\s*\n")
    known_list, begins = F.array(*[F.lit(w) for w in known]).cast("array<string>"), F.array(*[F.lit(w) for w in begin]).cast("array<string>")

    def open_end(part: Column) -> Column:
        word = F.lower(F.regexp_extract(part, r"([\p{L}\p{N}'&.-]+)\.[\"')\]]*$", 1))
        return (F.array_contains(known_list, word)) | word.rlike(r"^\p{L}$")

    def joined(acc: Column, part: Column) -> Column:
        last = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))
        first = F.regexp_extract(part, r"^[\"'(\[]*(\p{L}+)", 1)
        starts = first.rlike(r"^\p{Lu}") & F.array_contains(begins, F.lower(first))
        more = (F.size(acc) > 0) & open_end(last) & ~starts
        return F.when(more, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), part)))).otherwise(F.concat(acc, F.array(part)))

    done = F.aggregate(F.filter(parts, lambda x: F.trim(x) != ""), F.array().cast("array<string>"), joined)
    return F.transform(done, F.trim)
