"""The whole profile of one corpus: every block of the writing profiles for any messages, as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import FUNCTION_WORDS
from ..operators import profiles as P
from ..shared import lasting, scope, written
from . import profile_queries as Q
from .base import messages

#: Blocks of one row, and blocks that are lists with a bound of their own; each is a query over messages.
SINGLE = {"vocabulary": Q.vocabulary_by_author, "sentences": Q.sentence_stats, "paragraphs": Q.paragraph_stats, "grammar": Q.grammar_signature, "punctuation": Q.punctuation_profile, "readability": Q.readability, "structure": Q.structure_share, "assertiveness": Q.assertiveness}
LISTS = {"words": Q.token_frequency, "signature_words": Q.document_frequency, "phrases": Q.phrase_records, "templates": Q.sentence_templates, "greetings": Q.greeting_patterns, "closings": Q.closing_patterns, "lexicon": Q.lexicon_usage, "starters": Q.sentence_starters, "function_words": Q.function_word_freq}

SHARES = ("greeting", "closing", "hook")  # of messages, as structure_means has them


def build_profile(rows: DataFrame, name: str = "all") -> DataFrame:
    """One row: author (name), counts, a struct or null for each of SINGLE and a sorted list of structs for each of LISTS.

    rows are messages (msg_id, author, recipients, subject, body, sent) of one writer, whatever their author column says. Lists hold what
    their query keeps, some hundred entries at most. No messages give a profile of empty blocks.
    """
    spark = rows.sparkSession
    mine = rows.withColumn("author", F.lit(name))
    with scope(spark):
        blocks = shared_blocks(mine)
        out = written(P.extraction_summary(mine).select(F.lit(name).alias("author"), F.struct("*").alias("corpus")))
        # each block is a job and a table of one row: blocks in one plan would all be broadcasts, which have a time limit each
        for block, query in (SINGLE | LISTS).items():
            df = blocks[block] if block in blocks else query(spark, mine)
            df = df.drop("author") if "author" in df.columns else df
            row = F.max(F.struct("*")) if block in SINGLE else F.sort_array(F.collect_list(F.struct("*")))
            out = out.crossJoin(written(df.agg(row.alias(block))))
        return lasting(out)


def shared_blocks(mine: DataFrame) -> dict[str, DataFrame]:
    """Blocks of one writer that follow from tables several of them share, so that texts are taken apart once for all; the results are the queries' own."""
    sums = [*Q.form_sums(), *[c.alias(f"mark_{k}") for k, c in zip(Q.MARK_PATTERNS, Q.mark_sums(*Q.MARK_PATTERNS.items()), strict=True)], *[c.alias(f"share_{k}") for k, c in zip(SHARES, Q.structure_means(), strict=True)]]
    size = lambda parts: F.sum(F.size(parts).cast("long"))
    counts = written(mine.groupBy("author").agg(F.count("*").alias("total"), size(T.fields(F.col("body"))).alias("fields"), size(T.marks(F.col("body"))).alias("S"), *sums))
    words = written(Q.word_counts(mine))
    groups, n, word = T.matches(F.col("word"), "[aeiouy]+"), F.col("n"), F.col("word")
    total = lambda c: F.sum(c * n)
    told = words.groupBy("author").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"), total(F.length("word")).alias("L"), total((groups >= 3).cast("long")).alias("C"), total(F.greatest(groups, F.lit(1))).alias("Y"), *[F.sum(F.when(word.isin(*p), n).otherwise(0)).alias(f"{k}_n") for k, p in Q.PRONOUNS.items()])
    told = written(counts.join(told, "author", "left").fillna(0, ["words", "distinct_words", "L", "C", "Y", *[f"{k}_n" for k in Q.PRONOUNS]]))
    fields = mine.select("author", F.explode(T.marks(F.col("body"))).alias("s")).select("author", T.fields(F.col("s")).alias("f"), T.fields(F.lower("s")).alias("w"))
    sentences = written(fields.select("author", F.size("f").cast("long").alias("n"), F.lower(F.get("f", F.lit(0))).alias("starter"), F.slice("w", 1, 5).alias("w")))
    usage = written(Q.lexicon_usage(mine.sparkSession, mine))
    mean = lambda c: F.round(F.col(c) / F.col("words"), 6)
    double = lambda c, name: F.col(c).cast("double").alias(name)
    return {
        "vocabulary": Q.levelled(told.where("words > 0").select("author", "words", "distinct_words", mean("L").alias("mean_length"), mean("C").alias("complex"))),
        "grammar": Q.grammar_of(told),
        "readability": Q.graded(told.select("author", double("words", "W"), *[double(c, c) for c in "SYCL"])),
        "punctuation": Q.punctuation_of(counts.select("author", F.col("fields").alias("words"), *[F.col(f"mark_{k}").alias(k) for k in Q.MARK_PATTERNS])),
        "structure": counts.select("author", *[F.col(f"share_{k}").alias(k) for k in SHARES]),
        "sentences": Q.lengths_of(sentences, counts.select("author", F.col("mark_question").alias("questions"), F.col("mark_exclamation").alias("exclamations"))),
        "templates": Q.templates_of(sentences),
        "starters": Q.starters_of(sentences),
        "lexicon": usage,
        "assertiveness": Q.asserted(usage),
        "words": words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(100),
        "signature_words": Q.signature_words(words.where(F.length("word") > 3).select("author", "word", "df"), counts.select("author", "total")),
        "function_words": Q.shares_of(words.where(word.isin(*FUNCTION_WORDS)).select("author", "word", "n"), told.select("author", F.col("words").alias("total"))),
    }


def whole_profile(spark, sf):
    """The profile of all messages: how much each block holds, and a digest of it."""
    p = build_profile(messages(spark, sf))
    return p.select("author", *[F.size(b).cast("long").alias(f"n_{b}") for b in LISTS], *[F.md5(F.to_json(F.col(b))).alias(b) for b in SINGLE])


QUERIES = {"whole_profile": whole_profile}
SQL: dict[str, str] = {}
