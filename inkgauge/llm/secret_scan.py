"""Secrets by pattern, weighed by who owns them across the corpus; DataFrame functions only.

Candidates are found in each whole text. Each candidate's value is hashed, and the corpus counts in how many distinct
owners and repositories that hash occurs. A value that many owners carry is an example copied around; one that few
hold and that looks random is reported as live.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, own_name, scope, text_or_empty, written

#: Fixed patterns: kind, pattern, group that holds the value, least characters of that group. The first three are the
#: base kinds; the others are the spans that this method adds.
KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40),
    ("payment", r"([sr]k_(?:live|test)_[A-Za-z0-9]{16,})", 1, 24),
    # From the header to the END line, or without one over header fields and what can be base64 (escaped line ends too).
    ("private", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-[^-]++){0,20}+-----END [A-Z ]*PRIVATE KEY-----|(?:[\r\n]+[A-Za-z0-9-]+: [^\r\n]*+){0,20}+[A-Za-z0-9+/=\r\n\\]*+))", 1, 1),
]
BASE = 3
TOGETHER = 256  # matches placed at a time
#: Alphabets that a value may be drawn from, the smallest first, and the sizes of them; any other value counts as of 64.
ALPHABETS = [("^[0-9]*$", 10), ("^[0-9a-f]*$|^[0-9A-F]*$", 16), ("^[a-z]*$|^[A-Z]*$", 26), ("^[a-z0-9]*$|^[A-Z0-9]*$", 36), ("^[A-Za-z0-9]*$", 62)]
LONGEST = 64  # characters; what longer random values reach is above any limit here


def found(text: Column, rank: int) -> Column:
    """array<struct<start,kind,end,value>> of one kind, leftmost and non-overlapping; offsets in code points.

    Splitting by the pattern gives the text between matches, extracting gives the matches; their lengths add up to
    the offsets. A hexadecimal run is maximal from its first character, so that its least length stands in the pattern.
    """
    _, pattern, group, least = KINDS[rank]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.zip_with(F.arrays_zip(whole.alias("whole"), value.alias("value")), F.split(text, pattern, -1), lambda m, gap: F.struct(F.length(gap).alias("gap"), m["whole"].alias("whole"), m["value"].alias("value")))
    rows = F.filter(rows, lambda r: r["whole"].isNotNull())
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def placed(part: Column) -> Column:
        """at (length in all), out: spans of some matches, counted from the first one's gap."""
        return F.aggregate(
            part,
            start,
            lambda s, r: F.struct(
                (s["at"] + r["gap"] + F.length(r["whole"])).alias("at"),
                F.concat(s["out"], F.array(F.struct((s["at"] + r["gap"]).alias("start"), F.lit(rank).alias("kind"), (s["at"] + r["gap"] + F.length(r["whole"])).alias("end"), r["value"].alias("value")))).alias("out"),
            ),
        )

    def shifted(parts: Column) -> Column:
        begins = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        move = lambda p, at: F.transform(p["out"], lambda x: F.struct((x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["end"] + at).alias("end"), x["value"].alias("value")))
        return F.flatten(F.zip_with(parts, begins, move))

    # An array grows by copying, so matches are placed some at a time.
    some = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / TOGETHER).cast("int")), lambda i: placed(F.slice(all_, i * TOGETHER + 1, TOGETHER)))
    done = F.get(F.transform(F.array(rows), lambda all_: F.when(F.size(all_) > 0, F.get(F.transform(F.array(some(all_)), shifted), F.lit(0))).otherwise(none)), F.lit(0))
    return F.when(text.rlike(pattern), F.filter(done, lambda s: F.length(s["value"]) >= least)).otherwise(none)


def rendered(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def bits_a_character(value: Column) -> Column:
    """Shannon entropy of the characters of a string."""
    letters = F.split(value, "")
    n = F.length(value).cast("double")
    return F.aggregate(F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n), F.lit(0.0), lambda s, p: s - p * F.log2(p))


@functools.cache
def reached(size: int) -> list[float]:
    """Bits a character that nearly all random values of 0, 1, ... LONGEST characters from an alphabet reach: mean less three standard deviations."""
    out = [0.0]
    for n in range(1, LONGEST + 1):
        part = [-k / n * math.log2(k / n) if k else 0.0 for k in range(n + 1)]
        one = [math.comb(n, k) * (size - 1) ** (n - k) / size**n for k in range(n + 1)]
        mean = sum(p * f for p, f in zip(one, part, strict=True))
        square = sum(p * f * f for p, f in zip(one, part, strict=True))
        both = sum(math.comb(n, i) * math.comb(n - i, j) * (size - 2) ** (n - i - j) / size**n * part[i] * part[j] for i in range(1, n + 1) for j in range(1, n - i + 1))
        out.append(size * mean - 3 * math.sqrt(max(size * square + size * (size - 1) * both - (size * mean) ** 2, 0.0)))
    return out


def least_bits(value: Column, most: float) -> Column:
    """The limit of bits_a_character for a value: most, or less where random values of its length and alphabet don't reach that."""
    at = F.least(F.length(value), F.lit(LONGEST))
    limit = lambda size: F.get(F.array(*[F.lit(min(most, x)) for x in reached(size)]), at)
    out = limit(64)
    for pattern, size in reversed(ALPHABETS):
        out = F.when(value.rlike(pattern), limit(size)).otherwise(out)
    return out


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """A row for each document: __row, id_col, owner, repository, spans ordered by start and kind."""
    text = F.col("__text")
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repo_cols])
    src = docs.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(text_col).alias("__text"), F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("__owner"), repo.alias("__repo"))
    spans = functools.reduce(F.concat, [found(text, k) for k in range(len(KINDS))])
    return src.select(F.monotonically_increasing_id().alias("__row"), id_col, "__owner", "__repo", F.array_sort(spans).alias("__spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """__hash, owners, repositories: distinct holders of each value. Distinct triples are combined before the shuffle, so a copied value costs a row for each holder, not for each copy."""
    held = spans.select("__hash", "__owner", "__repo").distinct()
    by_owner = held.groupBy("__hash", "__owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("__hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied_owners: int = 3, live_bits: float = 3.0) -> DataFrame:
    """A row for each document: id_col, spans (array of kind, start, end, hash, owners, repositories, live).

    A value is live if fewer than copied_owners owners hold it and its characters hold at least live_bits bits each, or
    what random values of its length and alphabet reach if that is less; else it is a copied example or a placeholder. Null texts have no spans; null owners and repositories count as the
    empty one; ids may be null or repeat, each row stands alone; other columns are ignored; an empty table gives no
    rows. The value itself is hashed at once and never returned.
    """
    with scope(docs.sparkSession):
        return lasting(_scan_secrets(docs, id_col, text_col, owner_col, repo_cols, copied_owners, live_bits))


def _scan_secrets(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...], copied_owners: int, live_bits: float) -> DataFrame:
    rows = written(candidates(docs, id_col, text_col, owner_col, repo_cols).withColumn("__spans", F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), (bits_a_character(s["value"]) >= least_bits(s["value"], live_bits)).alias("random")))))
    each = rows.where(F.size("__spans") > 0).select("*", F.explode("__spans").alias("s")).select("__row", id_col, "__owner", "__repo", F.col("s.hash").alias("__hash"), "s")
    # Copies of one value are many rows with one hash. The statistics are written, so that both sides of the join come by
    # an exchange and Spark splits the rows of a frequent hash.
    stats = written(ownership(each))
    weighed = each.join(stats, "__hash").select(
        "__row", id_col,
        F.struct("s.start", "s.kind", "s.end", F.col("__hash").alias("hash"), "owners", "repositories", ((F.col("owners") < copied_owners) & F.col("s.random")).alias("live")).alias("span"),
    )
    with_spans = weighed.groupBy("__row").agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list("span")).alias("spans")).select(id_col, "spans")
    without = rows.where(F.size("__spans") == 0).select(id_col, F.array().cast(with_spans.schema["spans"].dataType).alias("spans"))
    return with_spans.unionByName(without)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The counts and digests of scan_secrets: n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    live = F.size(F.filter(spans, lambda s: s["live"])).cast("long")
    return scan_secrets(docs, id_col, **options).select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(rendered(base), 256).alias("base_sha256"), rendered(spans).alias("spans"), live.alias("n_live"), (F.size(spans).cast("long") - live).alias("n_copied"),
    )


def islands(spans: DataFrame, row: str) -> DataFrame:
    """row, __islands: array<struct<start,end>> of each row's spans (start, end), overlapping ones joined, in order."""
    upto = Window.partitionBy(row).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("start") > F.coalesce(F.max("end").over(upto), F.lit(-1))
    one = spans.withColumn("__new", new).withColumn("__island", F.sum(F.col("__new").cast("int")).over(Window.partitionBy(row).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    joined = one.groupBy(row, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__islands"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with spans (in order, apart) overwritten by mark."""
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).cast("int")
    part = lambda a, b: F.substring(text, a + 1, b - a)
    kept = F.transform(spans, lambda x, i: part(before(i), x["start"].cast("int")))
    return F.array_join(F.concat(kept, F.array(part(F.element_at(spans, -1)["end"].cast("int"), F.length(text)))), mark)


def mask_live_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with the live spans of scan_secrets in text_col overwritten by mark; all rows and columns stay.

    Overlapping or adjoining spans become one mark. Only documents in which a pattern matches are written and numbered, and only
    their numbers go with the spans; a text is joined once, if it has something to mask. Null texts stay.
    """
    any_kind = F.coalesce(functools.reduce(lambda a, b: a | b, [F.col(f"`{text_col}`").cast("string").rlike(k[1]) for k in KINDS]), F.lit(False))
    with scope(docs.sparkSession):
        row, spot = own_name(docs, "__number"), own_name(docs, "__islands")
        hit = written(docs.where(any_kind).withColumn(row, F.monotonically_increasing_id()))
        live = scan_secrets(hit, row, text_col, **options).select(row, F.explode(F.filter("spans", lambda s: s["live"])).alias("s")).select(row, "s.start", "s.end")
        held = hit.join(written(islands(live, row)).withColumnRenamed("__islands", spot), row, "left")
        text = F.col(f"`{text_col}`").cast("string")
        clean = F.when(F.col(f"`{spot}`").isNull(), text).otherwise(masked(text, F.col(f"`{spot}`"), mark))
        changed = held.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
        return lasting(docs.where(~any_kind).unionByName(changed))
