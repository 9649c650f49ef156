"""Risk expressions: payload score, sensitive data, composition of scores into a verdict."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicons import CONFIDENCE, FALSE_POSITIVE, PAYLOAD, SENSITIVE, SOFT, SOFT_AMPLIFIER


def alternatives(pattern: str) -> list[str]:
    """Parts of a pattern between bars outside groups."""
    out, depth = [""], 0
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        out = [*out, ""] if ch == "|" and not depth else [*out[:-1], out[-1] + ch]
    return out


def either(patterns: list[str]) -> str:
    """One pattern for any of patterns. Where all begin at a word's edge, the edge is looked for once, not once for each of them."""
    parts = [a for p in patterns for a in alternatives(p)]
    return "(?i)" + (r"\b(?:" + "|".join(a[2:] for a in parts) if all(a.startswith(r"\b") for a in parts) else "(?:" + "|".join(parts)) + ")"


ANY = {c: either([p for _, p in ps]) for c, ps in PAYLOAD.items()}
ANY_AT_ALL = either([p for ps in PAYLOAD.values() for _, p in ps])


def payload_hits(text: Column) -> Column:
    """array<struct<category,weight,match>>: the first match of every pattern, cut to 80 characters.

    One pass over the text finds whether any pattern matches, one a category which; patterns run where theirs does.
    """
    none = F.array().cast("array<struct<category:string,weight:double,match:string>>")
    hit = lambda c, w, p: F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(c).alias("category"), F.lit(w).alias("weight"), F.substring(F.regexp_extract(text, f"(?i){p}", 0), 1, 80).alias("match")))
    made = [F.when(text.rlike(ANY[c]), F.filter(F.array(*[hit(c, w, p) for w, p in ps]), lambda x: x.isNotNull())).otherwise(none) for c, ps in PAYLOAD.items()]
    return F.when(text.rlike(ANY_AT_ALL), F.concat(*made)).when(text.isNotNull(), none)


def category_weight(hits: Column, category: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(hits, lambda h: h["category"] == category), lambda h: h["weight"])), F.lit(0.0))


def payload_score(hits: Column) -> Column:
    """Noisy or of the two largest hard weights, lifted by soft categories; soft ones alone stay small."""
    hard = F.sort_array(F.array(*[category_weight(hits, c) for c in PAYLOAD if c not in SOFT]), False)
    base = 1 - (1 - F.get(hard, F.lit(0))) * (1 - F.get(hard, F.lit(1)))
    soft = F.least(functools.reduce(lambda a, b: a + b, [F.when(category_weight(hits, c) > 0, 1).otherwise(0) for c in SOFT]), F.lit(2))
    return F.least(F.when(base > 0, base + SOFT_AMPLIFIER * soft * (1 - base)).otherwise(0.1 * soft), F.lit(1.0)).cast("double")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def aba(value: Column) -> Column:
    """Nine digits whose sum by weights 3, 7, 1 is a multiple of 10."""
    d = F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))
    total = F.aggregate(F.zip_with(d, F.array(*[F.lit(w) for w in (3, 7, 1) * 3]), lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0), lambda s, x: s + x)
    return (F.size(d) == 9) & (total % 10 == 0)


def plain(value: Column) -> Column:
    return F.regexp_replace(value, r"[\s\-]", "")


REDACT = {
    "credit_card": lambda m: F.concat(F.repeat(F.lit("*"), F.length(plain(m)) - 4), F.right(plain(m), F.lit(4))),
    "ssn": lambda m: F.concat(F.lit("***-**-"), F.right(m, F.lit(4))),
    "routing_number": lambda m: F.concat(F.lit("****"), F.right(m, F.lit(4))),
    "iban": lambda m: F.concat(F.left(m, F.lit(4)), F.lit("****"), F.right(m, F.lit(4))),
    "api_key_aws": lambda m: F.concat(F.left(m, F.lit(8)), F.lit("****"), F.right(m, F.lit(4))),
    "api_key_stripe": lambda m: F.concat(F.left(m, F.lit(12)), F.lit("****")),
    "api_key_github": lambda m: F.concat(F.left(m, F.lit(8)), F.lit("****")),
    "api_key_generic": lambda m: F.concat(F.left(m, F.lit(8)), F.lit("****")),
    "private_key": lambda m: F.lit("-----BEGIN PRIVATE KEY----- [REDACTED]"),
    "us_passport": lambda m: F.concat(F.left(m, F.lit(1)), F.lit("****"), F.right(m, F.lit(3))),
    "medical_record": lambda m: F.when(F.length(m) > 3, F.concat(F.lit("MRN:****"), F.right(m, F.lit(3)))).otherwise(F.lit("****")),
}
VALID = {"credit_card": luhn, "routing_number": aba, "iban": lambda m: F.length(F.regexp_replace(m, r"\s", "")) >= 15}


def sensitive_values(text: Column, name: str, pattern: str, group: int) -> Column:
    """Values that pass the validator and stand in no voiding context, in order."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    ok = VALID.get(name, lambda m: F.lit(True))
    if name not in FALSE_POSITIVE:
        return F.filter(value, ok)
    gaps = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        start = s["at"] + F.length(r["gap"])
        low = F.greatest(start - 50, F.lit(0))
        near = F.lower(F.substring(text, low + 1, start + 50 - low))
        keep = ok(r["value"]) & ~near.rlike(FALSE_POSITIVE[name])
        return F.struct((start + F.length(r["whole"])).alias("at"), F.when(keep, F.concat(s["out"], F.array(r["value"]))).otherwise(s["out"]).alias("out"))

    rows = F.filter(F.zip_with(F.arrays_zip(whole.alias("whole"), value.alias("value")), gaps, lambda m, g: F.struct(g.alias("gap"), m["whole"].alias("whole"), m["value"].alias("value"))), lambda r: r["whole"].isNotNull())
    return F.aggregate(rows, state, step, lambda s: s["out"])


def sensitive_matches(text: Column, min_confidence: str = "medium") -> Column:
    """array<struct<pattern_type,rank,match_count,redacted,tags>> of the patterns that reach min_confidence."""
    made = []
    for name, pattern, group, base, context, tags in SENSITIVE:
        v = sensitive_values(text, name, pattern, group)
        n = F.size(v)
        rank = F.lit(base) if not context or base > 2 else F.when(text.rlike(context), base + 1).otherwise(base)
        rank = F.when(n >= 3, F.lit(3)).otherwise(rank)
        made.append(F.when(text.rlike(pattern) & (n > 0) & (rank >= CONFIDENCE.index(min_confidence)), F.struct(F.lit(name).alias("pattern_type"), rank.cast("int").alias("rank"), n.cast("long").alias("match_count"), REDACT[name](F.get(v, F.lit(0))).alias("redacted"), F.array(*[F.lit(t) for t in tags]).alias("tags"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def sensitive_summary(found: Column) -> Column:
    """struct<has_sensitive_data,total_matches,highest_confidence,compliance_tags,recommended_action>"""
    total = F.aggregate(found, F.lit(0).cast("long"), lambda s, m: s + m["match_count"])
    rank = F.coalesce(F.array_max(F.transform(found, lambda m: m["rank"])), F.lit(0))
    action = F.when(F.size(found) == 0, "none").when((rank == 3) | (total >= 5), "hold").when((rank == 2) | (total >= 2), "warn").otherwise("log")
    tags = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda m: m["tags"]))))
    return F.struct((F.size(found) > 0).alias("has_sensitive_data"), total.alias("total_matches"), F.get(F.array(*[F.lit(c) for c in CONFIDENCE]), rank).alias("highest_confidence"), tags.alias("compliance_tags"), action.alias("recommended_action"))


def scan_sensitive(rows: DataFrame, text: str = "body", subject: str | None = "subject", min_confidence: str = "medium") -> DataFrame:
    """rows with matches (by pattern) and scan, the summary of them: sensitive data in subject and text. Null texts count as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ((subject, text) if subject else (text,))]
    # explode of one element holds what is computed above it: no later expression repeats it
    found = rows.select("*", F.explode(F.array(sensitive_matches(F.concat_ws("\n", *parts), min_confidence))).alias("matches"))
    return found.select("*", F.explode(F.array(sensitive_summary(F.col("matches")))).alias("scan"))


def normalised_style(s: Column) -> Column:
    """Piecewise linear through (0, 0), (.002, .2), (.007, .5), (.02, .9), (.3, 1)."""
    points = [(0.0, 0.0), (0.002, 0.2), (0.007, 0.5), (0.02, 0.9), (0.3, 1.0)]
    out = F.when(s <= 0, F.lit(0.0))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(s < x1, y0 + (s - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(1.0))


def compose(style: Column, context: Column, payload: Column) -> Column:
    """struct<verdict,composite,reason>; the first rule that holds decides."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    s, x, d, c = style, clip(context), clip(payload), normalised_style(style)
    out = lambda verdict, value, reason: F.struct(F.lit(verdict).alias("verdict"), clip(value).alias("composite"), F.lit(reason).alias("reason"))
    return (
        F.when(s >= 0.02, out("block", F.greatest(c, F.lit(0.9)), "style_high"))
        .when((s >= 0.007) & (d >= 0.5), out("block", F.greatest(c, d, F.lit(0.9)), "style_mid+dlp_hit"))
        .when(d >= 0.5, out("block", F.greatest(d, F.lit(0.85)), "dlp_hit"))
        .when((s >= 0.007) & (x >= 0.7), out("flag", 0.5 * c + 0.5 * x, "style_mid+context_high"))
        .when(x >= 0.7, out("flag", 0.35 * c + 0.65 * x, "context_high"))
        .when((s >= 0.002) & (x >= 0.5), out("pass", 0.5 * c + 0.5 * x, "grey_zone"))
        .otherwise(out("pass", 0.6 * c + 0.3 * x + 0.1 * d, "clean"))
    )
