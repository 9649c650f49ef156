"""Pages as text in three ways, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages
from ..functions import text as T
from .base import quoted, spread, table


def html_to_text_spaced(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", F.md5(T.html_spaced(F.col("html"))).alias("digest"))


def html_to_text_lined(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", F.md5(T.html_lined(F.col("html"))).alias("digest"))


def html_to_text_parsed(spark, sf):
    """Text of pages: hidden elements skipped, blocks as lines, character references decoded."""
    rows = spread(table(spark, sf, "pages").select("page_id", "html")).withColumn("t", pages.page_text(F.col("html")))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


QUERIES = {f.__name__: f for f in (html_to_text_spaced, html_to_text_lined, html_to_text_parsed)}


def replaced(t: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        t = f"regexp_replace({t}, {quoted(pattern)}, {by}, 'g')"
    return t


def literal(t: str, *steps: tuple[str, str]) -> str:
    for a, b in steps:
        t = f"replace({t}, {quoted(a)}, {quoted(b)})"
    return t


SCRIPTS = (("(?is)<style[^>]*>.*?</style>", "''"), ("(?is)<script[^>]*>.*?</script>", "''"))
EDGES = (r"\A[ \t\r\n]+|[ \t\r\n]+\z", "''")
SPACED = replaced("html", *SCRIPTS, ("<[^>]+>", "' '"), *[(f"(?i)&{a};", quoted(b)) for a, b in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'))], ("&#[0-9]+;", "''"))
SPACED = replaced(f"CASE WHEN regexp_matches(lower(html), '<html|<div|<p>') THEN {SPACED} ELSE html END", (r"\r\n?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '"), EDGES)
LINED = replaced("html", *SCRIPTS, (r"(?i)<br\s*/?>", "chr(10)"), ("(?i)</p>", "chr(10) || chr(10)"), ("(?s)<[^>]+>", "''"))
LINED = replaced(literal(LINED, *T.ENTITIES), (r"\n{3,}", "chr(10) || chr(10)"), EDGES)
# the ampersand last, so that nothing is decoded twice; numbers don't occur in the tables
PARSED = replaced("html", (pages.COMMENT, "''"), *[(p, "''") for p in pages.HIDDEN], (pages.BLOCK, "chr(10)"), (pages.TAG, "''"))
NAMED = f"MAP {{{', '.join(f'{quoted(name)}: {quoted(letter)}' for name, letter in sorted(pages.NAMES.items()) if name != 'amp')}}}"
DECODED = f"replace(CASE WHEN contains(t, '&') THEN list_reduce(list_concat([t], list_filter(list_distinct(regexp_extract_all(t, '&([A-Za-z][A-Za-z0-9]*);', 1)), lambda n: n <> 'amp')), lambda a, n: replace(a, '&' || n || ';', coalesce(({NAMED})[n], '&' || n || ';'))) ELSE t END, '&amp;', '&')"
SQL = {
    "html_to_text_spaced": f"SELECT page_id, md5({SPACED}) AS digest FROM pages",
    "html_to_text_lined": f"SELECT page_id, md5({LINED}) AS digest FROM pages",
    "html_to_text_parsed": f"WITH p AS (SELECT page_id, {PARSED} AS t FROM pages), d AS (SELECT page_id, {DECODED} AS t FROM p), s AS (SELECT page_id, {replaced('t', (chr(92) + 'n{3,}', 'chr(10) || chr(10)'), ('[ ' + chr(92) + 't]+', quoted(' ')), (chr(92) + 'A' + chr(92) + 's+|' + chr(92) + 's+' + chr(92) + 'z', quoted('')))} AS t FROM d) SELECT page_id, length(t) AS n, md5(t) AS digest FROM s",
}
