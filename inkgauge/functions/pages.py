"""Text of HTML pages by expressions: what isn't shown goes, blocks end lines, character references become characters."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Raw elements, whose content isn't markup, and the head; one that isn't closed reaches to the end.
HIDDEN = [rf"(?is)<{tag}(?:[\s/][^>]*)?>.*?(?:</{tag}[^>]*>|\z)" for tag in ("script", "style", "head")]
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
WITHIN = r"""(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?"""  # attributes; a quoted value may hold the mark that ends a tag
BLOCK = rf"(?i)<(?:/?(?:p|div|tr|li)|br){WITHIN}>"
TAG = r"""(?i)<[a-z/!?](?:[^>"']|"[^"]*"|'[^']*')*>"""
REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
NAMES = {name: chr(code) for name, code in name2codepoint.items()}
UNKNOWN = "�"


def decoded(text: Column) -> Column:
    """Character references as characters: names of HTML 4, decimal and hexadecimal numbers; others stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in sorted(NAMES.items()) for x in pair])

    def one(ref: Column) -> Column:
        number = F.when(F.lower(ref).startswith("#x"), F.conv(F.substring(ref, 3, 8), 16, 10)).when(ref.startswith("#"), F.substring(ref, 2, 8)).cast("int")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(ref.startswith("#"), F.when(valid, letter).otherwise(UNKNOWN)).otherwise(F.coalesce(F.try_element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";"))))

    between = F.split(text, REFERENCE, -1)
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), one), F.array(F.lit("")))
    return F.when(text.contains("&"), F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def page_text(html: Column) -> Column:
    """Text of a page: no comments, scripts, styles and heads; line ends at paragraphs, divisions, rows, items and breaks, two in a row at
    most; blanks single; null stays null."""
    t = F.regexp_replace(html, COMMENT, "")
    for pattern in HIDDEN:
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(F.regexp_replace(t, BLOCK, "\n"), TAG, "")
    return bound(t, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded(x), r"\n{3,}", "\n\n"), r"[ \t]+", " "), r"^\s+|\s+\z", ""))
