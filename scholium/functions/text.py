"""Text expressions: translations, titles, years, ids, licences, creators.

All are column expressions that stay in the JVM. Patterns use (?U) so that white space
and word characters are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_LICENSES = ("CC-BY", "CC-BY-SA")
_OPENING, _CLOSING = "`‘“", "'’”"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def squeeze(c: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_translation(c: Column) -> Column:
    """A translation without its quotes and empty brackets and with a proper ellipsis."""
    out = squeeze(c)
    out = F.regexp_replace(out, f"^[{_OPENING}]", "")
    out = F.regexp_replace(out, rf"[{_CLOSING}]\z", "")
    out = F.regexp_replace(out, rf"[{_CLOSING}]\.\z", ".")
    out = F.replace(out, F.lit("()"), F.lit(""))
    return F.replace(out, F.lit("..."), F.lit("…"))


def translation_parts(translation: Column, comment: Column) -> Column:
    """struct(translation, comment, corpus_ref) of a translation that may end in one [remark].

    Several words are a comment, one word refers to a corpus; an ellipsis is neither.
    """
    text = clean_translation(translation)
    opens = F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))
    inside = strip(F.regexp_extract(text, r"(?s)\[([^\[]*)\]\z", 1))
    split = text.endswith("]") & (opens == 1)
    used = split & (inside != "…")
    is_comment = used & (F.size(F.split(inside, r"(?U)\s+")) > 1)
    rest = clean_translation(F.regexp_replace(text, r"(?s)\[[^\[]*\]\z", ""))
    return F.struct(
        F.when(used, rest).otherwise(text).alias("translation"),
        F.when(is_comment, F.concat_ws("; ", F.when(comment != "", comment), inside)).otherwise(comment).alias("comment"),
        F.when(used & ~is_comment, inside).alias("corpus_ref"),
    )


def strip_capitalization(c: Column) -> Column:
    """{X} as X for a single word character."""
    return F.regexp_replace(c, r"(?U)\{(\w)\}", "$1")


def norm_title(c: Column) -> Column:
    return strip_capitalization(F.lower(c))


def year(c: Column) -> Column:
    """The first four digits in a row; '' if there are none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), "([0-9]{4})", 1)


def ascii_slug(c: Column) -> Column:
    """Lower-case letters and digits of a text that is ASCII already; see bib.slug for any text."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def example_id(primary_text: Column) -> Column:
    """Ten hexadecimal digits that stay the same if only full stops change."""
    return F.substring(F.sha2(F.replace(primary_text, F.lit("."), F.lit("")), 256), 1, 10)


def leading_number(c: Column) -> Column:
    """The number a local id starts with, or NULL."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "^([0-9]+)", 1), F.lit("")).cast("int")


def capitalized(c: Column) -> Column:
    return F.initcap(squeeze(c))


def has_open_license(c: Column) -> Column:
    """Whether the licence's first word is one of the open ones; NULL is not."""
    return F.coalesce(F.get(F.split(strip(c), r"(?U)\s+"), F.lit(0)).isin(*OPEN_LICENSES), F.lit(False))


def is_current(superseded: Column) -> Column:
    return ~F.coalesce(superseded == "True", F.lit(False))


def creators_as_names(c: Column) -> Column:
    """'First Last, First Last & First Last' pairs given as 'Last, First, ...' joined by ' and ' for BibTeX.

    Parts alternate between surname and given names; an odd number gives NULL.
    """
    parts = F.transform(F.split(F.replace(F.replace(c, F.lit(" & "), F.lit(",")), F.lit("᠎"), F.lit("")), ","), strip)
    parts = F.filter(parts, lambda x: x != "")
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0)), F.lit(2)),
        lambda i: F.concat(F.get(parts, i), F.lit(", "), F.get(parts, i + 1)),
    )
    return F.when((F.size(parts) % 2 == 0) & (F.size(parts) > 0), F.array_join(pairs, " and "))


def unbalanced_removed(c: Column) -> Column:
    """Without round or curly brackets if there are more of one side than of the other."""
    for a, b in ("()", "{}"):
        n = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))  # noqa: E731, B023
        c = F.when(n(a) == n(b), c).otherwise(F.translate(c, a + b, ""))
    return c


def links(html: Column) -> Column:
    """The targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)


def strip_tex_comment(c: Column) -> Column:
    """A line up to its first unescaped %, with escaped ones as plain; a line break before % stays."""
    return F.when(
        c.contains("\\\\%"), F.concat(F.substring_index(c, "\\\\%", 1), F.lit("\\\\"))
    ).otherwise(F.replace(F.regexp_replace(c, r"(?s)(?<!\\)%.*\z", ""), F.lit("\\%"), F.lit("%")))
