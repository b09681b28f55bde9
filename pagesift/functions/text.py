"""Text functions: plain ``Column`` expressions, JVM-side.

"White space" is Unicode white space everywhere, as in the behaviour being
matched; Spark's own ``trim`` removes spaces only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.binding import let

# Words and symbols that mark a pager item.
PAGER_WORDS = [
    "next", "next page", "next results", "more results", "more", "prev", "previous", "last", "first",
    ">", "<", "»", "«",
]

#: Unicode white space, as in ``(?U)\\s``.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_PARKED = "￿"  # a noncharacter


def trim_ws(x: Column) -> Column:
    return F.trim(x, F.lit(WHITE_SPACE))


def is_blank(x: Column) -> Column:
    """Null, empty or only white space."""
    return ~F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))


def lower_chars(x: Column) -> Column:
    """Lower-case one character at a time: no final-sigma rule, and ``İ`` stays."""
    return F.translate(F.lower(F.translate(x, "Σİ", "σ" + _PARKED)), _PARKED, "İ")


def _capital(c: Column) -> Column:
    """Upper case of one character, where that is one character."""
    return F.when((F.length(F.upper(c)) == 1) & (c != "ı"), F.upper(c)).otherwise(c)


def clean_title(x: Column) -> Column:
    """Collapse white space; capitalise each word unless it already has a capital letter."""
    # Runs of white space are one space by now, so only single spaces are left to trim.
    words = F.split(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")), " ")
    # A word that is lower-cased here has no capital letter, so plain ``lower`` is per character.
    cased = F.transform(
        words,
        lambda w: F.when(w.rlike(r"\p{Lu}"), w).otherwise(
            F.concat(_capital(F.left(w, F.lit(1))), F.lower(w.substr(F.lit(2), F.length(w))))
        ),
    )
    return F.array_join(cased, " ")


def normalise_string(x: Column) -> Column:
    """The comparison and cache key form: lower-case, no punctuation, then ``clean_title``."""
    return clean_title(F.regexp_replace(lower_chars(F.coalesce(x, F.lit(""))), r"\p{P}", ""))


def is_int32(x: Column) -> Column:
    """The text is exactly a 32-bit integer, optionally signed."""
    return F.coalesce(x.rlike(r"^[+-]?[0-9]+$") & x.try_cast("int").isNotNull(), F.lit(False))


def has_any_word(x: Column, words: list[str]) -> Column:
    """True when the text contains one of the words, ignoring case (substring test)."""
    wanted = list(dict.fromkeys(w.lower() for w in words))
    pattern = "(?iu)" + "|".join(re.escape(w) for w in wanted)
    return F.coalesce(x.rlike(pattern), F.lit(False)) if wanted else F.lit(False)


def is_pager_text(text: Column) -> Column:
    """Short text that is a number or a pager word."""
    return let(trim_ws(text), lambda t: F.length(t).between(1, 25) & is_pager_label(t))


def is_pager_label(label: Column) -> Column:
    """``is_pager_text`` of a text that is trimmed and short; null is none."""
    return F.coalesce(is_int32(label) | F.lower(label).isin(PAGER_WORDS), F.lit(False))


def complexity(n_children: Column, text: Column) -> Column:
    """5 per child plus a fifth of the trimmed text length, which counts up to 500."""
    return complexity_of(n_children, F.length(trim_ws(text)))


def complexity_of(n_children: Column, trimmed_len: Column) -> Column:
    """``complexity`` from the length of the trimmed text."""
    return (n_children * 5 + F.floor(F.least(trimmed_len, F.lit(500)) / 5)).cast("int")


def css_escape(x: Column) -> Column:
    """Backslash before every character outside ``[a-zA-Z0-9_-]``."""
    return F.regexp_replace(x, r"([^a-zA-Z0-9_-])", r"\\$1")
