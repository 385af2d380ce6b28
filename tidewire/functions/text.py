"""Text and URL cleaning as JVM-side column expressions.

Every function takes and returns a Column, so a cleaning step fuses into the
scan stage and never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
NOT_AVAILABLE = "N/A"
TAG_PATTERN = "<[^>]+>"
# White space in any script: Java's Unicode class (it needs the (?U) flag)
# plus the four ASCII separators, and the same set as characters.
SPACE = r"[\s\x1c-\x1f]"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Hyphen, en dash, no-break space and newline all become a plain space.
DASHES_AND_BREAKS = r"\-–\xa0\n"
# Leading list markers; one of them is dropped.
BULLETS = "\u0095·•‣⁃⁌⁍∙○●◘◦☙❥❧⦾⦿\u3164*"
# ---------------------------------------------------------------------------


def strip_tags(text: Column) -> Column:
    """Delete anything that looks like an HTML tag."""
    return F.regexp_replace(text, TAG_PATTERN, "")


def strip_space(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_space(text: Column) -> Column:
    """Turn every run of white space into one space and trim the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def clean_full(text: Column) -> Column:
    """Lowercase, dashes, white space, leading bullet, quotes, non-ASCII, punctuation.

    The steps are fused into two pattern passes. Dashes, line breaks and
    repeated spaces are one run that becomes one space. The closing deletions
    cover non-ASCII and punctuation together; since they also delete every
    bullet and quote, all that is left of those steps is the space after a
    leading bullet and the &apos; entity. Doubled spaces that the deletions
    leave behind stay.
    """
    breaks = DASHES_AND_BREAKS
    run = f"[{breaks}][{breaks} ]*| [{breaks} ]+"
    trimmed = strip_space(F.regexp_replace(F.lower(text), run, " "))
    deleted = f"(?U)^[{BULLETS}]{SPACE}*|&apos;|" + r"[\p{P}[^\x00-\x7F]]"
    return F.regexp_replace(trimmed, deleted, "")


def clean_text_or_na(text: Column) -> Column:
    """``clean_full``, with null and empty input replaced by "N/A".

    Text that only becomes empty through cleaning stays empty.
    """
    return F.when(text.isNull() | (text == ""), F.lit(NOT_AVAILABLE)).otherwise(clean_full(text))


def clean_url_or_na(url: Column) -> Column:
    """Strip tags, collapse white space; null or nothing left gives "N/A"."""
    cleaned = collapse_space(strip_tags(url))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(NOT_AVAILABLE))


def mentions_all(words: str, *columns: Column) -> Column:
    """True where each word of ``words`` occurs as a whole word in any column.

    Case is ignored. A word ends where the next character is no letter, digit
    or underscore, in any script.
    """
    edge = r"[^\p{L}\p{N}_]"
    condition = F.lit(True)
    for word in words.split():
        pattern = f"(?iu)(^|{edge})\\Q{word}\\E({edge}|$)"
        found = F.lit(False)
        for column in columns:
            found = found | F.coalesce(column.rlike(pattern), F.lit(False))
        condition = condition & found
    return condition


def words(text: Column) -> Column:
    """Words separated by white space of any kind; an empty array for blank text."""
    return F.filter(F.split(text, f"(?U){SPACE}+"), lambda word: word != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is evaluated again for every element;
    binding it as a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
