"""Column functions over text.  All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def combined_text(title: Column, place: Column) -> Column:
    """Title, a space and the place, with missing parts left empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(place, F.lit(""))))


def words(c: Column) -> Column:
    """Whitespace-separated words; no empty strings at the ends."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(words(c)))


def normalise_title(c: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one space.

    Norwegian letters are dropped on purpose: the vocabulary is built that way.
    """
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def first_rule(lowered: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first rule whose pattern occurs in ``lowered``; a missing text gives the default."""
    chain = None
    for name, pattern in rules:
        hit = lowered.rlike("(?U)" + pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return F.lit(default) if chain is None else chain.otherwise(default)


def first_keyword(lowered: Column, keywords: Sequence[str], default: str) -> Column:
    """First keyword contained in ``lowered``, title-cased; a missing text gives the default."""
    chain = None
    for word in keywords:
        hit = lowered.contains(word)
        chain = F.when(hit, word.title()) if chain is None else chain.when(hit, word.title())
    return F.lit(default) if chain is None else chain.otherwise(default)


def mentions(c: Column, pattern: str) -> Column:
    """True where the pattern occurs; a missing text counts as false."""
    return F.coalesce(c.rlike("(?U)" + pattern), F.lit(False))


def absolute_url(c: Column, base: str) -> Column:
    """Put ``base`` before relative addresses; full addresses stay as they are."""
    return F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit(base), c))


def joined(values: Column, separator: str = ", ", missing: str = "") -> Column:
    """Join a list of strings; NULL members become ``missing`` instead of being dropped."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit(missing))), separator)
