"""Column functions that take page text to parsed JSON.  Bad input gives NULL, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.constants import (COMPANY_PATTERN, FOLLOWER_PATTERN, HYDRATION_PATTERN,
                              SCRIPT_PATTERN, SEARCH_BLOB_PATTERN)

# Characters that count as whitespace at the ends of a script body.
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def let(value: Column, body) -> Column:
    """Bind ``value`` for use in ``body``, so that it is evaluated once however often it occurs."""
    return F.transform(F.array(value), body)[0]


def fenced(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """``keep`` plus computed columns that no later filter can be pushed into.

    Spark moves a filter on a computed column below the projection by repeating the expression.
    For a parsed page that means parsing twice; a one-element generator keeps the filter above.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def first_of(values: Column) -> Column:
    """First element, or NULL for an empty or missing list."""
    return F.try_element_at(values, F.lit(1))


def script_blobs(html: Column) -> Column:
    """All script bodies that look like base64 of a JSON object, in page order."""
    found = F.regexp_extract_all(html, F.lit(SEARCH_BLOB_PATTERN), F.lit(1))
    return F.transform(found, lambda b: F.btrim(b, F.lit(BLANKS)))


def tolerant_base64(encoded: Column) -> Column:
    """Decode base64 to text: foreign characters are skipped and missing padding is allowed.

    Line breaks and missing padding pass the plain decoder, so the slower clean-up runs only on
    text that it refuses.
    """
    decode = lambda b: F.try_to_binary(b, F.lit("base64"))
    cleaned = F.regexp_replace(encoded, "[^A-Za-z0-9+/=]", "")
    return F.try_validate_utf8(F.coalesce(decode(encoded), decode(cleaned)))


def search_payload(html: Column) -> Column:
    """First blob that is a JSON object with the key ``queries``, as VARIANT."""
    parsed = F.transform(script_blobs(html), lambda b: F.try_parse_json(tolerant_base64(b)))
    return first_of(F.filter(
        parsed, lambda p: F.try_variant_get(p, "$.queries", "variant").isNotNull()))


def payload_queries(payload: Column) -> Column:
    return F.try_variant_get(payload, "$.queries", "array<variant>")


def first_with(queries: Column, path: str) -> Column:
    """First query entry in which ``path`` is present (an explicit JSON null counts as present)."""
    return first_of(F.filter(
        queries, lambda q: F.try_variant_get(q, path, "variant").isNotNull()))


def script_bodies(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(SCRIPT_PATTERN), F.lit(1))


def unescape_js(literal: Column) -> Column:
    """Text of a JavaScript string literal, read as a JSON string.

    The two escapes JSON lacks are rewritten first: ``\\xHH`` and ``\\'``.  A match must
    start at an unescaped backslash, so complete pairs before it are kept.  Both are rare, so
    the patterns run only on text that holds such a pair of characters at all.
    """
    def rewrite(text: Column, pair: str, pattern: str, replacement: str) -> Column:
        return F.when(text.contains(pair), F.regexp_replace(text, pattern, replacement)).otherwise(text)

    hex_fixed = rewrite(literal, "\\x", r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2")
    return let(hex_fixed, lambda h: F.from_json(
        F.concat(F.lit('{"x":"'), rewrite(h, "\\'", r"(?<!\\)((?:\\\\)*)\\'", "$1'"), F.lit('"}')),
        "x STRING", {"allowUnquotedControlChars": "true"})["x"])


def hydration_texts(html: Column) -> Column:
    """JSON text of every hydration script of an item page, in page order."""
    literals = F.transform(script_bodies(html),
                           lambda s: F.regexp_extract(s, HYDRATION_PATTERN, 1))
    return F.transform(F.filter(literals, lambda s: s != ""), unescape_js)


def loader_section(json_text: Column) -> Column:
    """Value of the first ``loaderData`` key that starts with ``item``, as VARIANT.

    A MAP keeps the JSON key order, which VARIANT objects do not; a repeated key keeps its first place and its last
    value.
    """
    loader = F.from_json(json_text, "loaderData MAP<STRING, VARIANT>")["loaderData"]
    entries = F.filter(F.map_entries(loader), lambda e: e["key"].startswith("item"))
    return F.transform(F.array(entries), lambda items: F.try_element_at(
        F.filter(items, lambda e: e["key"] == F.get(items, F.lit(0))["key"]), F.lit(-1))["value"])[0]


def follower_count(html: Column) -> Column:
    digits = F.regexp_extract(html, FOLLOWER_PATTERN, 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def company_profile(html: Column) -> Column:
    """Seller profile object inside the company element, as VARIANT; NULL for private sellers."""
    element = F.regexp_extract(html, COMPANY_PATTERN, 1)
    bodies = F.transform(script_bodies(element), lambda s: F.btrim(s, F.lit(BLANKS)))
    objects = F.filter(bodies, lambda s: s.startswith("{"))
    profiles = F.transform(objects, lambda s: F.try_variant_get(
        F.try_parse_json(s), "$.extendedProfileRecommerce", "variant"))
    return first_of(F.filter(profiles, lambda p: F.try_variant_get(
        p, "$", "map<string,variant>").isNotNull() & (F.to_json(p) != "{}")))
