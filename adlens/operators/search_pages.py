"""Search pages to listing rows.

Stages: landed pages -> ``parse_pages`` (one row per page, JSON parsed once) ->
``explode_listings`` (one row per ad) -> ``flatten_listings`` (the listing table).
No stage shuffles; everything a row needs is on the page it came from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.constants import FLAG_BUY_NOW, FLAG_PRIVATE, FLAG_RETAILER, FLAG_SHIPPING
from adlens.functions.payload import fenced, first_with, let, payload_queries, search_payload
from adlens.functions.text import absolute_url, joined
from adlens.operators.ingest import keep_first
from adlens.schemas import PAGE_METADATA, SEARCH_DOC


def parse_pages(pages: DataFrame) -> DataFrame:
    """Add ``docs`` (list of VARIANT), ``promoted`` (VARIANT), ``metadata`` and ``parse_error``."""
    entry = "$.state.data.result.searchEntry"
    found = fenced(pages, pages.columns, _found=let(
        payload_queries(search_payload(F.col("html"))), lambda q: F.struct(
            q.isNull().alias("lost"),
            F.try_variant_get(first_with(q, "$.state.data.docs"), "$.state.data", "variant").alias("data"),
            F.try_variant_get(first_with(q, entry), entry, "variant").alias("promoted"))))
    data = F.col("_found.data")
    return found.select(
        *pages.columns,
        F.try_variant_get(data, "$.docs", "array<variant>").alias("docs"),
        F.col("_found.promoted").alias("promoted"),
        F.try_variant_get(data, "$.metadata", PAGE_METADATA).alias("metadata"),
        F.when(F.col("_found.lost"), "no payload").when(data.isNull(), "no docs").alias("parse_error"))


def explode_listings(parsed: DataFrame, keep: Sequence[str] = (), include_raw: bool = False) -> DataFrame:
    """One row per ad in page order: the promoted entry first, then every object in ``docs``.

    Columns: ``keep``, ``metadata``, ``pos``, ``is_promoted``, ``doc`` (struct) and, if asked for,
    ``raw`` (VARIANT).  Documents are typed inside the page row: a filter on a parsed column
    below the explode would make Spark parse the page twice.
    """
    def entry(variant: Column, promoted: bool) -> Column:
        fields = [F.lit(promoted).alias("is_promoted"),
                  F.try_variant_get(variant, "$", SEARCH_DOC).alias("doc")]
        return F.struct(*fields, *([variant.alias("raw")] if include_raw else []))

    usable = F.col("parse_error").isNull()
    top = F.when(usable & F.col("promoted").isNotNull() & (F.to_json("promoted") != "{}"),
                 F.array(entry(F.col("promoted"), True)))
    organic = F.when(usable, F.transform("docs", lambda d: entry(d, False)))
    entries = F.concat(F.coalesce(top, F.array()), F.coalesce(organic, F.array()))
    rows = parsed.select(*keep, "metadata", F.posexplode(entries).alias("pos", "entry"))
    return (rows.select(*keep, "metadata", "pos", "entry.*")
            .where(F.col("doc").isNotNull()))


def flatten_struct(df: DataFrame, separator: str = "_") -> DataFrame:
    """Turn nested structs into ``a_b`` columns; lists and maps stay as they are."""
    def walk(prefix: str, name: str, dtype: T.DataType):
        if isinstance(dtype, T.StructType):
            for f in dtype:
                yield from walk(f"{prefix}.`{f.name}`", f"{name}{separator}{f.name}", f.dataType)
        else:
            yield F.col(prefix).alias(name)
    return df.select(*[c for f in df.schema for c in walk(f"`{f.name}`", f.name, f.dataType)])


def extras_map(extras: Column) -> Column:
    """``id -> joined values``; entries without id or values are skipped, the last repeat wins."""
    valid = F.filter(extras, lambda e: (F.coalesce(e["id"], F.lit("")) != "")
                     & (F.coalesce(F.size(e["values"]), F.lit(0)) > 0))
    return let(valid, lambda entries: let(
        F.array_distinct(F.transform(entries, lambda e: e["id"])),
        lambda ids: F.map_from_arrays(ids, F.transform(ids, lambda k: joined(F.element_at(
            F.filter(entries, lambda e: e["id"] == k), -1)["values"], missing="None")))))


def extras_columns(df: DataFrame, keys: Sequence[str], source: str = "extras") -> DataFrame:
    """Wide form: one ``extra_<key>`` column per listed key."""
    return df.select("*", *[F.col(source).getItem(k).alias(f"extra_{k}") for k in keys])


def flag_columns(flags: Column) -> dict[str, Column]:
    known = F.coalesce(flags, F.array().cast("array<string>"))
    return {
        "is_private": F.array_contains(known, FLAG_PRIVATE),
        "is_retailer": F.array_contains(known, FLAG_RETAILER),
        "has_shipping": F.array_contains(known, FLAG_SHIPPING),
        "has_buy_now": F.array_contains(known, FLAG_BUY_NOW),
        "flags": F.nullif(F.array_join(known, ", "), F.lit("")),
    }


def label_columns(labels: Column) -> dict[str, Column]:
    return {
        "label_ids": joined(F.transform(labels, lambda e: e["id"])),
        "label_texts": joined(F.transform(labels, lambda e: e["text"])),
    }


def list_size(values: Column) -> Column:
    """Length of a list, 0 when it is missing."""
    return F.when(values.isNull(), 0).otherwise(F.size(values))


def epoch_ms_timestamp(ms: Column) -> Column:
    """Timestamp from epoch milliseconds; anything else gives NULL."""
    return F.timestamp_millis(ms.try_cast("bigint"))


def page_columns(metadata: Column) -> dict[str, Column]:
    return {
        "page_current": metadata["paging"]["current"],
        "page_last": metadata["paging"]["last"],
        "total_match_count": metadata["result_size"]["match_count"],
        "total_group_count": metadata["result_size"]["group_count"],
        "search_query": F.try_element_at(metadata["params"]["q"], F.lit(1)),
    }


def flatten_listings(rows: DataFrame, keep: Sequence[str] = (), include_raw: bool = False) -> DataFrame:
    """Rows of ``explode_listings`` to the flat listing table."""
    doc = F.col("doc")
    columns = {c: F.col(c) for c in keep}
    columns |= {
        "ad_id": F.coalesce(doc["ad_id"], doc["id"]),
        "heading": doc["heading"], "canonical_url": doc["canonical_url"],
        "location": doc["location"], "trade_type": doc["trade_type"], "type": doc["type"],
        "brand": doc["brand"], "organisation_name": doc["organisation_name"],
        "price_amount": F.nanvl(doc["price"]["amount"], F.lit(None)),
        "price_currency_code": doc["price"]["currency_code"],
        "price_price_unit": doc["price"]["price_unit"],
        "coordinates_lat": doc["coordinates"]["lat"],
        "coordinates_lon": doc["coordinates"]["lon"],
        "coordinates_accuracy": doc["coordinates"]["accuracy"],
        "distance": doc["distance"],
        "image_urls": doc["image_urls"], "num_images": list_size(doc["image_urls"]),
        "timestamp": doc["timestamp"].try_cast("bigint"),
        "timestamp_dt": epoch_ms_timestamp(doc["timestamp"]),
        "extras": extras_map(doc["extras"]),
        "is_promoted": F.col("is_promoted"), "pos": F.col("pos"),
    }
    columns |= flag_columns(doc["flags"]) | label_columns(doc["labels"])
    columns |= page_columns(F.col("metadata"))
    if include_raw:
        columns["raw"] = F.col("raw")
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def parse_search_pages(pages: DataFrame, keep: Sequence[str] = (), include_raw: bool = False) -> DataFrame:
    """Landed pages to listing rows, promoted and organic, in page order."""
    rows = explode_listings(parse_pages(pages), keep, include_raw)
    return flatten_listings(rows, keep, include_raw)


def unreadable_pages(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The pages that gave no listing document, with the reason and the size of what was landed.

    ``collect_listings`` has no row for them; a caller that must account for every page reads this beside it.
    """
    return parsed.where(F.col("parse_error").isNotNull()).select(
        *keep, "parse_error", F.coalesce(F.length("html"), F.lit(0)).alias("html_chars"))


def open_fields(raw: Column, known: Sequence[str]) -> Column:
    """Fields of an object beyond the ``known`` ones, as name -> JSON text."""
    fields = F.try_variant_get(raw, "$", "map<string,variant>")
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*known))
    return F.transform_values(rest, lambda k, v: F.to_json(v))


def collect_listings(pages: DataFrame, query: str | None = None, max_pages: int | None = None,
                     include_raw: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """All listings of a query (or of every query), one row per ad: its first sighting.

    ``pages`` carries ``search_query``, ``range_no`` and ``page``; both filters reach the scan.  ``columns`` names what
    is wanted besides ``ad_id``: only that is shuffled.
    """
    chosen = pages
    if query is not None:
        chosen = chosen.where(F.col("search_query") == query)
    if max_pages is not None:
        chosen = chosen.where(F.col("page") <= max_pages)
    chosen = chosen.withColumnsRenamed({"search_query": "_query", "range_no": "_range", "page": "_page"})
    keep = ["_query", "_range", "_page"]
    rows = parse_search_pages(chosen, keep, include_raw)
    return keep_first(rows, ["ad_id"], F.struct(*keep, "pos"), columns).drop(*keep, "pos")


def page_summary(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per page: total matches, page, last page, whether it is the end, number of organic rows."""
    m = F.col("metadata")
    return parsed.select(
        *keep, m["result_size"]["match_count"].alias("total_matches"),
        m["paging"]["current"].alias("page_current"), m["paging"]["last"].alias("last_page"),
        F.coalesce(m["is_end_of_paging"],
                   m["paging"]["current"] >= m["paging"]["last"]).alias("is_end"),
        list_size(F.col("docs")).alias("n_rows"))


def largest_price(docs: Column) -> Column:
    """The largest price in a list of documents; NULL if none has one."""
    amounts = F.transform(docs, lambda d: F.try_variant_get(d, "$.price.amount", "double"))
    return F.array_max(F.filter(amounts, lambda a: a.isNotNull() & ~F.isnan(a)))


def page_price_max(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per page with rows: the largest price among its organic rows, found inside the row."""
    return (parsed.where(list_size(F.col("docs")) > 0)
            .select(*keep, largest_price(F.col("docs")).alias("page_max")))


def listing_cards(listings: DataFrame, base: str, id_column: str = "ad_id",
                  title_column: str = "heading") -> DataFrame:
    """Display form of a listing: text id, absolute address, price text, first image, UTC time."""
    amount = F.col("price_amount")
    # Through a decimal: a double of ten million and more would be shown with an exponent.
    exact = F.rtrim(amount.cast("decimal(30,8)").cast("string"), F.lit("0"))
    number = F.when(amount == F.floor(amount), F.floor(amount).cast("string")).otherwise(exact)
    return listings.select(
        F.col(id_column).cast("string").alias("id"), F.col(title_column).alias("title"),
        absolute_url(F.col("canonical_url"), base).alias("url"), "location",
        F.when(amount.isNull(), "N/A").otherwise(
            F.concat_ws(" ", number, "price_currency_code")).alias("price_display"),
        F.try_element_at("image_urls", F.lit(1)).alias("image_url"),
        F.col("timestamp_dt").alias("timestamp"))
