"""Item pages to one wide row per ad.  No stage shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.payload import (company_profile, fenced, first_of, follower_count,
                                      hydration_texts, let, loader_section)
from adlens.operators.search_pages import list_size, open_fields
from adlens.schemas import COMPANY_PROFILE, ITEM_SECTION


def parse_item_pages(pages: DataFrame) -> DataFrame:
    """Add ``section`` (typed item data), ``raw`` (VARIANT), ``followers``, ``company``, ``parse_error``."""
    found = fenced(pages, pages.columns, _found=let(hydration_texts(F.col("html")), lambda t: F.struct(
        F.size(t).alias("n"),
        first_of(F.filter(F.transform(t, loader_section), lambda s: s.isNotNull())).alias("raw"))))
    return found.select("*", F.col("_found.raw").alias("raw")).select(
        *pages.columns, "raw",
        F.try_variant_get("raw", "$", ITEM_SECTION).alias("section"),
        follower_count(F.col("html")).alias("followers"),
        F.try_variant_get(company_profile(F.col("html")), "$", COMPANY_PROFILE).alias("company"),
        F.when(F.col("_found.n") == 0, "no hydration data")
        .when(F.col("raw").isNull(), "no item section").alias("parse_error"))


def item_extras(extras: Column) -> Column:
    """``extra_<id> -> value`` and ``extra_<id>_id -> valueId``; the last repeat of an id wins."""
    def entries(e: Column) -> Column:
        name = F.concat(F.lit("extra_"), e["id"])
        value = F.struct(name.alias("k"), e["value"].alias("v"))
        ident = F.struct(F.concat(name, F.lit("_id")).alias("k"), e["valueId"].alias("v"))
        return F.when(e["valueId"].isNull(), F.array(value)).otherwise(F.array(value, ident))

    valid = F.filter(F.coalesce(extras, F.array()), lambda e: F.coalesce(e["id"], F.lit("")) != "")
    return let(F.flatten(F.transform(valid, entries)), lambda pairs: let(
        F.array_distinct(F.transform(pairs, lambda p: p["k"])),
        lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(
            F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))))


def category_columns(category: Column) -> dict[str, Column]:
    parent = category["parent"]
    top = parent["parent"]
    return {"category": category["value"], "category_id": category["id"],
            "sub_category": parent["value"], "sub_category_id": parent["id"],
            "top_category": top["value"], "top_category_id": top["id"]}


def image_columns(images: Column) -> dict[str, Column]:
    uris = F.coalesce(F.transform(images, lambda i: i["uri"]), F.array().cast("array<string>"))
    return {"num_images": list_size(images), "image_url": first_of(uris), "image_urls": uris}


def location_columns(location: Column) -> dict[str, Column]:
    at = location["position"]
    return {"latitude": at["lat"], "longitude": at["lng"], "coord_accuracy": at["accuracy"],
            "postal_code": location["postalCode"], "postal_name": location["postalName"],
            "country_code": location["countryCode"]}


def prefixed_fields(df: DataFrame, source: str, prefix: str) -> dict[str, Column]:
    """One column per field of the struct column ``source``, named ``<prefix><field>``."""
    dtype = df.select(source).schema[0].dataType
    if not isinstance(dtype, T.StructType):
        raise TypeError(f"{source} is not a struct")
    return {f"{prefix}{f.name}": F.col(f"{source}.{f.name}") for f in dtype}


def remaining_fields(df: DataFrame, source: str, raw: Column, path: str) -> Column:
    """Fields of the object at ``path`` that the struct column ``source`` does not declare, as name -> JSON text."""
    known = [f.name for f in df.select(source).schema[0].dataType]
    return open_fields(F.try_variant_get(raw, path, "variant"), known)


def seller_columns(section: Column, followers: Column, company: Column) -> dict[str, Column]:
    contact = first_of(company["contacts"])
    return {"canonical_url": F.nullif(section["meta"]["canonical"], F.lit("")),
            "follower_count": followers,
            "seller_org_name": company["orgName"], "seller_org_id": company["orgId"],
            "seller_logo_url": company["logo"], "seller_homepage_url": company["homepageUrl"],
            "seller_more_ads_url": company["moreAdsFromThisCompanyUrl"],
            "seller_contact_name": contact["name"], "seller_contact_phone": contact["phone"]}


def flatten_items(parsed: DataFrame, keep: Sequence[str] = ("ad_id",),
                  include_raw: bool = False) -> DataFrame:
    """Parsed item pages to the wide item table."""
    item = F.col("section")["itemData"]
    columns = {c: F.col(c) for c in keep}
    columns |= {"title": item["title"], "description": item["description"],
                "price": F.nanvl(item["price"], F.lit(None)),
                "extras": item_extras(item["extras"])}
    columns |= category_columns(item["category"]) | image_columns(item["images"])
    columns |= location_columns(item["location"])
    columns |= prefixed_fields(parsed, "section.itemData.meta", "meta_")
    columns |= prefixed_fields(parsed, "section.transactableData", "txn_")
    columns |= {"meta_rest": remaining_fields(parsed, "section.itemData.meta", F.col("raw"), "$.itemData.meta"),
                "txn_rest": remaining_fields(parsed, "section.transactableData", F.col("raw"), "$.transactableData")}
    columns |= seller_columns(F.col("section"), F.col("followers"), F.col("company"))
    if include_raw:
        columns["raw"] = F.col("raw")
    return parsed.select(*[c.alias(n) for n, c in columns.items()])


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and rows that did not with the reason in ``parse_error``."""
    return (parsed.where(F.col("parse_error").isNull()),
            parsed.where(F.col("parse_error").isNotNull()))


def get_items(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Item rows of the wanted ad ids (all pages if none are given); unreadable pages are skipped."""
    chosen = pages if wanted is None else pages.join(wanted, "ad_id", "left_semi")
    return flatten_items(split_quarantine(parse_item_pages(chosen))[0])
