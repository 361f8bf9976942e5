"""Catalogue queries: search, detail, history of a product, lists of retailers, brands and categories."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from . import history as H

SORTS = ("name", "price", "-price", "retailers")


def offer_stats(offers: DataFrame) -> DataFrame:
    """Per product: lowest price in stock, whether that is a sale, offers, retailers. One pass."""
    linked = offers.where("product_id is not null")
    lowest = linked.withColumn("_low", F.min(F.when(F.col("in_stock"), F.col("price_bani"))).over(Window.partitionBy("product_id")))
    sale = F.col("in_stock") & (F.col("price_bani") == F.col("_low")) & (F.col("old_price_bani") > F.col("price_bani"))
    return lowest.groupBy("product_id").agg(
        F.max("_low").alias("lowest_price_bani"), F.count("*").alias("offer_count"), F.count_distinct("retailer_id").alias("retailer_count"), F.bool_or("in_stock").alias("in_stock"), F.coalesce(F.bool_or(sale), F.lit(False)).alias("on_sale")
    )


@dataclass
class Search:
    """What a search may ask for; everything left out doesn't restrict it."""

    q: str | None = None
    brand: str | None = None
    category: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    in_stock: bool = False
    retailers: list[str] = field(default_factory=list)
    common: bool = False
    hide_unlisted: bool = False
    sort: str = "name"
    page: int = 1
    page_size: int | None = None


def search_products(products: DataFrame, brands: DataFrame, offers: DataFrame, retailers: DataFrame, ask: Search) -> DataFrame:
    """Product summaries. Restricting retailers selects products; their figures still span all retailers."""
    if ask.sort not in SORTS:
        raise ValueError(f"sort is one of {SORTS}")
    names = brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand"), F.col("normalized_name").alias("_brand_key"))
    out = products.join(F.broadcast(names), "brand_id", "left")
    for word in T.search_words(ask.q or ""):
        out = out.where(F.contains("normalized_name", F.lit(word)) | F.contains(F.coalesce("_brand_key", F.lit("")), F.lit(word)))
    if ask.brand is not None:
        known = T.aliases().get(T.key_of(ask.brand), ask.brand)
        out = out.where(F.col("_brand_key") == T.key_of(known))
    if ask.category is not None:
        out = out.where(T.fold(F.col("category")) == T.folded(ask.category))
    if ask.retailers:
        wanted = offers.where("product_id is not null").join(F.broadcast(retailers.where(F.col("slug").isin(ask.retailers)).select(F.col("id").alias("retailer_id"))), "retailer_id")
        sellers = wanted.groupBy(F.col("product_id").alias("id")).agg(F.count_distinct("retailer_id").alias("_n"))
        out = out.join(sellers.where(F.col("_n") >= (len(set(ask.retailers)) if ask.common else 1)).select("id"), "id", "left_semi")
    out = out.join(offer_stats(offers).withColumnRenamed("product_id", "id"), "id", "left")
    if ask.common and not ask.retailers:
        out = out.where("retailer_count >= 2")
    if ask.min_price is not None:
        out = out.where(F.col("lowest_price_bani") >= ask.min_price)
    if ask.max_price is not None:
        out = out.where(F.col("lowest_price_bani") <= ask.max_price)
    if ask.in_stock:
        out = out.where("lowest_price_bani is not null")
    if ask.hide_unlisted:
        out = out.where("offer_count is not null")
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    out = out.select(
        "id", "name", "brand", F.col("size_value").cast("double").alias("size_value"), "size_unit", "category", "lowest_price_bani", F.coalesce("offer_count", zero).alias("offer_count"),
        F.coalesce("retailer_count", zero).alias("retailer_count"), F.coalesce("in_stock", no).alias("in_stock"), F.coalesce("on_sale", no).alias("on_sale"),
    )
    if ask.page_size is None:
        return out
    return out.orderBy(*_order(ask.sort), "id").offset((ask.page - 1) * ask.page_size).limit(ask.page_size)


def _order(sort: str) -> list[Column]:
    if sort == "name":
        return [T.fold(F.col("name"))]
    if sort == "retailers":
        return [F.desc("retailer_count")]
    price = F.col("lowest_price_bani")
    return [price.isNull(), price.desc() if sort == "-price" else price.asc()]


def page_count(found: DataFrame, size: int) -> DataFrame:
    return found.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).alias("pages"))


def product_detail(offers: DataFrame, shops: DataFrame, product_ids: list[int]) -> DataFrame:
    """Offers of products, cheapest in stock first; all offers at the lowest price in stock are marked."""
    mine = offers.where(F.col("product_id").isin(product_ids))
    low = F.min(F.when(F.col("in_stock"), F.col("price_bani"))).over(Window.partitionBy("product_id"))
    named = mine.join(F.broadcast(shops.select(F.col("id").alias("retailer_id"), "slug")), "retailer_id")
    out = named.withColumn("is_cheapest", F.coalesce(F.col("in_stock") & (F.col("price_bani") == low), F.lit(False)))
    return out.select("product_id", F.col("id").alias("offer_id"), "slug", "price_bani", "old_price_bani", "in_stock", "is_cheapest", "last_seen_at").orderBy("product_id", ~F.col("in_stock"), "price_bani", "offer_id")


def product_history(history: DataFrame, shops: DataFrame, listings: list[int], as_of: Column, days: int | None = None) -> DataFrame:
    """Steps of the listings, of the last `days` with the one in effect when they began; series by retailer, points by time."""
    mine = history.where(F.col("listing").isin(listings))
    if days is not None:
        mine = H.window_from(mine, as_of - F.make_dt_interval(F.lit(days)))
    return mine.join(F.broadcast(shops.select(F.col("id").alias("retailer_id"), "slug")), "retailer_id").select("slug", "listing", "seen_at", "price_bani", "in_stock").orderBy("slug", "listing", "seen_at")


def list_retailers(retailers: DataFrame, offers: DataFrame, active: bool | None = None) -> DataFrame:
    stats = offers.groupBy(F.col("retailer_id").alias("id")).agg(F.count("*").alias("offer_count"), F.count_distinct("product_id").alias("product_count"), F.max("last_seen_at").alias("last_seen_at"))
    some = retailers if active is None else retailers.where(F.col("is_active") == active)
    zero = F.lit(0).cast("bigint")
    return some.join(stats, "id", "left").select("id", "slug", "name", "is_active", F.coalesce("offer_count", zero).alias("offer_count"), F.coalesce("product_count", zero).alias("product_count"), "last_seen_at").orderBy(F.lower("name"), "id")


def list_brands(brands: DataFrame, products: DataFrame, offers: DataFrame, q: str | None = None, hide_unlisted: bool = False) -> DataFrame:
    """Brands with how many products they have, or with those that are offered only."""
    linked = offers.where("product_id is not null").select(F.col("product_id").alias("id"))
    counted = products.join(linked, "id", "left_semi") if hide_unlisted else products
    counts = counted.groupBy("brand_id").agg(F.count("*").alias("product_count"))
    some = reduce(lambda x, w: x.where(F.contains("normalized_name", F.lit(w))), T.search_words(q or ""), brands)
    out = some.join(counts.withColumnRenamed("brand_id", "id"), "id", "inner" if hide_unlisted else "left")
    return out.select("id", "name", "normalized_name", F.coalesce("product_count", F.lit(0).cast("bigint")).alias("product_count")).orderBy("normalized_name", "id")


def list_categories(products: DataFrame, offers: DataFrame, hide_unlisted: bool = False) -> DataFrame:
    """Categories in the order they are shown, unknown ones last by name."""
    some = products.join(offers.where("product_id is not null").select(F.col("product_id").alias("id")), "id", "left_semi") if hide_unlisted else products
    known = F.create_map(*(F.lit(x) for i, c in enumerate(rules.CATEGORIES) for x in (c, i)))
    place = F.coalesce(F.try_element_at(known, F.col("category")), F.lit(len(rules.CATEGORIES)))
    return some.where("category is not null").groupBy("category").agg(F.count("*").alias("product_count")).withColumn("position", place).orderBy("position", F.lower("category"))


def brand_names(brands: DataFrame) -> DataFrame:
    return brands.select("name").distinct().orderBy("name")


def freshness(offers: DataFrame) -> DataFrame:
    return offers.agg(F.max("last_seen_at").alias("last_seen_at"), F.count("*").alias("offers"))
